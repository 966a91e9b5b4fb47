"""Registered queries of the signal operators over the driver's tables, with their SQL.

``events`` give one series a user, read in chunks of 64 samples, ``embeddings`` one frame of 8 channels
by 8 instants a vector. Arrays leave as comma-separated text, those of a series chunk by chunk. The
SQL writes coefficients and constants out, so that it shares none with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import artifact, calibrate, chunks, classify, dsp, features, filters, rate, spatial, spectral, windows
from .plans.decision import decide_epochs
from .sources import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def of(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return of


# --- inputs --------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, halo: int = 0, offset: int = 50000) -> DataFrame:
    """Chunks by user_id of a user's values in thousandths, less an offset that gives them signs."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.floor(F.col("value") * 1000).cast("int") - offset).alias("v"))
    return chunks.chunked(rows, ["user_id"], ["ts", "event_id"], "v", halo)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, samples: 8 instants of 8 channels, in millionths."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("samples"))


def text(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda v: v.cast("string")), ",")


def sql_series(offset: int = 50000) -> str:
    return f"ser AS (SELECT user_id, list(CAST(floor(value * 1000) AS BIGINT) - {offset} ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


SQL_BLOCKS = "blk AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1000000) AS BIGINT)) AS s FROM embeddings)"
SQL_LONG = "lng AS (SELECT vec_id, label, (i - 1) // 8 AS t, (i - 1) % 8 AS c, s[i] AS x FROM blk, unnest(range(1, 65)) AS u(i))"
#: A series' samples as rows, and a list as text.
SQL_ROWS = "pts AS (SELECT user_id, i - 1 AS t, x[i] AS x, len(x) AS n FROM ser, unnest(range(1, len(x) + 1)) AS u(i))"


SQL_CHUNK = "CAST(t // 64 AS INTEGER) AS chunk"


def sql_sat(e: str) -> str:
    return f"greatest(least({e}, 2147483647), -2147483648)"


def sql_text(value: str, order: str) -> str:
    return f"string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {order})"


# --- frames and masks ----------------------------------------------------------------------------


@register(f"""
WITH {SQL_BLOCKS}, f AS (SELECT *, vec_id % 256 AS mask, CAST(bit_count(CAST(vec_id % 256 AS INTEGER)) AS INTEGER) AS n FROM blk),
g AS (SELECT *, CASE WHEN n = 0 THEN 'EmptyChannelMask' WHEN 64 % n <> 0 THEN 'SampleLengthMismatch' END AS error FROM f)
SELECT vec_id AS seq, vec_id * 32000 AS timestamp_us, CAST(mask AS INTEGER) AS channel_mask, error,
  CASE WHEN error IS NULL THEN CAST(64 // n AS INTEGER) END AS samples_per_channel,
  CASE WHEN error IS NULL AND n > 2 THEN CAST(s[1 * n + 2 + 1] AS INTEGER) END AS sample_1_2 FROM g""")
def frame_header(spark, sf_dir):
    df = blocks(spark, sf_dir).select(F.col("vec_id").alias("seq"), (F.col("vec_id") * 32000).alias("timestamp_us"), (F.col("vec_id") % 256).cast("int").alias("channel_mask"), "samples")
    n = frames.enabled_count(F.col("channel_mask"))
    out = frames.validate_frames(df)
    at = F.when(F.col("error").isNull(), frames.sample_at(F.col("samples"), n, F.lit(1), F.lit(2)))
    return out.select("seq", "timestamp_us", "channel_mask", "error", "samples_per_channel", at.alias("sample_1_2"))


@register("""
WITH m AS (SELECT vec_id, CAST((vec_id * 37) % 65536 AS INTEGER) AS mask, CAST(vec_id % 18 AS INTEGER) AS ch, CAST(vec_id % 5 AS INTEGER) AS col FROM embeddings),
e AS (SELECT *, ch < 16 AND (mask >> least(ch, 31)) & 1 = 1 AS enabled FROM m)
SELECT vec_id, CAST(CASE WHEN ch <= 0 THEN 0 WHEN ch >= 16 THEN 65535 ELSE (1 << least(ch, 16)) - 1 END AS INTEGER) AS first_n, CAST(bit_count(mask) AS INTEGER) AS enabled_count, enabled,
  CASE WHEN enabled THEN CAST(bit_count(mask & ((1 << least(ch, 16)) - 1)) AS INTEGER) END AS column_of,
  CAST(list_filter(range(16), lambda c: (mask >> CAST(c AS INTEGER)) & 1 = 1)[col + 1] AS INTEGER) AS channel_at FROM e""")
def mask_columns(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") * 37) % 65536).cast("int").alias("mask"), (F.col("vec_id") % 18).cast("int").alias("ch"), (F.col("vec_id") % 5).cast("int").alias("col"))
    mask, ch = F.col("mask"), F.col("ch")
    return m.select(
        "vec_id", frames.first_n(ch).cast("int").alias("first_n"), frames.enabled_count(mask).alias("enabled_count"), frames.is_enabled(mask, ch).alias("enabled"), frames.column_of(mask, ch).alias("column_of"), frames.channel_at(mask, F.col("col")).alias("channel_at")
    )


def sql_bytes(value: str, width: int) -> str:
    return f"list_transform(range({width}), lambda k: CAST((CASE WHEN {value} < 0 THEN {value} + {1 << (8 * width)}::HUGEINT ELSE {value} END >> CAST(8 * k AS INTEGER)) & 255 AS HUGEINT))"


def sql_fnv(data: str) -> str:
    return f"list_reduce({data}, lambda h, b: ((h - h % 256 + xor(h % 256, b)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"


def sql_hex(h: str) -> str:
    return f"'0x' || lpad(lower(to_hex(CAST({h} AS UBIGINT))), 16, '0')"


@register(f"""
WITH {SQL_BLOCKS}, b AS (SELECT vec_id, list_concat(
  {sql_bytes('CAST(vec_id AS HUGEINT)', 4)}, {sql_bytes('CAST(vec_id * 32000 AS HUGEINT)', 8)}, {sql_bytes('250::HUGEINT', 4)}, {sql_bytes('255::HUGEINT', 2)}, {sql_bytes('8::HUGEINT', 4)},
  flatten(list_transform(s, lambda v: {sql_bytes('CAST(v AS HUGEINT)', 4)}))) AS d FROM blk)
SELECT vec_id, {sql_hex(sql_fnv('d'))} AS checksum FROM b""")
def frame_checksum(spark, sf_dir):
    df = blocks(spark, sf_dir)
    h = frames.checksum(F.col("vec_id"), F.col("vec_id") * 32000, F.lit(250), F.lit(255), F.lit(8), F.col("samples"))
    return df.select("vec_id", fixed.hex64(h).alias("checksum"))


@register(f"""
SELECT event_id, {sql_hex(sql_fnv("list_transform(range(1, strlen(event_type) + 1), lambda i: CAST(ascii(substr(event_type, CAST(i AS INTEGER), 1)) AS HUGEINT))"))} AS digest FROM events""")
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fixed.hex64(fixed.fnv1a64(fixed.text_bytes(F.col("event_type")))).alias("digest"))


@register(f"WITH {SQL_BLOCKS}, {SQL_LONG} SELECT vec_id, CAST(c AS INTEGER) AS col, CAST(c AS INTEGER) AS channel, {sql_text('x', 't')} AS x FROM lng GROUP BY vec_id, c")
def deinterleave(spark, sf_dir):
    df = frames.to_series(blocks(spark, sf_dir).withColumn("channel_mask", F.lit(255)), ["vec_id"])
    return df.select("vec_id", "col", "channel", text(F.col("x")).alias("x"))


@register("""SELECT vec_id, vec_id * 32000 AS timestamp_us, CAST(250 AS BIGINT) AS rate_hz, CAST(255 AS INTEGER) AS channel_mask, CAST(8 AS INTEGER) AS samples_per_channel, '<redacted>' AS samples FROM embeddings""")
def frame_redacted(spark, sf_dir):
    df = blocks(spark, sf_dir).select(F.col("vec_id").alias("seq"), (F.col("vec_id") * 32000).alias("timestamp_us"), F.lit(250).cast("long").alias("rate_hz"), F.lit(255).alias("channel_mask"), "samples")
    return frames.describe(df).withColumnRenamed("seq", "vec_id")


# --- windows and rate ----------------------------------------------------------------------------


def _epochs(name: str, window: int, hop: int) -> None:
    sql = f"""WITH {sql_series()}, k AS (SELECT user_id, x, unnest(range(CASE WHEN len(x) >= {window} THEN (len(x) - {window}) // {hop} + 1 ELSE 0 END)) AS k FROM ser)
SELECT user_id, CAST(k AS INTEGER) AS epoch_index, CAST(k * {hop} AS INTEGER) AS start_t, CAST(list_sum(x[k * {hop} + 1 : k * {hop} + {window}]) AS BIGINT) AS total, x[k * {hop} + {window}] AS last FROM k"""

    @register(sql, name)
    def run(spark, sf_dir):
        e = chunks.epochs(series(spark, sf_dir, window - 1), ["user_id"], window, hop)
        return e.select("user_id", "epoch_index", "start_t", fixed.total(fixed.longs(F.col("x"))).alias("total"), F.get("x", F.lit(window - 1)).cast("long").alias("last"))


_epochs("epochs_tumbling", 16, 16)
_epochs("epochs_sliding", 16, 6)
_epochs("epochs_gapped", 9, 20)


@register("SELECT user_id, CAST(count(*) AS INTEGER) AS n, 'WindowTooLarge' AS error FROM events GROUP BY user_id HAVING count(*) < 65")
def epochs_refused(spark, sf_dir):
    return chunks.refused(table(spark, sf_dir, "events"), ["user_id"], 65, 8)


@register("""WITH r AS (SELECT event_id, CAST(event_id % 5 * 250 AS BIGINT) AS hz FROM events) SELECT event_id, CASE WHEN hz > 0 THEN hz END AS rate_hz FROM r""")
def sample_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rate.valid_rate((F.col("event_id") % 5 * 250).cast("long")).alias("rate_hz"))


@register(f"""WITH {SQL_BLOCKS}, e AS (SELECT vec_id, CAST(vec_id % 10 AS INTEGER) AS n, s[1 : CAST(vec_id % 66 AS INTEGER)] AS s FROM blk)
SELECT vec_id, CASE WHEN len(s) = 0 THEN 'EmptyInput' END AS series_error,
  CASE WHEN len(s) = 0 OR len(s) % 8 <> 0 THEN 'SampleLengthMismatch' END AS block_error,
  CASE WHEN len(s) = 0 OR len(s) % 8 <> 0 THEN 'SampleLengthMismatch' WHEN len(s) < 24 THEN 'WindowTooLarge' END AS baseline_error,
  CASE WHEN len(s) = 0 OR len(s) % 8 <> 0 THEN 'SampleLengthMismatch' WHEN len(s) > 48 THEN 'WindowTooLarge' END AS screen_error FROM e""")
def refusals(spark, sf_dir):
    s = F.slice("samples", F.lit(1), (F.col("vec_id") % 66).cast("int"))
    df = blocks(spark, sf_dir).select("vec_id", s.alias("s"))
    return df.select("vec_id", dsp.input_error(F.col("s")).alias("series_error"), rate.decimate_error(F.col("s"), 8).alias("block_error"), spatial.baseline_error(F.col("s"), 8, 3).alias("baseline_error"), artifact.block_screen_error(F.col("s"), 8, 6).alias("screen_error"))


@register("""WITH w AS (SELECT event_id, event_id % 60 AS n, event_id % 13 AS w, event_id % 7 AS h FROM events)
SELECT event_id, CASE WHEN w = 0 OR h = 0 THEN 'InvalidWindow' WHEN w > n THEN 'WindowTooLarge' END AS error,
  CASE WHEN w > 0 AND h > 0 AND w <= n THEN CAST((n - w) // h + 1 AS INTEGER) END AS windows FROM w""")
def window_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", *((F.col("event_id") % m).cast("int").alias(c) for c, m in (("n", 60), ("w", 13), ("h", 7))))
    args = F.col("n"), F.col("w"), F.col("h")
    return e.select("event_id", windows.window_error(*args).alias("error"), windows.window_count(*args).alias("windows"))


@register(f"""WITH {SQL_BLOCKS}, {SQL_LONG} SELECT vec_id, {sql_text('x', 't, c')} AS kept, CAST(3 AS INTEGER) AS n_frames FROM lng WHERE t % 3 = 0 GROUP BY vec_id""")
def decimate(spark, sf_dir):
    return blocks(spark, sf_dir).select("vec_id", text(rate.decimate_unfiltered(F.col("samples"), 8, 3)).alias("kept"), rate.decimated_frames(F.lit(8), F.lit(3)).alias("n_frames"))


@register(f"WITH {sql_series()}, {SQL_ROWS} SELECT user_id, {SQL_CHUNK}, {sql_text('x', 't')} AS kept FROM pts WHERE t % 3 = 0 GROUP BY user_id, t // 64")
def decimate_checked(spark, sf_dir):
    kept = chunks.decimate(series(spark, sf_dir), 3, 250, 40_000).filter(F.size("kept") > 0)
    return kept.select("user_id", "chunk", text(F.col("kept")).alias("kept"))


# --- stateless conditioning ----------------------------------------------------------------------


@register(f"""WITH {sql_series()}, {SQL_ROWS}, m AS (SELECT *, CAST(sum(x) OVER (PARTITION BY user_id) AS BIGINT) // n AS mean FROM pts)
SELECT user_id, {SQL_CHUNK}, any_value(mean) AS mean, {sql_text('x - mean', 't')} AS y FROM m GROUP BY user_id, t // 64""")
def remove_mean(spark, sf_dir):
    return chunks.remove_mean(series(spark, sf_dir), ["user_id"]).select("user_id", "chunk", "mean", text(F.col("y")).alias("y"))


def _fir(name: str, coeffs: list[int], shift: int) -> None:
    acc = " + ".join(f"{c} * coalesce(lag(x, {k}) OVER w, 0)" if k else f"{c} * x" for k, c in enumerate(coeffs))
    value = f"({acc} + {1 << (shift - 1)}) >> {shift}" if shift else acc
    sql = f"""WITH {sql_series()}, {SQL_ROWS}, f AS (SELECT user_id, t, {sql_sat(value)} AS y FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, {SQL_CHUNK}, {sql_text('y', 't')} AS y FROM f GROUP BY user_id, t // 64"""

    @register(sql, name)
    def run(spark, sf_dir):
        return chunks.fir(series(spark, sf_dir, len(coeffs) - 1), coeffs, shift).select("user_id", "chunk", text(F.col("y")).alias("y"))


_fir("fir_ma4", [1, 1, 1, 1], 2)
_fir("fir_signed", [3, -5, 2], 1)
_fir("fir_unshifted", [20000, -7], 0)


# --- recursive filters ---------------------------------------------------------------------------


def sql_biquad(c: tuple[int, ...], x: str = "x") -> str:
    """The states of a biquad after every sample, the zero state first, by one fold."""
    b0, b1, b2, a1, a2 = c
    y = sql_sat(f"({b0} * v + {b1} * a[len(a)].x1 + {b2} * a[len(a)].x2 - {a1} * a[len(a)].y1 - {a2} * a[len(a)].y2 + 16384) >> 15").replace("v +", "v.x1 +", 1)
    items = f"list_transform({x}, lambda v: [{{'x1': v, 'x2': 0::BIGINT, 'y1': 0::BIGINT, 'y2': 0::BIGINT}}])"
    zero = "[{'x1': 0::BIGINT, 'x2': 0::BIGINT, 'y1': 0::BIGINT, 'y2': 0::BIGINT}]"
    step = f"list_append(a, {{'x1': w[1].x1, 'x2': a[len(a)].x1, 'y1': CAST({y.replace('v.x1', 'w[1].x1')} AS BIGINT), 'y2': a[len(a)].y1}})"
    return f"list_reduce({items}, lambda a, w: {step}, {zero})"


def sql_states(fold: str, coeffs: tuple[int, ...], state: tuple[str, ...]) -> str:
    """A row for each chunk, from the states of a fold: its outputs, and the digest of coefficients and state after it."""
    hashed = " , ".join([*(f"({c})::HUGEINT" for c in coeffs), *(f"CAST(z9.{k} AS HUGEINT)" for k in state)])
    data = f"flatten(list_transform([{hashed}], lambda z: {sql_bytes('z', 4)}))"
    return f"""WITH {sql_series()}, f AS (SELECT user_id, {fold} AS st FROM ser), k AS (SELECT user_id, st, unnest(range((len(st) - 2) // 64 + 1)) AS k FROM f),
e AS (SELECT *, st[least((k + 1) * 64 + 1, len(st))] AS z9 FROM k)
SELECT user_id, CAST(k AS INTEGER) AS chunk, array_to_string(list_transform(st[k * 64 + 2 : least((k + 1) * 64 + 1, len(st))], lambda z: z.y1), ',') AS y, {sql_hex(sql_fnv(data))} AS state_hash FROM e"""


def _recursive(name: str, f, sql: str) -> None:
    @register(sql, name)
    def run(spark, sf_dir):
        out = chunks.recurrence(series(spark, sf_dir), ["user_id"], [f])
        state = F.struct(*(F.get("state0", F.lit(i)).alias(k) for i, k in enumerate(f.state)))
        return out.select("user_id", "chunk", text(F.col("y0")).alias("y"), fixed.let(state, lambda s: fixed.hex64(filters.state_hash(s, f))).alias("state_hash"))


# The designs as the SQL reads them, written out apart from the operators' table.
SQL_DESIGNS = {
    "filter_identity": (32768, 0, 0, 0, 0),
    "notch50_250": (32257, -19936, 32257, -19936, 31745),
    "notch50_500": (32450, -52505, 32450, -52505, 32132),
    "notch50_1000": (32600, -62009, 32600, -62009, 32432),
    "notch60_250": (32232, -4048, 32232, -4048, 31696),
    "notch60_500": (32398, -47235, 32398, -47235, 32029),
    "notch60_1000": (32568, -60562, 32568, -60562, 32368),
    "bandpass_motor_intent_250": (6957, 0, -6957, -47759, 18854),
    "bandpass_motor_intent_500": (3957, 0, -3957, -56533, 24853),
    "bandpass_motor_intent_1000": (2115, 0, -2115, -61015, 28538),
    "bandpass_attention_250": (2980, 0, -2980, -58676, 26809),
    "bandpass_attention_500": (1566, 0, -1566, -62167, 29635),
    "bandpass_attention_1000": (803, 0, -803, -63869, 31162),
    "bandpass_safety_wide_250": (10747, 0, -10747, -43487, 11274),
    "bandpass_safety_wide_500": (6444, 0, -6444, -52482, 19880),
    "bandpass_safety_wide_1000": (3576, 0, -3576, -58338, 25616),
}


def _biquad(name: str, coeffs: tuple[int, ...]) -> None:
    c = SQL_DESIGNS[name]
    _recursive(name, filters.Biquad(coeffs), sql_states(sql_biquad(c), c, ("x1", "x2", "y1", "y2")))


_biquad("filter_identity", filters.notch_coeffs("disabled", 333))
for _rate in (250, 500, 1000):
    for _mode in ("50", "60"):
        _biquad(f"notch{_mode}_{_rate}", filters.notch_coeffs(_mode, _rate))
    for _preset in ("motor_intent", "attention", "safety_wide"):
        _biquad(f"bandpass_{_preset}_{_rate}", filters.bandpass_coeffs(_preset, _rate))

_DC = sql_sat("(((w[1].x1 - a[len(a)].x1) * 32768 + 32604 * a[len(a)].y1) + 16384) >> 15")
_DC_FOLD = f"""list_reduce(list_transform(x, lambda v: [{{'x1': v, 'y1': 0::BIGINT}}]),
  lambda a, w: list_append(a, {{'x1': w[1].x1, 'y1': CAST({_DC} AS BIGINT)}}), [{{'x1': 0::BIGINT, 'y1': 0::BIGINT}}])"""
_recursive("dc_blocker", filters.DcBlocker(), sql_states(_DC_FOLD, (32604,), ("x1", "y1")))


# --- across channels -----------------------------------------------------------------------------


def _across(name: str, f: Callable[[Column], Column], reference: str, of: str = "") -> None:
    sql = f"""WITH {SQL_BLOCKS}, {SQL_LONG}, r AS (SELECT *, {reference} AS r FROM lng {of})
SELECT vec_id, {sql_text(sql_sat('x - r'), 't, c')} AS y FROM r GROUP BY vec_id"""

    @register(sql, name)
    def run(spark, sf_dir):
        return blocks(spark, sf_dir).select("vec_id", text(f(F.col("samples"))).alias("y"))


_INSTANT = "WINDOW w AS (PARTITION BY vec_id, t)"
_across("car", lambda s: spatial.common_average(s, 8), "CAST(sum(x) OVER w AS BIGINT) // 8", _INSTANT)
_across("ref_single", lambda s: spatial.single_reference(s, 8, 3), "max(CASE WHEN c = 3 THEN x END) OVER w", _INSTANT)
_across("ref_average", lambda s: spatial.average_reference(s, 8, [0, 5, 5]), "CAST(sum(CASE WHEN c = 0 THEN x WHEN c = 5 THEN 2 * x ELSE 0 END) OVER w AS BIGINT) // 3", _INSTANT)
_across("baseline", lambda s: spatial.remove_baseline(s, 8, 3), "CAST(sum(CASE WHEN t < 3 THEN x ELSE 0 END) OVER (PARTITION BY vec_id, c) AS BIGINT) // 3")


def _filter(name: str, weights: list[list[int]]) -> None:
    rows = ", ".join(f"({o}, {i}, {w})" for o, row in enumerate(weights) for i, w in enumerate(row))
    sql = f"""WITH {SQL_BLOCKS}, {SQL_LONG}, wt(o, c, w) AS (VALUES {rows}),
p AS (SELECT vec_id, t, o, {sql_sat('CAST(sum(w * x) AS BIGINT) >> 16')} AS y FROM lng JOIN wt USING (c) GROUP BY vec_id, t, o)
SELECT vec_id, {sql_text('y', 't, o')} AS y FROM p GROUP BY vec_id"""

    @register(sql, name)
    def run(spark, sf_dir):
        return blocks(spark, sf_dir).select("vec_id", text(spatial.spatial_filter(F.col("samples"), weights)).alias("y"))


_filter("spatial_identity", spatial.identity_weights(8, 8))
_filter("spatial_car_matrix", spatial.common_average_weights(8))
_filter("spatial_2x8", [[65536, -65536, 32768, -32768, 16384, -16384, 8192, -8192], [1000, 2000, 3000, 4000, 5000, 6000, 7000, -90000]])


# --- screening -----------------------------------------------------------------------------------


@register(f"""WITH {sql_series(0)} SELECT user_id, CASE WHEN list_max(x) >= 8388607 OR list_min(x) <= -8388608 THEN 'saturated'
  WHEN list_max(x) > 200000 OR list_min(x) < -200000 THEN 'amplitude_exceeded' ELSE 'clean' END AS flag FROM ser""")
def artifact_scan(spark, sf_dir):
    return chunks.artifact_scan(series(spark, sf_dir, offset=0), ["user_id"], 200_000)


def sql_screen(x: str, t: str, keys: str, limits: artifact.ScreenLimits) -> str:
    """bits by keys of rows with x, t, n and the sample before (p)."""
    q = "any_value(n) // 4"
    head = f"sum(CASE WHEN {t} < n // 4 THEN {x} ELSE 0 END)::BIGINT // greatest({q}, 1)"
    tail = f"sum(CASE WHEN {t} >= n - n // 4 THEN {x} ELSE 0 END)::BIGINT // greatest({q}, 1)"
    return f"""CAST(max(CASE WHEN {x} >= 8388607 OR {x} <= -8388608 THEN 1 ELSE 0 END) + max(CASE WHEN abs({x}) > {limits.amplitude} THEN 2 ELSE 0 END)
  + max(CASE WHEN abs({x} - p) > {limits.slew} THEN 4 ELSE 0 END) + CASE WHEN max({x}) - min({x}) <= {limits.flat_range} THEN 8 ELSE 0 END
  + CASE WHEN {q} > 0 AND abs({tail} - {head}) > {limits.drift} THEN 16 ELSE 0 END AS INTEGER)"""


_SERIES_LIMITS = artifact.ScreenLimits(120_000, 160_000, 9_000, 12_000)
_BLOCK_LIMITS = artifact.ScreenLimits(260_000, 300_000, 120_000, 90_000)


@register(f"""WITH {sql_series()}, {SQL_ROWS}, p AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY t) AS p FROM pts),
b AS (SELECT user_id, {sql_screen('x', 't', 'user_id', _SERIES_LIMITS)} AS bits FROM p GROUP BY user_id)
SELECT user_id, bits, bits & 13 <> 0 AS disqualifying FROM b""")
def artifact_screen(spark, sf_dir):
    df = chunks.artifact_screen(series(spark, sf_dir, 1), ["user_id"], _SERIES_LIMITS)
    return df.select("user_id", "bits", artifact.disqualifying(F.col("bits")).alias("disqualifying"))


@register(f"""WITH {SQL_BLOCKS}, {SQL_LONG}, p AS (SELECT *, 8 AS n, lag(x) OVER (PARTITION BY vec_id, c ORDER BY t) AS p FROM lng),
b AS (SELECT vec_id, c, {sql_screen('x', 't', 'vec_id, c', _BLOCK_LIMITS)} AS bits FROM p GROUP BY vec_id, c)
SELECT vec_id, {sql_text('bits', 'c')} AS bits FROM b GROUP BY vec_id""")
def screen_block(spark, sf_dir):
    return blocks(spark, sf_dir).select("vec_id", text(artifact.artifact_screen_block(F.col("samples"), 8, _BLOCK_LIMITS)).alias("bits"))


# --- features ------------------------------------------------------------------------------------


def sql_log2(v: str) -> str:
    """Sixteen squarings in 128-bit integers; v is a HUGEINT below 2**63."""
    msb = f"(length(bin(CAST({v} AS BIGINT))) - 1)"
    start = f"[{{'m': CASE WHEN {msb} <= 32 THEN {v} * (1::HUGEINT << CAST(greatest(32 - {msb}, 0) AS INTEGER)) ELSE {v} >> CAST(greatest({msb} - 32, 0) AS INTEGER) END, 'r': CAST({msb} AS BIGINT) * 65536}}]"
    up = "((a[1].m * a[1].m) >> 32) >= 8589934592::HUGEINT"
    step = f"[{{'m': ((a[1].m * a[1].m) >> 32) >> CAST(CASE WHEN {up} THEN 1 ELSE 0 END AS INTEGER), 'r': a[1].r + CASE WHEN {up} THEN b[1].r ELSE 0 END}}]"
    bits = "list_transform(range(16), lambda k: [{'m': 0::HUGEINT, 'r': CAST(1 << CAST(15 - k AS INTEGER) AS BIGINT)}])"
    return f"CASE WHEN {v} <= 0 THEN 0 ELSE CAST(list_reduce({bits}, lambda a, b: {step}, {start})[1].r AS INTEGER) END"


_VARIANCE = """m AS (SELECT *, CAST(sum(x) OVER (PARTITION BY user_id) AS BIGINT) // n AS mean, lag(x) OVER (PARTITION BY user_id ORDER BY t) AS p FROM pts),
v AS (SELECT user_id, CAST(sum(CAST(x - mean AS HUGEINT) * (x - mean)) AS HUGEINT) // any_value(n) AS v, CAST(sum(abs(x)) AS BIGINT) // any_value(n) AS abs_mean,
  CAST(sum(CASE WHEN (x < 0 AND p > 0) OR (x > 0 AND p < 0) THEN 1 ELSE 0 END) AS INTEGER) AS zero_crossings FROM m GROUP BY user_id)"""
_ISQRT = "CAST(floor(sqrt(CAST(v AS DOUBLE))) AS HUGEINT)"


@register(f"""WITH {sql_series()}, {SQL_ROWS}, {_VARIANCE}, g AS (SELECT *, {_ISQRT} AS g FROM v)
SELECT user_id, CAST(v AS BIGINT) AS variance, {sql_log2('v')} AS log_variance_q16,
  CAST(CASE WHEN g * g > v THEN g - 1 WHEN (g + 1) * (g + 1) <= v THEN g + 1 ELSE g END AS BIGINT) AS rms, abs_mean, zero_crossings FROM g""", "features")
def feature_columns(spark, sf_dir):
    return chunks.features(series(spark, sf_dir, 1), ["user_id"])


@register(f"""WITH {sql_series()}, {SQL_ROWS}, {_VARIANCE}
SELECT user_id, CAST(CAST(v AS FLOAT) AS BIGINT) AS variance, CAST(CAST(abs_mean AS FLOAT) AS BIGINT) AS abs_mean, CAST(2 AS INTEGER) AS n FROM v""")
def feature_vectors(spark, sf_dir):
    """Floats are read back as whole numbers, as the two engines write them differently."""
    v = chunks.features(series(spark, sf_dir, 1), ["user_id"]).select("user_id", features.feature_vector(F.col("variance"), F.col("abs_mean")).alias("f"))
    return v.select("user_id", F.get("f", F.lit(0)).cast("long").alias("variance"), F.get("f", F.lit(1)).cast("long").alias("abs_mean"), F.size("f").alias("n"))


_NUMBER = "least(CAST(floor(l_extendedprice * 100) AS HUGEINT) * (1 + l_orderkey) * (1 + l_partkey), 9223372036854775807::HUGEINT)"


@register(f"""WITH n AS (SELECT DISTINCT {_NUMBER} AS v FROM lineitem), g AS (SELECT v, {_ISQRT} AS g FROM n)
SELECT CAST(v AS BIGINT) AS v, CAST(CASE WHEN g * g > v THEN g - 1 WHEN (g + 1) * (g + 1) <= v THEN g + 1 ELSE g END AS BIGINT) AS root, {sql_log2('v')} AS log2_q16 FROM g""")
def isqrt_log2(spark, sf_dir):
    """Of a product of each row of lineitem, which saturates at 2**63 - 1."""
    v = fixed.dec(F.floor(F.col("l_extendedprice") * 100)) * fixed.dec(1 + F.col("l_orderkey")) * fixed.dec(1 + F.col("l_partkey"))
    n = table(spark, sf_dir, "lineitem").select(F.least(fixed.dec(v), fixed.num(2**63 - 1)).cast("long").alias("v")).distinct()
    return n.select("v", fixed.isqrt(fixed.dec(F.col("v"))).cast("long").alias("root"), fixed.log2_q16(fixed.dec(F.col("v"))).alias("log2_q16"))


# --- narrowband power ----------------------------------------------------------------------------

_BINS = [spectral.goertzel_coeff_q14(f * 1000, 250) for f in (8, 10, 13, 31)]
# The same, as the SQL reads them.
SQL_BINS = (32108, 31738, 31036, 23316)

#: The cosine of a quarter turn, for a phase of 0 to 65536, as the SQL computes it.
_SQL_QUARTER = "(65536 - ((80849 * x2) >> 16) + ((16625 * x4) >> 16) - ((1363 * ((x4 * x2) >> 16)) >> 16)) >> 2"
_SQL_COEFFS = f"""w AS (SELECT f, (f * 1000 << 16) // 250000 AS turns FROM fs), q AS (SELECT *, turns // 16384 % 4 AS q, turns % 16384 * 4 AS p FROM w),
x1 AS (SELECT *, CASE WHEN q % 2 = 1 THEN 65536 - p ELSE p END AS x FROM q), x2 AS (SELECT *, (x * x) >> 16 AS x2 FROM x1), x4 AS (SELECT *, (x2 * x2) >> 16 AS x4 FROM x2),
cs AS (SELECT f, CASE WHEN f = 0 OR f >= 125 THEN NULL ELSE CAST(greatest(least(2 * CASE WHEN q IN (1, 2) THEN -({_SQL_QUARTER}) ELSE {_SQL_QUARTER} END, 32768), -32768) AS INTEGER) END AS c FROM x4)"""


@register(f"""WITH fs AS (SELECT DISTINCT CAST(event_id % 130 AS BIGINT) AS f FROM events), {_SQL_COEFFS} SELECT f AS hz, c AS coeff_q14 FROM cs""")
def goertzel_coeffs(spark, sf_dir):
    known = F.create_map(*(v for f in range(1, 125) for v in (F.lit(f).cast("long"), F.lit(spectral.goertzel_coeff_q14(f * 1000, 250)))))
    hz = table(spark, sf_dir, "events").select((F.col("event_id") % 130).cast("long").alias("hz")).distinct()
    return hz.select("hz", F.try_element_at(known, F.col("hz")).alias("coeff_q14"))


def sql_goertzel(c: int, shift: int) -> str:
    new = f"(w[1].s1 + (({c} * a[1].s1) >> 14) - a[1].s2)"
    fold = f"list_reduce(list_transform(x, lambda v: [{{'s1': v, 's2': 0::BIGINT}}]), lambda a, w: [{{'s1': greatest(least({new}, 1099511627776), -1099511627776), 's2': a[1].s1}}], [{{'s1': 0::BIGINT, 's2': 0::BIGINT}}])"
    power = f"list_transform({fold}, lambda z: CAST(z.s1 >> {shift} AS HUGEINT) * (z.s1 >> {shift}) + CAST(z.s2 >> {shift} AS HUGEINT) * (z.s2 >> {shift}) - CAST(({c} * (z.s1 >> {shift})) >> 14 AS HUGEINT) * (z.s2 >> {shift}))[1]"
    return f"greatest(least({power}, 18446744073709551615::HUGEINT), 0)"


@register(
    f"""WITH {sql_series()}, b AS (SELECT user_id, {', '.join(f'{sql_goertzel(c, 4)} AS p{k}' for k, c in enumerate(SQL_BINS))} FROM ser)
SELECT user_id, {', '.join(f'CAST(p{k} AS VARCHAR) AS power_{k}' for k in range(4))},
  CASE WHEN p1 <> 0 THEN CAST(least(least(p0 * 1000, 18446744073709551615::HUGEINT) // p1, 4294967295) AS BIGINT) END AS ratio_permille FROM b"""
)
def goertzel_bank(spark, sf_dir):
    b = chunks.goertzel_bank(series(spark, sf_dir), ["user_id"], _BINS, 4).withColumnRenamed("powers", "p")
    p = [F.get("p", F.lit(k)) for k in range(4)]
    return b.select("user_id", *(v.cast("string").alias(f"power_{k}") for k, v in enumerate(p)), spectral.power_ratio_permille(p[0], p[1]).alias("ratio_permille"))


# --- decisions -----------------------------------------------------------------------------------


_MEANS = [[((7 * k + 3 * i) % 11 - 5) * 40_000 for i in range(64)] for k in range(5)]
_WEIGHTS = [(13 * i) % 17 - 8 for i in range(64)]


def sql_decide(best: str, confidence: str, below: str) -> str:
    return f"CASE WHEN {below} THEN 'NoIntent' ELSE 'Intent' END AS kind, CASE WHEN NOT ({below}) THEN CAST({best} AS INTEGER) END AS class, CASE WHEN NOT ({below}) THEN CAST({confidence} AS INTEGER) END AS confidence_permille"


@register(f"""WITH {SQL_BLOCKS}, cm(i, m) AS (VALUES {', '.join(f'({k}, {m})' for k, m in enumerate(_MEANS))}),
d AS (SELECT vec_id, i, CAST(list_sum(list_transform(list_zip(s, m), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2]))) AS HUGEINT) AS d FROM blk, cm),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM d),
b AS (SELECT vec_id, max(CASE WHEN r = 1 THEN i END) AS best, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM r GROUP BY vec_id),
c AS (SELECT *, CASE WHEN d1 + d2 = 0 THEN 0 ELSE (d2 - d1) * 1000 // (d1 + d2) END AS conf FROM b)
SELECT vec_id, {sql_decide('best', 'conf', 'conf < 20')} FROM c""")
def mdm(spark, sf_dir):
    d = blocks(spark, sf_dir).select("vec_id", classify.classify_mdm(F.col("samples"), _MEANS, 20).alias("d"))
    return d.select("vec_id", "d.kind", "d.class", "d.confidence_permille")


@register(f"""WITH {SQL_BLOCKS}, l AS (SELECT vec_id, CAST(list_sum(list_transform(list_zip(s, {_WEIGHTS}), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS HUGEINT) + 12345 AS sc FROM blk),
c AS (SELECT vec_id, CAST(sc AS BIGINT) AS score, abs(sc) * 1000 // (abs(sc) + 2000000) AS conf, sc FROM l)
SELECT vec_id, score, {sql_decide('CASE WHEN sc >= 0 THEN 1 ELSE 0 END', 'conf', 'abs(sc) < 2000000')} FROM c""")
def lda(spark, sf_dir):
    s = F.col("samples")
    d = blocks(spark, sf_dir).select("vec_id", classify.lda_score(s, _WEIGHTS, 12345).alias("score"), classify.classify_lda_binary(s, _WEIGHTS, 12345, 2_000_000).alias("d"))
    return d.select("vec_id", "score", "d.kind", "d.class", "d.confidence_permille")


@register(f"""WITH {SQL_BLOCKS}, l AS (SELECT vec_id, CAST(list_sum(list_transform(list_zip(s, {_WEIGHTS}), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS HUGEINT) + 12345 AS sc FROM blk),
c AS (SELECT vec_id, sc, abs(sc) * 1000 // (abs(sc) + 2000000) AS conf FROM l)
SELECT vec_id, abs(sc) < 2000000 AS abstains, CASE WHEN abs(sc) < 2000000 THEN 'NoIntent' ELSE 'Intent(class=' || CASE WHEN sc >= 0 THEN '1' ELSE '0' END || ', confidence_permille=' || CAST(conf AS VARCHAR) || ')' END AS decision FROM c""")
def decision_texts(spark, sf_dir):
    d = blocks(spark, sf_dir).select("vec_id", classify.classify_lda_binary(F.col("samples"), _WEIGHTS, 12345, 2_000_000).alias("d"))
    return d.select("vec_id", classify.is_abstain(F.col("d")).alias("abstains"), classify.decision_text(F.col("d")).alias("decision"))


@register("""WITH b AS (SELECT event_id, CAST(event_id % 256 AS INTEGER) & 31 AS bits FROM events)
SELECT event_id, bits, bits = 0 AS is_clean, bits | 4 AS with_slew, bits & 8 <> 0 AS has_flatline, bits & 13 <> 0 AS disqualifying FROM b""")
def report_bits(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", artifact.from_bits((F.col("event_id") % 256).cast("int")).alias("bits"))
    b = F.col("bits")
    return df.select("event_id", "bits", artifact.is_clean(b).alias("is_clean"), artifact.with_flag(b, artifact.SLEW).alias("with_slew"), artifact.has(b, artifact.FLATLINE).alias("has_flatline"), artifact.disqualifying(b).alias("disqualifying"))


# --- calibration ---------------------------------------------------------------------------------


def covariances(spark: SparkSession, sf_dir: str, count: int, scale: int = 1) -> DataFrame:
    """vec_id, label, cov of the first channels; ``scale`` divides samples (rounding down)."""
    s = F.transform("samples", lambda v: F.floor(v / scale).cast("int"))
    df = blocks(spark, sf_dir).select("vec_id", "label", s.alias("s"))
    return df.select("vec_id", "label", calibrate.covariance(F.array(*(frames.column(F.col("s"), 8, c) for c in range(count))), count).alias("cov"))


def sql_cov(scale: int = 1) -> str:
    x = f"CAST(floor(x / {scale}) AS BIGINT)" if scale > 1 else "x"
    return f"""{SQL_BLOCKS}, {SQL_LONG}, mm AS (SELECT vec_id, label, t, c, {x} AS x FROM lng), dv AS (SELECT *, x - CAST(sum(x) OVER (PARTITION BY vec_id, c) AS BIGINT) // 8 AS d FROM mm),
cv AS (SELECT a.vec_id, any_value(a.label) AS label, a.c AS i, b.c AS j, CAST(CAST(sum(CAST(a.d AS HUGEINT) * b.d) AS HUGEINT) // 8 AS BIGINT) AS v FROM dv a JOIN dv b ON a.vec_id = b.vec_id AND a.t = b.t GROUP BY a.vec_id, a.c, b.c)"""


@register(f"WITH {sql_cov()} SELECT vec_id, {sql_text('v', 'i, j')} AS cov FROM cv GROUP BY vec_id")
def covariance(spark, sf_dir):
    return covariances(spark, sf_dir, 8).select("vec_id", text(F.flatten("cov")).alias("cov"))


@register(f"""WITH {sql_cov()}, sm AS (SELECT label, i, j, CAST(sum(v) AS BIGINT) // count(*) AS m, count(*) AS n FROM cv GROUP BY label, i, j)
SELECT label, {sql_text('m', 'i, j')} AS mean, any_value(n) AS n FROM sm GROUP BY label""")
def session_mean(spark, sf_dir):
    return calibrate.session_mean(covariances(spark, sf_dir, 8), ["label"]).select("label", text(F.flatten("mean")).alias("mean"), "n")


@register(f"""WITH {sql_cov()}, o AS (SELECT label, i, j, list(v ORDER BY vec_id) AS vs FROM cv GROUP BY label, i, j),
f AS (SELECT label, i, j, list_reduce(vs[2:], lambda a, b: a + ((3277 * (b - a)) >> 15), vs[1]) AS r FROM o)
SELECT label, {sql_text('r', 'i, j')} AS reference FROM f GROUP BY label""")
def drift_update(spark, sf_dir):
    return calibrate.drift_stream(covariances(spark, sf_dir, 8), "label", "vec_id", 3277).select("label", text(F.flatten("reference")).alias("reference"))


#: Two channels of samples scaled so that variances stay far below 2**31.
_SCALE = 200
_TWO = f"""{sql_cov(_SCALE)}, sm AS (SELECT label, i, j, CAST(sum(v) AS HUGEINT) // count(*) AS m FROM cv WHERE i < 2 AND j < 2 GROUP BY label, i, j),
r2 AS (SELECT label, max(CASE WHEN i = 0 AND j = 0 THEN m END) AS a, max(CASE WHEN i = 0 AND j = 1 THEN m END) AS b, max(CASE WHEN i = 1 AND j = 0 THEN m END) AS c, max(CASE WHEN i = 1 AND j = 1 THEN m END) AS d FROM sm GROUP BY label)"""


def sql_isqrt(v: str) -> str:
    g = f"CAST(floor(sqrt(CAST({v} AS DOUBLE))) AS HUGEINT)"
    return f"(CASE WHEN {g} * {g} > {v} THEN {g} - 1 WHEN ({g} + 1) * ({g} + 1) <= {v} THEN {g} + 1 ELSE {g} END)"


_CHOLESKY = f"""{_TWO}, l0 AS (SELECT *, {sql_isqrt('(a * 65536 * 65536)')} AS l00 FROM r2), l1 AS (SELECT *, (c * 65536 * 65536) // l00 AS l10 FROM l0),
l2 AS (SELECT *, {sql_isqrt('((d * 65536 - ((l10 * l10) >> 16)) * 65536)')} AS l11 FROM l1),
w0 AS (SELECT *, (65536::HUGEINT * 65536) // l00 AS w00, (65536::HUGEINT * 65536) // l11 AS w11 FROM l2), wh AS (SELECT *, ((-((l10 * w00) >> 16)) * 65536) // l11 AS w10 FROM w0)"""


@register(f"WITH {_CHOLESKY} SELECT label, CAST(w00 AS VARCHAR) || ',0,' || CAST(w10 AS VARCHAR) || ',' || CAST(w11 AS VARCHAR) AS whitener FROM wh")
def cholesky_2(spark, sf_dir):
    m = calibrate.session_mean(covariances(spark, sf_dir, 2, _SCALE), ["label"])
    return calibrate.with_matrix(m, calibrate.whiten_cholesky, ["mean"], "w").select("label", text(F.flatten("w")).alias("whitener"))


def _sql_align(i: int, j: int) -> str:
    w = (("w00", "0"), ("w10", "w11"))
    half = lambda k: f"({w[i][0]} * {('a', 'b')[k]} + {w[i][1]} * {('c', 'd')[k]})"
    return f"((({half(0)}) * {w[j][0]}) >> 16) + ((({half(1)}) * {w[j][1]}) >> 16)"


@register(f"WITH {_CHOLESKY} SELECT label, {' || chr(44) || '.join(f'CAST({_sql_align(i, j)} AS VARCHAR)' for i in range(2) for j in range(2))} AS aligned FROM wh")
def align_2(spark, sf_dir):
    m = calibrate.session_mean(covariances(spark, sf_dir, 2, _SCALE), ["label"])
    m = calibrate.with_matrix(m, calibrate.whiten_cholesky, ["mean"], "w")
    return calibrate.with_matrix(m, calibrate.align, ["w", "mean"], "out").select("label", text(F.flatten("out")).alias("aligned"))


_Q = 24
_U = f"{1 << _Q}::HUGEINT"


def _sql_mul(p: str, q: str) -> list[str]:
    return [f"(({p}{i}0 * {q}0{j} + {p}{i}1 * {q}1{j}) >> {_Q})" for i in range(2) for j in range(2)]


_AT = ["00", "01", "10", "11"]
_STEP = ", ".join(f"({3 * (1 << _Q) if k in (0, 3) else 0}::HUGEINT - {m}) // 2 AS t{_AT[k]}" for k, m in enumerate(_sql_mul("z", "y")))


@register(f"""WITH RECURSIVE {_TWO}, e AS (SELECT label, a, b, c, d, ((a + d) * 2000) // 2000000 AS eps FROM r2), g AS (SELECT *, a + d + 2 * eps AS s FROM e),
ns AS (
  SELECT label, s, 0 AS k, ((a + eps) * {_U}) // s AS y00, (b * {_U}) // s AS y01, (c * {_U}) // s AS y10, ((d + eps) * {_U}) // s AS y11, {_U} AS z00, 0::HUGEINT AS z01, 0::HUGEINT AS z10, {_U} AS z11 FROM g
  UNION ALL
  SELECT label, s, k + 1, {', '.join(_sql_mul('y', 't'))}, {', '.join(_sql_mul('t', 'z'))} FROM (SELECT *, {_STEP} FROM ns WHERE k < 14)
), f AS (SELECT *, {sql_isqrt(f'(s * {1 << (2 * _Q)}::HUGEINT)')} AS root FROM ns WHERE k = 14), v AS (SELECT *, {1 << (2 * _Q)}::HUGEINT // root AS inv FROM f)
SELECT label, {' || chr(44) || '.join(f'CAST((z{a} * inv) >> {2 * _Q - 16} AS VARCHAR)' for a in _AT)} AS root FROM v""")
def inverse_sqrt_2(spark, sf_dir):
    m = calibrate.session_mean(covariances(spark, sf_dir, 2, _SCALE), ["label"])
    return calibrate.with_matrix(m, calibrate.inverse_sqrt_spd, ["mean"], "w").select("label", text(F.flatten("w")).alias("root"))


@register(f"""WITH {SQL_BLOCKS}, n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM blk)
SELECT label, vec_id, k AS observations, CASE WHEN k = 1 THEN 1 ELSE (k - 2) % 12 + 1 END AS staleness, k = 1 OR (k - 2) % 12 = 11 AS refresh_due, 1 + (k - 1) // 12 AS refreshes FROM n""")
def online_aligner_replay(spark, sf_dir):
    out = calibrate.online_aligner(covariances(spark, sf_dir, 8, _SCALE), "label", "vec_id", refresh_every=12)
    return out.select("label", "vec_id", "observations", "staleness", "refresh_due", "refreshes")


def _sql_times(a: str, b: str) -> str:
    """The product of two 8 x 8 matrices of Q24 numbers, as lists by rows."""
    return f"list_transform(range(64), lambda k: list_reduce(list_transform(range(8), lambda m: {a}[(k // 8) * 8 + m + 1] * {b}[m * 8 + k % 8 + 1]), lambda p, q: p + q) >> 24)"


_EYE = f"list_transform(range(64), lambda k: CASE WHEN k // 8 = k % 8 THEN {_U} ELSE 0::HUGEINT END)"
_HALF = f"list_transform(list_zip({_EYE}, {_sql_times('z', 'y')}), lambda p: (3 * p[1] - p[2]) // 2)"


@register(f"""WITH RECURSIVE {sql_cov(_SCALE)}, run AS (SELECT label, vec_id, i, j, row_number() OVER o AS k, sum(CAST(v AS HUGEINT)) OVER o AS s FROM cv WINDOW o AS (PARTITION BY label, i, j ORDER BY vec_id)),
mean AS (SELECT label, vec_id, list(CAST(s AS HUGEINT) // k ORDER BY i, j) AS r, CAST(sum(CASE WHEN i = j THEN CAST(s AS HUGEINT) // k ELSE 0 END) AS HUGEINT) AS trace FROM run WHERE k % 12 = 1 GROUP BY label, vec_id),
reg AS (SELECT label, vec_id, list_transform(list_zip(r, range(64)), lambda p: p[1] + CASE WHEN p[2] // 8 = p[2] % 8 THEN (trace * 2000) // 8000000 ELSE 0 END) AS r, trace + 8 * ((trace * 2000) // 8000000) AS s FROM mean),
ns AS (
  SELECT label, vec_id, s, 0 AS k, list_transform(r, lambda v: (v * {_U}) // s) AS y, {_EYE} AS z FROM reg
  UNION ALL
  SELECT label, vec_id, s, k + 1, {_sql_times('y', 't')}, {_sql_times('t', 'z')} FROM (SELECT *, {_HALF} AS t FROM ns WHERE k < 14)
), f AS (SELECT *, {1 << 48}::HUGEINT // {sql_isqrt(f'(s * {1 << 48}::HUGEINT)')} AS inv FROM ns WHERE k = 14)
SELECT label, vec_id, array_to_string(list_transform(z, lambda v: (v * inv) >> 32), ',') AS whitener FROM f""")
def online_aligner_whiteners(spark, sf_dir):
    out = calibrate.online_aligner(covariances(spark, sf_dir, 8, _SCALE), "label", "vec_id", refresh_every=12)
    return out.filter("refresh_due").select("label", "vec_id", text(F.flatten("whitener")).alias("whitener"))


# --- end to end ----------------------------------------------------------------------------------

_DECISION_LIMITS = artifact.ScreenLimits(400_000, 300_000, 45, 30_000)
_DECISION_MEANS = [[1_900_000, 20_000, 3], [2_050_000, 35_000, 6], [2_150_000, 60_000, 9]]
_FIR = f"{sql_sat('(z + 2 * coalesce(lag(z) OVER w, 0) + coalesce(lag(z, 2) OVER w, 0) + 2) >> 2')}"


@register(f"""WITH {sql_series()}, k AS (SELECT user_id, x, unnest(range(CASE WHEN len(x) >= 16 THEN (len(x) - 16) // 8 + 1 ELSE 0 END)) AS k FROM ser),
pt AS (SELECT user_id, k, i - 1 AS t, x[k * 8 + i] AS x, 16 AS n FROM k, unnest(range(1, 17)) AS u(i)),
pv AS (SELECT *, lag(x) OVER (PARTITION BY user_id, k ORDER BY t) AS p FROM pt),
sc AS (SELECT user_id, k, {sql_screen('x', 't', 'user_id, k', _DECISION_LIMITS)} AS bits FROM pv GROUP BY user_id, k),
rm AS (SELECT pt.user_id, pt.k, t, x - CAST(sum(x) OVER (PARTITION BY pt.user_id, pt.k) AS BIGINT) // 16 AS z FROM pt JOIN sc ON pt.user_id = sc.user_id AND pt.k = sc.k WHERE bits & 13 = 0),
fr AS (SELECT user_id, k, t, {_FIR} AS y FROM rm WINDOW w AS (PARTITION BY user_id, k ORDER BY t)),
fm AS (SELECT *, CAST(sum(y) OVER (PARTITION BY user_id, k) AS BIGINT) // 16 AS mean, lag(y) OVER (PARTITION BY user_id, k ORDER BY t) AS q FROM fr),
ft AS (SELECT user_id, k, CAST(sum(CAST(y - mean AS HUGEINT) * (y - mean)) AS HUGEINT) // 16 AS v, CAST(sum(abs(y)) AS BIGINT) // 16 AS am, CAST(sum(CASE WHEN (y < 0 AND q > 0) OR (y > 0 AND q < 0) THEN 1 ELSE 0 END) AS BIGINT) AS zc FROM fm GROUP BY user_id, k),
fv AS (SELECT user_id, k, {sql_log2('v')} AS lv, am, zc FROM ft),
cm(i, a, b, c) AS (VALUES {', '.join(f'({k}, {m[0]}, {m[1]}, {m[2]})' for k, m in enumerate(_DECISION_MEANS))}),
ds AS (SELECT user_id, k, i, CAST(lv - a AS HUGEINT) * (lv - a) + CAST(am - b AS HUGEINT) * (am - b) + CAST(zc - c AS HUGEINT) * (zc - c) AS d FROM fv, cm),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY d, i) AS r FROM ds),
b2 AS (SELECT user_id, k, max(CASE WHEN r = 1 THEN i END) AS best, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM rk GROUP BY user_id, k),
c2 AS (SELECT *, CASE WHEN d1 + d2 = 0 THEN 0 ELSE (d2 - d1) * 1000 // (d1 + d2) END AS conf FROM b2)
SELECT user_id, CAST(k AS INTEGER) AS epoch_index, {sql_decide('best', 'conf', 'conf < 100')} FROM c2""")
def pipeline_decision(spark, sf_dir):
    e = chunks.epochs(series(spark, sf_dir, 15), ["user_id"], 16, 8)
    return decide_epochs(e, ["user_id"], _DECISION_MEANS, _DECISION_LIMITS, 100)
