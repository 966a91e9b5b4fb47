"""What the corpus operators share: scratch tables, caches and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. A temporary one of our own is made only in local mode, where
    driver and executors are one; a cluster has to name a shared one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='wavemill-')}"
        sc.setCheckpointDir(named)
    return named


#: For tables whose rows take megabytes: pages and groups of rows end by their bytes after each row,
#: while Parquet would else look after a hundred rows, and a task hold that many.
LARGE_ROWS = {"parquet.block.size": 16 << 20} | {f"parquet.{kind}.size.row.check.{end}": 1 for kind in ("page", "block") for end in ("min", "max")}


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage, and outlive lost executors.

    ``save`` writes and rereads a table, ``drop`` deletes those that are no longer read, ``keep``
    all but some. What is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, set()
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/wavemill-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).options(**options).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            self._delete(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))

    def _delete(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already have ended  # noqa: BLE001
            return


class Shipped:
    """A broadcast object that executors can load without this package: it is pickled by value."""

    def __init__(self, spark: SparkSession, thing):
        self.broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        return cloudpickle.loads(self.broadcast.value)


class Memo(dict):
    """A dict that computes what it lacks and remembers what was asked for lately.

    It holds two generations of ``limit`` entries at most; when the young one is full it becomes
    the old one, from which entries come back as they are asked for.
    """

    def __init__(self, compute: Callable, limit: int = 150_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.compute(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def lacks(self, keys: set) -> list:
        """Those of the keys that would have to be computed."""
        return [k for k in keys if k not in self and k not in self.old]


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The kernel; what its worker no longer needs goes back to the system after each task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, chunk: int = 256) -> DataFrame:
    """Run one function over the rows of ``df``, Arrow batch by Arrow batch.

    ``make`` runs once a task and gives the function; it gets a row's column values (strings as
    UTF-8 bytes) and returns the output row. A batch leaves after ``chunk`` rows, so memory
    holds one input batch and few outputs.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c.cast(pa.large_binary()) if pa.types.is_large_string(c.type) else c for c in batch.columns]
            for at in range(0, batch.num_rows, chunk):
                parts = [c.slice(at, chunk).to_pylist() for c in cols]
                rows = list(map(f, *parts))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of things whose sizes sum up to at most so much (or one thing)."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, to
        at = to


def text_chunks(text: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes of text (or one row)."""
    return runs(np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False)).astype(np.int64), most)


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the words of all in a row as places in the distinct ones, and those.

    Words part at ASCII white space. The work is done column by column, no word is an object.
    """
    lists = pc.ascii_split_whitespace(text)
    coded = lists.flatten().dictionary_encode()
    words, places, counts = coded.dictionary, coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # what stands before and after white space
    if empty >= 0:
        told, ends = np.concatenate(([0], np.cumsum(places != empty))), np.cumsum(counts)
        counts, places = told[ends] - told[ends - counts], places[places != empty]
        places, words = places - (places > empty), pa.concat_arrays([words[:empty], words[empty + 1 :]])
    return counts.astype(np.int64), places, words


def in_row(which: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a row of things, thing k being flat[starts[k]:starts[k + 1]], and how many each has."""
    counts = np.diff(starts)[which]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - counts), counts)
    return flat[at], counts


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty): other columns can't clash."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
