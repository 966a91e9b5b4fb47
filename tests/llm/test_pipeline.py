"""The pipeline's stages against the operators' own brute-force rules."""

import corpus_pipeline as C
import pytest

from tests.llm.test_minhash import brute


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("toxic = 1").collect()}
            gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()}
            assert len(gone & toxic) >= 0.6 * len(toxic & {r.doc_id for r in docs.collect()}) and out.count() > 0.8 * before
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {i for i, _, c in brute(rows) if i == c}
        if name == "personal_data":
            assert out.count() == docs.count() and out.filter("n_chars <> char_length(text)").count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
        docs = out


ODD = "doc_id long, text string, lang string, source string, n_chars long, sid long, key string, shard int, filled long, told long, n_values int"


def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and names that stages use themselves."""
    rest = (7, "k", 7, 7, 7, 7)
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "clean words here", "en", "s", 16), (3, "word " * 100_000, "en", "s", 500_000), (4, "same text of two rows", "en", "s", 21), (4, "same text of two rows", "en", "s", 21)]
    return spark.createDataFrame([(*r, *rest) for r in rows], ODD)


@pytest.mark.parametrize("name, stage", C.STAGES[:3])
def test_stages_keep_odd_rows(spark, data, name, stage):
    df = odd(spark)
    out = stage(spark, df, data)
    assert out.columns == df.columns and out.count() == (5 if name == "near_duplicates" else 6)
    assert stage(spark, df.limit(0), data).count() == 0


def test_packing_of_odd_rows(spark, data):
    out = C.STAGES[3][1](spark, odd(spark), data).toPandas()
    assert out.groupby(out.doc_id.fillna(-1)).length.sum().to_dict() == {-1.0: 4, 1.0: 1, 2.0: 1, 3.0: 100_001, 4.0: 12}
    assert C.STAGES[3][1](spark, odd(spark).limit(0), data).count() == 0


def test_run_is_the_stages_by_plain_rules(spark, data):
    """The whole run against the chain's decisions read plainly, links by all pairs, the expression's
    texts one by one, and the tokenizer's ids."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from tests.llm.test_toxicity import plainly
    from wavemill.llm import pii, toxicity
    from wavemill.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{data}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    at = chain.categories.index("toxic")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if plainly(chain, t)[at] < chain.thresholds[at]]
    rows = [(i, t) for (i, t), (j, _, c) in zip(rows, brute(rows)) if i == c]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", pii.replaced(F.col("text"))["text"].alias("text")).collect()
    t, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), []
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = C.run(spark, data).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 2


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    from wavemill.llm import common

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, made = "spark://host:7077", []
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        setCheckpointDir = staticmethod(made.append)  # noqa: N815

    class Session:
        conf, sparkContext = Conf, Context  # noqa: N815

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.checkpoint_dir(Session)
    Context.master = "local[4]"
    assert common.checkpoint_dir(Session) == Context.made[0]
