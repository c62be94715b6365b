"""Columns of the caller survive with their contents, whatever their names; repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

NAMES = ["_k", "_key", "_out", "_m", "_p", "_bare", "_row", "_text", "_id", "_sha", "_shard", "_slot", "gone_id",
         "gone_sha", "shard_id", "shard_crc", "shard_slot", "h", "n", "new", "norm", "kind"]


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"w{i % 37}x{i % 11}" for i in range(90))
    rows = [(1, "call +1 212-555-0147 or mail anna.keller@example.com"), (2, "call +1 212-555-0147 again"), (3, None),
            (None, "Mr. John Smith met Smith"), (4, words + " a"), (5, words + " a"), (5, words + " a"), (6, words + " b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")) \
        .withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))
    for c in NAMES:
        df = df.withColumn(c, F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df.repartition(2).cache()


def contents(df):
    for r in df.collect():
        for c in NAMES:
            assert r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}"


def test_surrogates_keep_columns(docs):
    from txrisk.llm.surrogates import replace_entities
    out = replace_entities(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    contents(out)
    rows = {r.doc_id: r for r in out.collect() if r.doc_id != 5}
    assert "555" not in rows[2].text and rows[1].n_entities == 2 and rows[3].text is None
    assert "Smith" not in rows[None].text


def test_filters_keep_columns(docs):
    from txrisk.llm.exact_dedup import drop_exact_duplicates
    from txrisk.llm.jaccard_join import drop_near_duplicates
    from txrisk.llm.perplexity import keep_good
    for f in (drop_exact_duplicates, drop_near_duplicates, keep_good):
        out = f(docs)
        assert sorted(out.columns) == sorted(docs.columns)
        contents(out)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(drop_exact_duplicates(docs)) == [1, 2, 3, 5, 6, None]
    assert ids(drop_near_duplicates(docs, percent=80, width=5)) == [1, 2, 3, 4, None]


def test_rows_that_repeat_an_id(spark):
    from txrisk.llm.jaccard_join import drop_near_duplicates
    rows = [(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in drop_near_duplicates(df).collect()), key=repr) == \
        [(1, "a b c d e f"), (7, None), (None, "a b c d e f"), (None, "x")]


def test_written_shards(docs, tmp_path, spark):
    from txrisk.llm.hilbert_shards import shard_rows, write_shards
    write_shards(docs, str(tmp_path / "out"), 3)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "shard"}
    contents(out)
    plan = {(r.doc_id, r.text_crc32): r.shard for r in shard_rows(docs, 3).collect()}
    import zlib
    for r in out.collect():
        if r.doc_id != 5:
            assert plan[r.doc_id, zlib.crc32((r.text or "").encode())] == r.shard
    write_shards(docs.limit(0), str(tmp_path / "none"))


def test_names_end_at_days_and_months(spark):
    from txrisk.llm.surrogates import replace_entities
    df = spark.createDataFrame([(1, "I met Mr. Smith Monday. On Monday Mr. Smith left in May.")], "doc_id long, text string")
    out = replace_entities(df).first().text
    assert "Smith" not in out and out.count("Monday") == 2 and out.endswith("left in May.")


def test_counts_keep_all_their_bytes():
    from txrisk.llm.perplexity import _planes, _unplanes
    for a in ([2**32 + 5, 1, 7], [0], [255, 256], [2**62], []):
        assert _unplanes(_planes(np.array(a, np.int64))).tolist() == a


def test_runs_are_sent_when_the_bound_is_met(spark, monkeypatch):
    """Small bounds on held bigrams and postings change no score."""
    from txrisk.llm import perplexity as Q
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2).cache()
    want = sorted(tuple(r) for r in Q.judge_quality(docs).collect())
    c = Q._Counter(500)
    full = [c.add(*(np.arange(300, dtype=np.uint64) + k * 300 for _ in range(3)), np.ones(300, np.int64)) for k in range(4)]
    assert full == [False, True, True, True] and len(c.total()[0]) == 1200
    monkeypatch.setattr(Q, "RUN_POSTINGS", 1000)
    monkeypatch.setattr(Q, "HELD_PAIRS", 500)
    assert sorted(tuple(r) for r in Q.judge_quality(docs).collect()) == want
