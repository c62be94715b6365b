"""Scores of all texts in parts, beside the model as a table."""

import os
import random

import numpy as np
import pytest

from txrisk.llm import bigram_passes as B
from txrisk.llm import perplexity as Q


def _docs(spark):
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, rnd.choice(["en", "de", None]), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 60, 200]))))
            for i in range(120)]
    rows += [(200 + i, "en", rows[5][2] or "a b c") for i in range(9)]          # copies, some in another language
    rows += [(300, None, None), (301, "en", None), (None, "de", "a b a b a b"), (5, "en", " \n"), (5, "en", "a b c")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [{}, {"BUCKET_BYTES": 500, "PART_BYTES": 2000, "RUN_WORDS": 700},
                                   {"BUCKET_BYTES": 500, "PART_BYTES": 2000, "OFTEN": 0.02, "KEY_BITS": 1},
                                   {"OFTEN": 2.0}])
def test_scores_in_parts_are_those_of_the_table(spark, monkeypatch, small):
    docs = _docs(spark).cache()
    want = _sorted(Q.score(docs, Q.fit(docs)))
    for name, value in small.items():
        monkeypatch.setattr(B, name, value)
    assert _sorted(B.score_all(docs)[0]) == want


def _bytes_under(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_stored_tables_stay_below_the_input(spark, monkeypatch, tmp_path):
    """What lies in the checkpoint folder at any time, beside the Parquet that is read."""
    rnd, path = random.Random(5), f"{tmp_path}/docs"
    rows = [(i, "en", " ".join(f"word{rnd.randrange(20_000)}" for _ in range(150))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    most, top = [0], Q.materialize(docs.limit(1), "size").inputFiles()[0].removeprefix("file://")
    top = os.path.dirname(os.path.dirname(top))
    before = _bytes_under(top)

    def watched(module):
        put = module.stored

        def stored(df, name):
            out = put(df, name)
            most[0] = max(most[0], _bytes_under(top) - before)
            return out
        monkeypatch.setattr(module, "stored", stored)
    watched(Q)
    watched(B)
    Q.judge_quality(docs).collect()
    assert 0 < most[0] < 1.2 * _bytes_under(path)


def test_bigrams_are_coded_without_loss():
    rng = np.random.default_rng(1)
    b, a = np.unique(rng.integers(0, 2**48, (2, 500), dtype=np.uint64) % np.array([[40], [2**48]], np.uint64), axis=1)
    words, size, own, at = B._decode(*B._code(b, a))
    assert np.array_equal(np.repeat(words, size), b) and np.array_equal(own[at], a)
    assert B._unzip(B._zip(b"", b"xy", b"")) == [b"", b"xy", b""] and B._unzip(B._zip()) == []
