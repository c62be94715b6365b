"""Word runs against brute force: random words, planted repetitions, whole query."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from txrisk.llm import periodic_runs as R

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s, least=12):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, 2 * q):
                seg = s[i:i + size]
                if not any(seg[x:] == seg[:size - x] for x in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_tuples(runs):
    return [tuple(int(x) for x in r) for r in runs]


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(1500):
        least, k = rnd.choice([2, 4, 12]), rnd.randint(1, 4)
        s = [rnd.randint(1, k) for _ in range(rnd.randint(1, 60))]
        if rnd.random() < 0.5:
            s = (s[:rnd.randint(1, 9)] * 10)[:rnd.randint(1, 60)] + s
        want = brute(s, least)
        assert as_tuples(R.runs_of(s, least)) == want
        if least >= 4:
            words = [b"w%d" % x for x in s]
            h = np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            blocks = R.recurring_blocks(h, np.array([0, len(s)]), least // 2)
            assert as_tuples(R.text_runs(words, blocks, least)) == want


def test_extension_is_common_prefix():
    rnd = random.Random(2)
    s = [rnd.randint(1, 2) for _ in range(300)] + [1] * 100
    tree = R.SuffixTree(s)
    i, j = np.array([(a, b) for a in range(0, 400, 7) for b in range(0, 400, 11) if a != b]).T
    for a, b, n in zip(i.tolist(), j.tolist(), tree.extension(i, j).tolist()):
        assert s[a:a + n] == s[b:b + n] and (max(a, b) + n == 400 or s[a + n] != s[b + n])


def test_blocks_keep_to_their_text():
    h = np.array([1, 2, 3, 4, 5, 6] * 4, np.uint64)
    assert R.recurring_blocks(h, np.array([0, 12, 24]), 6) == [(0, 12), (12, 24)]
    assert R.recurring_blocks(h[:12], np.array([0, 6, 12]), 6) == []  # met once in either text


def stutter(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = stutter(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)), len(words))


def test_query_against_brute_force(spark):
    from txrisk.llm.queries import queries
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 4000}
    got = {r.doc_id: tuple(r) for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert any(got[d][1] for d in short)
    for d, t in short.items():
        assert got[d] == expected(d, t)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 30_000), (5, "a b c " * 3 + "d"), (5, "a b c " * 3 + "d"),
            (None, "x y " * 6), (6, "a b\x0bc d e f " * 2), (7, "one")]
    rows += [(i, " ".join(f"w{k % (i % 7 + 2)}" for k in range(i))) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("runs", "start", "length", "period", "_best", "_lines", "n_words", "collapsed"):
        df = df.withColumn(c, F.lit("x"))
    out = R.run_digest(R.periodic_runs(df.withColumn("text", R.stuttered(F.col("doc_id"), F.col("text"))).repartition(3)))
    got = sorted((tuple(r) for r in out.where("doc_id IS NULL OR doc_id <> 4").collect()), key=repr)
    assert got == sorted((expected(d, t) for d, t in rows if d != 4), key=repr)
    assert tuple(out.where("doc_id = 4").first())[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert R.periodic_runs(df.limit(0)).count() == 0
