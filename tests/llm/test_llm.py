"""The corpus operators against brute force, on small fixtures with edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 30_000


def make(spark, rows, extra=True):
    """documents with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("k", "n", "rid", "rank", "shard", "kept", "_k", "h", "size", "toxic"):
            df = df.withColumn(c, F.lit("x"))
    return df


def edge_rows():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", None, 3), (4, LONG, "en", "s", None),
            (5, "one", "en", "s", 3), (6, "one two", None, "s", 7), (7, "One TWO", "en", "s", 7)]
    base = text(120)
    for i in range(10, 40):
        words = base.split()
        if i >= 20:
            words[rnd.randrange(120)] = "changed" + str(i % 7)
        rows.append((i, " ".join(words), "en", "hot", 600))
    rows += [(i, text(rnd.choice([3, 8, 15, 18, 19, 25, 60])), rnd.choice(["en", "de"]), f"s{i % 3}", 1) for i in range(40, 90)]
    short = text(17)
    rows += [(90, short, "en", "s", 1), (91, short + " tail", "en", "s", 1), (92, short + " tail end", "en", "s", 1)]
    rows += [(93, "naïve café  x  y 日本語 <|endoftext|> a's 12 " * 50, "fr", "s", 1), (94, "a" * 5000, "en", "s", 1)]
    return rows + [rows[10], rows[10], (None, base, "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def texts():
    return [(d, t or "") for d, t, *_ in edge_rows()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hf():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts(docs, empty):
    from txrisk.llm.token_counts import count_tokens
    tok = hf()
    want = []
    for d, t in texts():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((d, len(t.encode()), n, n > 512))
    assert rows_of(count_tokens(docs)) == sorted(want, key=repr)
    assert count_tokens(empty).count() == 0


def test_unit_memo_survives_equal_hashes(monkeypatch):
    from txrisk.llm import units
    from txrisk.llm.token_counts import tokenizer_path
    monkeypatch.setattr(units, "hash_ranges", lambda b, s, e: np.full(len(s), 7, np.uint64))
    enc = units.UnitEncoder(tokenizer_path())
    raw = [x.encode() for x in ("one two three", "four  five", "")]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = enc.lengths(np.frombuffer(b"".join(raw), np.uint8), off)
    assert got.tolist() == [len(hf().encode(x.decode(), add_special_tokens=False).ids) for x in raw]


def test_packing(docs, empty):
    from txrisk.llm.best_fit import pack_documents, plan_best_fit
    tok = hf()
    got = pack_documents(docs, room=256).collect()
    want = defaultdict(int)
    for d, t in texts():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) % 256 or 256
        for k, a in enumerate([0, *range(head, len(ids), 256)]):
            b = head if k == 0 else a + 256
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    have = defaultdict(int)
    place = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        place[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for spans in place.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    assert pack_documents(empty).count() == 0
    rnd = random.Random(1)
    hist = {n: rnd.randint(1, 50) for n in range(1, 101)}
    assert plan_best_fit(hist, 100)[1] == _best_fit(hist, 100)


def _best_fit(hist, room):
    left = []
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            fits = [x for x in left if x >= n]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(room - n)
    return len(left)


def test_shards(docs, empty):
    from txrisk.llm.hilbert_shards import hilbert_index, shard_rows
    got = shard_rows(docs).collect()
    want = sorted((repr(d), len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts())
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(24))
    assert shard_rows(empty).count() == 0 and shard_rows(docs.limit(5)).count() == 5
    cube = np.array(np.meshgrid(*[range(4)] * 3, indexing="ij")).reshape(3, -1).T
    path = cube[np.argsort(hilbert_index(cube, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # neighbours along the curve touch


def test_exact_groups(docs, empty):
    from txrisk.llm.exact_dedup import drop_exact_duplicates, exact_groups
    by = defaultdict(list)
    for d, t in texts():
        by[t].append(d)
    want = []
    for d, t in texts():
        ids = [x for x in by[t] if x is not None]
        keep = max(ids) if ids else None
        want.append((d, keep, len(by[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert rows_of(exact_groups(docs)) == sorted(want, key=repr)
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 3), 2, "0"))  # noqa: E731  collisions everywhere
    assert rows_of(exact_groups(docs, hash_of=weak)) == sorted(want, key=repr)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(t or "" for (t,) in kept.select("text").collect()) == sorted(by)
    assert exact_groups(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def _sets(width):
    out = []
    for d, t in texts():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        out.append((d, frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()))
    return out


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5)])
def test_similar_components(docs, empty, percent, width):
    from txrisk.llm.jaccard_join import drop_near_duplicates, similar_components
    rows = _sets(width)
    named = {s for d, s in rows if d is not None and s}
    parent = {s: s for s in named}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    every = list(named)
    for i, a in enumerate(every):
        for b in every[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for d, s in rows:
        if d is not None and s:
            least[root(s)] = min(least[root(s)], d)
    want = sorted(((d, len(s), (least[root(s)] if s in named else None) if s else d) for d, s in rows), key=repr)
    assert rows_of(similar_components(docs, percent, width)) == want
    assert len({c for _, n, c in want if n}) < len([1 for _, n, _ in want if n]) - 20
    kept = {r.doc_id for r in drop_near_duplicates(docs, percent, width).select("doc_id").collect()}
    assert kept == {d for d, n, c in want if d is None or c is None or c >= d}
    assert similar_components(empty).count() == 0


def test_light_and_heavy_agree(docs):
    """The boundary changes the way, not the links."""
    from txrisk.llm import jaccard_join as J
    t = J.Threshold(90)
    sets = [s for _, s in _sets(3) if 0 < len(s) <= 24]
    table = J.materialize(J.set_table(docs, 3), "t")
    classes = table.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                                            F.first("sketch").alias("sketch"))
    assert J.choose_boundary({len(s): 5 for s in sets}, t) > 5
    parts = []
    for light in (0, 24):
        links = J.class_links(docs, classes, 3, t, light)
        comp = J.connected_components(links)
        groups = defaultdict(set)
        for r in comp.collect():
            groups[bytes(r.c)].add(bytes(r.k))
        parts.append({frozenset(g) for g in groups.values()})
    assert parts[0] == parts[1]


def test_components_of_a_chain(spark):
    from txrisk.llm.components import connected_components
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_components_grow(spark):
    """Links that come later give what all links together give."""
    from txrisk.llm.components import connected_components, extend_components
    rng = random.Random(4)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(75)] + [(7, 7), (200, 201), (201, 200)]
    frame = lambda p: spark.createDataFrame(p, "a long, b long")
    want = {tuple(r) for r in connected_components(frame(pairs)).collect()}
    for cut in (0, 30, len(pairs)):
        comp = extend_components(connected_components(frame(pairs[:cut])), frame(pairs[cut:]))
        got = [tuple(r) for r in comp.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert connected_components(frame([])).count() == 0


def test_tree_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken
    from txrisk.llm.bpe_tree import TreeCodec, decode_ids, encode_documents, round_trip
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in texts():
        ids = enc.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.encode()).hexdigest()))
    assert rows_of(round_trip(docs)) == sorted(want, key=repr)
    assert round_trip(empty).count() == 0
    back = decode_ids(encode_documents(docs)).collect()
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in back) == sorted((repr(d), t.encode()) for d, t in texts())
    small = TreeCodec(ranks, P.PATTERN, leaf=3)  # joins everywhere
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b ", " ", "\n", "é", "日", "'s", "12", " ", "  ", "<|endoftext|>", "x" * 9])
                    for _ in range(rnd.randint(0, 60)))
        ids = small.encode(t)
        assert ids.tolist() == enc.encode_ordinary(t) and small.decode(ids).decode() == t


def test_quality(docs, empty):
    from txrisk.llm.perplexity import judge_quality, keep_good
    got = {}
    for r in judge_quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(texts())
    for d, t in texts():
        if d is None:
            continue
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i:i + 3])].append(i)
        rep = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        r = got[d][0]
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                                 len(rep), failed)
        assert r.kept == (not failed and r.lower <= r.log_ppl <= r.upper)
    assert keep_good(docs).columns == docs.columns
    assert judge_quality(empty).count() == 0 and keep_good(empty).count() == 0


@pytest.mark.parametrize("share", [2.0**-20, 2.0**-7, 1.0])
def test_perplexity_model_is_kneser_ney(spark, monkeypatch, share):
    """Spark's sorted arrays against modified Kneser-Ney from plain dictionaries:
    all bigrams common, some, none."""
    from txrisk.llm import perplexity as Q
    monkeypatch.setattr(Q, "PAIR_SHARE", share)
    rnd = random.Random(9)
    lines = [" ".join(rnd.choice("abcdefghijkl") * rnd.choice([1, 1, 2]) for _ in range(40)) for _ in range(30)]
    docs = make(spark, [(i, t, "en", "s", 1) for i, t in enumerate(lines)])
    scores = {r.doc_id: r.log_ppl for r in Q.score(docs.select("doc_id", "lang", "text"),
                                                    Q.fit(docs.select("doc_id", "lang", "text"))).collect()}
    words = defaultdict(int)
    for t in lines:
        for w in t.split():
            words[w] += 1
    vocab = {w for w, c in words.items() if c >= 2}
    pairs = defaultdict(int)
    for t in lines:
        ws = [w if w in vocab else None for w in t.split()]
        for p in zip(ws, ws[1:]):
            pairs[p] += 1
    ids = [*vocab, None]
    left = {w: sum(1 for (_, b) in pairs if b == w) for w in ids}
    d = Q._discounts(np.array([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))
    low = Q._discounts(np.array([sum(c == k for c in left.values()) for k in (1, 2, 3, 4)]))
    seen = sum(left.values())
    kept = {w: max(c - low[min(c, 3)], 0) for w, c in left.items()}
    uni = {w: (kept[w] + (seen - sum(kept.values())) / len(ids)) / seen for w in ids}
    total = defaultdict(int)
    for (a, _), c in pairs.items():
        total[a] += c
    direct = {p: max(c - d[min(c, 3)], 0) / total[p[0]] for p, c in pairs.items()}
    rest = {a: 1 - sum(v for (x, _), v in direct.items() if x == a) for a in ids}
    for i, t in enumerate(lines):
        ws = [w if w in vocab else None for w in t.split()]
        lp = np.log(uni[ws[0]]) + sum(np.log(direct.get(p, 0) + rest[p[0]] * uni[p[1]]) for p in zip(ws, ws[1:]))
        lp -= sum(np.log(max(len(words) - len(vocab), 1)) for w in ws if w is None)
        assert abs(scores[i] + lp / len(ws)) < 1e-4


def test_perplexity_reads_words_of_a_small_language(spark):
    """Words far rarer than 2^-16 of the corpus are words, not one unknown."""
    from txrisk.llm import perplexity as Q
    rnd = random.Random(4)
    many = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rnd.choices(many, k=1000)), "en", "s", 1) for i in range(400)]
    few = [f"p{i}" for i in range(60)]
    mixed = rnd.sample(few, 60)
    rows += [(1000 + i, " ".join([*few, f"t{i}"]), "es", "s", 1) for i in range(4)] + [(2000, " ".join(mixed), "es", "s", 1)]
    d = make(spark, rows).select("doc_id", "lang", "text")
    got = {r.doc_id: r.log_ppl for r in Q.score(d, Q.fit(d)).where("lang = 'es'").collect()}
    assert got[2000] > got[1000] + 0.5


def test_perplexity_counts_each_different_text_once(spark):
    from txrisk.llm import perplexity as Q
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices("abcdefghij", k=40)), "en", "s", 1) for i in range(20)]
    once, often = (make(spark, r).select("doc_id", "lang", "text") for r in (rows, rows + [(100 + i, *rows[3][1:]) for i in range(30)]))
    want = {r.doc_id: r.log_ppl for r in Q.score(once, Q.fit(once)).collect()}
    got = {r.doc_id: r.log_ppl for r in Q.score(often, Q.fit(often)).collect()}
    assert all(got[i] == v for i, v in want.items()) and all(got[100 + i] == want[3] for i in range(30))


def test_perplexity_bands_reject_on_both_sides(spark):
    from txrisk.llm.perplexity import judge_quality
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in judge_quality(d).collect() if not r.base_failed]
    assert any(r.log_ppl < r.lower for r in rows) and any(r.log_ppl > r.upper for r in rows)


def test_perplexity_buckets_follow_the_bytes(spark, monkeypatch):
    from txrisk.llm import perplexity as Q
    rnd = random.Random(8)
    d = make(spark, [(i, " ".join(rnd.choices("abcdefghij", k=40)), "en", "s", 1) for i in range(50)])
    d = d.select("doc_id", "lang", "text")
    want = {r.doc_id: r.log_ppl for r in Q.score(d, Q.fit(d)).collect()}
    monkeypatch.setattr(Q, "BUCKET_BYTES", 200)
    fitted = Q.fit(d)
    assert fitted.buckets == 20  # 50 texts of 79 bytes
    assert {r.doc_id: r.log_ppl for r in Q.score(d, fitted).collect()} == want


def test_toxicity(spark, docs, empty):
    from txrisk.llm.toxicity import Settings, score_toxicity
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    s = Settings(members=2, steps=100)
    got = {r.doc_id: r for r in score_toxicity(d, labels, s).collect()}
    assert len(got) == d.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    pos = [got[r.doc_id].score for r in labels.collect() if r.toxic == 1 and got[r.doc_id].held_out]
    neg = [got[r.doc_id].score for r in labels.collect() if r.toxic == 0 and got[r.doc_id].held_out]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.75
    none = labels.where("false")
    edge = score_toxicity(docs, none, s).collect()
    assert len(edge) == len(texts()) and all(0 <= r.score <= 1 for r in edge)
    assert score_toxicity(empty, none, s).count() == 0


def test_scores_do_not_see_held_out_labels(spark):
    from txrisk.llm.toxicity import Settings, fold, score_toxicity
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    s = Settings(members=1, steps=20)
    assert rows_of(score_toxicity(d, labels, s)) == rows_of(score_toxicity(d, turned, s))


PII = [
    (1, "Mail that.30@mail1.example.com or THAT.30@MAIL1.EXAMPLE.COM!! now", None),
    (2, "call +1 (017) 555-7713 or 017-555-7713; card 4111 1111 1111 1111 and 4111111111111111", None),
    (3, "host 152.143.123.131, 8.8.8.8. key = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" iban DE89370400440532013000", None),
    (4, "Mrs. Anna Keller met Mr. Peter Keller and Frau Keller; г-н Иван Петров", None),
    (5, "no data here: 12 of 345, version 1.2.3, order 12345678", None), (6, "", None), (7, None, None)]


def test_surrogates(spark, docs, empty):
    from txrisk.llm.surrogates import replace_entities
    d = make(spark, [(i, t, "en", "s", 1) for i, t, _ in PII])
    out = {r.doc_id: r for r in replace_entities(d, "k1").collect()}
    assert (out[5].text, out[6].text, out[7].text) == (PII[4][1], "", None)
    assert [out[i].n_entities for i in range(1, 8)] == [2, 4, 4, 4, 0, 0, 0]
    a, b = re.findall(r"[\w.]+@[\w.]+", out[1].text)
    assert a.lower() == b.lower() and b == b.upper() and a.endswith(".com") and a != "that.30@mail1.example.com"
    assert re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})",
                     out[2].text)
    assert m and m.groups()[:3] == m.groups()[3:6] and "0175557713" not in "".join(m.groups()[:3])
    card = m.group(8)
    assert m.group(7).replace(" ", "") == card and card[0] == "4" and card != "4" + "1" * 15
    digits = [int(x) for x in card[::-1]]
    assert sum(digits[::2] + [x * 2 - 9 * (x > 4) for x in digits[1::2]]) % 10 == 0
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[3].text)
    assert len(ips) == 2 and all(0 <= int(x) <= 255 for ip in ips for x in ip.split("."))
    assert re.search(r'key = "[0-9a-f]{40}" iban DE\d{20}$', out[3].text) and "24be" not in out[3].text
    m = re.fullmatch(r"Mrs\. (\w+ra) (\w+) met Mr\. (\w+n) (\w+) and Frau (\w+); г-н ([а-яА-Я]+в) ([а-яА-Я]+)", out[4].text)
    assert m and m.group(2) == m.group(4) == m.group(5) != "Keller"
    again = {r.doc_id: r.text for r in replace_entities(d, "k1").collect()}
    other = {r.doc_id: r.text for r in replace_entities(d, "k2").collect()}
    assert again == {i: r.text for i, r in out.items()} and other[1] != again[1]
    same = replace_entities(docs)
    assert same.drop("n_entities").columns == docs.columns and same.count() == len(texts())
    assert replace_entities(empty).count() == 0


def test_surrogates_take_whole_names(spark):
    from txrisk.llm.surrogates import replace_entities
    rows = ["Mrs. Mary Jane Watson came. Mrs. Watson left; Watson's hat and Mary stayed, watson too",
            "Herr Ludwig van Beethoven und Prof. Dr. Jean-Luc O'Brien, Frau von Stein", "Watson alone is no name here"]
    d = make(spark, [(i, t, "en", "s", 1) for i, t in enumerate(rows)])
    out = {r.doc_id: r for r in replace_entities(d, "k1").collect()}
    a = re.fullmatch(r"Mrs\. (\w+) (\w+) (\w+) came\. Mrs\. (\w+) left; (\w+)'s hat and (\w+) stayed, watson too", out[0].text)
    assert a and a[3] == a[4] == a[5] != "Watson" and a[1] == a[6] != "Mary" and a[2] != "Jane"
    b = re.fullmatch(r"Herr (\w+) van (\w+) und Prof\. Dr\. (\w+) (\w+), Frau von (\w+)", out[1].text)
    assert b and not {"Ludwig", "Beethoven", "Luc", "Brien", "Stein"} & set(b.groups())
    assert out[2].text == rows[2] and [out[i].n_entities for i in range(3)] == [4, 3, 0]


def test_surrogates_take_national_phones(spark):
    from txrisk.llm.surrogates import replace_entities
    same = ["01 23 45 67 89", "+33 1 23 45 67 89", "0123456789"]
    rows = [*same, "030 1234567", "0171/1234567", "(089) 123456", "612 345 678", "612 34 56 78", "91 123 45 67", "01.23.45.67.89"]
    d = make(spark, [(i, f"tel {t}.", "fr", "s", 1) for i, t in enumerate(rows)])
    out = {r.doc_id: r for r in replace_entities(d, "k1").collect()}
    for i, t in enumerate(rows):
        assert out[i].n_entities == 1 and out[i].text != f"tel {t}."
        assert re.sub(r"\d", "0", out[i].text) == re.sub(r"\d", "0", f"tel {t}.")
    assert len({re.sub(r"\D", "", out[i].text)[-9:] for i in (0, 1, 2, 9)}) == 1


def test_hilbert_tells_sources_with_a_common_start_apart(spark):
    from txrisk.llm.hilbert_shards import shard_rows
    rows = [(None, "same", "en", f"https://www.example.org/{i % 32:02d}", 1) for i in range(320)]
    assert len({r.hilbert for r in shard_rows(make(spark, rows), 4).collect()}) == 16


def test_surrogates_of_secrets_without_digits(spark):
    from txrisk.llm.surrogates import replace_entities
    rows = ["sk-" + "abcdeFGHIJ" * 3, "ghp_" + "abcDEF" * 6, "AKIA" + "ABCDEFGH" * 2, "abcdef" * 6, "ABCDEF" * 6]
    d = make(spark, [(i, f"key {t} end", "en", "s", 1) for i, t in enumerate(rows)])
    out = {r.doc_id: r for r in replace_entities(d, "k1").collect()}
    assert all(out[i].n_entities == 1 and t not in out[i].text for i, t in enumerate(rows))


def test_surrogates_stay_distinct(spark):
    """A crowded form: collisions are certain at first."""
    from txrisk.llm.surrogates import replace_entities
    rows = [(i, f"at {i % 10}.{i // 10 % 10}.{i // 100 % 10}.1 now", "en", "s", 1) for i in range(1000)]
    out = [r.text for r in replace_entities(make(spark, rows)).select("text").collect()]
    assert len(set(out)) == 1000 and not set(out) & {t for _, t, *_ in rows}


def test_url_lists(spark):
    from datetime import datetime, timedelta
    from txrisk.llm.url_lists import filter_captures
    t0 = datetime(2024, 1, 1)
    day = lambda n: None if n is None else t0 + timedelta(days=n)
    rnd = random.Random(4)
    pats = ["b.org", "x.b.org", "a.b.org", "a.b.org/p", "a.b.org/p/q", "c.net", "org"]
    events = [(rnd.choice(["l1", "l2"]), rnd.choice(pats), day(rnd.randint(0, 300)), rnd.choice(["add", "remove"]))
              for _ in range(60)]
    events += events[:5] + [(None, "b.org", day(1), "add"), ("l1", None, day(1), "add"), ("l1", "b.org", None, "add")]
    urls = ["http://A.b.org/p/q/r?x=1", "https://u@a.b.org:80/p#f", "http://b.org", "http://x.a.b.org/", "ftp://c.net/p",
            "http://notb.org/", "nonsense", "", None, "http://a.b.org./pq"]
    caps = [(i, rnd.choice(urls), day(rnd.choice([0, 5, 90, 299, 300, rnd.randint(0, 400), None]))) for i in range(300)]
    caps += [caps[0], (None, urls[0], day(50))]
    keys = {urls[0]: ["a.b.org", "b.org", "org", "a.b.org/p", "a.b.org/p/q", "a.b.org/p/q/r"],
            urls[1]: ["a.b.org", "b.org", "org", "a.b.org/p"], urls[2]: ["b.org", "org"],
            urls[3]: ["x.a.b.org", "a.b.org", "b.org", "org"], urls[4]: ["c.net"], urls[5]: ["org"],
            urls[9]: ["a.b.org", "b.org", "org"]}
    want = []
    for i, url, t in caps:
        active = []
        for name, pat in {(e[0], e[1]) for e in events}:
            past = [(e[2], e[3] == "add") for e in events if e[:2] == (name, pat) and None not in e and t and e[2] <= t]
            if None not in (name, pat) and pat in keys.get(url, []) and past and max(past)[1]:
                active.append((-len(pat), name, pat))
        best = min(active) if active else (0, None, None)
        want.append((i, url, t, bool(active), len(active), best[1], best[2]))
    c = spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp").withColumn("list", F.lit("x"))
    e = spark.createDataFrame(events, "list string, pattern string, at timestamp, action string")
    got = filter_captures(c, e)
    assert rows_of(got.drop("valid_from", "valid_to")) == sorted(want, key=repr)
    assert filter_captures(c.where("false"), e).count() == 0
    assert filter_captures(c, e.where("false")).where("blocked").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(C.STAGES) - 1:
            assert docs.columns == names
            docs = docs.cache()
            counts.append(docs.count())
    assert [k for k, _ in C.STAGES] == ["quality_rules", "exact_dedup", "near_duplicates", "pii_surrogates", "best_fit_packing"]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_queries_are_registered():
    import __spark_entry__ as E
    qs = E.queries()
    assert all(any(q.startswith(f"op{n}_") for q in qs) for n in range(1, 11))
    assert "pipeline" in qs and {"op6_exact_dedup", "op8_jaccard_join"} <= set(E.oracle_sql())
