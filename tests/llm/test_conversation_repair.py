"""Conversation repair against a search over all edit strings and a plain rewrite of the whole query."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txrisk.llm import conversation_repair as C

SF = "/root/testdata/sf0.001"
FULL = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?((ua)*u?)?")


def cheapest(rows):
    """(cost, ASCII-least audit, output initials): best-first over edit strings.  rows: (initial, fault)."""
    heap, seen = [(0, "", 0, "")], {}
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(rows) and FULL.fullmatch(out):
            return cost, audit, out
        state = (i, out[-1:], len(out) > 1)
        if seen.setdefault(state, (cost, audit)) < (cost, audit):
            continue
        options = [(2, "I", i, c) for c in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            options.append((3, "D", i + 1, ""))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options += [(extra, "K", i + 1, initial)] + [(2 + extra, "R", i + 1, c) for c in "ua"]
        for c, letter, j, more in options:
            if PREFIX.fullmatch(out + more):
                heapq.heappush(heap, (cost + c, audit + letter, j, out + more))


def all_strings(rows):
    """The same by trying every string of edits with at most three insertions at a place."""
    best = None
    def go(i, cost, audit, out, ins):
        nonlocal best
        if best and cost > best[0] or not PREFIX.fullmatch(out):
            return
        if i == len(rows) and FULL.fullmatch(out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if ins < 3:
            for c in "ua":
                go(i, cost + 2, audit + "I", out + c, ins + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                e = fault == "truncated"
                go(i + 1, cost + e, audit + "K", out + initial, 0)
                for c in "ua":
                    go(i + 1, cost + 2 + e, audit + "R", out + c, 0)
    go(0, 0, "", "", 0)
    return best


def kinds(rows):
    f = {"blank": "delete", "duplicate": "delete", "truncated": "truncated", "ok": "ok"}
    return bytes(C.KINDS.index((i if i in ("s", "u", "a") else "-", f[x])) for i, x in rows)


def test_every_short_conversation():
    for n in range(4):
        for rows in itertools.product([(i, f) for i in "suax" for f in ("ok", "truncated", "blank")], repeat=n):
            want = all_strings(rows)
            assert C.repair(kinds(rows)) == want[:2]
            made = C.apply_edits(want[1], iter([(i, "t") for i, _ in rows]))
            assert "".join(r[:1] for r, _ in made) == want[2]


def test_longer_conversations():
    rnd = random.Random(1)
    for _ in range(400):
        rows = [(rnd.choice("suuaaax"), rnd.choice(["ok", "ok", "truncated", "blank"])) for _ in range(rnd.randint(4, 40))]
        assert C.repair(kinds(rows)) == cheapest(rows)[:2]


def test_very_long_conversation_is_tight():
    rnd = random.Random(2)
    rows = [(rnd.choice("sua"), rnd.choice(["ok", "truncated", "blank"])) for _ in range(100_000)]
    cost, audit = C.repair(kinds(rows))
    made = list(C.apply_edits(audit, iter([(i, f) for i, f in rows])))
    assert FULL.fullmatch("".join(r[:1] for r, _ in made))
    paid, i = 0, 0
    for letter in audit:
        paid += {"I": 2, "D": 3, "R": 2, "K": 0}[letter]
        if letter != "I":
            paid += letter != "D" and rows[i][1] == "truncated"
            i += 1
    assert paid == cost and i == len(rows)


def plain(rows, damage=True):
    """The whole query, row by row."""
    one = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        out, r, t = by[conv], one(role), one(text)
        fate = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 9
        t = "" if fate == 1 else re.sub("[.!?]", "", t) if fate == 2 else t
        r = "user" if fate == 4 else r
        out += [(turn, role, text, r, t)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    result = []
    for conv, got in by.items():
        key = lambda x: "" if x is None else "1" + x
        dig = lambda t: "" if t is None else hashlib.sha256(f"{len(t)}:{t}".encode()).hexdigest()
        got.sort(key=lambda x: (x[0] is not None, x[0] or 0, key(x[1]), dig(x[2])))
        turns = [x[0] for x in got if x[0] is not None]
        seen, flags = set(), []
        for *_, r, t in got:
            body = t.strip(" \t\n\x0b\f\r")
            flags.append("blank" if not body else "duplicate" if (r, t) in seen else
                         "truncated" if body[-1] not in ".!?" else "ok")
            seen.add((r, t))
        pairs = [(x[3] or "x", f) for x, f in zip(got, flags)]
        cost, audit, _ = cheapest([(r[:1], f) for r, f in pairs])
        it, lines, out = iter(got), [], ""
        full = cheapest([(r[:1], f) for r, f in pairs])[2]
        pos = 0
        for letter in audit:
            if letter == "I":
                lines.append(("user:" if full[pos] == "u" else "assistant:"))
                pos += 1
                continue
            x = next(it)
            if letter != "D":
                role = x[3] if letter == "K" else "user" if full[pos] == "u" else "assistant"
                lines.append(f"{role}:{x[4]}")
                pos += 1
        initials = [x[3][:1] for x in got]
        result.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                       *(flags.count(f) for f in ("blank", "duplicate", "truncated")),
                       sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_plain_rewrite(spark, sf):
    from txrisk.llm.queries import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op13_conversation_repair"](spark, sf).collect()), key=repr)
    assert got == plain(rows)


def test_edges(spark):
    rnd = random.Random(3)
    rows = [(1, None, None, None), (2, 1, "system", "S."), (3, 1, "user", "Hi.\f"), (None, 1, "user", "Null id."),
            (None, None, "assistant", "Yes \x0b"), (4, 1, "tool", "x."), (4, 2, "", "y!"), (5, 3, "user", " \t\n")]
    rows += [(6, 1, "user", "same."), (6, 1, "user", "same."), (6, 1, "assistant", "b."), (6, 1, None, "c.")]
    rows += [(7, -2**62, "user", "far."), (7, 2**62, "assistant", "far.")]
    rows += [(8, k // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c?", ""])) for k in range(300)]
    rows += [(9, 1, "user", "long " * 50_000 + "."), (9, 2, "assistant", "ab" * 10)]
    rows += [(c, t, "user", f"text {t}.") for c in range(10, 200) for t in (1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("_o", "tag", "_role", "audit", "same", "first", "fault", "gaps"):
        df = df.withColumn(c, F.lit("x"))
    df = df.repartition(3)
    out = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    got = out(C.repair_conversations(df, C.damaged))
    assert got == plain(rows)
    gone = [r for r in got if r[7] == ""]
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)  # all its rows dropped
    assert out(C.repair_conversations(df)) == plain(rows, damage=False)
    assert C.repair_conversations(df.limit(0)).count() == 0
