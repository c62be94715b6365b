"""Operator 13: least-cost repair of the turn structure of conversations.

Each row of a conversation is kept, given another role or deleted, and rows
with an empty text can be put in anywhere, until the initials of the roles read
``(s?(ua)+)?``.  Among the cheapest edits the ASCII-least string of their
initials wins.

The states of the pattern are few, so the cost of the rest of a conversation is
a vector of four numbers.  Going backward over the rows, such vectors are
stored at every b-th row only, b = sqrt(rows); going forward, a block's
vectors are computed again from the one behind it, and the least letter that
stays tight is emitted.

Rows meet in two passes, both sorted streams: one over a few bytes per row (a
byte per row is held, as many as the string of edits has letters), one over the
texts, in which the edits are applied and the repaired text is digested row by
row.  No task holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a.  FIXED VALUES of the pattern
FOLLOW = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)                # state after the one user / assistant row that can follow
ROLE = ("user", "user", "assistant", "user")
KINDS = [(i, f) for i in "sua-" for f in ("ok", "truncated", "delete")]  # a row as one byte
END = (0, FAR, FAR, 0)
SPACES = " \t\n\x0b\f\r"


def with_inserts(v: tuple) -> tuple:
    """Costs when rows may be put in before what v is the cost of."""
    w = list(v)
    for _ in range(2):  # two insertions lead through all states
        w = [min(w[q], INSERT + w[NEXT[q]]) for q in range(4)]
    return tuple(w)


@lru_cache(maxsize=1 << 16)
def _back(kind: int, v: tuple) -> tuple:
    initial, fault = KINDS[kind]
    extra = TRUNCATED if fault == "truncated" else 0
    out = []
    for q in range(4):
        best = DELETE + v[q]
        if fault != "delete":
            best = min(best, RETAG + extra + v[NEXT[q]])
            if (q, initial) in FOLLOW:
                best = min(best, extra + v[FOLLOW[q, initial]])
        out.append(best)
    return with_inserts(tuple(out))


def back(kind: int, v: tuple) -> tuple:
    """Costs before a row from those after it.  Differences are few, so steps are remembered."""
    low = min(v)
    w = _back(kind, tuple(min(x - low, FAR) for x in v))
    return tuple(x + low for x in w)


def repair(kinds: bytes) -> tuple[int, str]:
    """Cost and ASCII-least cheapest edits of the rows (numbers of KINDS)."""
    n = len(kinds)
    block = max(1, isqrt(n))
    v = with_inserts(END)
    stored = {n: v}
    for i in range(n - 1, -1, -1):
        v = back(kinds[i], v)
        if i % block == 0:
            stored[i] = v
    cost, out, q = v[0], [], 0
    for a in range(0, n, block):
        b = min(a + block, n)
        ahead = [stored[b]]
        for i in range(b - 1, a - 1, -1):
            ahead.append(back(kinds[i], ahead[-1]))
        for i in range(a, b):
            here, after = ahead[b - i], ahead[b - i - 1]
            initial, fault = KINDS[kinds[i]]
            extra = TRUNCATED if fault == "truncated" else 0
            while True:
                left = here[q]
                if left == DELETE + after[q]:
                    out.append("D")
                    break
                if left == INSERT + here[NEXT[q]]:
                    out.append("I")
                    q = NEXT[q]
                    continue
                if fault != "delete" and (q, initial) in FOLLOW and left == extra + after[FOLLOW[q, initial]]:
                    out.append("K")
                    q = FOLLOW[q, initial]
                    break
                out.append("R")
                q = NEXT[q]
                break
    while q not in (0, 3):
        out.append("I")
        q = NEXT[q]
    return cost, "".join(out)


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text), one by one."""
    q = 0
    for letter in audit:
        if letter == "I":
            yield ROLE[q], ""
            q = NEXT[q]
            continue
        role, text = next(rows)
        if letter == "K":
            yield role, text
            q = FOLLOW[q, role[:1]]
        elif letter == "R":
            yield ROLE[q], text
            q = NEXT[q]


def damaged(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _role, _text, _copy, _gone of ``conv`` after planted damage.

    By crc32(``conv_id:turn``) % 20: 0 drops a row (_gone), 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it a user's; nulls read as one space.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    return _slim(conv).withColumns({
        "_gone": fate == 0, "_text": text, "_role": F.when(fate == 4, "user").otherwise(one("role")),
        "_copy": F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})


def undamaged(conv: DataFrame) -> DataFrame:
    """The same columns with nothing changed (nulls read as one space)."""
    return _slim(conv).withColumns({
        "_gone": F.lit(False), "_text": F.coalesce("text", F.lit(" ")), "_role": F.coalesce("role", F.lit(" ")),
        "_copy": F.lit(0)})


def _slim(conv: DataFrame) -> DataFrame:
    return conv.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                       F.col("text").cast("string"))


def _digest(*cols) -> Column:
    """128 bits; the lengths keep ("ab", "c") and ("a", "bc") apart."""
    parts = [x for c in cols for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def repair_conversations(conv: DataFrame, prepare=undamaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256:
    one row per different conv_id of ``conv`` (conv_id, turn, role, text).

    Rows are taken by turn, nulls first; rows of one turn by role, then by a digest of the
    text, nulls first (equal rows stand together).
    A null role or text reads as one space, so its row is blank or, like one of an empty
    role, needs another role; a
    null conv_id is a conversation of its own.  The first fault of a row counts: blank
    (white space only), duplicate (role and text met earlier), truncated (last character
    that is no white space not one of ``.!?``).  gaps: turn numbers missing between
    least and greatest.  illegal: neighbours whose initials are not su, ua or au.
    ``audit`` has K, R, D or I for each edit.  ``prepare`` is applied first and may
    mark rows as gone; a conversation without rows has zeros, an empty audit and the digest of
    nothing.  An empty table gives no rows; other columns are not read.
    """
    order = ["conv_id", "turn", "_o", "_copy"]
    rows = prepare(conv).withColumn("_o", _order_key())
    # what the first pass needs of a row: a few bytes
    trimmed = F.rtrim("_text", F.lit(SPACES))
    blank = F.length(trimmed) == 0
    initial = F.substring("_role", 1, 1)
    slim = rows.select(*order, "_gone", initial.alias("initial"), blank.alias("blank"),
                       (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
                       _digest("_role", "_text").alias("same"))
    # where each role and text stands first; only those that are met again
    place = F.struct("turn", "_o", "_copy")
    firsts = (slim.where("NOT _gone AND NOT blank").groupBy("conv_id", "same")
              .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("conv_id").alias("fc"), F.col("same").alias("fs"), "first"))
    marked = slim.join(firsts, (F.col("conv_id").eqNullSafe(F.col("fc"))) & (F.col("same") == F.col("fs"))
                       & ~F.col("_gone") & ~F.col("blank"), "left")
    fault = (F.when(F.col("_gone"), F.lit(-1)).when(F.col("blank"), F.lit(0)).when(place > F.col("first"), F.lit(1))
             .when(F.col("truncated"), F.lit(2)).otherwise(F.lit(3)))
    facts = marked.select(*order, fault.alias("fault"), "initial")
    audits = (facts.repartition("conv_id").sortWithinPartitions(*order)
              .mapInArrow(_audits, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                   "cost long, audit string"))
    # the edits travel ahead of their conversation's texts
    text = rows.where("NOT _gone").select(*order, F.lit(1).alias("tag"), "_role", "_text")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = [F.lit(None).cast("long").alias(c) for c in counts]
    head = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("_o"),
                         F.lit(0).alias("_copy"), F.lit(0).alias("tag"), F.lit("").alias("_role"),
                         F.col("audit").alias("_text"), *counts)
    both = head.unionByName(text.select("*", *none))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "_o", "_copy")
            .mapInArrow(_texts, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                "cost long, audit string, repaired_sha256 string"))


def _order_key() -> Column:
    """Rows of one turn by role, then by a digest of the text, nulls first."""
    role = F.when(F.col("role").isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), F.col("role"), F.lit("\x00")))
    text = F.when(F.col("text").isNull(), F.lit("").cast("binary")).otherwise(_digest("text"))
    return F.concat(role.cast("binary"), text)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of rows sorted by conversation and place -> one row per conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    number = {k: i for i, k in enumerate(KINDS)}
    what = ("delete", "delete", "truncated", "ok")
    out: list[tuple] = []
    now = None

    class One:
        def __init__(self, key):
            self.key, self.kinds, self.faults = key, bytearray(), [0, 0, 0, 0]
            self.low = self.high = self.before = self.place = None
            self.turns = self.illegal = 0

        def add(self, turn, place, fault, initial):
            if place == self.place and fault:  # the row before once more
                fault = 1
            self.place = place
            self.faults[fault] += 1
            if turn is not None:  # sorted: a new number is a new turn
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            self.kinds.append(number[initial if initial in ("s", "u", "a") else "-", what[fault]])

        def row(self):
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.key, gaps, *self.faults[:3], self.illegal, *repair(bytes(self.kinds)))

    def batch():
        cols = list(zip(*out))
        types = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "_o", "fault", "initial")]
        for key, turn, o, fault, initial in zip(*cols):
            if now is None or key != now.key:
                if now is not None:
                    out.append(now.row())
                now = One(key)
            if fault >= 0:
                now.add(turn, (turn, o), fault, initial)
        if len(out) >= 1024:
            yield batch()
            out.clear()
    if now is not None:
        out.append(now.row())
    if out:
        yield batch()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's edits, then its rows in order -> its row with the digest."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out: list[tuple] = []

    def stream():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("tag", "conv_id", "_role", "_text", *counts)]
            yield from zip(*cols)

    def batch():
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          ["conv_id", *counts, "audit", "repaired_sha256"])

    rows = stream()
    for _, key, _, audit, *numbers in rows:  # a head; its rows are taken by the edits, one each
        sha, first = hashlib.sha256(), True
        for role, text in apply_edits(audit, ((r[2], r[3]) for r in rows)):
            sha.update((("" if first else "\n") + role + ":" + text).encode())
            first = False
        out.append((key, *numbers, audit, sha.hexdigest()))
        if len(out) >= 1024:
            yield batch()
            out.clear()
    if out:
        yield batch()
