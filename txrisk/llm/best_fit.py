"""Operator 5: best-fit packing planned on the histogram of lengths.

Texts are tokenized once and only the lengths and checksums of their pieces
are kept.  The histogram (as many entries as a sequence has tokens) is planned
by best fit over counts: all pieces of a length are placed at once, into runs
of equal sequences.  Pieces then take planned places by their rank within
their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.ranks import rank_within
from txrisk.llm.spark_io import materialize, text_slices
from txrisk.llm.token_counts import tokenizer_path
from txrisk.llm.units import encoder

SLICE_BYTES = 1 << 20  # of texts tokenized at a time: a task holds some forty times as much
PLAN = np.dtype([("length", "i8"), ("rank", "i8"), ("per", "i8"), ("seq", "i8"), ("at", "i8")])


def plan_best_fit(histogram: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Places of all pieces, and the number of sequences.

    Lengths go in falling order, each into the sequences with the least room
    that holds it, filled before the next.  Sequences with equal room are kept
    as runs of numbers, so the work depends on the number of lengths, not of
    pieces.  A row says: the pieces of ``length`` from ``rank`` on lie ``per``
    to a sequence, from sequence ``seq`` and position ``at`` on.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []
    used, rows = 0, []

    def give(left: int, run: tuple[int, int]) -> None:
        if left and run[1]:
            if left not in free:
                bisect.insort(rooms, left)
                free[left] = []
            free[left].append(run)

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                seq, many = free[left].pop()
                if not free[left]:
                    del free[left]
                    rooms.pop(i)
            else:
                left, seq = room, used
                many = -(-todo // (room // length))
                used += many
            per = left // length
            full = min(many, todo // per)
            if full:
                rows.append((length, rank, per, seq, room - left))
                give(left - per * length, (seq, full))
                todo, rank = todo - full * per, rank + full * per
            if full < many:
                if todo:  # the last sequence of the run gets fewer
                    rows.append((length, rank, todo, seq + full, room - left))
                    give(left - todo * length, (seq + full, 1))
                    full, rank, todo = full + 1, rank + todo, 0
                give(left, (seq + full, many - full))
    out = np.array(rows, PLAN)
    return out[np.lexsort((out["rank"], out["length"]))], used


def piece_table(docs: DataFrame, tokenizer: str, room: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for rows, buf, off in text_slices(batches, limit=SLICE_BYTES):
            ids, counts = enc.encode(buf, off)
            docs_, piece, start, length, crc = [], [], [], [], []
            at = 0
            for d, n in enumerate(counts.tolist()):
                own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                cuts = [0, *range((n + 1) % room or room, n + 2, room)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    docs_.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(docs_, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", room: int = 2048,
                   end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A document is the ids of its text (null: empty), then ``end_id``.  Longer
    ones than ``room`` are cut from their end, so the first piece may be
    shorter.  Null ids and repeated rows are packed like any other, an empty
    table gives no rows, other columns are not read.
    """
    pieces = piece_table(docs, tokenizer, room, end_id)
    pieces = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `room` rows
    plan, _ = plan_best_fit(counts, room)
    keys = plan["length"] << 44 | plan["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - row["rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(row["seq"] + k // row["per"], pa.int64()),
                 pa.array(row["at"] + k % row["per"] * length, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (rank_within(pieces, "length", counts)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                               "sequence_id long, offset long"))
