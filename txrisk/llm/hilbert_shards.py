"""Operator 4: shards cut from a Hilbert-curve order of metadata.

Four dimensions (language, source, text bytes, id) are quantised to 4 bits at
their own quantiles; the Hilbert index of the 65 536 possible cells orders the
rows, and runs of equal counts become shards, so each shard spans a compact
box in all dimensions and readers can skip files by their minima and maxima.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.ranks import rank_within
from txrisk.llm.spark_io import fresh_name, materialize, utf8_len

BITS = 4
ACCURACY = 10_000


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows of ``coords``).

    Coordinates are turned to the transposed index by undoing excess rotations
    from the highest bit down, then Gray-coded, then interleaved.
    """
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            invert = (x[i] & q) != 0
            swap = np.where(invert, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(invert, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _string_cuts(base: DataFrame, name: str) -> list[str]:
    """Quantiles of whole strings: for each step the least value that so many rows do not exceed."""
    counts = materialize(base.groupBy(name).count().repartitionByRange(name)
                         .withColumn("part", F.spark_partition_id()), "shard-values")
    sums = sorted((r["part"], r["n"]) for r in counts.groupBy("part").agg(F.sum("count").alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in sums)]).tolist()
    before = base.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sums, ends)] or [(0, 0)], "part int, before long")
    up = F.sum("count").over(Window.partitionBy("part").orderBy(name)) + F.col("before")
    ranked = counts.join(F.broadcast(before), "part").select(name, up.alias("up"))
    cuts = ranked.agg(*[F.min(F.when(F.col("up") * 2**BITS >= ends[-1] * k, F.col(name))).alias(f"c{k}")
                        for k in range(1, 2**BITS)]).first()
    return [c for c in cuts if c is not None]


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for each row.

    Law ``rows``: shards hold equal counts, at most one apart; slots are gapless
    from 0 along the curve (rows of a cell in the order of a row hash).  Null
    texts count as empty (crc32 0, size 8), null metadata as the least value,
    repeated rows get a slot each, an empty table gives none; other columns are
    not read.  ``grown_shard`` is null: it belongs to another law.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_len(text) + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(d) for c, d in (("lang", "d0"), ("source", "d1"))])
    base = materialize(base.select("*", F.col("size").alias("d2"),
                                   F.coalesce("doc_id", F.lit(-2**63)).alias("d3"),
                                   F.monotonically_increasing_id().alias("rid")), "shard-rows")
    steps = [i / 2**BITS for i in range(1, 2**BITS)]
    cuts = base.agg(*[F.percentile_approx(f"d{i}", steps, ACCURACY).alias(f"d{i}") for i in (2, 3)]).first().asDict()
    cuts |= {d: _string_cuts(base, d) for d in ("d0", "d1")}
    cell = F.lit(0)
    for i in range(4):
        digit = F.lit(0)
        for c in sorted(set(cuts[f"d{i}"] or [])):
            digit = digit + (F.col(f"d{i}") > F.lit(c)).cast("int")
        cell = cell * 2**BITS + digit
    cells = base.select("doc_id", "size", "text_crc32", "rid", cell.cast("long").alias("cell"))
    # at most 2^16 cells, whatever the number of rows
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    codes = np.array(sorted(counts), np.int64)
    coords = np.stack([(codes >> (BITS * (3 - i))) & (2**BITS - 1) for i in range(4)], 1)
    index = hilbert_index(coords, BITS)
    order = np.argsort(index)
    first = dict(zip(codes[order].tolist(),
                     np.concatenate([[0], np.cumsum([counts[c] for c in codes[order].tolist()])])[:-1].tolist()))
    total = sum(counts.values())
    table = docs.sparkSession.createDataFrame(
        [(c, int(h), first[c]) for c, h in zip(codes.tolist(), index.tolist())] or [(0, 0, 0)],
        "cell long, hilbert long, _first long")
    least, extra = total // shards, total % shards
    at = F.col("_first") + F.col("rank")
    wide = extra * (least + 1)  # rows in the shards that hold one more
    shard = F.when(at < wide, F.floor(at / F.lit(least + 1))).otherwise(
        F.floor((at - wide) / F.lit(max(least, 1))) + extra).cast("int")
    start = F.col("shard") * least + F.least(F.col("shard"), F.lit(extra))
    return (rank_within(cells, "cell", counts).join(F.broadcast(table), "cell")
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                    at.alias("at"), "hilbert")
            .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("at") - start).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "hilbert"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write ``docs`` as Parquet in folders ``shard=N``, rows along the curve.

    Joins the plan back by (doc_id, crc32 of the text); rows that repeat both go
    together.  All columns are kept, whatever their names, but one named
    ``shard``, which the folder replaces.  Null ids and texts (read as empty) are
    placed like others; an empty table writes no rows.
    """
    own, crc_of, place = (fresh_name(docs.columns, c) for c in ("shard_id", "shard_crc", "shard_slot"))
    docs = docs.drop("shard")
    plan = materialize(shard_rows(docs, shards), "shard-plan").groupBy("doc_id", "text_crc32").agg(
        F.min("shard").alias("shard"), F.min("slot").alias(place))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    plan = plan.select(F.col("doc_id").alias(own), F.col("text_crc32").alias(crc_of), "shard", place)
    (docs.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (crc == F.col(crc_of)))
     .drop(own, crc_of).repartitionByRange(shards * 4, "shard", place)
     .sortWithinPartitions("shard", place).drop(place)
     .write.partitionBy("shard").parquet(path))
