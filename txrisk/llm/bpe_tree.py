"""Operator 9: byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves; leaves are encoded, and two
neighbours are joined by re-encoding a window around their border.  The
window grows, doubling, until it holds on either side a safe cut: ASCII white
space after a character that is no white space.  No match of the
pre-tokenizer's pattern runs over such a cut and none looks past it, in the
halves as in the whole, so the ids outside the window are those of the whole
text.  If a half has no safe cut, the window takes all of it.  Decoding joins
bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import text_slices
from txrisk.llm.units import ends_safely
from txrisk.llm.words import SPACE

LEAF_CHARS = 4096
FIRST_WINDOW = 16  # tokens taken from either side at first


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken
        self.leaf = leaf
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.names = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text (uint32)."""
        if len(text) <= self.leaf:
            return np.array(self.enc.encode_ordinary(text), np.uint32)
        mid = len(text) // 2
        return self.join(self.encode(text[:mid]), self.encode(text[mid:]))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined texts, from those of either part."""
        i, head = self._edge(left, from_end=True)
        j, tail = self._edge(right, from_end=False)
        middle = self.enc.encode_ordinary((head + tail).decode("utf-8"))
        return np.concatenate([left[:i], np.array(middle, np.uint32), right[j:]])

    def _edge(self, ids: np.ndarray, from_end: bool) -> tuple[int, bytes]:
        """Token index of the safe cut nearest to the border, and the bytes between."""
        k = FIRST_WINDOW
        while True:
            part = (ids[-k:] if from_end else ids[:k]).tolist()
            pieces = [self.bytes[t] for t in part]
            raw = b"".join(pieces)
            buf = np.frombuffer(raw, np.uint8)
            cut = np.flatnonzero(SPACE[buf[1:]] & ~SPACE[buf[:-1]]) + 1
            # a window may begin inside a character: judge cuts after a whole one
            cut = cut[ends_safely(buf, cut) & (cut >= (0 if k >= len(ids) else 4))]
            if len(cut):
                at = int(cut[-1] if from_end else cut[0])
                n = int(np.searchsorted(np.cumsum([len(p) for p in pieces]), at, side="left")) + 1
                return (len(ids) - len(part) + n, raw[at:]) if from_end else (n, raw[:at])
            if k >= len(ids):
                return (0, raw) if from_end else (len(ids), raw)
            k *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, halves joined up the tree."""
        if len(ids) <= self.leaf:
            return b"".join([self.bytes[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def digest(self, ids: np.ndarray) -> str:
        """sha256 of the decimal ids with commas between."""
        h = hashlib.sha256()
        for a in range(0, len(ids), 1 << 16):
            h.update((("," if a else "") + ",".join([self.names[i] for i in ids[a:a + (1 << 16)].tolist()])).encode())
        return h.hexdigest()


_CODECS: dict[str, TreeCodec] = {}


def codec(name: str) -> TreeCodec:
    """The worker's codec of a rank file (kept between tasks)."""
    if name not in _CODECS:
        import public_tokenizers as P
        with open(P.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[name] = TreeCodec(ranks, P.PATTERN)
    return _CODECS[name]


def _schema(extra: str) -> str:
    return "doc_id long, " + extra


def encode_documents(docs: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and ids (array<int>) of each row.

    A null text counts as empty (no ids), a null doc_id stays null, repeated
    rows are encoded each, an empty table gives none; other columns are not
    read.  A text of any length is encoded whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for rows, buf, off in text_slices(batches):
            ids = [c.encode(buf[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                ["doc_id", "ids"])

    return _slim(docs).mapInArrow(run, _schema("ids array<int>"))


def decode_ids(encoded: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and decoded (binary) from ``encode_documents``' rows; null ids decode to nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for b in batches:
            raw = [c.decode(np.array(x.as_py() or [], np.uint32)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, _schema("decoded binary"))


def round_trip(docs: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids and
    keeps digests only.  Same rules for nulls and repeats as ``encode_documents``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for rows, buf, off in text_slices(batches):
            n, a_hash, b_hash = [], [], []
            for a, b in zip(off[:-1], off[1:]):
                ids = c.encode(buf[a:b].tobytes().decode("utf-8", "replace"))
                n.append(len(ids))
                a_hash.append(c.digest(ids))
                b_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(a_hash), pa.array(b_hash)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs).mapInArrow(run, _schema("n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
