"""The memo of token ids: found by hash in a step or two, however many units it holds."""

import numpy as np
import pytest

from txrisk.llm import units
from txrisk.llm.words import hash_ranges


def _steps(table: units.SlotTable) -> np.ndarray:
    """How far from its first place each hash lies."""
    place = np.flatnonzero(table.table >= 0)
    return (place - table._places(table.keys[table.table[place]])) & (len(table.table) - 1)


def test_slots_are_found_in_few_steps():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**64, 300_000, dtype=np.uint64))
    rng.shuffle(h)
    t = units.SlotTable(bits=4)
    for part in np.array_split(h[:250_000], 7):  # grows several times
        assert (t.find(part) == -1).all()
        t.add(part)
    assert len(t) == 250_000 and (t.find(h[:250_000]) == np.arange(250_000)).all()
    assert (t.find(h[250_000:]) == -1).all()
    assert _steps(t).mean() < 1 and 2 * len(t) <= len(t.table)


def test_slots_with_equal_first_places_wrap_around():
    last = np.uint64(2**64 - 1)
    t = units.SlotTable(bits=6)
    h = last - np.arange(25, dtype=np.uint64)  # all begin at the last place
    t.add(h[:10])
    t.add(h[10:20])
    assert (t.find(h) == [*range(20), *[-1] * 5]).all()
    assert (t.find(np.zeros(0, np.uint64)) == []).all()
    assert t.find(np.array([5], np.uint64))[0] == -1  # its place holds a hash that was pushed on


def test_ids_over_many_slices_are_the_library_s(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = units.UnitEncoder(path)
    monkeypatch.setattr(np, "insert", None)  # no sorted memo is rewritten for each slice
    words = [f"{a}{b}é{'.' * (b % 3)}" for a in ("the", "Über", "x-", "''s", "　") for b in range(40)]
    rng = np.random.default_rng(5)
    for _ in range(6):
        texts = ["", *(" ".join(rng.choice(words, n)) + "\n" for n in rng.integers(1, 60, 20))]
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), off)
        want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_hashes_of_ranges_do_not_depend_on_what_lies_between():
    buf = np.frombuffer(b"one two three", np.uint8)
    whole = hash_ranges(buf, np.array([0, 3, 7]), np.array([3, 7, 13]))  # fills the buffer
    wide = np.frombuffer(b"#one# two## three", np.uint8)
    assert (whole == hash_ranges(wide, np.array([1, 5, 11]), np.array([4, 9, 17]))).all()
