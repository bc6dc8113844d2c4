"""Equality must not be fooled by texts that collide under every polynomial modulo a power of two."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import table  # noqa: E402

from keystrata.llm import bagminhash, iblt, runs, substrings  # noqa: E402

def hashed(words, lane=0):
    w = runs.Words(np.array([len(words)]), np.frombuffer(b" ".join(words), np.uint8))
    return runs.of_words(w.text, w.start, w.end, lane)


TURN = [bin(i).count("1") % 2 for i in range(1024)]
LEFT, RIGHT = "".join("ab"[x] for x in TURN), "".join("ba"[x] for x in TURN)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 15, 35])
def test_runs_are_equal_as_their_words_are(width):
    r = np.random.default_rng(width)
    words = [b"%d" % x for x in r.integers(0, 2, 300)]
    h = runs.of_runs(hashed(words), width)
    want = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    assert len(h) == len(want) and len(np.unique(h)) == len(set(want))
    first = {}
    assert all(first.setdefault(k, x) == x for k, x in zip(want, h.tolist(), strict=True))


def test_blocks_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    w = runs.Words(np.array([200, 300]), np.frombuffer(text, np.uint8))
    at = np.flatnonzero((w.left >= 7) & (w.place % 3 == 1))
    whole = w.windows(at, 7)
    monkeypatch.setattr(runs, "BLOCK", 16)
    assert (w.windows(at, 7) == whole).all()


def test_word_runs_of_thue_and_morse():
    a, b = ([b"xy"[t : t + 1] for t in turn] for turn in (TURN, [1 - t for t in TURN]))
    for lane in (0, 1):
        assert runs.of_runs(hashed(a, lane), 1024)[0] != runs.of_runs(hashed(b, lane), 1024)[0]


def test_words_of_any_length():
    words = [b"a" * n for n in range(1, 60)] + [b"a" * n + b"\x00" for n in range(1, 30)] + [b"\x00" * n for n in range(1, 30)] + [b"12345678", b"12345678\x00", b"12345678 "[:8] + b"9"]
    h = hashed(words * 2)
    assert len(np.unique(h)) == len(set(words)) and (h[: len(words)] == h[len(words) :]).all()


def test_lanes_differ():
    words = [b"m%d" % i for i in range(500)]
    a, b = hashed(words, 0), hashed(words, 1)
    assert len(np.unique(a)) == len(np.unique(b)) == 500 and not (a == b).any()


def test_substrings(spark):
    words = [f"w{i}" for i in range(34)]
    data = [[i, " ".join([*words[:17], odd, *words[17:]]), "en", "s", 1, None, 1] for i, odd in enumerate((LEFT, RIGHT))]
    assert [r.n_removed for r in substrings.deduplicate(table(spark, data)).collect()] == [0, 0]
    data.append([2, data[0][1], "en", "s", 1, None, 1])
    assert {r.doc_id: r.n_removed for r in substrings.deduplicate(table(spark, data)).collect()} == {0: 35, 1: 0, 2: 35}


def test_overlap():
    a, b = (bagminhash.normal(f"one two {x} four five six") for x in (LEFT, RIGHT))
    assert bagminhash.overlap([a, a], [b, a]).tolist() == [0.0, 1.0]


def test_paragraphs():
    _, key = iblt.paragraphs([f"{LEFT}".encode(), f"{RIGHT}".encode()])
    assert len(set(key.tolist())) == 2
