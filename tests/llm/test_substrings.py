"""op 10 against brute force."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import substrings  # noqa: E402


def brute(data, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", x[1] or "") for x in data]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for x, w in zip(data, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[x[0], len(w), len(gone), " ".join(t for i, t in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("window", [35, 8, 1])
def test_equals_brute_force(spark, window, monkeypatch):
    data = hard(80)
    shared = " ".join(f"p{i}" for i in range(60))
    for i, cut in ((40, 0), (41, 120), (50, 33), (60, 99)):
        data[i][1] = data[i][1] + " " + shared[cut:] + " " + data[i + 1][1]
    data[70][1] = "a b " * 60
    data[71][1] = shared + " x " + shared
    monkeypatch.setattr(substrings, "SLICE", 900)
    got = substrings.deduplicate(table(spark, data), window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(data, window)


@pytest.mark.parametrize("window", [35, 50, 8, 3, 2, 1])
def test_cover_has_every_difference(window):
    p, flags = substrings.cover(window)
    have = {(a - b) % p for a in range(p) if flags[a] for b in range(p) if flags[b]}
    assert have == set(range(p)) and 1 <= p <= window


def test_empty(spark):
    assert substrings.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
