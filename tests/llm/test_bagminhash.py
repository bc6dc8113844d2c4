"""op 7 against brute force."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import bagminhash as b  # noqa: E402


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])


def jaccard(x, y):
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def classes(texts, similar=0.8):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= similar:
                a, c = sorted((find(i), find(j)))
                root[c] = a
    return [find(i) for i in range(len(texts))]


def partition(keys, names):
    out = {}
    for k, n in zip(keys, names, strict=True):
        out.setdefault(k, []).append(n)
    return sorted(sorted(map(str, v)) for v in out.values())


def varied(n=40, words=120, seed=3):
    """Texts in chains: each next one differs a little, so that ends of a chain are apart."""
    r = random.Random(seed)
    out = []
    for c in range(4):
        w = [f"w{r.randrange(400)}" for _ in range(words)]
        for _ in range(n // 4):
            out.append(" ".join(w))
            i = r.randrange(words)
            w = [*w[:i], f"n{r.randrange(9999)}", *w[i + 1 :]]
    return out


def test_signature_estimates_weighted_jaccard():
    r = random.Random(5)
    w = [f"a{r.randrange(30)}" for _ in range(400)]
    pairs = [(" ".join(w), " ".join(w[:300] + w[:60])), ("a b c d e " * 40, "a b c d e " * 25), (" ".join(w[:8]), " ".join(w[1:9])), ("x", "x")]
    texts = [b.normal(t) for p in pairs for t in p]
    doc, h = b.shingles(texts)
    s = b.signatures(doc, h, len(texts), 4000)
    for k, (x, y) in enumerate(pairs):
        want = jaccard(bag(x), bag(y))
        assert abs((s[2 * k] == s[2 * k + 1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000) + 1e-9
        assert abs(b.overlap([texts[2 * k]], [texts[2 * k + 1]])[0] - want) < 1e-9


def test_classes_equal_brute_force(spark):
    data = hard(40)
    data[20][0] = 4999  # else two rows, and so two classes, go by one id
    data += [[5000 + i, t, "en", "s", len(t), None, 1] for i, t in enumerate(varied())]
    data += [[7000 + i, data[50][1], "en", "s", 1, None, 1] for i in range(60)]
    got = b.deduplicate(table(spark, data)).collect()
    assert len(got) == len(data) and got[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "start", "class_id", "class_size", "kept"]
    want = partition(classes([x[1] for x in data]), [x[0] for x in data])
    assert partition([r.class_id if r.class_id is not None else -1 for r in got], [r.doc_id for r in got]) == want
    assert sum(r.kept for r in got) == len(want) and all(r.doc_id == r.class_id for r in got if r.kept)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_members_that_the_leader_misses(spark, monkeypatch):
    """One band of one row: buckets hold unlike documents, so blocks of a family must find every link among them."""
    monkeypatch.setattr(b, "MEETING", 1500)
    texts = varied(48, 30, 9)
    data = [[i, t, "en", "s", len(t), None, 1] for i, t in enumerate(texts)]
    got = b.deduplicate(table(spark, data), bands=8, rows=1).collect()
    assert partition([r.class_id for r in got], [r.doc_id for r in got]) == partition(classes(texts), range(len(texts)))


def test_empty(spark):
    assert b.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
