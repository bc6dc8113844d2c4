"""ops 2 and 9 against brute force."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import iblt, token_counts  # noqa: E402


def units(text):
    """Pieces of a text with how often each occurred before, cut byte by byte by the rule."""
    raw, out, seen, start = text.encode() + b"\n", set(), Counter(), 0
    for i, c in enumerate(raw):
        cut = c == 10
        if c == 32 and i >= 6:
            h = 0
            for k in range(6):
                h ^= int(iblt._NEAR[k][raw[i - 1 - k]])
            cut = h % iblt.CUT == 0
        if cut:
            if i > start:
                out.add((raw[start:i], seen[raw[start:i]]))
                seen[raw[start:i]] += 1
            start = i + 1
    return out


def test_peeling_gives_the_difference():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, 300, dtype=np.uint64), r.integers(0, 2**64, 40, dtype=np.uint64)
    left, right = iblt.sketch(np.zeros(300, "i8"), a, 1, 64), iblt.sketch(np.zeros(310, "i8"), np.concatenate([a[30:], b]), 1, 64)
    _, keys, side, ok = left.minus(right).peel()
    assert ok.all() and set(keys[side > 0].tolist()) == set(a[:30].tolist()) and set(keys[side < 0].tolist()) == set(b.tolist())


def test_fingerprints(spark):
    data = hard(70, words=200)
    got = iblt.fingerprints(table(spark, data)).collect()
    assert len(got) == len(data)
    texts = [(x[0], x[1] or "") for x in data if data.count(x) == 1 and sum(y[0] == x[0] for y in data) == 1 and x[0] is not None]
    order = sorted(((-1 if x[0] is None else x[0], x[1] or "") for x in data), reverse=True)
    by = {(r.doc_id, r.n_chars): r for r in got}
    seen = {}
    for d, t in texts:
        r = by[d, len(t)]
        i = order.index((d, t))
        options = {order[i + 1][1] if i + 1 < len(order) else order[0][1]}
        options |= {x[1] for x in order if i + 1 < len(order) and x[0] == order[i + 1][0]}  # ties
        edits = {iblt.edit(t, a): a for a in options}
        edited = next(e for e in edits if hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256)
        for name, other in (("near_edited", edited), ("near_next", edits[edited])):
            x, y = units(t), units(other)
            assert abs(r[name] - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-9
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(seen.values())) == len(seen) or "" in seen
    one = iblt.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert iblt.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_equal_the_library(spark):
    from tokenizers import models

    scores = token_counts.load(P.path("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", -1000.0) for i in range(256)), *scores.items()], 0, True)
    low = min(scores.values())
    data = hard(60)
    data[9][1] = "Übergrößen: 東京 naïveté 12345 ħħħ xx́ 🧿🧿 " + "ab" * 90
    words = {w for x in data for w in (x[1] or "").split()}
    own = token_counts.Counter(scores).walk(list(words))
    known = set("".join(scores))
    for w in words:
        if set(w) <= known:  # the library's unknown penalty follows its own least score
            assert own[w] == len(model.tokenize("▁" + w)), w
    alone = {w: token_counts.Counter(scores).walk([w])[w] for w in list(words)[:60]}
    assert all(own[w] == n for w, n in alone.items()) and low < 0
    got = token_counts.count_tokens(table(spark, data), P.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in got) == Counter((x[0], len((x[1] or "").split()), sum(own[w] for w in (x[1] or "").split())) for x in data)
    assert own["🧿🧿"] >= 8 and token_counts.count_tokens(spark.createDataFrame([], SCHEMA), P.path("piece_bpe_32k.model")).count() == 0


def test_batches_keep_to_bytes():
    import pyarrow as pa

    texts = pa.array(["a" * 10] * 1030 + ["b" * (5 << 20), None, "c" * (3 << 20), "d" * (2 << 20)])
    got = iblt.runs_of(texts)
    assert got == [(0, 512), (512, 512), (1024, 6), (1030, 1), (1031, 2), (1033, 1)] and iblt.runs_of(pa.array([], pa.string())) == []


def test_neighbours_meet_across_partitions(spark):
    """Many partitions of a document or none: each document's neighbour is the next one, whatever partition that is in."""
    data = [(i, f"text number {i} " * (i % 5)) for i in range(40)]
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(data, "doc_id long, text string"), partitions=64).collect()}
    for i, t in data:
        after = data[(i - 1) % 40][1]
        assert got[i].edited_sha256 == hashlib.sha256(iblt.edit(t, after).encode()).hexdigest()
