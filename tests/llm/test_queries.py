"""Every registered query of the corpus operators over a whole table, against brute force or SQL."""

import base64
import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_bagminhash import classes, partition  # noqa: E402
from test_substrings import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from keystrata.llm import bpe  # noqa: E402

DATA = "/root/testdata/sf0.001"
Q = entry.queries()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_one_query_for_each_operator():
    names = [n for n in Q if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in Q


def test_op1(spark, docs):
    got = {r.doc_id: r for r in Q["op1_quality_rules"](spark, DATA).collect()}
    assert got.keys() == {d for d, _ in docs}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_op2(spark, docs):
    got = {r.doc_id: r for r in Q["op2_fingerprints"](spark, DATA).collect()}
    fall = docs[::-1]
    for i, (d, t) in enumerate(fall):
        after, half = fall[(i + 1) % len(fall)][1], len(t) // 2
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - half] + after[:half]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got.values() if r.n_chars > 1500]
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.mean([r.near_next for r in long])
    by = {}
    assert all(by.setdefault(t, got[d].fingerprint) == got[d].fingerprint for d, t in docs) and len(set(by.values())) == len(by)


def test_op3(spark):
    df = Q["op3_exact_dedup"](spark, DATA)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cur = c.execute(entry.oracle_sql()["op3_exact_dedup"])
    names = [x[0] for x in cur.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())


def test_op4(spark, docs):
    t, at, want = bpe.load(P.path("byte_bpe_50k.json")), 0, []
    for d, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in Q["op4_orc_tokens"](spark, DATA).collect()) == want


def test_op5(spark, docs):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, len(i := own.encode_ordinary(t)), sha(" ".join(map(str, i))), sha(t)) for d, t in docs]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q["op5_byte_bpe"](spark, DATA).collect()) == want


def test_op7(spark, docs):
    got = Q["op7_bagminhash"](spark, DATA).collect()
    assert partition([r.class_id for r in got], [r.doc_id for r in got]) == partition(classes([t for _, t in docs]), [d for d, _ in docs])


def test_op8(spark, docs):
    t, want = bpe.load(P.path("word_bpe_49k.json")), []
    for d, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(p := ids[a : a + 2048]), crc(p)) for k, a in enumerate(range(0, len(ids), 2048))]
    got = Q["op8_best_fit"](spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * sum(used.values()) / 2048 + 1


def plain_tokens(word, scores, low):
    """Tokens of a word's best segmentation, of all cuts by forward scores alone; the fewest of equally good ones."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            part, (s, n) = word[start:end], best[start]
            if part in scores:
                options.append((s + scores[part], -(n + 1)))
            elif end - start == 1:
                options.append((s + low - 10, -(n + len(part.encode()))))
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_op9(spark, docs):
    from keystrata.llm.token_counts import load

    scores = load(P.path("piece_bpe_32k.model"))
    low, alone = min(scores.values()), {}
    for _, t in docs:
        for w in t.split():
            if w not in alone:
                alone[w] = plain_tokens("\u2581" + w, scores, low)
    got = {r.doc_id: r for r in Q["op9_token_counts"](spark, DATA).collect()}
    assert got.keys() == {d for d, _ in docs}
    for d, t in docs:
        assert (got[d].n_pretokens, got[d].n_tokens) == (len(t.split()), sum(alone[w] for w in t.split()))


def test_op10(spark, docs):
    want = Counter()
    for (d, n, gone, kept), c in brute([[d, t] for d, t in docs], 35).items():
        want[d, n, gone, sha(kept)] += c
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in Q["op10_substrings"](spark, DATA).collect()) == want
