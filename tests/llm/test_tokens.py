"""ops 4, 5 and 8 against the libraries on whole texts."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import bpe, byte_bpe, orc_tokens, packing  # noqa: E402


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_round_trip(spark):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    how = {"path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}
    data = hard()
    got = byte_bpe.decode(byte_bpe.encode(table(spark, data), **how), **how).collect()
    want = Counter((x[0], tuple(own.encode_ordinary(x[1] or "")), (x[1] or "").encode()) for x in data)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_rank_file_equals_merge_file(spark):
    a, b = bpe.encoder(P.path("byte_bpe_50k.json")), bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    import pyarrow as pa

    odd = ["", " ", "  a", "a  ", " a b ", "a   b", "a\u00a0 b", "a \u00a0 b", "\x1c a\x1cb", "'s re don't", "0" * 300, "a\u0085 \tb", "x" * 90 + " y" * 3, "\u1680 a\u3000 "]
    texts = [x[1] or "" for x in hard()] + odd
    (x, at), (y, _) = a.encode(pa.array(texts)), b.encode(pa.array(texts))
    assert x.tolist() == y.tolist()
    for t, i, j in zip(texts, at, at[1:]):
        assert x[i:j].tolist() == a.t.encode(t, add_special_tokens=False).ids, t
    w = bpe.encoder(P.path("word_bpe_49k.json"))
    z, at = w.encode(pa.array([*texts, "İSTANBUL'S o'clock.", None]))
    for t, i, j in zip([*texts, "İSTANBUL'S o'clock.", ""], at, at[1:]):
        assert z[i:j].tolist() == w.t.encode(t, add_special_tokens=False).ids, t


def test_offsets_and_split_characters(spark):
    how = {"path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}
    r = byte_bpe.encode(spark.createDataFrame([(1, "a 𝒳y é")], "doc_id long, text string"), offsets=True, **how).first()
    table_ = bpe.token_bytes(bpe.encoder(**how).t)
    assert r.token_start[0] == 0 and r.token_end[-1] == 6 and all(a < b for a, b in zip(r.token_start, r.token_end))
    assert max(b - a for a, b in zip(r.token_start, r.token_end)) <= 2
    pieces = [[i] for i in r.ids]
    assert "".join(byte_bpe.decode_stream(pieces, table_)) == "a 𝒳y é"


def test_orc_files(spark, tmp_path):
    t = bpe.load(P.path("byte_bpe_50k.json"))
    data = hard()
    files = orc_tokens.write_tokens(table(spark, data), str(tmp_path / "o"), P.path("byte_bpe_50k.json"))
    rows = orc_tokens.with_crc(orc_tokens.with_start(files).select("doc_id", "start", "n_tokens", "ids")).collect()
    ids = {(x[0], x[1]): t.encode(x[1] or "", add_special_tokens=False).ids + [2] for x in data}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((x[0], len(v := ids[x[0], x[1]]), crc(v)) for x in data)
    at, last = 0, None
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.doc_id is not None and r.doc_id >= last))
        at, last = at + r.n_tokens, r.doc_id
    import pyarrow.orc as orc

    assert sum(orc.ORCFile(p).nrows for p in Path(tmp_path, "o").glob("*.orc")) == len(data)
    assert files.filter("doc_id = 63").count() == 2
    assert orc_tokens.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), P.path("byte_bpe_50k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if i is None:
            gaps.append(capacity - x)
        else:
            gaps[i] -= x
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_are_best_fit(seed):
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 65, 300), r.integers(1, 9, 40 * seed), np.full(30, 33)])
    runs = packing.supersteps(Counter(lengths.tolist()), 64)
    firsts = [x[0] for x in runs]
    place = defaultdict(list)
    for rank, n in enumerate(sorted(lengths.tolist(), reverse=True)):
        first, length, each, seq, used = runs[np.searchsorted(firsts, rank, "right") - 1]
        assert length == n
        place[seq + (rank - first) // each].append((used + (rank - first) % each * length, n))
    for got in place.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at <= 64
    assert len(place) == best_fit_decreasing(lengths.tolist(), 64)


def test_packing(spark):
    t = bpe.load(P.path("word_bpe_49k.json"))
    data = hard()
    got = packing.pack(table(spark, data), P.path("word_bpe_49k.json")).collect()
    want = Counter()
    for x in data:
        ids = t.encode(x[1] or "", add_special_tokens=False).ids + [0]
        want.update((x[0], k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == best_fit_decreasing([r.length for r in got], 2048)
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0


def test_byte_bpe_of_an_empty_table(spark):
    how = {"path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}
    assert byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA), offsets=True, **how), **how).count() == 0
