"""Byte-pair encoding of whole texts by the tokenizers library, over Arrow batches.

A byte-pair tokenizer never merges across a pre-token's edge, and a single space between two
characters that aren't white space is such an edge. So a text falls into segments that the library
may encode on their own, and equal segments (words, mostly) have equal ids. A worker keeps the ids
of the segments it has met in a bounded memo and gives the library only new ones, many to a call.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker remembers before it starts anew, and the longest that it remembers.
MEMO, LONGEST = 500_000, 48
_SIGNS = frozenset(".,;:!?")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = r"[\s\v\pZ\x{85}\x{1c}-\x{1f}][\s\v\pZ\x{85}\x{1c}-\x{1f}]"


def byte_chars() -> dict[int, str]:
    """The byte-to-character table of byte-level tokenizers: printable Latin-1 stays, other bytes follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a special token's string in a text is ordinary text
    return t


def from_ranks(path: str, pattern: str):
    """A tokenizers BPE with the ranks of a .tiktoken file.

    A rank file has no merges: any two neighbours whose bytes together have a rank may merge, lowest
    rank first. Each token's merge is the split at which its parts meet when its own bytes are merged
    by lower ranks; tokens that lower ranks cannot build in two parts are only found whole
    (ignore_merges looks up whole matches first).
    """
    import base64

    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    to = byte_chars()
    name = {t: "".join(map(to.__getitem__, t)) for t in ranks}

    def parts(token: bytes, rank: int) -> list[bytes]:
        out = [token[i : i + 1] for i in range(len(token))]
        while True:
            best = min(((r, i) for i in range(len(out) - 1) if (r := ranks.get(out[i] + out[i + 1], rank)) < rank), default=None)
            if best is None:
                return out
            i = best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]

    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(two := parts(token, rank)) == 2:
            merges.append((name[two[0]], name[two[1]]))
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, by the reversed byte table; special tokens stand for their own string."""
    back = {c: b for b, c in byte_chars().items()}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    table = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        s = tokenizer.id_to_token(i)
        if i in special or s is None:
            table.append((special.get(i) or "").encode())
        else:
            table.append(bytes(back[c] for c in s))
    return table


class Encoder:
    """Whole texts to ids (bytes of little-endian unsigned 32-bit integers), segment by segment.

    spaced: a segment keeps the space before it (byte-level tokenizers); else white space is dropped
    by the tokenizer itself and segments have none.
    """

    def __init__(self, tokenizer, spaced: bool):
        self.t, self.spaced = tokenizer, spaced
        self.memo: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.marks = np.array([x.startswith("\u0120") if spaced else x.endswith("</w>") for x in names])
        tokenizer.model._resize_cache(0)  # the memo does its work

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def one(self, s: str) -> bytes:
        return self.ids(s).tobytes()

    def together(self, some: list[str], marks: np.ndarray, ends: bool, each: int, into: dict[str, bytes]) -> None:
        """Segments in one call; marked ids open (or end, each-th by each-th) a segment, or else nothing is stored."""
        ids = self.ids((" " if self.spaced else "") + " ".join(some))
        at = np.flatnonzero(marks[ids])
        if len(at) != len(some) * each:
            return
        raw, b = ids.tobytes(), 0
        stops = (at[each - 1 :: each] + 1) * 4 if ends else [*(at[1:] * 4), len(ids) * 4]
        for s, e in zip(some, map(int, stops), strict=True):
            into[s] = raw[b:e]
            b = e

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of segments that aren't remembered.

        Many go to the library in one text. With byte-level tokenizers a segment opens with its own
        space, the only one it has. With word-end tokenizers a segment of letters is one word, and a
        sign after it another, so each gives one or two ids that end words. Whatever doesn't count
        up is encoded on its own.
        """
        got: dict[str, bytes] = {}
        if self.spaced:
            groups = [(1, [s for s in new if s and " " not in s])]
        else:
            groups = [(1, [s for s in new if s.isalpha()]), (2, [s for s in new if s[-1:] in _SIGNS and s[:-1].isalpha()])]
        for each, some in groups:
            for a in range(0, len(some), 256):
                self.together(some[a : a + 256], self.marks, not self.spaced, each, got)
        lead = " " if self.spaced else ""
        for s in new:
            if s not in got:
                got[s] = self.one(lead + s)
        return got

    def known(self, segments: list[str]) -> list[bytes]:
        memo = self.memo
        got = list(map(memo.get, segments))
        new = [i for i, b in enumerate(got) if b is None]
        if new:
            extra = self.learn([segments[i] for i in new])
            for i in new:
                got[i] = extra[segments[i]]
            if len(memo) < MEMO:
                memo.update((s, b) for s, b in extra.items() if len(s) <= LONGEST)
        return got

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Segments of each text. Spaces next to other white space aren't edges for a tokenizer that keeps spaces."""
        out = pc.split_pattern(texts, " ")
        if self.spaced and (odd := pc.match_substring_regex(texts, _ODD)).true_count:
            own = [_CUT.split(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            out = pc.if_else(odd, pa.array(own, out.type), out)
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, with `end` after each, and where each text's begin (and the last ends)."""
        texts = texts.cast(pa.string())
        lists = self.cut(pc.fill_null(texts, ""))
        at = lists.offsets.to_numpy().astype("i8")
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy().astype("i4")
        ids = self.known(coded.dictionary.to_pylist())
        if self.spaced and len(words):  # a text's first segment has no space before it
            heads = pc.list_element(lists, 0).dictionary_encode()
            words[at[:-1]] = heads.indices.to_numpy() + len(ids)
            for h in heads.dictionary.to_pylist():
                if len(self.heads) > MEMO // 10:
                    self.heads.clear()
                if (b := self.heads.get(h)) is None:
                    b = self.heads[h] = self.one(h) if h else b""
                ids.append(b)
        if end is not None:
            words = np.insert(words, at[1:], len(ids))
            at = at + np.arange(len(at))
            ids.append(np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, ids), "i4", len(ids)) // 4
        starts = np.cumsum(sizes, dtype="i4") - sizes
        n = sizes[words]
        stops = np.concatenate([np.zeros(1, "i8"), np.cumsum(n)])
        flat = np.frombuffer(b"".join(ids), "<u4")
        where = np.repeat(starts[words] - stops[:-1].astype("i4"), n)
        where += np.arange(len(where), dtype="i4")
        return flat[where], stops[at]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; made once a process."""
    if (path, pattern) not in _ENCODERS:
        if pattern:
            _ENCODERS[path, pattern] = Encoder(from_ranks(path, pattern), True)
        else:
            with open(path, encoding="utf-8") as f:
                pre = json.load(f)["pre_tokenizer"]
            _ENCODERS[path, pattern] = Encoder(load(path), pre["type"] == "ByteLevel")
    return _ENCODERS[path, pattern]
