"""Token counts of a unigram model, by dynamic programming along a trie of pre-tokens.

A pre-token's best segmentation extends that of its prefixes: the forward score of a prefix is the
best of the scores before its last piece plus that piece's. So the distinct new pre-tokens of a batch
are put in a trie and walked depth first (in sorted order, the walk's stack is the trie's path):
every shared prefix is scored once, and where a pre-token ends its number of tokens is stored. A
document's count sums its pre-tokens'. Counting is row by row: no shuffle; a worker's store of terminal counts
is bounded and starts anew when full.

The pieces are those of a public vocabulary. Its model is a byte-pair one without probabilities, so
pieces get the log-probabilities of the Zipf-Mandelbrot law at their rank. A character without a
piece costs the least score less 10 and counts as its bytes (byte fallback).

Defined results: pre-tokens are runs of anything but white space, with the vocabulary's word mark before; null
and empty texts count 0; a very long text is one row, a very long pre-token is walked whole and not remembered; repeated
rows, shared and null ids are counted each; an empty table gives none. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import dtype, map_batches

MARK, STORE, LONGEST = "▁", 400_000, 64


def load(path: str) -> dict[str, float]:
    """Scores of a sentencepiece file's ordinary pieces by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces, 1)}


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values()) - 10
        self.tails = {p[i:] for p in scores for i in range(len(p))}  # longer pieces may end in these
        self.store: dict[str, int] = {}

    def walk(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word's best segmentation; words are pre-tokens without mark."""
        scores, tails, out = self.scores, self.tails, {}
        best, many, last = [0.0], [0], ""
        for plain in sorted(words):
            word = MARK + plain
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], many[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                s = scores.get(char)
                if s is None:
                    top, n = best[end - 1] + self.unknown, many[end - 1] + len(char.encode())
                else:
                    top, n = best[end - 1] + s, many[end - 1] + 1
                for start in range(end - 2, -1, -1):
                    part = word[start:end]
                    if part not in tails:
                        break
                    s = scores.get(part)
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and many[start] + 1 < n:
                            top, n = s, many[start] + 1
                best.append(top)
                many.append(n)
            out[plain] = many[-1]
            last = word
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        words = [t.split() for t in texts]
        seen: set[str] = set()
        for w in words:
            seen.update(w)
        store = self.store
        new = self.walk([w for w in seen if w not in store])
        if len(store) > STORE:
            store.clear()
            new |= self.walk([w for w in seen if w not in new])
        store.update((w, n) for w, n in new.items() if len(w) <= LONGEST)
        near = {w: new[w] if w in new else store[w] for w in seen}
        return [len(w) for w in words], [sum([near[x] for x in w]) for w in words]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens long, n_tokens long."""

    def run(batch):
        import pyarrow as pa

        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(load(path))
        a, b = _COUNTERS[path].count([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[id_col, "n_pretokens", "n_tokens"])

    return map_batches(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {dtype(docs, id_col)}, n_pretokens bigint, n_tokens bigint")
