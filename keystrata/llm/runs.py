"""Hashes of words, and of runs of consecutive words.

A word's hash takes its bytes in eights, each joined to what came before; a run's hash joins the hashes
of its halves. Joining is one-to-one in either side and not linear, so no arrangement of letters or words (as
there is for polynomials modulo a power of two) makes unlike runs alike by rule. Two lanes with seeds of
their own give 128 bits. All words of a block are hashed at once.
"""

from __future__ import annotations

import numpy as np

#: Words that are hashed at a time, and the lanes' seeds.
BLOCK, SEEDS = 1 << 17, (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: What of eight bytes belongs to a word that has so many left.
_HELD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) * np.uint64(0x9E3779B97F4A7C15) + right)


def of_words(text: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the words that begin and end at these bytes."""
    eights = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) + np.uint64(SEEDS[lane]))
    live, at = np.arange(len(start)), start
    while len(live):
        out[live] = join(out[live], eights[at] & _HELD[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def of_runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each word on, as far as there are so many."""
    done, size, out = 0, 1, None
    while True:
        if width & size:
            out = h if out is None else join(out[: max(0, len(h) - done)], h[done:])
            done += size
        if done == width:
            return out[: max(0, len(out))]
        h = join(h[: max(0, len(h) - size)], h[size:])
        size *= 2


class Words:
    """The words of several texts, joined by one space: their bytes, place in the text, and whose they are."""

    def __init__(self, counts: np.ndarray, text: np.ndarray):
        self.counts, self.text = counts, text
        gaps = np.flatnonzero(text == 32)
        any_ = int(len(text) > 0)
        self.start = np.concatenate([np.zeros(any_, "i8"), gaps + 1])
        self.end = np.concatenate([gaps, np.full(any_, len(text), "i8")])
        self.first = np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.left = counts[self.doc] - self.place

    def windows(self, at: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
        """For the words `at` (rising) the hash of `width` words from there on."""
        out = np.empty(len(at), np.uint64)
        k = 0
        while k < len(at):
            lo = at[k]
            stop = int(np.searchsorted(at, lo + BLOCK))
            hi, origin = at[stop - 1] + width, self.start[lo]
            words = of_words(self.text[origin : self.end[hi - 1]], self.start[lo:hi] - origin, self.end[lo:hi] - origin, lane)
            out[k:stop] = of_runs(words, width)[at[k:stop] - lo]
            k = stop
        return out


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of the key columns in order, where each row went, and how many there were."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    s = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in s])
    group = np.cumsum(new) - 1
    back = np.empty(len(order), "i8")
    back[order] = group
    return [k[new] for k in s], back, np.bincount(group, minlength=int(new.sum()))
