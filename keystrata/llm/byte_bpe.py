"""Byte-level BPE encoding and decoding over Arrow batches.

encode() gives token ids (and, if asked for, character offsets), decode() reverses the byte table.
Both are row by row: no shuffle, no state that grows, nothing to recover but the task itself.

Defined results: a null text counts as empty and gives no ids; ids and other nulls pass through;
repeated rows give repeated results; a very long text is encoded as one row; an empty table gives none; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.bpe import encoder, token_bytes
from keystrata.llm.common import dtype, map_batches, text_of


def char_offsets(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; a token that holds part of a character covers all of it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    stop = np.cumsum(sizes[ids])
    start = stop - sizes[ids]
    return char[start].astype("i4"), (char[stop - 1] + 1).astype("i4")


_TABLES: dict[tuple, list[bytes]] = {}


def table_of(path: str, pattern: str | None) -> list[bytes]:
    """A vocabulary's bytes by id, made once a worker."""
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = token_bytes(encoder(path, pattern).t)
    return _TABLES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id_col, ids array<int>; with offsets also token_start, token_end array<int> (code points, end exclusive).

    path: a tokenizers file, or with pattern a file of byte ranks and the expression that splits texts.
    """

    def run(batch):
        import pyarrow as pa

        e = encoder(path, pattern)
        ids, ends = e.encode(batch.column(1))
        lists = [ids.view("i4")]
        if offsets:
            sizes = np.array([len(x) for x in table_of(path, pattern)])
            pairs = [char_offsets(t, ids[a:b], sizes) for t, a, b in zip(batch.column(1).to_pylist(), ends, ends[1:])]
            lists += [np.concatenate([p[k] for p in pairs] or [np.zeros(0, "i4")]) for k in (0, 1)]
        columns = [pa.ListArray.from_arrays(ends.astype("i4"), x) for x in lists]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "ids", "token_start", "token_end"][: 2 + 2 * offsets])

    more = ", token_start array<int>, token_end array<int>" if offsets else ""
    return map_batches(docs.select(id_col, text_of(text_col).alias("text")), run, f"`{id_col}` {dtype(docs, id_col)}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids, decoded binary: the bytes that the ids stand for. Bytes, as a list of ids may begin or end inside a character."""

    def run(batch):
        import pyarrow as pa

        table, ids = table_of(path, pattern), batch.column(1)
        flat, ends = ids.flatten().to_pylist(), [0, *np.cumsum(np.diff(ids.offsets.to_numpy())).tolist()]
        out = [b"".join([table[i] for i in flat[a:b]]) for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    return map_batches(encoded.select(id_col, F.coalesce(ids_col, F.expr("array()").cast("array<int>")).alias("ids")), run, f"`{id_col}` {dtype(encoded, id_col)}, ids array<int>, decoded binary", rows=256)


def decode_stream(pieces: Iterable[Iterable[int]], table: list[bytes]) -> Iterator[str]:
    """Text of ids that arrive in pieces: a character that is split between pieces waits for its last byte."""
    import codecs

    d = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in pieces:
        yield d.decode(b"".join(table[i] for i in ids))
    yield d.decode(b"", True)
