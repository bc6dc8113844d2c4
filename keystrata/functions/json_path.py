"""Values inside JSON documents: paths are lists of keys and 0-based places."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_of(keys: list) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in keys)


def fetch(doc: str | Column, keys: list, default: str | None = None) -> Column:
    """The value at a path as text; null, or the default, where there is none."""
    got = F.get_json_object(doc, path_of(keys))
    return got if default is None else F.coalesce(got, F.lit(default))


def test(doc: str | Column, keys: list, value) -> Column:
    """Whether the value at a path equals a JSON scalar."""
    return fetch(doc, keys).eqNullSafe(F.lit(value if isinstance(value, str) else json.dumps(value)))


class PatchError(ValueError):
    """A step of a patch that doesn't apply."""


def _walk(doc, keys):
    for k in keys:
        if isinstance(doc, list) and isinstance(k, int) and 0 <= k < len(doc) or isinstance(doc, dict) and k in doc:
            doc = doc[k]
        else:
            raise PatchError(f"no {k!r}")
    return doc


def _put(doc, keys, value, new: bool):
    if not keys:
        return value
    at, last = _walk(doc, keys[:-1]), keys[-1]
    if isinstance(at, list):
        place = len(at) if last == "-" and new else len(at) - 1 if last == "-" else last
        if not isinstance(place, int) or not 0 <= place <= len(at) - (not new):
            raise PatchError(f"no place {last!r}")
        if new:
            at.insert(place, value)
        else:
            at[place] = value
    elif isinstance(at, dict) and (new or last in at):
        at[last] = value
    else:
        raise PatchError(f"no {last!r}")
    return doc


def _take(doc, keys):
    if not keys:
        return None, doc
    at, last = _walk(doc, keys[:-1]), keys[-1]
    if isinstance(at, list) and last == "-" and at:
        return doc, at.pop()
    if isinstance(at, list) and isinstance(last, int) and 0 <= last < len(at) or isinstance(at, dict) and last in at:
        return doc, at.pop(last)
    raise PatchError(f"no {last!r}")


def apply_patch(doc, steps: list[dict]):
    """The document after all steps (add, remove, replace, move, copy, test); the input isn't changed, an error leaves nothing done."""
    out = json.loads(json.dumps(doc))
    for s in steps:
        op, path = s["op"], s["path"]
        if op in ("add", "replace"):
            out = _put(out, path, json.loads(json.dumps(s["value"])), op == "add")
        elif op == "remove":
            out, _ = _take(out, path)
        elif op == "copy":
            out = _put(out, path, json.loads(json.dumps(_walk(out, s["from"]))), True)
        elif op == "move":
            out, v = _take(out, s["from"])
            out = _put(out, path, v, True)
        elif op == "test":
            if _walk(out, path) != s["value"]:
                raise PatchError("test failed")
        else:
            raise PatchError(f"no operation {op!r}")
    return out


def patch(df: DataFrame, column: str, steps: list[dict]) -> DataFrame:
    """df with status and reason, its JSON column patched where all steps apply (Arrow batches)."""

    def run(docs: pd.Series) -> pd.DataFrame:
        out = []
        for text in docs:
            try:
                out.append((json.dumps(apply_patch(json.loads(text), steps), separators=(",", ":")), "ok", None))
            except (PatchError, ValueError, TypeError) as e:
                out.append((text, "fail", str(e)))
        return pd.DataFrame(out, columns=["doc", "status", "reason"])

    call = F.pandas_udf(run, "doc string, status string, reason string")
    return df.withColumn("_p", call(F.col(column))).withColumns({column: F.col("_p.doc"), "status": F.col("_p.status"), "reason": F.col("_p.reason")}).drop("_p")
