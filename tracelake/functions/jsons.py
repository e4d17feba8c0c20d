"""JSON documents in text: detection, deep lookup, and objects inside free text."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_document(col: Column) -> Column:
    """Text that parses to a JSON object or array; the cheap test runs first."""
    kind = F.schema_of_variant(F.try_parse_json(F.when(col.contains('"'), col)))
    return F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))


_SCALAR = r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity'
_PART = re.compile(rf"[ \t\n\r]*(?:([{{}}\[\],:])|({_SCALAR}))", re.DOTALL)


def deep_loads(text: str):
    """A JSON document of any depth, by an explicit stack; ValueError if it is broken."""
    top: list = []
    stack: list = [(top, None)]
    at, wanted = 0, "value"

    def put(value) -> None:
        holder, key = stack[-1]
        if key is None:
            holder.append(value)
        else:
            holder[key] = value
            stack[-1] = (holder, None)

    while True:
        part = _PART.match(text, at)
        if part is None:
            if wanted == "end" and not text[at:].strip(" \t\n\r"):
                return top[0]
            raise ValueError(f"no JSON at {at}")
        at = part.end()
        mark, scalar = part.groups()
        if wanted in ("value", "first item") and (scalar is not None or mark in ("{", "[")):
            value = json.loads(scalar) if scalar is not None else {} if mark == "{" else []
            put(value)
            if scalar is None:
                stack.append((value, None))
                wanted = "first key" if mark == "{" else "first item"
                continue
        elif wanted in ("key", "first key") and scalar is not None and scalar[0] == '"':
            stack[-1] = (stack[-1][0], json.loads(scalar))
            wanted = "colon"
            continue
        elif wanted == "colon" and mark == ":":
            wanted = "value"
            continue
        elif wanted == "more" and mark == ",":
            wanted = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif wanted in ("more", "first key", "first item") and mark == ("}" if isinstance(stack[-1][0], dict) else "]"):
            stack.pop()
        else:
            raise ValueError(f"no JSON at {at}")
        wanted = "more" if len(stack) > 1 else "end"


def json_read(text: str | None) -> tuple[object, str]:
    """(document, status): ok, broken, or empty. What is too deep for the usual reader is read by the explicit stack."""
    if not text or not text.strip():
        return None, "empty"
    try:
        return json.loads(text), "ok"
    except RecursionError:
        try:
            return deep_loads(text), "ok"
        except ValueError:
            return None, "broken"
    except ValueError:
        return None, "broken"


def lookup(document, keys: Sequence[str], text_only: bool = False) -> str:
    """First of ``keys`` at this level, else depth first through nested objects; "" if there is none.

    An empty value of a key that may be empty (``text_only`` False) answers for its object: what is
    nested in it is not looked at.
    """
    accepted = (str,) if text_only else (str, int)
    waiting = [document]
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        for key in keys:
            value = node.get(key)
            if isinstance(value, accepted) and (value or not text_only):
                if str(value):
                    return str(value)
                break
        else:
            waiting.extend(reversed(node.values()))
    return ""


def json_lookup(col: Column, finds: dict[str, tuple[Sequence[str], bool]]) -> Column:
    """Several lookups in one reading of a document: struct of ``status`` and one text per name.

    ``finds`` gives (keys, text_only) per name. ``status`` tells a document without the keys (ok)
    from one that could not be read (broken) and from none at all (empty).
    """
    @F.pandas_udf(", ".join(["status string", *(f"`{name}` string" for name in finds)]))
    def find(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for text in docs:
            document, status = json_read(text)
            rows.append([status, *(lookup(document, *how) for how in finds.values())])
        return pd.DataFrame(rows, columns=["status", *finds], dtype=object)

    return find(col)


def json_find(col: Column, keys: Sequence[str], text_only: bool = False) -> Column:
    """One lookup of ``json_lookup`` as text."""
    return json_lookup(col, {"found": (keys, text_only)})["found"]


def json_fields(docs: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """Rows ``keep`` + (path, key, value, kind, status): every scalar of every document, read once.

    ``path`` is the way to the object or list that holds the scalar (``/a/0/b``, "" at the top), ``key``
    its name or place there, ``kind`` text, number, truth or null. A document that can't be read, or is
    empty, gives one row with nulls and its status, so that it is not mistaken for one without fields.
    """
    kinds = {str: "text", bool: "truth", int: "number", float: "number", type(None): "null"}

    def walk(text):
        document, status = json_read(text)
        if status in ("broken", "empty"):
            return [(None, None, None, None, status)]
        out, waiting = [], [("", "", document)]
        while waiting:
            path, key, node = waiting.pop()
            if isinstance(node, (dict, list)):
                inner = path if node is document else f"{path}/{key}"
                inside = node.items() if isinstance(node, dict) else enumerate(node)
                waiting.extend(reversed([(inner, str(k), v) for k, v in inside]))
            else:
                kind = kinds[type(node)]
                out.append((path, key, None if node is None else node if kind == "text" else json.dumps(node), kind, status))
        return out

    rows = docs.select(*keep, F.col(doc).alias("_doc"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            found = [walk(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            again = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [row for f in found for row in f]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(again) for c in batch.columns[:-1]), *(pa.array([row[i] for row in flat], pa.string()) for i in range(5))],
                names=[*batch.schema.names[:-1], "path", "key", "value", "kind", "status"])

    return rows.mapInArrow(run, (types + ", " if types else "") + "path string, key string, value string, kind string, status string")


# A quoted string with its escapes, a quote that never closes, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}]', re.DOTALL)


def _balanced_end(text: str, start: int) -> int:
    depth = 0
    for token in _TOKEN.finditer(text, start):
        mark = token.group()
        if mark == '"':
            return -1
        depth += (mark == "{") - (mark == "}")
        if depth == 0 and mark == "}":
            return token.end()
    return -1


def json_objects(col: Column) -> Column:
    """Every complete JSON object in free text, distinct, in order of appearance.

    A balanced stretch that is not JSON is passed over as a whole, and a brace
    that never closes is skipped alone.
    """

    @F.pandas_udf("array<string>")
    def extract(texts: pd.Series) -> pd.Series:
        def one(text):
            found: dict[str, bool] = {}
            at = text.find("{") if text else -1
            while at >= 0:
                end = _balanced_end(text, at)
                piece = text[at:end] if end > 0 else None
                if piece is not None and piece not in found:
                    try:
                        json.loads(piece)
                        found[piece] = True
                    except (ValueError, RecursionError):
                        found[piece] = False
                at = text.find("{", end if end > 0 else at + 1)
            return [piece for piece, valid in found.items() if valid]
        return texts.map(one)

    return extract(F.when(col.contains("{"), col))
