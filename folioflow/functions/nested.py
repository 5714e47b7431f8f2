"""JSON values of any shape: canonical form, rewriting of strings, decoding with a default. Arrow-batched, since no built-in walks an undeclared tree."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(text: Column) -> Column:
    """SHA-256 of a JSON text's compact form with sorted keys; null for null and for what isn't JSON."""

    def run(column: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else hashlib.sha256(_canonical(json.loads(x)).encode("utf-8")).hexdigest()
            except ValueError:
                return None

        return column.map(one)

    return F.pandas_udf(run, "string")(text)


def rewritten(text: Column, old: str, new: str) -> Column:
    """A JSON text with `old` at the start of every string value, at any depth, replaced by `new`; keys stay, what isn't JSON stays as it is."""

    def walk(x: object) -> object:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return new + x[len(old) :] if isinstance(x, str) and x.startswith(old) else x

    def run(column: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else _canonical(walk(json.loads(x)))
            except ValueError:
                return x

        return column.map(one)

    return F.pandas_udf(run, "string")(text)


def decoded(text: Column, path: str, kind: str, default: object) -> Column:
    """The value at a path of a JSON text, cast to kind; the default where the text isn't JSON or lacks it."""
    return F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(default).cast(kind))
