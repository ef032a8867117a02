"""JSON documents: strict reading, leaves and redaction. Nested values of any depth need Python; each call is one value."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from sievemark.functions.text import POSIX_PATH, USER_HOME, WINDOWS_PATH

_HOME = re.compile(USER_HOME)


def _strict(text: str):
    """The value, or ValueError for a repeated key, NaN, an infinity or a number out of range."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(f"not a number: {name}")

    def number(raw):
        if math.isinf(value := float(raw)):
            raise ValueError(f"out of range: {raw}")
        return value

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)


def _problem(text: str) -> str | None:
    try:
        _strict(text)
    except (ValueError, RecursionError) as e:
        return str(e)
    return None


@F.pandas_udf(StringType())
def strict_json_problem(texts: pd.Series) -> pd.Series:
    """Why a text isn't strict JSON; null if it is (or is null)."""
    return texts.map(_problem, na_action="ignore")


def _leaves(value, path=""):
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _leaves(value[k], f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from _leaves(x, f"{path}[{i}]")
    else:
        yield path, value


@F.pandas_udf(StringType())
def numeric_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the sorted [path, number] pairs of all numbers in a document, as compact JSON; null if it isn't strict JSON."""

    def one(text: str) -> str | None:
        if _problem(text):
            return None
        pairs = sorted([p, v] for p, v in _leaves(_strict(text)) if isinstance(v, (int, float)) and not isinstance(v, bool))
        return hashlib.sha256(json.dumps(pairs, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return texts.map(one, na_action="ignore")


_NUMBERS = ArrayType(StructType([StructField("path", StringType()), StructField("value", DoubleType())]))


def numeric_leaves(texts):
    """Paths and values of all numbers in a document, in the order of the paths."""
    return F.from_json(_number_rows(texts), _NUMBERS)


@F.pandas_udf(StringType())
def _number_rows(texts: pd.Series) -> pd.Series:
    rows = lambda x: [{"path": p, "value": float(v)} for p, v in _leaves(_strict(x)) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return texts.map(lambda x: None if _problem(x) else json.dumps(rows(x)), na_action="ignore")


def string_leaves(texts):
    """Paths and values of all strings in a document, in the order of the paths."""
    return F.from_json(_string_rows(texts), "array<struct<path string, value string>>")


@F.pandas_udf(StringType())
def _string_rows(texts: pd.Series) -> pd.Series:
    rows = lambda x: [{"path": p, "value": v} for p, v in _leaves(_strict(x)) if isinstance(v, str)]
    return texts.map(lambda x: None if _problem(x) else json.dumps(rows(x)), na_action="ignore")


def scrubbed_json(texts, names: dict[str, str] | None = None, omitted: frozenset[str] = frozenset()):
    """The document, keys sorted, without the omitted keys, and with named strings, users' homes and other absolute paths
    replaced in every string (as text.redacted does it); null if it isn't strict JSON."""
    patterns = [(re.compile(re.escape(x), re.IGNORECASE), to) for x, to in (names or {}).items()]
    patterns += [(_HOME, "<USER_HOME>"), (re.compile(WINDOWS_PATH), r"\1<ABSOLUTE_PATH>"), (re.compile(POSIX_PATH), r"\1<ABSOLUTE_PATH>")]

    def scrub(value):
        if isinstance(value, dict):
            return {k: scrub(v) for k, v in value.items() if k not in omitted}
        if isinstance(value, list):
            return [scrub(x) for x in value]
        if isinstance(value, str):
            for pattern, to in patterns:
                value = pattern.sub(to, value)
        return value

    @F.pandas_udf(StringType())
    def scrubbed(own: pd.Series) -> pd.Series:
        one = lambda x: None if _problem(x) else json.dumps(scrub(_strict(x)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return own.map(one, na_action="ignore")

    return scrubbed(texts)
