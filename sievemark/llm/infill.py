"""Fill-in-the-middle: texts cut between units at two hashed places, and their pieces in another order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

# What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def boundaries(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Places between units, the text's start and end included (only 0 for an empty text). A line ends behind its newline,
    a word behind the white space that follows it; a char is a code point."""
    if unit == "line":
        inner = np.flatnonzero(points[:-1] == 10) + 1
    elif unit == "word":
        space = np.isin(points, _SPACES)
        inner = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    elif unit == "char":
        inner = np.arange(1, len(points))
    else:
        raise ValueError(f"unknown unit: {unit}")
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(key: object, seed: int) -> list[int]:
    """The first four 32-bit numbers of the hash of seed and key (an empty one for null)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: str, key: object, unit: str, seed: int, percent: int, spm_percent: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    points = code_points(text)
    edges = boundaries(points, unit)
    n = len(edges) - 1
    one, other, whether, which = draws(key, seed)
    if n == 0 or whether % 100 >= percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), other % (n + 1)))
    first, last = int(edges[first]), int(edges[last])
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, first), (first, last), (last, len(points))))
    p, s, m = marks
    if which % 100 < spm_percent:
        return n, "spm", first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain), output: a row
    for each row of docs (doc_id, text; other columns don't matter).

    A null text is an empty one and plain, as is a text that contains a mark; a null doc_id draws as an empty one. Repeated
    rows are cut alike; cuts that fall together leave an empty piece. Texts are worked on one at a time and whole."""
    if len(set(marks)) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks must be three different texts in angle brackets, so that they can't arise where pieces meet")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearranged(text or "", key, unit, seed, percent, spm_percent, marks) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    piece = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(piece(2), piece(4), piece(3))).when(form == "spm", F.concat(piece(3), piece(4), piece(2))).otherwise(output)


def with_digests(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of fill_in_middle with output_sha256 and restored_sha256 in place of the output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))
