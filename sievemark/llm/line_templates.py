"""Line dedup by a template tree: lines of the same length and leading tokens, with what varies generalised."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small_batches, spanning, written

WILDCARD = "<*>"
#: Leading tokens that name a leaf, with the number of tokens.
DEPTH = 3


#: The digits among the first 256 characters.
_DIGITS = [c for c in map(chr, range(256)) if c.isdigit()]


def _without_digit(line: str) -> bool:
    """Quickly, where it has no characters beyond the first 256."""
    for c in _DIGITS:
        if c in line:
            return False
    try:
        line.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not any(c.isdigit() for c in line)


def masked(line: str) -> list[str]:
    """Tokens of a line; one with a digit is variable."""
    if _without_digit(line):
        return line.split()
    return [WILDCARD if any(c.isdigit() for c in x) else x for x in line.split()]


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _needed(size: int, similarity: float) -> int:
    return math.ceil(similarity * size - 1e-9)


def general(tokens: list[str]) -> bool:
    """Whether masked tokens name a template: one of the leading ones is fixed and has a letter."""
    return any(x != WILDCARD and any(map(str.isalpha, x)) for x in tokens[:DEPTH])


def _codes(templates: list[list[str]]) -> np.ndarray:
    """Codes of the tokens behind the leading ones."""
    code: dict[str, int] = {WILDCARD: 0}
    return np.array([[code.setdefault(x, len(code)) for x in t[DEPTH:]] for t in templates], np.int32)


def alike(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of left and right (codes of tokens; 0 is variable) have at least that share of equal tokens in place."""
    out = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), 128):
        part, same = left[at : at + 128], np.zeros((min(128, len(left) - at), len(right)), np.int32)
        for k in range(left.shape[1]):
            own = np.where(part[:, k] > 0, part[:, k], -1)
            same += own[:, None] == right[:, k][None, :]
        out[at : at + 128] = same >= _needed(left.shape[1], similarity)
    return out


def generalise(templates: list[list[str]], similarity: float) -> tuple[list[int], list[list[str]]]:
    """Group of each of the templates (of equal length and leading tokens), and each group's template: templates that are
    alike are linked, what links reach is a group, and its places that differ become variable."""
    codes, of = _codes(templates), np.arange(len(templates))
    for i, j in spanning(alike(codes, codes, similarity), of, of, len(of)):
        of = np.where(of == of[j], of[i], of)
    names, of = np.unique(of, return_inverse=True)
    groups = [[x[0] if len(set(x)) == 1 else WILDCARD for x in zip(*(t for t, g in zip(templates, of, strict=True) if g == k), strict=True)] for k in range(len(names))]
    return of.tolist(), groups


def bands(tokens: list[str], similarity: float) -> list[str]:
    """Stretches of a template's tokens behind the leading ones, of which any two alike templates of a leaf share one: one
    more than the places that may differ. One with a variable token isn't among them, as such tokens are never equal."""
    rest = tokens[DEPTH:]
    spare = len(rest) - _needed(len(rest), similarity)
    cuts = [len(rest) * k // (spare + 1) for k in range(spare + 2)]
    parts = [(k, rest[i:j]) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return [f"{k} {' '.join(x)}" for k, x in parts if WILDCARD not in x]


def _links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """a, b: a spanning forest of the alike templates of each bucket, or of one pair i, j of its blocks."""
    names, block = rows["template"].to_numpy(np.int64), rows["block"].to_numpy()
    texts = [x.split(" ") for x in rows["text"]]
    edges: list[tuple[int, int]] = []
    for (_, i, j), own in rows.groupby(["bucket", "i", "j"], sort=False).indices.items():
        if len(own) < 2:
            continue
        codes = _codes([texts[x] for x in own])
        left, right = (np.arange(len(own)),) * 2 if i == j else (np.flatnonzero(block[own] == i), np.flatnonzero(block[own] == j))
        found = alike(codes[left], codes[right], similarity)
        if i == j:
            found = np.triu(found, 1)
        edges += [(own[x], own[y]) for x, y in spanning(found, left, right, len(own))]
    ends = names[np.array(edges, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def _lines(docs: DataFrame) -> DataFrame:
    """key, doc_id, line, leaf, template, text (tokens, masked; null if the line is its own template), fresh (the text's first
    line of the template) of every line with a visible character."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.binary(), "doc_id": pa.int64(), "line": pa.int32(), "leaf": pa.int64(), "template": pa.int64(), "text": pa.string(), "fresh": pa.bool_()}
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = set()
                for i, line in enumerate((text or "").split("\n")):
                    tokens = masked(line)
                    if not tokens:
                        continue
                    if general(tokens):
                        plain = " ".join(tokens)
                        leaf, name = _hash(str(len(tokens)), *tokens[:DEPTH]), _hash(plain)
                    else:
                        plain = None
                        leaf = name = _hash("", *line.split())
                    row = (key, doc_id, i, leaf, name, plain, name not in seen)
                    seen.add(name)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds.values(), strict=True)], names=list(kinds))

    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(parse, "key binary, doc_id long, line int, leaf long, template long, text string, fresh boolean")


def _key():
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))]
    return F.unhex(F.md5(F.encode(F.concat(*parts), "UTF-8")))


def _linked(work: DataFrame, similarity: float) -> DataFrame:
    return work.groupBy("task").applyInPandas(lambda rows: _links(rows, similarity), "a long, b long")


def _linked_by_bands(texts: DataFrame, similarity: float, most: int, pool: int) -> DataFrame:
    """a, b of alike templates (leaf, template, text) of large leaves."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [])
            for leaf, template, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in bands(text.split(" "), similarity):
                    out[0].append(_hash(str(leaf), x))
                    out[1].append(template)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["bucket", "template"])

    texts = written(texts.select("leaf", "template", "text"), "large-leaves")
    rows = written(texts.mapInArrow(banded, "bucket long, template long"), "bands")
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    pools = -(-rows.count() // pool) + 1
    blocks = F.ceil(F.col("size") / most).cast("int")
    own = rows.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    own = own.withColumn("block", F.pmod(F.xxhash64("template", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket", F.lit(4)), F.lit(pools))).otherwise(F.xxhash64("bucket", "i", "j"))
    work = own.join(texts.select("template", "text"), "template").select(task.alias("task"), "bucket", "i", "j", "block", "template", "text")
    return _linked(work, similarity)


def recurring_lines(docs: DataFrame, least_docs: int = 3, similarity: float = 0.7, most: int = 2000, pool: int = 200) -> DataFrame:
    """key (128 bits of doc_id and text), dropped (places of lines, from 0): of each row with lines to drop.

    A line has a template: its tokens, variable ones masked. Templates in the same leaf (number of tokens, leading tokens)
    are linked if at least `similarity` of the tokens behind the leading ones are equal and in place, and what links reach
    is one template. A line whose leading tokens are all variable or without a letter (see general) is its own template, token
    by token, and links with no other. Lines whose template is in least_docs or more rows go, but for those in the row with
    the smallest doc_id. Rows of equal doc_id and text count each, for templates alone and for linked ones alike, and stay or
    go together; a row with several lines of a template counts once. Lines without a visible character stay. Templates are counted and told apart before anything is gathered,
    so a line in every document is one row.

    Leaves of up to `most` different templates are compared whole, about `pool` templates a task. The templates of a larger
    one meet in the buckets of their bands, of which alike ones share one, and a bucket of more than `most` is dealt to
    blocks, each pair of which is one task's work: so links are the same at every size, and no task holds more than two
    blocks."""
    small_batches(docs.sparkSession)
    lines = written(_lines(docs), "lines")
    where = F.struct("doc_id", "key")
    templates = written(lines.groupBy("leaf", "template").agg(F.count_if("fresh").alias("n"), F.min(where).alias("first")), "templates")
    leaves = templates.groupBy("leaf").agg(F.count("*").alias("size"), F.sum("n").alias("rows"))
    # Joins with plain tables can split a large leaf's side.
    leaves = written(leaves.where((F.col("size") > 1) & (F.col("rows") >= least_docs)).select("leaf", "size"), "leaves")

    def texts(of: DataFrame) -> DataFrame:
        own = templates.join(of, "leaf").select("template", F.col("first.key").alias("key"), "leaf")
        return lines.where("fresh").select("template", "key", "text").join(own, ["template", "key"]).dropDuplicates(["template"])

    zero = F.lit(0).cast("int")
    whole = leaves.where(F.col("size") <= most)
    pools = -(-(whole.agg(F.sum("size")).first()[0] or 0) // pool) + 1
    task = F.pmod(F.xxhash64("leaf", F.lit(4)), F.lit(pools))
    work = texts(whole).select(task.alias("task"), F.col("leaf").alias("bucket"), zero.alias("i"), zero.alias("j"), zero.alias("block"), "template", "text")
    found = [_linked(work, similarity)]
    if not leaves.where(F.col("size") > most).isEmpty():
        found.append(_linked_by_bands(texts(leaves.where(F.col("size") > most)), similarity, most, pool))
    merged = components(reduce(DataFrame.unionByName, found), "alike").select(F.col("node").alias("template"), F.col("root").alias("merged"))
    merged = written(merged, "merged")
    # A row counts once for a merged template, whatever number of its members it holds; repeated rows have one key.
    both = lines.where("fresh").join(merged, "template").groupBy("merged", "key", "doc_id", "template").agg(F.count("*").alias("n"))
    both = both.groupBy("merged", "key", "doc_id").agg(F.max("n").alias("n"))
    both = both.groupBy("merged").agg(F.sum("n").alias("n"), F.min(where).alias("first"))
    alone = templates.join(merged, "template", "left_anti").where(F.col("n") >= least_docs).select("template", "first")
    chosen = alone.unionByName(merged.join(both.where(F.col("n") >= least_docs), "merged").select("template", "first"))
    gone = lines.select("key", "line", "template").join(chosen.select("template", F.col("first.key").alias("kept")), "template").where(F.col("key") != F.col("kept"))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def without_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with two more columns, __lines (how many the text has; 0 for null) and __dropped, and text without the
    dropped lines; a null text stays null."""
    found = recurring_lines(docs, **options).select(F.col("key").alias("__key"), F.col("dropped").alias("__places"))
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("__places", i)), "\n")
    rows = docs.withColumn("__key", _key()).join(found, "__key", "left")
    rows = rows.withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))).withColumn("__dropped", F.coalesce(F.size("__places"), F.lit(0)))
    return rows.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept)).drop("__key", "__places")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays) of every row."""
    rows = without_recurring_lines(docs.select("doc_id", "text"), **options)
    return rows.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), "text")


def with_fresh_lines(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, whatever their names: text without recurring lines, n_chars its length; rows of which
    nothing stays go. Null and empty texts stay; repeated rows stay or go together; ties are settled by a hash of the row."""
    rows = without_recurring_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text"))
    rows = rows.where(~((F.col("__dropped") > 0) & (F.trim(F.regexp_replace("text", "\\s+", "")) == "")))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("own")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.select(*[fresh.get(c, F.col("own")[c]).alias(c) for c in docs.columns])
