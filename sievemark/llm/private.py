"""Personal data by bootstrapped contextual extraction: seeds that patterns of characters find teach patterns of words, which
find identifiers that the first patterns miss. DataFrame functions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# Kinds in their order, and the form of each. Lookbehinds and possessive repeats are added: they find the same
# spans, but read a long run of characters once, where it would be read once from each of its characters.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: What may be an identifier: phone-like and mail-like runs, and words with a digit, groups of four digits among them.
MENTION = rf"\+[0-9][\x20().0-9-]+[0-9]|(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.{_HOST}++)*+|(?<![A-Za-z0-9])[A-Za-z]*+[0-9](?:[._:/-]?+[A-Za-z0-9]|(?<=[0-9]{{4}})\x20(?=[0-9]{{4}}))*+"
#: An identifier's length, its fewest digits (or an @), and how much of the text beside it is its context.
LENGTHS, DIGITS, CONTEXT = (6, 64), 5, 80
_BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is reckoned once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """Sums of the numbers before each: within blocks, and of blocks, so that long arrays take little copying."""
    empty = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<long>").alias("out"))
    scan = lambda a: F.aggregate(a, empty, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["out"], F.array(s["t"])).alias("out")), lambda s: s["out"])
    sums = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda t, x: t + x))
    last = F.floor((F.greatest(F.size(numbers), F.lit(1)) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK))
    shifted = lambda bs: bound(scan(sums(bs)), lambda before: F.flatten(F.transform(bs, lambda b, i: F.transform(scan(b), lambda v: v + F.get(before, i)))))
    return bound(blocks, shifted)


def places(text: Column, form: str, hint: str | None = None) -> Column:
    """Array of s, e (code points, e exclusive), m, before, after: the leftmost matches that don't overlap, and the text up to
    the match before and to the one behind. hint: a text that every match contains."""
    kind = "array<struct<s:long,e:long,m:string,before:string,after:string>>"
    none = F.array().cast(kind)

    def of(found: Column) -> Column:
        def placed(rest: Column) -> Column:
            width = F.transform(found, lambda m, i: (F.length(F.get(rest, i)) + F.length(m)).cast("long"))
            one = lambda starts: F.transform(found, lambda m, i: bound(F.get(starts, i) + F.length(F.get(rest, i)), lambda s: F.struct(s.cast("long").alias("s"), (s + F.length(m)).cast("long").alias("e"), m.alias("m"), F.get(rest, i).alias("before"), F.get(rest, i + 1).alias("after"))))
            return bound(width, lambda w: bound(running(w), one))

        return F.when(F.size(found) == 0, none).otherwise(bound(F.split(text, form, -1), placed).cast(kind))

    found = bound(F.regexp_extract_all(text, F.lit(form), F.lit(0)), of)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(none) if hint else found


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check of card numbers."""
    at = lambda i: F.substring(digits, -i, F.lit(1))
    digit = lambda i: F.when(i % 2 == 0, F.translate(at(i), "0123456789", "0246813579")).otherwise(at(i)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: t + digit(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a kind's form is one of the kind."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(_BYTE)
    if kind == "card":
        return bound(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def seed_kind(m: Column) -> Column:
    """The first kind of which the whole of m is a valid match; else null."""
    whole = lambda k: m.rlike(rf"\A(?:{FORMS[k]})\z")
    return F.coalesce(*[F.when(F.when(whole(k), valid(k, m)).otherwise(False), F.lit(i)) for i, k in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    """Array of s, k (place in KINDS), e by s, then k: the valid matches of all forms."""
    hints = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    of = lambda i, k: F.transform(F.filter(places(text, FORMS[k], hints[k]), lambda p: valid(k, p["m"])), lambda p: F.struct(p["s"].alias("s"), F.lit(i).alias("k"), p["e"].alias("e")))
    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def patterns_of(before: Column, after: Column) -> Column:
    """What stands around a mention: two words before it, and a word on either side. `^` and `$` stand for none."""
    near = lambda c, p: F.regexp_extract(c, p, 1)
    left = F.lower(F.substring(before, -CONTEXT, F.lit(CONTEXT)))
    right = F.lower(F.substring(after, 1, CONTEXT))
    two = near(left, r"((?:(?<!\S)\S++\s++)?(?<!\S)\S++\s*+)$")
    one = F.when(F.trim(left) == "", "^").otherwise(near(left, r"(\S*+)\s*+$"))
    after_it = F.when(F.trim(right) == "", "$").otherwise(near(right, r"^\s*+(\S++)"))
    return F.array(F.concat(F.lit("2:"), F.when(F.trim(left) == "", "^").otherwise(F.regexp_replace(F.trim(two), r"\s+", " "))), F.concat_ws("_", F.concat(F.lit("1:"), one), after_it))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), base (see base_spans), mentions (array of s, e, m, seed, patterns): of what may be an
    identifier. seed is the kind of those that are one as a whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    enough = lambda m: F.length(m).between(*LENGTHS) & (F.contains(m, F.lit("@")) | (F.length(F.regexp_replace(m, "[^0-9]", "")) >= DIGITS))
    told = lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lower(p["m"]).alias("m"), seed_kind(p["m"]).alias("seed"), patterns_of(p["before"], p["after"]).alias("patterns"))
    mentions = F.transform(F.filter(places(text, MENTION), lambda p: enough(p["m"])), told)
    return docs.select("doc_id", F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"), base_spans(text).alias("base"), mentions.alias("mentions"))


def fit_patterns(marked_docs: DataFrame, rounds: int = 3, support: float = 3.0, confidence: float = 0.8) -> DataFrame:
    """pattern, kind, confidence of the patterns that find a kind's identifiers.

    The graph has an edge for each pattern and identifier that some text joins. Seeds have score 1. A round gives each
    pattern the share of its identifiers, by their scores, that are of a kind, if these and its seeds are worth `support`
    identifiers; then each identifier that is no seed the chance that not all of its patterns err. An identifier takes its
    likeliest kind, the first of equals. Everything is counted over all texts, copies of an identifier or a text once."""
    each = marked_docs.select(F.explode("mentions").alias("p")).select("p.m", "p.seed", F.explode("p.patterns").alias("pattern"))
    edges = written(each.groupBy("pattern", "m").agg(F.min("seed").alias("seed")), "edges")
    totals = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).where(F.col("seeds") > 0), "totals")
    open_edges = edges.where("seed is null").select("pattern", "m").join(totals.select("pattern"), "pattern", "left_semi")
    open_edges = written(open_edges, "open")
    seeded = written(edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("w")), "seeded")
    found = None
    for _ in range(rounds):
        weights = seeded.withColumn("s", F.col("w"))
        if found is not None:
            grown = open_edges.join(found, "m").groupBy("pattern", "kind").agg(F.sum("score").alias("w"))
            weights = weights.unionByName(grown.withColumn("s", F.lit(0.0)))
        shares = weights.groupBy("pattern", "kind").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where((F.col("w") >= support) & (F.col("s") >= support))
        patterns = written(shares.join(totals, "pattern").select("pattern", "kind", (F.col("w") / F.col("n")).alias("confidence")), "patterns")
        # A pattern never makes an identifier sure, as a logarithm of 0 would.
        chance = open_edges.join(patterns, "pattern").groupBy("m", "kind").agg((1 - F.exp(F.sum(F.log(1 - 0.99 * F.least("confidence", F.lit(1.0)))))).alias("score"))
        best = chance.groupBy("m").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b"))
        found = written(best.select("m", "b.kind", "b.score").where(F.col("score") >= confidence / 2), "found")
    return patterns.where(F.col("confidence") >= confidence)


def found_spans(marked_docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, found (array of s, k, e): mentions in a pattern of a kind that overlap no base span, each once, of the kind of its
    surest pattern."""
    each = marked_docs.select("key", F.explode(F.filter("mentions", lambda m: m["seed"].isNull())).alias("p"))
    each = each.select("key", "p.s", "p.e", F.explode("p.patterns").alias("pattern"))
    sure = each.join(patterns, "pattern").groupBy("key", "s", "e").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("k"))
    # A mention is no longer than a cell, so it starts in a cell of a span that it overlaps, or in the one before.
    cell = lambda c: F.floor(c / LENGTHS[1])
    taken = marked_docs.select("key", F.explode("base").alias("b")).select("key", F.explode(F.sequence(cell(F.col("b.s")) - 1, cell(F.col("b.e") - 1))).alias("cell"), F.col("b.s").alias("from"), F.col("b.e").alias("to")).distinct()
    own = sure.withColumn("cell", cell(F.col("s")))
    clear = own.join(taken, (own["key"] == taken["key"]) & (own["cell"] == taken["cell"]) & (own["s"] < taken["to"]) & (own["e"] > taken["from"]), "left_anti")
    return clear.groupBy("key").agg(F.collect_list(F.struct("s", "k", "e")).alias("found"))


def find_private(docs: DataFrame, rounds: int = 3, support: float = 3.0, confidence: float = 0.8) -> DataFrame:
    """doc_id, base, spans (arrays of s, k, e by s, then k: base ones, and all) of every row of docs (doc_id, text; other
    columns don't matter). k is a kind's place in KINDS.

    A null text is an empty one, without spans; a null doc_id goes through. Repeated rows and copies get the same spans, and
    count once where patterns are learned. Without seeds, or where none shares its words with others, base spans are all."""
    rows = written(marked(docs), "marked")
    found = found_spans(rows, fit_patterns(rows, rounds, support, confidence))
    both = rows.select("doc_id", "key", "base").join(written(found, "private"), "key", "left")
    more = F.coalesce("found", F.array().cast("array<struct<s:long,k:int,e:long>>"))
    return both.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with `<kind>` in place of each span; a span that begins within the one before is part of it."""
    name = lambda k: F.get(F.array(*[F.lit(f"<{x}>") for x in KINDS]), k)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, p: Column) -> Column:
        kept = F.substring(text, state["at"].cast("int") + 1, (p["s"] - state["at"]).cast("int"))
        inside = F.struct(F.greatest(state["at"], p["e"]).alias("at"), state["out"].alias("out"))
        return F.when(p["s"] < state["at"], inside).otherwise(F.struct(p["e"].alias("at"), F.concat(state["out"], kept, name(p["k"])).alias("out")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found (spans beyond base ones)."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    line = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", name(p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda p: p["k"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"))
