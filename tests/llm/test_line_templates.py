import random
from collections import Counter

from sievemark.llm import line_templates

LOG = "user u{} logged in from the main office"
ROWS = [
    (1, "Only here is this line of words\nThe same words stand here again\nShort one"),
    (2, "The same words stand here again\nSome other line that is alone"),
    (3, "x y z w v\nThe same words stand here again"),
    (4, LOG.format(1) + "\nA line of its own here"),
    (5, LOG.format(22) + "\nA second line of its own"),
    (6, LOG.format(333)),
    (7, "user alice logged in from the main office"),
    (8, None),
    (9, ""),
    (10, "\n\n"),
    (11, "Twice in this one text only\nTwice in this one text only"),
    (12, "Short one"),
    (13, "Short one"),
    (14, "Short one"),
    (15, "long " * 40000),
    (None, "The same words stand here again"),
    (3, "x y z w v\nThe same words stand here again"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, n_chars long, leaf string").repartition(4)


def test_recurring_templates_go_but_for_the_first(spark):
    got = {(r.doc_id, r.text) for r in line_templates.dedup_lines(frame(spark)).collect()}
    texts = dict(got)
    assert texts[None] == "The same words stand here again"  # a null doc_id comes first
    assert texts[1] == ROWS[0][1].split("\n")[0] + "\nShort one" and texts[2] == "Some other line that is alone" and texts[3] == "x y z w v"
    assert texts[4] == ROWS[3][1] and texts[5] == "A second line of its own" and texts[6] == "" and texts[7] == "user alice logged in from the main office"
    assert [texts[k] for k in (8, 9, 10, 11)] == [dict(ROWS)[k] for k in (8, 9, 10, 11)] and texts[12] == texts[13] == texts[14] == "" and texts[15] == "long " * 40000
    counts = Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_templates.dedup_lines(frame(spark)).collect())
    assert counts[3, 2, 1] == 2 and counts[8, 0, 0] == 1 and counts[9, 1, 0] == 1 and counts[1, 3, 1] == 1


def test_a_word_that_varies_is_generalised(spark):
    lines = [f"error while the {w} service was being started again today" for w in ("mail", "web", "print", "name", "login")]
    rows = [(i, x) for i, x in enumerate(lines)]
    texts = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, [(i, x.replace("error while the", f"error while the", 1)) for i, x in rows]), similarity=0.8).collect()}
    assert texts[0] == lines[0] and not any(texts[i] for i in range(1, 5))
    apart = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, rows), similarity=0.8, most=2).collect()}
    assert apart == texts  # a large leaf's templates meet by their bands, and merge as those of a small one


def test_links_are_the_same_at_every_size(spark):
    rng = random.Random(5)
    words, rows = ["red", "blue", "green", "7"], []
    for i in range(300):
        size = rng.choice([2, 4, 5, 7, 9])
        lead = rng.choice([["go", "to", "the"], ["go", "8", "the"]])
        rows.append((i, " ".join(lead + [rng.choice(words) for _ in range(size - 3)])))
    leaves = {}
    for i, x in rows:
        own = line_templates.masked(x)
        if not line_templates.general(own):
            own = ["=", "=", "=", *x.split()]  # a leaf of its own
            leaves.setdefault(x, {}).setdefault(tuple(own), set()).add(i)
            continue
        leaves.setdefault((len(own), *own[:3]), {}).setdefault(tuple(own), set()).add(i)
    gone = set()
    for templates in leaves.values():
        of, _ = line_templates.generalise([list(x) for x in templates], 0.7)
        for k in set(of):
            docs = set().union(*(d for d, g in zip(templates.values(), of, strict=True) if g == k))
            gone |= docs - {min(docs)} if len(docs) >= 3 else set()
    for most in (2000, 5):
        got = {r.doc_id for r in line_templates.dedup_lines(frame(spark, rows), most=most).collect() if r.n_dropped}
        assert got == gone and 20 < len(gone) < 300


def test_bands_of_a_template():
    tokens = "a b c d e f g h i j".split()
    assert line_templates.bands(tokens, 0.7) == ["0 d e", "1 f g", "2 h i j"]
    assert line_templates.bands(["a", "b", "c", "d"], 0.7) == ["0 d"]
    assert line_templates.bands(["a", "<*>", "c", "<*>", "e", "f", "g"], 0.7) == ["1 f g"]


def test_generalise_marks_places():
    of, groups = line_templates.generalise([[*"abcdefg"], [*"abcdxfg"], [*"abcqrst"]], 0.7)
    assert of == [0, 0, 1] and groups[0] == ["a", "b", "c", "d", "<*>", "f", "g"]


def test_lines_of_variables_alone_go_only_if_they_are_equal(spark):
    rows = [(i, f"{i} {i * 7} {i * 3} {i + 5}\nThe capital of {'ABCDE'[i]}\nPage {i} of 9\nRead more\n這是一個沒有空格的很長的句子\n| 1 | 2 | 3 |\n| {i} | 2 |") for i in range(5)]
    texts = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, rows)).collect()}
    stay = lambda i: "\n".join(rows[i][1].split("\n")[k] for k in (0, 1, 6))
    assert texts[0] == rows[0][1] and all(texts[i] == stay(i) for i in range(1, 5))


def test_page_numbers_are_generalised(spark):
    rows = [(i, f"Page {12 + i} of 30\nSome text {'uvwx'[i]} of its own") for i in range(4)]
    texts = {r.doc_id: r.text for r in line_templates.dedup_lines(frame(spark, rows)).collect()}
    assert texts[0] == rows[0][1] and all(texts[i] == f"Some text {'uvwx'[i]} of its own" for i in range(1, 4))


def plain(rows, least=3, similarity=0.7):
    """What is left of each row by dicts: templates, links of alike ones, counts of rows, and the row that keeps its lines."""
    names, leaves = {}, {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            tokens = line_templates.masked(line)
            if tokens and line_templates.general(tokens):
                names[line] = tuple(tokens)
                leaves.setdefault((len(tokens), *tokens[:3]), set()).add(tuple(tokens))
            elif tokens:
                names[line] = ("=", *line.split())
    root = {t: t for t in names.values()}
    for own in leaves.values():
        for x in own:
            for y in own:
                same = sum(a == b != line_templates.WILDCARD for a, b in zip(x[3:], y[3:], strict=True))
                if x < y and same >= similarity * len(x[3:]) - 1e-9 and root[x] != root[y]:
                    root = {t: root[x] if r == root[y] else r for t, r in root.items()}
    held = {}
    for i, (_, text) in enumerate(rows):
        for t in {root[names[line]] for line in (text or "").split("\n") if line in names}:
            held.setdefault(t, []).append(i)
    first = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    drop = {t: min(map(first, own)) for t, own in held.items() if len(own) >= least}
    return [None if text is None else "\n".join(line for line in text.split("\n") if line not in names or root[names[line]] not in drop or first(i) == drop[root[names[line]]]) for i, (_, text) in enumerate(rows)]


def test_whole_operator_against_a_plain_version(spark):
    for seed in range(3):
        rng = random.Random(seed)
        words = ["go", "to", "the", "7", "red", "blue", "x1", "|", "é"]
        lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 8]))) for _ in range(60)] + ["", "  "]
        rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in (None, *range(40))] + [(50, None), (51, "")]
        rows += [rng.choice(rows) for _ in range(25)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((str(r.doc_id), str(r.text)) for r in line_templates.without_recurring_lines(df).collect())
        want = plain(rows)
        assert got == sorted((str(k), str(t)) for (k, _), t in zip(rows, want, strict=True)) and sum(t != w for (_, t), w in zip(rows, want, strict=True)) > 20


def test_repeated_rows_count_alike_in_merged_and_single_templates(spark):
    for line in ("the same line of words is here", "the main office user alice logged in from here"):
        other = line if "same" in line else line.replace("alice", "bob")
        rows = [(1, line), (1, line), (2, other)]
        assert [r.text for r in line_templates.dedup_lines(frame(spark, rows)).orderBy("doc_id").collect()] == [line, line, ""]


def test_exact_lines_against_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {}
    for r in docs.collect():
        for line in set((r.text or "").split("\n")):
            seen.setdefault(line, set()).add(r.doc_id)
    common = {x: min(d) for x, d in seen.items() if len(d) >= 3 and x.split()}
    left = Counter(line for r in line_templates.dedup_lines(docs).collect() for line in set(r.text.split("\n")) if line in common and r.doc_id != common[line])
    assert common and not left


def test_rows_of_which_nothing_stays_go(spark):
    docs = frame(spark)
    kept = line_templates.with_fresh_lines(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and 6 not in {r.doc_id for r in rows} and {8, 9, 10} <= {r.doc_id for r in rows}
    assert next(r.n_chars for r in rows if r.doc_id == 3) == 9 and next(r.n_chars for r in rows if r.doc_id == 1) == len("Only here is this line of words\nShort one")
    assert line_templates.with_fresh_lines(docs.where("false")).count() == 0
