"""Trees of files against full joins, and capped walks against a plain queue."""

import random
from collections import OrderedDict, deque

from sievemark.operators import graph, inventory


def side(spark, files):
    return inventory.tree(spark.createDataFrame([(p, s, 1) for p, s in files.items()], "path string, sha256 string, bytes long"))


def plain(left, right):
    out = {p: "missing" for p in left if p not in right} | {p: "unexpected" for p in right if p not in left}
    return out | {p: "changed" for p in left if p in right and left[p] != right[p]}


def test_differences_are_those_of_a_full_join(spark):
    rng = random.Random(2)
    for seed in range(3):
        names = ["a", "b", "c d", "é"]
        path = lambda: "/".join([rng.choice(names) for _ in range(rng.randint(0, 4))] + [f"f{rng.randint(0, 9)}.x"])
        left = {path(): rng.choice("xyz") for _ in range(80)}
        right = {p: rng.choice("xyz") if rng.random() < 0.1 else s for p, s in left.items() if rng.random() < 0.9} | {path(): "n" for _ in range(5 * seed)}
        got = {r.path: r.problem for r in inventory.file_differences(side(spark, left), side(spark, right)).collect()}
        assert got == plain(left, right)
    assert inventory.differences(side(spark, left), side(spark, left)).count() == 0
    none = side(spark, left).where("false")
    assert {r.path for r in inventory.file_differences(side(spark, left), none).collect()} == set(left) and inventory.differences(none, none).count() == 0


def test_one_changed_file_is_its_path_only(spark):
    left = {f"d{i % 9}/e{i % 7}/f{i}": str(i) for i in range(400)}
    right = left | {"d3/e3/f3": "other"}
    rows = inventory.differences(side(spark, left), side(spark, right)).collect()
    assert sorted((r.depth, r.path, r.is_file, r.problem) for r in rows) == [(0, "", False, "changed"), (1, "d3", False, "changed"), (2, "d3/e3", False, "changed"), (3, "d3/e3/f3", True, "changed")]


def test_a_file_and_a_folder_of_one_name(spark):
    rows = inventory.differences(side(spark, {"a": "1", "b": "2"}), side(spark, {"a/x": "1", "b": "2"})).where("depth > 0").collect()
    assert sorted((r.path, r.is_file, r.problem) for r in rows) == [("a", False, "unexpected"), ("a", True, "missing"), ("a/x", True, "unexpected")]
    sizes = {r.path: (r.files, r["bytes"]) for r in side(spark, {"a/x": "1", "a/y": "1", "b": "2"}).collect()}
    assert sizes == {"": (3, 3), "a": (2, 2), "a/x": (1, 1), "a/y": (1, 1), "b": (1, 1)}


def queue(members, root, depth, most):
    files, visited, waiting = OrderedDict(), set(), deque([(root, 0)])
    while waiting and len(files) < most:
        node, level = waiting.popleft()
        if node in visited:
            continue
        visited.add(node)
        for _, child, is_file in sorted((m[1:] for m in members if m[0] == node)):
            if is_file:
                files.setdefault(child)
                if len(files) >= most:
                    break
            elif level < depth:
                waiting.append((child, level + 1))
    return list(files)


def test_walks_are_those_of_a_queue(spark):
    rng = random.Random(6)
    for case in range(6):
        members, places = [], {}
        for _ in range(120):
            parent = f"c{rng.randint(0, 12)}"
            places[parent] = places.get(parent, 0) + rng.randint(1, 3)
            is_file = rng.random() < 0.6
            members.append((parent, places[parent], f"f{rng.randint(0, 40)}" if is_file else f"c{rng.randint(0, 12)}", is_file))
        df = spark.createDataFrame(members, "parent string, position int, child string, is_file boolean").repartition(3)
        depth, most = rng.randint(0, 4), rng.choice([0, 1, 5, 17, 1000])
        got = [r.file for r in graph.walk_files(df, "c0", depth, most).orderBy("place").collect()]
        assert got == queue(members, "c0", depth, most), (case, depth, most)
