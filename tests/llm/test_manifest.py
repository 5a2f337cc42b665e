"""The Merkle manifest against a plain computation of every tree, proof and folded root."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from arenaflow.llm import merkle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if value is None else f"{len(str(value).encode())}:{value}" for value in row))


def tree(digests):
    paths, places, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        runs = [nodes[at:at + 16] for at in range(0, len(nodes), 16)]
        for path, place in zip(paths, places):
            run, at = runs[place // 16], place % 16
            path.append(("".join(run[:at]), "".join(run[at + 1:])))
        places, nodes = [place // 16 for place in places], [digest("".join(run)) for run in runs]
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    members = {name: sorted(groups[name], key=lambda row: (row[0] is not None, row[0] or 0, leaf(row))) for name in names}
    trees = {name: tree([leaf(row) for row in members[name]]) for name in names}
    root, tops = tree([trees[name][0] for name in names])
    found = []
    for name, top in zip(names, tops):
        for row, path in zip(members[name], trees[name][1]):
            folded = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf((*row[:4], row[4].translate(str.maketrans(UPPER, LOWER))))
            for before, after in path + top:
                folded = digest(before + folded + after)
            proof = digest("".join(before + after for before, after in path + top))
            found.append((row[0], leaf(row), trees[name][0], root, proof, folded, folded == root))
    return sorted(found, key=repr)


def built(frame):
    made = merkle.manifest(frame, doubted=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                           claims={"text": F.translate("text", UPPER, LOWER)})
    return sorted(map(tuple, made.collect()), key=repr)


def test_hot_group_nulls_ties_and_repeated_rows(spark):
    draw = random.Random(5)
    sources = [None, "", *["hot"] * 6, *[f"s{number}é" for number in range(20)]]
    rows = [(draw.choice([None, *range(4000)]), draw.choice(sources), draw.choice([None, "en"]), draw.choice([None, 3]),
             draw.choice([None, "", "Abc É", "X" * 2000])) for _ in range(1500)]
    rows += [(number, "hot", "en", 1, f"Text {number}") for number in range(merkle.SPAN + 20)] + rows[:30]
    assert built(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_small_and_empty_tables(spark):
    one = [(7, "a", None, None, "Long " * 100_000)]
    assert built(spark.createDataFrame(one, SCHEMA)) == by_hand(one)
    assert built(spark.createDataFrame([], SCHEMA)) == []


def test_runs_of_seventeen_and_clashing_columns(spark):
    for size in (16, 17, 257):
        rows = [(number, "a", "en", 1, f"T{number}") for number in range(size)]
        frame = spark.createDataFrame(rows, SCHEMA).withColumns(
            {name: F.lit(1) for name in ("tree", "block", "number", "digest", "leaf", "root", "id")})
        assert built(frame) == by_hand(rows)


def test_sweeps_and_folding():
    digests = [digest(str(number)) for number in range(40)]
    nodes = merkle.sweep_up(0, digests, 40)
    root, paths = tree(digests)
    assert nodes[-1][3] == root and [label[:2] for label in nodes] == sorted(label[:2] for label in nodes)
    for number, suffix in enumerate(merkle.sweep_down(0, 40, nodes, None)):
        assert merkle.fold(digests[number], suffix) == root
        assert merkle.fold(digest("other"), suffix) != root
