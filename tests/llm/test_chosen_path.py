"""The chosen-path join against all pairs, with large groups of copies."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arenaflow.llm import chosen_path

SCHEMA = "doc_id long, text string"


def by_hand(rows, size=2, over=4, under=5):
    """Every two rows are compared through the shingles they share; ids must be unique."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[at:at + size]) for at in range(max(1, len(words) - size + 1))} if words else set()
    parent = {doc_id: doc_id for doc_id in sets}

    def top(doc_id):
        while parent[doc_id] != doc_id:
            doc_id = parent[doc_id]
        return doc_id

    holders = defaultdict(list)
    for doc_id in sorted(sets):
        shared = Counter(other for shingle in sets[doc_id] for other in holders[shingle])
        for shingle in sets[doc_id]:
            holders[shingle].append(doc_id)
        for other, both in shared.items():
            if under * both >= over * (len(sets[doc_id]) + len(sets[other]) - both):
                one, two = sorted((top(doc_id), top(other)))
                parent[two] = one
    return sorted((doc_id, len(sets[doc_id]), top(doc_id), top(doc_id) == doc_id) for doc_id in sets)


def found(frame, **options):
    return sorted(map(tuple, chosen_path.near_duplicates(frame, size=2, **options).collect()), key=repr)


def edited(draw, words, share):
    return [draw.choice("qwxyz") + str(draw.randrange(99)) if draw.random() < share else word for word in words]


def test_large_families_and_common_words(spark, monkeypatch):
    # Small nodes of 48 make the families meet pivots, branch and be cut into chunks.
    monkeypatch.setattr(chosen_path, "SMALL", 48)
    draw = random.Random(3)
    vocabulary = [f"w{number}" for number in range(300)]
    rows, bases = [], [draw.choices(vocabulary, k=60) for _ in range(2)]
    for number in range(700):
        if number < 330:
            # Mutual similarities lie on both sides of 0.8.
            words = edited(draw, bases[0], draw.choice([0.01, 0.03, 0.06]))
        elif number < 500:
            words = edited(draw, bases[1], 0.05)
        else:
            words = ["common", "opening"] + draw.choices(vocabulary, k=draw.randrange(0, 40))
        rows.append((number, " ".join(words)))
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(by_hand(rows), key=repr)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "two one"), (8, "ONE\x0btwo"),
            (9, "long " * 50_000 + "end"), (10, "long " * 60_000 + "end"), (11, "a b c d e f"), (12, "a b c d e f g"), (13, "a b c d e")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == sorted(by_hand(rows), key=repr)
    clashing = frame.withColumns({name: F.lit(0) for name in ("node", "cls", "label", "n", "_id", "_hash", "row", "sketch")})
    assert found(clashing) == sorted(by_hand(rows), key=repr)
    assert found(frame.limit(0)) == []


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{number}" for number in range(30))
    rows = [(5, text), (5, text), (None, text + " more"), (2, text + " also"), (None, "alone here"), (8, "x y"), (8, "z y x")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted([
        (5, 29, 2, False), (5, 29, 2, False), (None, 30, 2, False), (2, 30, 2, True), (None, 1, None, False),
        (8, 1, 8, True), (8, 2, 8, True)], key=repr)


def test_share_of_pairs_that_meet_in_a_tree():
    draw = np.random.default_rng(7)
    share = 0.8
    lost = 0
    roots = [np.uint64(number * 7919 + 13) for number in range(chosen_path.trees(share))]
    for _ in range(300):
        one = draw.integers(0, 1 << 32, (1, chosen_path.POSITIONS), dtype=np.uint32)
        two = np.where(draw.random(one.shape) < share, one, one + np.uint32(1)).astype(np.uint32)
        alive = [(root, root) for root in roots]
        for _ in range(6):
            alive = [(a, b) for left, right in alive for a, b in zip(
                chosen_path._branch(np.array([left]), one)[0], chosen_path._branch(np.array([right]), two)[0]) if a == b]
        lost += not alive
    assert lost <= 1


def _nodes_table(nodes, own, bits):
    lists = pa.array([sorted(row) for row in nodes], pa.list_(pa.int64()))
    count = len(nodes)
    return pa.table([
        pa.array([own] * count), pa.array(range(count), pa.int64()), pa.array(range(count), pa.int64()), pa.array([True] * count),
        pa.array([own] * count), lists, pa.array([bits] * count, pa.binary())],
        names=["chunk", "cls", "label", "lead", "node", "nodes", "bits"]).combine_chunks()


def test_pairs_belong_to_the_first_node_that_holds_both(monkeypatch):
    monkeypatch.setattr(chosen_path, "PAIRS_AT_ONCE", 37)
    draw = random.Random(9)
    nodes = [{0, *(draw.randrange(-60, 60) for _ in range(draw.randrange(0, 9)))} for _ in range(60)]
    left, right, _ = chosen_path._owned_pairs(_nodes_table(nodes, 0, bytes(chosen_path.COMPARED)), 200)
    want = {(one, two) for two in range(60) for one in range(two) if min(nodes[one] & nodes[two]) == 0}
    assert len(left) == len(want) and set(zip(left.tolist(), right.tolist())) == want


def test_many_agreeing_pairs_take_little_time():
    draw = random.Random(10)
    nodes = [{7, *(draw.randrange(1 << 40) for _ in range(9))} for _ in range(1200)]
    table = _nodes_table(nodes, 7, bytes(chosen_path.COMPARED))
    start = time.process_time()
    left, _, _ = chosen_path._owned_pairs(table, 200)
    assert len(left) == 1200 * 1199 // 2 and time.process_time() - start < 6
