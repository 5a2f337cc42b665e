"""Kernels against brute force, with one key that holds a large share of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arenaflow.functions import spatial
from arenaflow.functions.columns import finite, half_up
from arenaflow.functions.graph import connected_components
from arenaflow.functions.heroes import combat_log_name, pretty_name
from arenaflow.functions.ranks import exact_median, exact_order_statistics
from arenaflow.functions.temporal import (
    asof_lookup, carry_forward, gap_sessions, nearest_lookup, ordered_index, running_total,
)


def skewed(seed, count, top=400):
    """``(key, time, sequence, value)`` where key "hot" holds two thirds of the rows."""
    source = random.Random(seed)
    return [(source.choice(["hot", "hot", "cold", "warm"]) if number % 3 else "hot", source.randrange(-50, top), number,
             source.randrange(1000)) for number in range(count)]


SCHEMA = "key STRING, time BIGINT, sequence BIGINT, value BIGINT"


@pytest.fixture(params=[1, 7])
def facts(spark, request):
    data = skewed(3, 600)
    return data, spark.createDataFrame(data, SCHEMA).repartition(request.param)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("few", [False, True])
def test_asof_matches_brute_force(spark, facts, forward, few):
    data, frame = facts
    asked = [(key, time, number) for number, (key, time, _, _) in enumerate(skewed(9, 200, 500))]
    asked.append(("absent", 5, 9999))
    requests = spark.createDataFrame(asked, "key STRING, at BIGINT, request BIGINT")
    found = asof_lookup(requests, frame, ["key"], "at", "time", ["sequence"], ["sequence", "value"], 40, "f", forward, False, few)
    got = {row.request: (row.f and (row.f.time, row.f.sequence)) for row in found.collect()}
    for key, at, number in asked:
        if forward:
            options = [(time, sequence) for k, time, sequence, _ in data if k == key and time >= at]
            want = min(options) if options else None
        else:
            options = [(time, sequence) for k, time, sequence, _ in data if k == key and time <= at]
            want = max(options) if options else None
        assert got[number] == want
    assert len(got) == len(asked)


def test_asof_highest_ignores_time_order(spark):
    frame = spark.createDataFrame([("a", 1, 9, 10), ("a", 2, 5, 20), ("a", 70, 7, 30)], SCHEMA)
    requests = spark.createDataFrame([("a", 3), ("a", 100), ("a", 0)], "key STRING, at BIGINT")
    found = asof_lookup(requests, frame, ["key"], "at", "time", ["sequence"], ["value"], 10, "f", highest=True)
    assert {row.at: row.f and row.f.sequence for row in found.collect()} == {3: 9, 100: 9, 0: None}


def test_null_times_find_nothing(spark):
    frame = spark.createDataFrame([("a", 1, 1, 1)], SCHEMA)
    requests = spark.createDataFrame([("a", None)], "key STRING, at BIGINT")
    for forward in (False, True):
        found = asof_lookup(requests, frame, ["key"], "at", "time", ["sequence"], ["value"], 10, "f", forward)
        assert [row.f for row in found.collect()] == [None]


def test_nearest_prefers_the_earlier_of_two(spark, facts):
    data, frame = facts
    asked = [(key, time, number) for number, (key, time, _, _) in enumerate(skewed(5, 150, 450))]
    requests = spark.createDataFrame(asked, "key STRING, at BIGINT, request BIGINT")
    found = nearest_lookup(requests, frame, ["key"], "at", "time", ["sequence"], ["value"], 3, 50, "f")
    got = {row.request: row.f and row.f.time for row in found.collect()}
    for key, at, number in asked:
        options = [(abs(time - at), time) for k, time, _, _ in data if k == key and abs(time - at) <= 3]
        assert got[number] == (min(options)[1] if options else None)


def test_running_total_and_index(facts):
    data, frame = facts
    total = running_total(frame, ["key"], ["time", "sequence"], "value", 25, "total")
    placed = ordered_index(total, ["key"], ["time", "sequence"], 25, "place")
    got = {row.sequence: (row.total, row.place) for row in placed.collect()}
    sums, counts = defaultdict(int), defaultdict(int)
    for key, _, sequence, value in sorted(data, key=lambda row: (row[1], row[2])):
        sums[key] += value
        assert got[sequence] == (sums[key], counts[key])
        counts[key] += 1


def test_gap_sessions_split_only_above_the_gap(spark):
    times = [0, 8000, 16001, 16001, 24001, 24002, 40000]
    frame = spark.createDataFrame([("a", time, number, 1) for number, time in enumerate(times)], SCHEMA)
    found = gap_sessions(frame, ["key"], "time", 8000, {"n": F.count("*")}, {"rows": F.sum("n")})
    assert sorted((row.session_start, row.session_end, row.rows) for row in found.collect()) == [
        (0, 8000, 2), (16001, 24002, 4), (40000, 40000, 1)]


def test_gap_sessions_match_brute_force(facts):
    data, frame = facts
    found = gap_sessions(frame, ["key"], "time", 2, {"n": F.count("*")}, {"rows": F.sum("n")})
    want = []
    for key in {row[0] for row in data}:
        current = []
        for time in sorted(row[1] for row in data if row[0] == key):
            if current and time - current[-1] > 2:
                want.append((key, current[0], current[-1], len(current)))
                current = []
            current.append(time)
        want.append((key, current[0], current[-1], len(current)))
    assert sorted((row.key, row.session_start, row.session_end, row.rows) for row in found.collect()) == sorted(want)


def test_carry_forward_last_first_and_maximum(spark, facts):
    data, frame = facts
    sparse = frame.withColumn("value", F.when(F.col("value") % 5 == 0, F.col("value")))
    got = {row.sequence: (row.newest, row.oldest, row.top) for row in carry_forward(
        sparse, ["key"], ["time", "sequence"],
        {"newest": ("value", "last"), "oldest": ("value", "first"), "top": ("value", "max")}, 30).collect()}
    seen = defaultdict(list)
    for key, _, sequence, value in sorted(data, key=lambda row: (row[1], row[2])):
        if value % 5 == 0:
            seen[key].append(value)
        history = seen[key]
        assert got[sequence] == ((history[-1], history[0], max(history)) if history else (None, None, None))


def components(pairs, vertices):
    parent = {vertex: vertex for vertex in vertices}

    def find(vertex):
        while parent[vertex] != vertex:
            vertex = parent[vertex]
        return vertex

    for left, right in pairs:
        a, b = find(left), find(right)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {vertex: find(vertex) for vertex in vertices}


def test_components_of_a_chain_a_hub_and_pairs(spark):
    chain = [(number, number + 1) for number in range(0, 60)]
    hub = [(1000, 1001 + number) for number in range(200)]
    pairs = [(3000, 2999), (4000, 4000), (5000, 5001), (5001, 5000)]
    edges = chain + hub + pairs
    found = connected_components(spark.createDataFrame(edges, "l BIGINT, r BIGINT"), "l", "r")
    got = {row.vertex: row.component for row in found.collect()}
    used = {vertex for edge in edges if edge[0] != edge[1] for vertex in edge}
    assert got == components([edge for edge in edges if edge[0] != edge[1]], used)


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "l BIGINT, r BIGINT"), "l", "r").count() == 0


@pytest.mark.parametrize("levels", [3, 1])
def test_band_edges_keep_the_components_of_all_pairs(spark, monkeypatch, levels):
    """A crowd, a spread and exact boundary distances; few splits leave more to the points."""
    monkeypatch.setattr(spatial, "LEVELS", levels)
    source = random.Random(11)
    points = [("hot", number, source.uniform(0, 60), source.gauss(0, 900), source.gauss(0, 900)) for number in range(260)]
    points += [("hot", 300 + number, source.uniform(0, 400), source.uniform(-8000, 8000), source.uniform(-8000, 8000))
               for number in range(120)]
    points += [("hot", 600 + number, 30.0, 10.0, 10.0) for number in range(40)]
    points += [("edge", 900, 0.0, 0.0, 0.0), ("edge", 901, 20.0, 2500.0, 0.0), ("edge", 902, 40.001, 2500.0, 0.0),
               ("edge", 903, 40.0, 2500.0, 2500.01)]
    frame = spark.createDataFrame(points, "extraction_id STRING, id BIGINT, t DOUBLE, x DOUBLE, y DOUBLE")
    edges = [(row.left_id, row.right_id) for row in spatial.band_edges(frame, ["extraction_id"], 20.0, 2500.0).collect()]
    want = [(a[1], b[1]) for a in points for b in points
            if a[0] == b[0] and abs(a[2] - b[2]) <= 20 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 2500 ** 2]
    ids = [point[1] for point in points]
    assert components(edges, ids) == components(want, ids)
    assert len(edges) < len(want) / 4


def test_densest_seed_matches_all_pairs(spark):
    source = random.Random(4)
    points = []
    for group in range(6):
        count = (1, 2, 3, 30, 200, 80)[group]
        for number in range(count):
            points.append((group, number, float(source.randrange(-6000, 6000)), float(source.randrange(-6000, 6000))))
    points += [(9, number, 100.0, 200.0) for number in range(5)]
    frame = spark.createDataFrame(points, "g INT, ord BIGINT, x DOUBLE, y DOUBLE")
    got = {row.g: (row.seed.x, row.seed.y) for row in spatial.densest_seed(frame, ["g"], 3500.0, ["ord"]).collect()}
    for group in {point[0] for point in points}:
        members = [point for point in points if point[0] == group]

        def score(point):
            near = [d for d in ((point[2] - q[2]) ** 2 + (point[3] - q[3]) ** 2 for q in members) if d <= 3500 ** 2]
            return len(near), -sum(near), -point[1]

        best = max(members, key=score)
        assert got[group] == (best[2], best[3])


def test_densest_seed_of_one_crowded_group(spark):
    """A hundred thousand points of one group: the tree opens few of them, and no pair of all cells is made."""
    import numpy as np

    draw = np.random.default_rng(2)
    count = 100_000
    places = np.concatenate([draw.normal(2000, 1500, (count // 2, 2)), draw.uniform(-8000, 8000, (count // 2, 2))]).round(1)
    frame = spark.createDataFrame([(1, number, float(x), float(y)) for number, (x, y) in enumerate(places)],
                                  "g INT, ord BIGINT, x DOUBLE, y DOUBLE")
    seed = spatial.densest_seed(frame, ["g"], 3500.0, ["ord"]).collect()[0].seed

    def near(x, y):
        return int((((places - (x, y)) ** 2).sum(axis=1) <= 3500.0 ** 2).sum())

    # Points whose count is close to the best lie around the seed: count all of them.
    around = places[((places - (seed.x, seed.y)) ** 2).sum(axis=1) <= 150.0 ** 2]
    assert near(seed.x, seed.y) == max(near(x, y) for x, y in around)
    assert near(seed.x, seed.y) >= max(near(x, y) for x, y in places[draw.choice(count, 300, replace=False)])


def test_exact_order_statistics(facts):
    data, frame = facts
    found = exact_order_statistics(frame, ["key"], "value", {
        "low": F.lit(0), "middle": F.floor(F.col("n") / 2), "p95": F.ceil(F.col("n") * 0.95) - 1})
    for row in found.collect():
        values = sorted(value for key, _, _, value in data if key == row.key)
        size = len(values)
        assert (row.low, row.middle, row.p95) == (values[0], values[size // 2], values[-(-size * 95 // 100) - 1])


def test_order_statistics_of_one_hot_group(spark):
    """Nearly all rows in one group, of values that differ in their lowest bits, signs and magnitudes."""
    source = random.Random(8)
    values = [source.choice([-1, 1]) * source.choice([1e-300, 1.0, 1e300]) * (1 + source.randrange(50) * 2.0 ** -50)
              for _ in range(6000)] + [0.0, -0.0, float("inf"), float("-inf")]
    rows = [("hot", value) for value in values] + [("cold", 3.5), ("cold", None)]
    frame = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    places = {f"p{place}": place for place in (0, 1, 1500, 3001, 3002, 4500, len(values) - 1)}
    found = {row.g: row for row in exact_order_statistics(frame, ["g"], "v", {
        name: F.least(F.lit(place), F.col("n") - 1) for name, place in places.items()}).collect()}
    for name, place in places.items():
        assert found["hot"][name] == sorted(values)[place] and found["cold"][name] == 3.5
    for kind in ("BIGINT", "INT", "DECIMAL(12,3)"):
        typed = frame.where("abs(v) BETWEEN 0.5 AND 2 OR v = 0").selectExpr("g", f"CAST(v * 1000 AS {kind}) AS v")
        middle = exact_order_statistics(typed, ["g"], "v", {"m": F.floor(F.col("n") / 2)})
        want = {key: sorted(row.v for row in typed.collect() if row.g == key) for key in {row.g for row in typed.collect()}}
        assert {row.g: row.m for row in middle.collect()} == {key: own[len(own) // 2] for key, own in want.items()}


def test_exact_median_of_even_and_odd_groups(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", 9.0), ("b", 3.0)], "g STRING, v DOUBLE")
    assert {row.g: row.m for row in exact_median(frame, ["g"], "v", "m").collect()} == {"a": 2.5, "b": 3.0}


def test_names_and_numbers(spark):
    frame = spark.createDataFrame([
        ("npc_dota_hero_nevermore",), ("npc_dota_neutral_kobold",), ("item_black_king_bar",), ("dota_fire_blast",),
        ("plain",), ("item_",)], "name STRING")
    assert [row[0] for row in frame.select(pretty_name(F.col("name"))).collect()] == [
        "Shadow Fiend", "Neutral Kobold", "Black King Bar", "Fire Blast", "Plain", "item_"]
    numbers = spark.createDataFrame([(-2.5,), (2.5,), (float("nan"),), (float("inf"),), (None,)], "v DOUBLE")
    assert [row[0] for row in numbers.where(finite(F.col("v"))).select(half_up(F.col("v"))).collect()] == [-2, 3]
    assert numbers.where(~finite(F.col("v"))).count() == 3
    ids = spark.createDataFrame([(1,), (24,), (None,)], "h INT")
    assert [row[0] for row in ids.select(combat_log_name(F.col("h"))).collect()] == ["npc_dota_hero_antimage", None, None]
