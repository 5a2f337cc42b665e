"""Streams over several micro-batches: late and repeated rows, held-back entities, sessions across batches."""

import random
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from arenaflow.operators.farming import damage_sessions
from arenaflow.streaming import sampler, stateful, timelines

HOUR = 3600
CANDIDATES = ("match_id string, start_time long, duration int, avg_rank_tier int, num_rank_tier int, sequence long")


def fed(spark, folder, schema, batches, made):
    """Rows that a stream gives, started anew from its checkpoint for every batch; the batch number is kept."""
    stateful.use_keyed_state(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/inbox")
        made(spark.readStream.schema(schema).parquet(f"{folder}/inbox")).writeStream.outputMode("append").format(
            "parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def with_window(stream):
    return stream.withColumn("start_ts", F.timestamp_seconds("start_time")).withColumn(
        "window_start", sampler.window_start(F.col("start_time")))


def test_candidates_are_coalesced_over_batches_and_late_rows_counted(spark, tmp_path):
    batches = [
        [("a", 100, 1, None, 5, 1), ("b", 200, 2, 10, None, 2), ("b", 200, 9, 12, None, 3), ("c", HOUR + 5, 3, None, None, 4)],
        # The second batch still finds the first hour open; its end is past the watermark afterwards.
        [("a", 100, 8, 40, None, 5), ("c", HOUR + 5, 7, 33, 2, 6), ("d", 2 * HOUR + 100, 4, 1, 1, 7)],
        [("a", 100, 6, 50, 50, 8), ("late", 300, 5, 1, 1, 9), ("d", 2 * HOUR + 100, 5, None, 3, 10), ("e", 9 * HOUR, 1, 1, 1, 11)],
    ]
    made = fed(spark, tmp_path, CANDIDATES, batches, lambda stream: stateful.coalesce_candidates(
        with_window(stream), delay_minutes=30))
    assert sorted(map(tuple, made.where("NOT late").select(
        "match_id", "duration", "avg_rank_tier", "num_rank_tier", "offers").collect())) == [
        ("a", 1, 40, 5, 2), ("b", 2, 12, None, 2), ("c", 3, 33, 2, 2), ("d", 4, 1, 3, 2)]
    assert sorted(map(tuple, made.where("late").select("match_id", "sequence", "offers").collect())) == [
        ("a", 8, 1), ("late", 9, 1)]
    assert [tuple(row) for row in stateful.late_counts(made).collect()] == [("1970-01-01T00:00:00.000Z", 2)]


def log_rows(draw, matches, creeps):
    rows = []
    for match in range(matches):
        entity = 0
        for _ in range(creeps):
            entity += 1
            born, spawner = draw.randrange(1, 800), draw.choice([1, 2, 3, None, 16777215])
            rows.append((f"m{match}", born, stateful.CREEP, entity, spawner, draw.random() < 0.8, None, None))
            for number in range(3):
                rows.append((f"m{match}", born + draw.randrange(-50, 400), stateful.UPDATE, entity, None, False, "m_iHealth", str(number)))
            if draw.random() < 0.5:
                rows.append((f"m{match}", born + draw.randrange(1, 300), stateful.DELETE, entity, None, False, None, None))
        for handle in (1, 2):
            for _ in range(2):
                entity += 1
                born = draw.randrange(1, 900)
                rows.append((f"m{match}", born, stateful.SPAWNER, entity, handle, draw.random() < 0.5, None, None))
                rows.append((f"m{match}", born + 20, stateful.UPDATE, entity, None, True, "m_Type", "1"))
                rows.append((f"m{match}", born + 90, stateful.DELETE, entity, None, False, None, None))
    # One sequence for each row, in the order drawn.
    rows.sort(key=lambda row: (row[1], row[2] != stateful.SPAWNER))
    return [(row[0], number, *row[2:4], None if row[4] is None else Decimal(row[4]), *row[5:])
            for number, row in enumerate(rows, 1)]


def by_hand(rows):
    """The log read once from its start, entity by entity."""
    found, seen, entities, names = [], {}, {}, ("identity", "creation", "checkpoint")

    def out(match, entity, emission, sequence, released, path=None, value=None):
        found.append((match, entity, emission, sequence, released, path, value))

    for match, sequence, kind, entity, handle, complete, path, value in rows:
        key = (match, entity)
        if kind == stateful.SPAWNER:
            entities[key] = {"own": True, "whole": complete, "gone": False}
            for name in names if complete else names[:2]:
                out(match, entity, name, sequence, sequence)
            if seen.setdefault((match, handle), sequence) == sequence:
                for (other, creep), state in entities.items():
                    if other == match and state.get("handle") == handle:
                        for held in state.pop("held"):
                            out(match, creep, held[0], held[1], sequence, *held[2:])
        elif kind == stateful.CREEP:
            if complete and handle is not None and handle != 16777215:
                entities[key] = {"handle": handle, "gone": False, "held": []}
                for name in names:
                    if (match, handle) in seen:
                        out(match, entity, name, sequence, sequence)
                    else:
                        entities[key]["held"].append((name, sequence))
        elif key in entities:
            state = entities[key]
            if state.get("own"):
                if kind == stateful.UPDATE and complete and not state["whole"]:
                    state["whole"] = True
                    out(match, entity, "checkpoint", sequence, sequence)
                elif kind == stateful.DELETE:
                    out(match, entity, "deletion", sequence, sequence)
                continue
            name = "deletion" if kind == stateful.DELETE else "update"
            if (match, state["handle"]) not in seen:
                state["held"].append((name, sequence, path, value))
            elif not state["gone"]:
                out(match, entity, name, sequence, sequence, path, value)
                state["gone"] = kind == stateful.DELETE
    return sorted(found, key=repr)


def test_entities_are_held_back_until_their_spawner_is_seen(spark, tmp_path):
    rows = log_rows(random.Random(4), 3, 25)
    want = by_hand(rows)
    assert any(row[4] > row[3] for row in want) and any(row[2] == "deletion" and row[4] > row[3] for row in want)
    batch = stateful.linked_entities(spark.createDataFrame(rows, stateful.LOG))
    assert sorted(map(tuple, batch.collect()), key=repr) == want
    cuts = [rows[at:at + 90] for at in range(0, len(rows), 90)]
    streamed = fed(spark, tmp_path, stateful.LOG, cuts, stateful.stream_linked_entities)
    assert sorted(map(tuple, streamed.select(*stateful.EMISSIONS.names).collect()), key=repr) == want


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    draw = random.Random(9)
    rows = sorted((draw.randrange(0, 400_000), draw.randrange(3)) for _ in range(400))
    rows = [("m", slot, 1, 7, at, 10) for at, slot in rows] + [("m", 9, 1, 7, 5_000_000, 10)]
    schema = "extraction_id string, player_slot int, camp_id int, sequence long, at_ms long, damage long"
    cuts = [rows[:150], rows[150:290], rows[290:-1], rows[-1:]]
    streamed = fed(spark, tmp_path, schema, cuts, lambda stream: timelines.session_window_actions(
        stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second"), "at"))
    batch = damage_sessions(spark.createDataFrame(rows[:-1], schema).withColumnRenamed("at_ms", "time_ms"), 8000)
    at = ("first_damage", "last_damage")
    assert sorted(map(tuple, streamed.select(
        "player_slot", "damage_event_count", "total_damage", *[F.unix_millis(name) for name in at]).collect())) == sorted(
        map(tuple, batch.select("player_slot", "damage_event_count", "total_damage", "session_start", "session_end").collect()))


class FakeState:
    """A value state and the timers of one group, which count the calls made to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, time):
        self.calls += 1
        self.timers.add(time)


def test_open_rows_of_a_group_take_few_calls_to_its_state():
    """A match alone gives what it gives among others, and the calls do not follow the number of matches."""
    draw = random.Random(8)
    names = ["match_id", "rank", "sequence", "closes_ms"]
    batches = [(mark, [Row(**dict(zip([*names, "__group"], (draw.choice([None, *range(300)]), draw.choice([None, 1, 2, 3]), number * 1000 + at,
                                                            HOUR * draw.randrange(1, 9), 0)))) for at in range(400)])
               for number, mark in enumerate([0, 0, HOUR, 3 * HOUR - 1, 3 * HOUR, 5 * HOUR, 20 * HOUR])]

    def run(chosen):
        state, made = FakeState(), []
        operator = stateful._Coalesce(names, "match_id", ["rank"], "sequence", "closes_ms")
        operator.init(state)
        for mark, rows in batches:
            time = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
            made += operator.handleInputRows((0,), iter([row for row in rows if chosen(row)]), time)
            for timer in sorted(timer for timer in state.timers if timer <= mark):
                state.timers.discard(timer)
                made += operator.handleExpiredTimer((0,), time, SimpleNamespace(getExpiryTimeInMs=lambda: timer))
        return state, made

    state, together = run(lambda row: True)
    alone = [row for match in (None, *range(300)) for row in run(lambda row: row["match_id"] == match)[1]]
    assert sorted(together, key=repr) == sorted(alone, key=repr)
    assert sum(row["offers"] for row in together) == sum(len(rows) for _, rows in batches)
    assert state.value is None and state.calls < 100
