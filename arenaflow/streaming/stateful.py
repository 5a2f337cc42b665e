"""Keyed state with timers: coalescing candidates until their window closes, and holding entities back until they are linked.

Both operators need the RocksDB state store (``use_keyed_state``).  A row meets
the state of its key or group of keys only, so state is spread like any shuffle;
it leaves by a timer or when its key is settled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arenaflow import fixed_values as fixed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, which keyed state with timers needs."""
    spark.conf.set(_PROVIDER, _ROCKS)


# --- candidates -----------------------------------------------------------------------------


#: Keys meet their state in so many groups: a call to the state costs more than a row, so a group's open rows are one value.
GROUPS = 4096


class _Coalesce(StatefulProcessor):
    """One open row for each key of a group: its first row with the latest known values, until ``closes`` (milliseconds) passes.

    A group has one timer, at the earliest end among its open rows.
    """

    def __init__(self, names: list[str], key: str, latest: list[str], order: str, closes: str):
        self.names, self.key, self.latest, self.order, self.closes = names, key, latest, order, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, rows binary")

    def _load(self) -> tuple[int | None, dict]:
        """The group's timer and its open rows: by key the values of ``names`` and the number of offers."""
        if not self.open.exists():
            return None, {}
        timer, rows = self.open.get()
        return timer, pickle.loads(rows)

    def _keep(self, held: dict, timer: int | None, earliest: int) -> None:
        if timer is None or earliest < timer:
            timer = earliest
            self.handle.registerTimer(timer)
        self.open.update((timer, pickle.dumps(held, pickle.HIGHEST_PROTOCOL)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        places, found = None, {}
        for row in rows:
            if places is None:
                places = [row.__fields__.index(name) for name in self.names]
                closes, order, own, *latest = (row.__fields__.index(name) for name in (
                    self.closes, self.order, self.key, *self.latest))
            if row[closes] <= watermark:
                yield Row(**{name: row[at] for name, at in zip(self.names, places)}, late=True, offers=1)
                continue
            seen = found.setdefault(row[own], [row, 0, {}])
            if row[order] < seen[0][order]:
                seen[0] = row
            seen[1] += 1
            for name, at in zip(self.latest, latest):
                if row[at] is not None and (name not in seen[2] or row[order] > seen[2][name][0]):
                    seen[2][name] = (row[order], row[at])
        if not found:
            return
        timer, held = self._load()
        for name, (first, offers, newest) in found.items():
            known = held.get(name)
            values = list(known[:-1]) if known else [first[at] for at in places]
            for column, (_, value) in newest.items():
                values[self.names.index(column)] = value
            held[name] = (*values, offers + (known[-1] if known else 0))
        ends = self.names.index(self.closes)
        self._keep(held, timer, min(held[name][ends] for name in found))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, ends = timerValues.getCurrentWatermarkInMs(), self.names.index(self.closes)
        timer, held = self._load()
        left = {name: values for name, values in held.items() if values[ends] > watermark}
        for name, values in held.items():
            if name not in left:
                yield Row(**dict(zip(self.names, values)), late=False, offers=values[-1])
        if left and len(left) < len(held):
            self._keep(left, None, min(values[ends] for values in left.values()))
        elif held and not left:
            self.open.clear()

    def close(self) -> None:
        pass


def coalesce_candidates(candidates: DataFrame, order: str = "sequence", delay_minutes: int = fixed.WINDOW_DELAY_MINUTES,
                        latest: tuple[str, ...] = ("avg_rank_tier", "num_rank_tier")) -> DataFrame:
    """Streaming candidates, one row for each match, with ``late`` and ``offers`` appended.

    The first row of a match (by ``order`` in its micro-batch) wins and later known
    values of ``latest`` replace its own, over any number of micro-batches, until
    the watermark passes the end of the row's hour.  Then the match leaves with
    ``late`` false and the number of rows it was made of, and its state goes.
    A row whose hour has closed before its micro-batch leaves by itself with ``late`` true, so late rows
    can be counted and stored; none is dropped.
    """
    closes = (F.floor(F.unix_seconds("start_ts") / 3600) * 3600 + 3600).cast("bigint") * 1000
    # Without the watermarked column the operator sees late rows too.
    rows = candidates.withWatermark("start_ts", f"{delay_minutes} minutes").withColumn("closes_ms", closes).drop("start_ts")
    output = T.StructType([*rows.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("offers", T.LongType())])
    grouped = rows.withColumn("__group", F.pmod(F.xxhash64("match_id"), F.lit(GROUPS)))
    return grouped.groupBy("__group").transformWithState(
        _Coalesce(rows.columns, "match_id", list(latest), order, "closes_ms"), output, "append", "EventTime")


def late_counts(coalesced: DataFrame) -> DataFrame:
    """Late rows of every window in the output of ``coalesce_candidates``."""
    return coalesced.where("late").groupBy("window_start").agg(F.count(F.lit(1)).alias("late_count"))


# --- linked entities ------------------------------------------------------------------------

SPAWNER, CREEP, UPDATE, DELETE = "spawner", "creep", "update", "delete"
LOG = (T.StructType().add("extraction_id", "string").add("sequence", "long").add("kind", "string")
       .add("entity_instance_id", "long").add("handle", T.DecimalType(20, 0)).add("complete", "boolean")
       .add("path", "string").add("value", "string"))
EMISSIONS = (T.StructType().add("extraction_id", "string").add("entity_instance_id", "long").add("emission", "string")
             .add("sequence", "long").add("released_at", "long").add("path", "string").add("value", "string"))
#: What the creation of an entity gives, in order.
_BIRTH = ("identity", "creation", "checkpoint")


class _Tag(StatefulProcessor):
    """Give the updates and the deletion of a creep the spawner handle that its creation named."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spawner = handle.getValueState("spawner", "handle decimal(20, 0), own boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.spawner.get() if self.spawner.exists() else None
        for row in sorted(rows, key=lambda row: row["sequence"]):
            if row["kind"] in (SPAWNER, CREEP):
                if row["kind"] == CREEP and (not row["complete"] or row["handle"] is None or row["handle"] == fixed.INVALID_HANDLE):
                    continue
                known = (row["handle"], row["kind"] == SPAWNER)
                self.spawner.update(known)
            if known is not None:
                yield Row(**{**row.asDict(), "handle": known[0], "own": known[1]})

    def close(self) -> None:
        pass


class _HoldBack(StatefulProcessor):
    """Keep what the creeps of a spawner report until the spawner is seen, then let it out in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "sequence long")
        self.waiting = handle.getListState("waiting", "sequence long, kind string, entity long, path string, value string")
        self.gone = handle.getMapState("gone", "entity long", "gone boolean")
        self.whole = handle.getMapState("whole", "entity long", "whole boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        extraction, seen = key[0], self.seen.exists()

        def out(row: tuple, released: int) -> Iterator[Row]:
            sequence, kind, entity, path, value = row
            for name in _BIRTH if kind == CREEP else ("deletion" if kind == DELETE else kind,):
                yield Row(extraction_id=extraction, entity_instance_id=entity, emission=name, sequence=sequence,
                          released_at=released, path=path, value=value)

        for row in sorted(rows, key=lambda row: row["sequence"]):
            sequence, kind, entity = row["sequence"], row["kind"], row["entity_instance_id"]
            fields = (sequence, kind, entity, row["path"], row["value"])
            if row["own"]:
                names = _BIRTH[:2] if kind == SPAWNER else ("deletion",) if kind == DELETE else ()
                if row["complete"] and kind in (SPAWNER, UPDATE) and not self.whole.containsKey((entity,)):
                    self.whole.updateValue((entity,), (True,))
                    names += ("checkpoint",)
                for name in names:
                    yield Row(extraction_id=extraction, entity_instance_id=entity, emission=name, sequence=sequence,
                              released_at=sequence, path=None, value=None)
                if kind == SPAWNER and not seen:
                    seen = True
                    self.seen.update((sequence,))
                    for held in self.waiting.get():
                        yield from out(tuple(held), sequence)
                    self.waiting.clear()
            elif not seen:
                self.waiting.appendValue(fields)
            elif not self.gone.containsKey((entity,)):
                yield from out(fields, sequence)
                if kind == DELETE:
                    self.gone.updateValue((entity,), (True,))

    def close(self) -> None:
        pass


def stream_linked_entities(log: DataFrame) -> DataFrame:
    """Streaming form of ``linked_entities``; rows of ``LOG`` arrive in micro-batches that ascend by ``sequence``.

    Creeps are tagged with their spawner's handle first, so that the hold-back
    buffer is kept for each handle and not for a whole match.
    """
    tagged = T.StructType([*LOG.fields, T.StructField("own", T.BooleanType())])
    known = log.select(*LOG.names).groupBy("extraction_id", "entity_instance_id").transformWithState(
        _Tag(), tagged, "append", "None")
    return known.groupBy("extraction_id", "handle").transformWithState(_HoldBack(), EMISSIONS, "append", "None")


def linked_entities(log: DataFrame) -> DataFrame:
    """Identity, creation, checkpoint, updates and deletion of spawners and of the creeps whose spawner is seen.

    A creep counts when it was created complete and names a spawner handle.  Until the first spawner of that handle is created,
    whatever the creep reports is held back; ``released_at`` is the sequence at which a row comes out, its own or the
    spawner's.  Reports after a deletion count only where the deletion itself was held back.  A spawner's checkpoint
    comes with its creation or with the first update that completes it.
    """
    born = log.where(F.col("kind") == CREEP).where(
        F.col("complete") & F.col("handle").isNotNull() & (F.col("handle") != fixed.INVALID_HANDLE))
    seen = log.where(F.col("kind") == SPAWNER).groupBy("extraction_id", "handle").agg(F.min("sequence").alias("seen_at"))
    creeps = born.select("extraction_id", "entity_instance_id", "handle", F.col("sequence").alias("born_at")).join(
        seen, ["extraction_id", "handle"])
    spawners = log.where(F.col("kind") == SPAWNER).select("extraction_id", "entity_instance_id", "sequence", "complete")

    def emitted(frame: DataFrame, emission, released) -> DataFrame:
        return frame.select(
            "extraction_id", "entity_instance_id", emission.alias("emission"), "sequence", released.alias("released_at"),
            *[F.col(name) if name in frame.columns else F.lit(None).cast("string").alias(name) for name in ("path", "value")])

    late_as = F.greatest("sequence", "seen_at")
    names = F.explode(F.array(*map(F.lit, _BIRTH)))
    births = emitted(creeps.withColumn("sequence", F.col("born_at")), names, late_as)
    own = emitted(spawners, F.explode(F.when(F.col("complete"), F.array(*map(F.lit, _BIRTH))).otherwise(
        F.array(*map(F.lit, _BIRTH[:2])))), F.col("sequence"))
    keys = ["extraction_id", "entity_instance_id"]
    completed = log.where((F.col("kind") == UPDATE) & F.col("complete")).join(
        spawners.where(~F.col("complete")).select(*keys, F.col("sequence").alias("born_at")), keys).where(
        "sequence > born_at").groupBy(*keys).agg(F.min("sequence").alias("sequence"))
    reports = log.where(F.col("kind").isin(UPDATE, DELETE)).select(
        "extraction_id", "entity_instance_id", "kind", "sequence", "path", "value")
    removed = reports.where(F.col("kind") == DELETE).groupBy("extraction_id", "entity_instance_id").agg(
        F.min("sequence").alias("deleted_at"))
    told = reports.join(creeps.join(removed, keys, "left"), keys).where("sequence > born_at").where(
        "deleted_at IS NULL OR sequence <= deleted_at OR seen_at > deleted_at")
    deleted = reports.where(F.col("kind") == DELETE).join(spawners.select(*keys, F.col("sequence").alias("born_at")), keys).where(
        "sequence > born_at").drop("path", "value")
    return births.unionByName(own).unionByName(emitted(
        told, F.when(F.col("kind") == DELETE, "deletion").otherwise(F.col("kind")), late_as)).unionByName(
        emitted(deleted, F.lit("deletion"), F.col("sequence"))).unionByName(
        emitted(completed, F.lit("checkpoint"), F.col("sequence")))
