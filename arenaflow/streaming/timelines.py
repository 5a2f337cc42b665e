"""Timelines built from tick-ordered observations.

Each operator is the batch form over all matches of a per-tick state machine:
state becomes a running value per key, and "the first tick that ..." becomes an
aggregate.  Ticks and sequences are cut into cells, so no task orders a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, finite
from arenaflow.functions.temporal import asof_lookup, carry_forward

SEQUENCE_CELL = 65536
TICK_CELL = 4096


def pause_safe_clock(observations: DataFrame, cell: int = SEQUENCE_CELL) -> DataFrame:
    """Observations with ``clock``: pause-adjusted game time.

    Rows hold nullable ``net_tick, millis_per_tick, game_start_time,
    total_paused_ticks, paused, direct_game_time`` per ``extraction_id,
    sequence``.  The tick-derived time is used once its inputs are known, the
    direct time before; a paused clock keeps its value.
    """
    usable = observations.select(
        "*",
        F.when(finite(F.col("millis_per_tick")) & (F.col("millis_per_tick") > 0), F.col("millis_per_tick")).alias("__ms"),
        F.when(finite(F.col("game_start_time")) & (F.col("game_start_time") > 0), F.col("game_start_time"))
        .alias("__start"),
        F.greatest(F.lit(0), F.col("total_paused_ticks").cast("bigint")).alias("__pauses"),
        F.when(finite(F.col("direct_game_time")), F.col("direct_game_time")).alias("__direct"),
    ).withColumn("__pauses", F.when(F.col("total_paused_ticks").isNotNull(), F.col("__pauses")))
    key, order = ["extraction_id"], ["sequence"]
    state = carry_forward(usable, key, order, {
        "s_tick": ("net_tick", "last"), "s_ms": ("__ms", "last"), "s_start": ("__start", "last"),
        "s_pauses": ("__pauses", "last"), "s_paused": ("paused", "last"), "s_direct": ("__direct", "last")}, cell)
    derived = (
        F.col("s_tick") * F.col("s_ms") / 1000.0 - F.col("s_start")
        - F.coalesce("s_pauses", F.lit(0)) * F.col("s_ms") / 1000.0)
    paused = F.coalesce("s_paused", F.lit(False))
    timed = state.withColumn("__running", F.when(~paused, F.coalesce(
        F.when(finite(derived), derived), F.when(derived.isNull(), F.col("s_direct"))))
    ).withColumn("__held", F.when(paused, F.col("s_direct")))
    known = carry_forward(timed, key, order, {
        "__last": ("__running", "last"), "__first": ("__held", "first")}, cell)
    return known.withColumn("clock", F.coalesce("__last", "__first")).select(*observations.columns, "clock")


def combat_times(game_time: Column, raw_timestamp: Column, source_timestamp: Column) -> tuple[Column, Column]:
    """Game time when the clock is finite; raw time falls back to the source timestamp."""
    def usable(value: Column) -> Column:
        return F.when(finite(value), value.cast("double"))

    return usable(game_time), F.coalesce(usable(raw_timestamp), usable(source_timestamp))


def coalesce_counters(observations: DataFrame, ticks: DataFrame, keys: list[str], cell: int = TICK_CELL) -> DataFrame:
    """Counter changes: last value per key and tick, unchanged values dropped.

    ``observations``: ``extraction_id, *keys, tick, sequence, total``;
    ``ticks``: ``extraction_id, tick, game_time`` for every finished tick.
    What was seen before the clock is the baseline at the first timed tick, at
    time ``min(t, 0)``; a different value of that same tick waits for the next.
    """
    identity = ["extraction_id", *keys]
    timed = ticks.where(finite(F.col("game_time")))
    first = timed.groupBy("extraction_id").agg(
        F.min("tick").alias("first_tick"), F.min_by("game_time", "tick").alias("first_time"))
    second = timed.join(first.select("extraction_id", "first_tick"), "extraction_id").where("tick > first_tick").groupBy(
        "extraction_id").agg(F.min("tick").alias("second_tick"))
    starts = first.join(second, "extraction_id", "left")
    latest = observations.where("total >= 0").groupBy(*identity, "tick").agg(F.max_by("total", "sequence").alias("total"))
    placed = latest.join(starts, "extraction_id")
    opening = placed.where("tick <= first_tick").groupBy(
        *identity, "first_tick", "first_time", "second_tick").agg(
        F.max_by("total", F.when(F.col("tick") < F.col("first_tick"), F.col("tick"))).alias("untimed"),
        F.max(F.when(F.col("tick") == F.col("first_tick"), F.col("total"))).alias("pending"))
    baseline = opening.select(
        *identity, F.col("first_tick").alias("tick"), F.least("first_time", F.lit(0.0)).alias("game_time"),
        F.coalesce("untimed", "pending").alias("total"))
    waiting = opening.where("untimed <> pending AND second_tick IS NOT NULL").select(
        *identity, F.col("second_tick").alias("tick"), F.col("pending").alias("total"), F.lit(0).alias("fresh"))
    later = placed.where("tick > first_tick").select(*identity, "tick", "total", F.lit(1).alias("fresh"))
    changes = later.unionByName(waiting).groupBy(*identity, "tick").agg(F.max_by("total", "fresh").alias("total")).join(
        timed.select("extraction_id", "tick", "game_time"), ["extraction_id", "tick"])
    series = baseline.unionByName(changes.select(baseline.columns))
    compared = carry_forward(series, identity, ["tick"], {"previous": ("total", "last")}, cell, inclusive=False)
    return compared.where("previous IS NULL OR previous <> total").drop("previous")


def world_coordinate(cell: Column, offset: Column) -> Column:
    value = cell.cast("double") * fixed.CELL_SIZE - fixed.CELL_ORIGIN + offset.cast("double")
    return F.when(finite(value) & value.between(fixed.WORLD_MINIMUM, fixed.WORLD_MAXIMUM), value)


HERO_STATE = ("entity_handle", "game_player_id", "hero_id", "team_id", "life_state", "illusion", "clone", "phantom",
              "replicating_handle", "cell_x", "cell_y", "offset_x", "offset_y")


def tick_milliseconds(seconds: Column) -> Column:
    return F.when(finite(seconds), F.floor(seconds * 1000.0 + 0.000001).cast("bigint"))


def sample_grid(ticks: DataFrame, game_end: DataFrame | None = None, cell: int = TICK_CELL) -> DataFrame:
    """100 ms grid times with the first tick that reaches them, up to the game end.

    ``game_end`` holds ``extraction_id, end_ms``.
    """
    reached = ticks.withColumn("reached", tick_milliseconds(F.col("game_time"))).where("reached >= 0")
    before = carry_forward(reached, ["extraction_id"], ["tick"], {"previous": ("reached", "max")}, cell, inclusive=False)
    limited = before if game_end is None else before.join(game_end, "extraction_id", "left")
    end = F.col("reached") if game_end is None else F.least("reached", "end_ms")
    step = fixed.SAMPLE_MS
    low = F.coalesce((F.floor(F.col("previous") / step) + 1) * step, F.lit(0)).cast("bigint")
    high = (F.floor(end / step) * step).cast("bigint")
    return limited.withColumn("low", low).withColumn("high", high).where("low <= high").select(
        "extraction_id", "tick", F.explode(F.sequence("low", "high", F.lit(step).cast("bigint")))
        .alias("game_time_milliseconds"))


def resample_positions(states: DataFrame, grid: DataFrame, roster: DataFrame, cell: int = TICK_CELL) -> DataFrame:
    """Last known position of each player's main hero on the 100 ms grid.

    ``states`` holds one row per changed entity and tick: ``extraction_id,
    entity_uid, generation, tick``, a ``deleted`` flag and nullable state
    columns.  ``roster`` holds ``extraction_id, game_player_id, roster_hero_id,
    roster_team_id, selected_handle``.  Dead heroes and copies are left out; of
    several candidates the newest generation wins.
    """
    entity = ["extraction_id", "entity_uid"]
    full = carry_forward(states, entity, ["tick"], {name: (name, "last") for name in HERO_STATE}, cell)
    lives = full.groupBy(*entity).agg(F.min("tick").alias("born"))
    # State is looked up once per entity and sampled tick; the grid times of a
    # tick are attached at the end.
    asked = grid.select("extraction_id", "tick").distinct().join(lives, "extraction_id").where(
        "tick >= born").select(*entity, "tick")
    held = asof_lookup(asked, full, entity, "tick", "tick", ["generation"], ["generation", "deleted", *HERO_STATE],
                       cell, "state", unique_times=True)
    current = held.select("extraction_id", "tick",
                          *[F.col(f"state.{name}").alias(name) for name in ("generation", "deleted", *HERO_STATE)]
                          ).where("NOT coalesce(deleted, false)")

    def absent(handle: Column) -> Column:
        return handle.isin(*fixed.NULL_HANDLES)

    valid_roster = roster.where("game_player_id BETWEEN 0 AND 9")
    chosen = valid_roster.where(F.col("selected_handle").isNotNull() & ~absent(F.col("selected_handle"))).select(
        "extraction_id", F.col("selected_handle").alias("entity_handle"), F.col("game_player_id").alias("chosen_player"))
    linked = current.join(chosen, ["extraction_id", "entity_handle"], "left").withColumn(
        "player", F.coalesce("chosen_player", "game_player_id"))
    known = linked.join(valid_roster.withColumnRenamed("game_player_id", "player"), ["extraction_id", "player"], "left")
    original = (
        (F.col("illusion") == F.lit(False)) & (F.col("phantom") == F.lit(False)) & (F.col("clone") == F.lit(False))
        & absent(F.col("replicating_handle")))
    other_selected = F.coalesce(~absent(F.col("selected_handle")) & (F.col("selected_handle") != F.col("entity_handle")),
                                F.lit(False))
    copied = (
        F.coalesce("illusion", F.lit(False)) | F.coalesce("clone", F.lit(False)) | F.coalesce("phantom", F.lit(False))
        | F.coalesce(~absent(F.col("replicating_handle")), F.lit(False)))
    hero = F.coalesce("roster_hero_id", "hero_id")
    team = F.coalesce("roster_team_id", "team_id")
    agrees = (
        F.coalesce(F.col("roster_hero_id") == F.col("hero_id"), F.lit(True))
        & F.coalesce(F.col("roster_team_id") == F.col("team_id"), F.lit(True)))
    eligible = known.where(
        F.col("player").between(0, 9)
        & (F.col("chosen_player").isNotNull() | (~other_selected & F.coalesce(original, F.lit(False))))
        & (F.col("life_state") == 0) & ~copied & agrees & (hero > 0) & team.isin(fixed.RADIANT, fixed.DIRE)
    ).select("extraction_id", "tick", F.col("player").alias("game_player_id"), "generation", hero.alias("hero_id"), team.alias("team_id"),
             world_coordinate(F.col("cell_x"), F.col("offset_x")).alias("world_x"),
             world_coordinate(F.col("cell_y"), F.col("offset_y")).alias("world_y")
             ).where("world_x IS NOT NULL AND world_y IS NOT NULL")
    newest = eligible.groupBy("extraction_id", "tick", "game_player_id").agg(
        F.max_by(F.struct("hero_id", "team_id", "world_x", "world_y"), "generation").alias("row"))
    return grid.join(newest, ["extraction_id", "tick"]).select(
        "extraction_id", "game_time_milliseconds", "game_player_id", F.col("tick").alias("demo_tick"), "row.*")


def probability_samples(graph: DataFrame, spans: DataFrame, spectator: DataFrame) -> DataFrame:
    """Win-probability samples from the graph, else from spectator updates.

    ``graph``: ``extraction_id, sequence, position, value`` (0..100, 64 positions);
    ``spans``: ``extraction_id, graph_start, graph_end, match_duration``;
    ``spectator``: ``extraction_id, sequence, tick, game_time, value``.
    A graph of zeros only, or without a valid span, is not usable.
    """
    last = graph.where(F.col("position").between(0, fixed.GRAPH_POSITIONS - 1)).groupBy("extraction_id", "position").agg(
        F.max_by("value", "sequence").alias("value")).where("value BETWEEN 0 AND 100")
    duration = F.col("graph_end") - F.col("graph_start")
    usable = spans.where(
        finite(F.col("graph_start")) & finite(F.col("graph_end")) & finite(F.col("match_duration"))
        & (F.col("match_duration") >= 0) & (F.col("graph_end") > F.col("graph_start"))
    ).join(last.where("value <> 0").select("extraction_id").distinct(), "extraction_id", "left_semi")
    time = (F.col("match_duration") - duration) + duration * F.col("position") / F.lit(fixed.GRAPH_POSITIONS - 1.0)
    from_graph = last.join(usable, "extraction_id").withColumn("game_time_seconds", time).where(
        finite(F.col("game_time_seconds")) & (F.col("game_time_seconds") >= 0)
    ).groupBy("extraction_id", "game_time_seconds").agg(
        F.max_by("value", "position").alias("value")).select(
        "extraction_id", "game_time_seconds", (F.col("value") / 100.0).alias("radiant_probability"),
        F.lit(fixed.GRAPH_HISTORY).alias("source"))
    valid = finite(F.col("value")) & F.col("value").between(0.0, 1.0)
    per_tick = spectator.groupBy("extraction_id", "tick", "game_time").agg(
        F.max_by(F.struct(F.when(valid, F.col("value")).alias("value")), "sequence").alias("row")).where(
        F.col("row.value").isNotNull() & finite(F.col("game_time")) & (F.col("game_time") >= 0))
    from_updates = per_tick.groupBy("extraction_id", F.col("game_time").alias("game_time_seconds")).agg(
        F.max_by("row.value", "tick").alias("radiant_probability")).join(
        from_graph.select("extraction_id").distinct(), "extraction_id", "left_anti").select(
        "extraction_id", "game_time_seconds", "radiant_probability", F.lit(fixed.SPECTATOR_UPDATES).alias("source"))
    return from_graph.unionByName(from_updates)


def capture_linked_creeps(creeps: DataFrame, spawners: DataFrame) -> DataFrame:
    """Creeps with complete properties whose spawner handle was seen, whenever it was seen."""
    complete = creeps.where(
        "spawner_handle IS NOT NULL AND life_state IS NOT NULL AND health IS NOT NULL "
        "AND team_number IS NOT NULL AND summoned IS NOT NULL").where(F.col("spawner_handle") != fixed.INVALID_HANDLE)
    return complete.join(
        spawners.select("extraction_id", F.col("handle").alias("spawner_handle")), ["extraction_id", "spawner_handle"],
        "left_semi")


def link_statistics(creeps: DataFrame, spawners: DataFrame) -> DataFrame:
    """Spawners, linked creeps, and creeps with invalid or unresolved spawner handles."""
    counted = spawners.groupBy("extraction_id").agg(F.count("*").alias("spawner_count"))
    linked = capture_linked_creeps(creeps, spawners).groupBy("extraction_id").agg(F.count("*").alias("linked_creeps"))
    handles = spawners.select("extraction_id", F.col("handle").alias("spawner_handle")).distinct().withColumn(
        "seen", F.lit(True))
    states = creeps.where("spawner_handle IS NOT NULL").join(
        handles, ["extraction_id", "spawner_handle"], "left").groupBy("extraction_id").agg(
        count_if(F.col("spawner_handle") == fixed.INVALID_HANDLE).alias("invalid_handles"),
        count_if((F.col("spawner_handle") != fixed.INVALID_HANDLE) & F.col("seen").isNull()).alias("unresolved_handles"))
    joined = counted.join(linked, "extraction_id", "full_outer").join(states, "extraction_id", "full_outer")
    return joined.select("extraction_id", *[
        F.coalesce(name, F.lit(0)).alias(name)
        for name in ("spawner_count", "linked_creeps", "invalid_handles", "unresolved_handles")])


def session_window_actions(assigned: DataFrame, time: str, gap: str = "8 seconds") -> DataFrame:
    """Streaming form of damage sessions: Spark's session window per player and camp.

    Give ``assigned`` a watermark on ``time`` when it is a stream.  Rows are
    merged into sessions by partial aggregation.
    """
    return assigned.groupBy("extraction_id", "player_slot", "camp_id", F.session_window(time, gap).alias("session")).agg(
        F.count("*").alias("damage_event_count"), F.sum("damage").alias("total_damage"),
        F.min(time).alias("first_damage"), F.max(time).alias("last_damage")
    ).select("extraction_id", "player_slot", "camp_id", "damage_event_count", "total_damage", "first_damage",
             "last_damage")
