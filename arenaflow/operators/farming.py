"""Camp-farming sessions: nearest position, nearest live camp, gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, finite, half_up
from arenaflow.functions.heroes import combat_log_name
from arenaflow.functions.temporal import (
    asof_lookup, carry_forward, cell_number, gap_sessions, nearest_lookup, ordered_index, running_total,
)
from arenaflow.schemas import PROPERTY_ARRAY
from arenaflow.session import cut_lineage

ENTITY = ["extraction_id", "entity_instance_id"]
CAMP = ["extraction_id", "camp_id"]


def _milliseconds(seconds: Column) -> Column:
    return half_up(seconds * 1000)


def _creation_properties(checkpoints: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """First creation checkpoint per entity, pivoted to typed columns."""
    first = checkpoints.where("checkpoint_kind = 'creation'").groupBy(*ENTITY).agg(
        F.min_by(F.struct("checkpoint_game_time", "properties"), "sequence").alias("first"))
    listed = F.from_json("first.properties", PROPERTY_ARRAY)

    def value(path: str, kind: str) -> Column:
        found = F.filter("listed", lambda entry: entry["propertyPath"] == path)
        return F.array_max(F.transform(found, lambda entry: entry["value"].try_cast(kind)))

    return first.withColumn("listed", listed).select(
        *ENTITY, F.col("first.checkpoint_game_time").alias("checkpoint_game_time"),
        *[value(path, kind).alias(name) for name, (path, kind) in fields.items()])


def _entity_times(events: DataFrame) -> DataFrame:
    def first(kind: str) -> Column:
        return F.min_by("game_time", F.when(F.col("event_type") == kind, F.col("sequence")))

    return events.groupBy(*ENTITY).agg(
        count_if(F.col("event_type") == "create").alias("create_count"),
        first("create").alias("create_time"),
        count_if(F.col("event_type") == "delete").alias("delete_count"),
        first("delete").alias("delete_time"))


def _facts(instances: DataFrame, checkpoints: DataFrame, events: DataFrame, class_name: str,
           fields: dict[str, tuple[str, str]]) -> DataFrame:
    chosen = instances.where(F.col("class_name") == class_name).select(*ENTITY, "handle", "game_time")
    keys = chosen.select(*ENTITY)
    return (
        chosen
        .join(_creation_properties(checkpoints.join(keys, ENTITY, "left_semi"), fields), ENTITY, "left")
        .join(_entity_times(events.join(keys, ENTITY, "left_semi")), ENTITY, "left")
        .withColumn("creation_ms", _milliseconds(F.coalesce("create_time", "checkpoint_game_time", "game_time")))
        .withColumn("deletion_ms", _milliseconds(F.col("delete_time")))
    )


def spawner_facts(instances: DataFrame, checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Camp spawners with place, type and lifetime; one created before the clock has always existed."""
    return _facts(instances, checkpoints, events, fixed.SPAWNER_CLASS, {
        "world_x": ("worldX", "double"), "world_y": ("worldY", "double"), "camp_type": ("m_Type", "int"),
    }).withColumn("creation_ms", F.coalesce("creation_ms", F.lit(fixed.BEFORE_CLOCK_MS)))


def creep_facts(instances: DataFrame, checkpoints: DataFrame, events: DataFrame, updates: DataFrame) -> DataFrame:
    """Neutral creeps with spawner, team, lifetime and death time."""
    facts = _facts(instances, checkpoints, events, fixed.CREEP_CLASS, {
        "spawner_handle": ("m_hNeutralSpawner", "decimal(20,0)"), "team_number": ("m_iTeamNum", "int"),
        "health": ("m_iHealth", "int"), "life_state": ("m_lifeState", "int"), "summoned": ("m_bIsSummoned", "boolean"),
    })
    return facts.join(death_times(facts, updates), ENTITY, "left").withColumn(
        "death_ms", _milliseconds(F.col("death_time")))


def death_times(creeps: DataFrame, updates: DataFrame) -> DataFrame:
    """Time of the first death transition in update order.

    Health must fall to zero from a nonzero value, or the life state must leave
    zero.  The checkpoint value seeds each property's history.
    """
    tracked = updates.where(F.col("property_path").isin("m_iHealth", "m_lifeState")).select(
        *ENTITY, "sequence", "property_path", F.col("value").try_cast("int").alias("value"), "game_time")
    history = carry_forward(tracked, [*ENTITY, "property_path"], ["sequence"], {"previous": ("value", "last")}, 65536,
                            inclusive=False)
    compared = history.join(creeps.select(*ENTITY, "health", "life_state"), ENTITY)
    seed = F.when(F.col("property_path") == "m_iHealth", F.col("health")).otherwise(F.col("life_state"))
    previous = F.coalesce(F.col("previous"), seed)
    died = (
        ((F.col("property_path") == "m_iHealth") & (previous != 0) & (F.col("value") == 0))
        | ((F.col("property_path") == "m_lifeState") & (previous == 0) & (F.col("value") != 0)))
    return compared.withColumn("died", died).where("died").groupBy(*ENTITY).agg(
        F.min_by("game_time", "sequence").alias("death_time"))


def link_violations(spawners: DataFrame, creeps: DataFrame) -> DataFrame:
    """``extraction_id, entity_instance_id, problem`` for entities that break a link rule."""
    def lifetime(kind: str) -> list[Column]:
        return [
            F.when(F.coalesce("create_count", F.lit(0)) != 1, f"{kind} needs exactly one creation"),
            F.when(F.coalesce("delete_count", F.lit(0)) > 1, f"{kind} has several deletions"),
            F.when((F.col("delete_count") == 1) & F.col("deletion_ms").isNull(), f"{kind} deletion has no time")]

    handles = spawners.groupBy("extraction_id", F.col("handle").alias("spawner_handle")).agg(
        F.count("*").alias("spawners"))
    of_spawners = spawners.select(*ENTITY, F.explode(F.array_compact(F.array(*lifetime("spawner")))).alias("problem"))
    of_creeps = creeps.join(handles, ["extraction_id", "spawner_handle"], "left").select(
        *ENTITY, F.explode(F.array_compact(F.array(
            *lifetime("creep"),
            F.when(F.col("creation_ms").isNull(), "creep has no creation time"),
            F.when(F.col("spawner_handle") == fixed.INVALID_HANDLE, "creep has the invalid spawner handle"),
            F.when((F.col("spawner_handle") != fixed.INVALID_HANDLE) & (F.coalesce("spawners", F.lit(0)) != 1),
                   "spawner handle does not resolve exactly once"),
            F.when(F.col("spawner_handle").isNull(), "creep has no spawner handle")))).alias("problem"))
    return of_spawners.unionByName(of_creeps)


def camps(spawners: DataFrame) -> DataFrame:
    """Spawners with their camp id: 0-based rank by y, x, handle and instance."""
    shared = spawners.groupBy("extraction_id", "handle").agg(F.count("*").alias("handle_count"))
    return ordered_index(spawners, ["extraction_id"], ["world_y", "world_x", "handle", "entity_instance_id"],
                         500.0, "camp_id").join(shared, ["extraction_id", "handle"])


def camp_creeps(located: DataFrame, creeps: DataFrame) -> DataFrame:
    """Team-neutral creeps of camps whose handle is unambiguous."""
    owner = located.where("handle_count = 1").select(
        "extraction_id", "camp_id", F.col("handle").alias("spawner_handle"))
    return creeps.where(
        (F.col("team_number") == fixed.NEUTRAL) & (F.col("spawner_handle") != fixed.INVALID_HANDLE)
    ).join(owner, ["extraction_id", "spawner_handle"]).select(
        *CAMP, "entity_instance_id", "creation_ms", "deletion_ms", "death_ms")


def alive_at(time: Column, creation: Column, deletion: Column, death: Column | None = None) -> Column:
    """Created at or before, deleted only later; a death at the very time still counts as alive."""
    exists = (creation <= time) & (deletion.isNull() | (deletion > time))
    return exists if death is None else exists & (death.isNull() | (death >= time))


def eligible_damage(combat: DataFrame, players: DataFrame) -> DataFrame:
    """Direct hero damage on neutral units, over the whole log and not only the actual game."""
    names = players.select("extraction_id", "player_slot", combat_log_name(F.col("hero_id")).alias("attacker_name")) \
        .where("attacker_name IS NOT NULL").groupBy("extraction_id", "attacker_name").agg(
        F.count("*").alias("heroes"), F.min("player_slot").cast("bigint").alias("player_slot")).where("heroes = 1")
    return combat.where(
        (F.col("event_type") == fixed.DAMAGE) & (F.col("value") > 0) & (F.col("target_team") == fixed.NEUTRAL)
        & F.col("target_name").startswith(fixed.NEUTRAL_NAME_PREFIX)
        & (F.col("attacker_illusion") == F.lit(False)) & finite(F.col("game_time"))
    ).select("extraction_id", "sequence", "attacker_name", _milliseconds(F.col("game_time")).alias("time_ms"),
             F.col("value").cast("bigint").alias("damage")).join(
        names.drop("heroes"), ["extraction_id", "attacker_name"]).drop("attacker_name")


def locate_damage(damage: DataFrame, positions: DataFrame) -> DataFrame:
    """Damage with the attacker's nearest position in time; damage without one is dropped."""
    samples = positions.select(
        "extraction_id", F.col("player_slot").cast("bigint").alias("player_slot"),
        F.col("game_time_milliseconds").cast("bigint").alias("sample_ms"), F.col("sequence").alias("sample_sequence"),
        F.col("world_x").cast("double").alias("hero_x"), F.col("world_y").cast("double").alias("hero_y"))
    return nearest_lookup(
        damage, samples, ["extraction_id", "player_slot"], "time_ms", "sample_ms", ["sample_sequence"],
        ["hero_x", "hero_y"], fixed.POSITION_TOLERANCE_MS, 60_000, "sample", unique_times=True,
    ).where("sample IS NOT NULL").select("*", "sample.hero_x", "sample.hero_y").drop("sample")


def alive_counts(creeps: DataFrame, cell_ms: int = 60_000) -> DataFrame:
    """Number of live creeps per camp as a step function ``at, alive``.

    A creep lives until its deletion, or until one millisecond after its death
    because a death at the asked time still counts.  Counting births and deaths
    in time order answers "is any creep alive" without pairing creeps and damage.
    """
    forever = F.lit(9007199254740991)
    closed = F.least(F.coalesce("deletion_ms", forever), F.coalesce(F.col("death_ms") + 1, forever))
    steps = creeps.withColumn("closed", closed).where("creation_ms < closed").select(*CAMP, F.inline(F.array(
        F.struct(F.col("creation_ms").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("closed").alias("at"), F.lit(-1).alias("step")))))
    merged = steps.groupBy(*CAMP, "at").agg(F.sum("step").alias("step"))
    return running_total(merged, CAMP, ["at"], "step", cell_ms, "alive").select(*CAMP, "at", "alive")


def nearest_camp(damage: DataFrame, located: DataFrame, creeps: DataFrame,
                 radius: float = fixed.CAMP_RADIUS) -> DataFrame:
    """Damage with its nearest existing camp that has a live creep; a tie goes to the lower id.

    Camps are joined by map cell as wide as the radius, so damage meets only the
    camps around it.
    """
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    sites = located.select(
        *CAMP, "world_x", "world_y", "creation_ms", "deletion_ms", F.inline(around)).select(
        *CAMP, "world_x", "world_y", "creation_ms", "deletion_ms",
        (cell_number(F.col("world_x"), radius) + F.col("dx")).alias("cx"),
        (cell_number(F.col("world_y"), radius) + F.col("dy")).alias("cy"))
    dx, dy = F.col("world_x") - F.col("hero_x"), F.col("world_y") - F.col("hero_y")
    reachable = damage.withColumn("cx", cell_number(F.col("hero_x"), radius)).withColumn(
        "cy", cell_number(F.col("hero_y"), radius)).join(sites, ["extraction_id", "cx", "cy"]).withColumn(
        "squared", dx * dx + dy * dy).where(
        (F.col("squared") <= radius * radius)
        & alive_at(F.col("time_ms"), F.col("creation_ms"), F.col("deletion_ms"))
    ).select("extraction_id", "player_slot", "sequence", "time_ms", "damage", "camp_id", "squared")
    candidates = asof_lookup(reachable, alive_counts(creeps), CAMP, "time_ms", "at", [], ["alive"], 60_000, "count",
                             unique_times=True).where(F.col("count.alive") > 0)
    return candidates.groupBy("extraction_id", "player_slot", "sequence", "time_ms", "damage").agg(
        F.min(F.struct("squared", "camp_id")).alias("best")).select(
        "extraction_id", "player_slot", "sequence", "time_ms", "damage", F.col("best.camp_id").alias("camp_id"))


def damage_sessions(assigned: DataFrame, gap_ms: int = fixed.DAMAGE_GAP_MS) -> DataFrame:
    """Sessions per player and camp: a pause above the gap starts a new one."""
    return gap_sessions(
        assigned, ["extraction_id", "player_slot", "camp_id"], "time_ms", gap_ms,
        {"events": F.count("*"), "total": F.sum("damage"), "first_event": F.min(F.struct("time_ms", "sequence"))},
        {"damage_event_count": F.sum("events"), "total_damage": F.sum("total"),
         "first_sequence": F.min("first_event")["sequence"]})


def farming_actions(assigned: DataFrame, located: DataFrame, creeps: DataFrame,
                    gap_ms: int = fixed.DAMAGE_GAP_MS) -> DataFrame:
    """One row per session with the fate of the creeps alive at its first damage."""
    sessions = damage_sessions(assigned, gap_ms)
    key = ["extraction_id", "player_slot", "camp_id", "session_number"]
    start = F.col("session_start")
    initial = _alive_at_start(sessions, creeps).groupBy(*key).agg(
        F.count("*").alias("initial_creep_count"), F.count("death_ms").alias("dead_initial_creep_count"),
        F.max("death_ms").alias("last_death"))
    joined = sessions.join(initial, key, "left").join(
        located.select(*CAMP, F.col("handle").alias("spawner_handle"), "camp_type",
                       F.col("world_x").alias("camp_world_x"), F.col("world_y").alias("camp_world_y")), CAMP)
    cleared = (
        (F.col("initial_creep_count") > 0) & (F.col("dead_initial_creep_count") == F.col("initial_creep_count"))
        & (F.col("last_death") <= F.col("session_end") + gap_ms))
    ordered = action_order(joined.withColumn("cleared", F.coalesce(cleared, F.lit(False))))
    return ordered.select(
        "extraction_id", "action_index", F.lit(fixed.FARMING_DEFINITION).alias("definition_name"), "player_slot",
        "camp_id", "spawner_handle", "camp_type", "camp_world_x", "camp_world_y",
        start.alias("start_game_time_ms"),
        F.when(F.col("cleared"), F.col("last_death")).otherwise(F.col("session_end")).alias("end_game_time_ms"),
        F.when(F.col("cleared"), "cleared").otherwise("not_cleared").alias("result"),
        "damage_event_count", "total_damage",
        F.coalesce("initial_creep_count", F.lit(0)).alias("initial_creep_count"),
        F.coalesce("dead_initial_creep_count", F.lit(0)).alias("dead_initial_creep_count"))


def _alive_at_start(sessions: DataFrame, creeps: DataFrame, cell_ms: int = 60_000) -> DataFrame:
    """Creeps alive at each session's first damage, joined by camp and minute.

    Lives are cut to the minutes in which their match has sessions.
    """
    span = sessions.groupBy("extraction_id").agg(
        F.min("session_start").alias("from_ms"), F.max("session_start").alias("to_ms"))
    ended = F.least(F.coalesce("deletion_ms", "to_ms"), F.coalesce("death_ms", "to_ms"), F.col("to_ms"))
    minutes = creeps.join(span, "extraction_id").withColumn(
        "opened", F.greatest("creation_ms", "from_ms")).withColumn("ended", ended).where("opened <= ended").withColumn(
        "minute", F.explode(F.sequence(cell_number(F.col("opened"), cell_ms), cell_number(F.col("ended"), cell_ms))))
    return sessions.withColumn("minute", cell_number(F.col("session_start"), cell_ms)).join(
        minutes.select(*CAMP, "minute", "creation_ms", "deletion_ms", "death_ms"), [*CAMP, "minute"]).where(
        alive_at(F.col("session_start"), F.col("creation_ms"), F.col("deletion_ms"), F.col("death_ms")))


def action_order(actions: DataFrame) -> DataFrame:
    """0-based index per extraction by start, player, camp and first damage."""
    return ordered_index(actions, ["extraction_id"], ["session_start", "player_slot", "camp_id", "first_sequence"],
                         60_000, "action_index")


def assigned_damage(combat: DataFrame, players: DataFrame, positions: DataFrame, instances: DataFrame,
                    checkpoints: DataFrame, entity_events: DataFrame, updates: DataFrame,
                    radius: float = fixed.CAMP_RADIUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Camps, their creeps and the damage assigned to them.

    Camps, creeps and assigned damage are small next to the raw tables and are
    used several times, so each is written to a reliable checkpoint once.
    """
    located = cut_lineage(camps(spawner_facts(instances, checkpoints, entity_events)))
    creeps = cut_lineage(camp_creeps(located, creep_facts(instances, checkpoints, entity_events, updates)))
    damage = cut_lineage(locate_damage(eligible_damage(combat, players), positions))
    return located, creeps, cut_lineage(nearest_camp(damage, located, creeps, radius))


def action_violations(actions: DataFrame) -> DataFrame:
    """``extraction_id, action_index, problem`` for actions that break a rule."""
    rules = {
        "wrong definition": ~F.col("definition_name").eqNullSafe(F.lit(fixed.FARMING_DEFINITION)),
        "negative identifier": (F.col("action_index") < 0) | (F.col("player_slot") < 0) | (F.col("camp_id") < 0),
        "position is not finite": ~finite(F.col("camp_world_x")) | ~finite(F.col("camp_world_y")),
        "ends before it starts": F.col("end_game_time_ms") < F.col("start_game_time_ms"),
        "unknown result": ~F.col("result").isin("cleared", "not_cleared"),
        "no damage events": F.col("damage_event_count") <= 0,
        "no damage": F.col("total_damage") <= 0,
        "invalid creep counts": (F.col("initial_creep_count") <= 0)
            | (F.col("dead_initial_creep_count") > F.col("initial_creep_count")),
        "cleared with live creeps": (F.col("result") == "cleared")
            & (F.col("dead_initial_creep_count") != F.col("initial_creep_count")),
    }
    problems = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]))
    return actions.select("extraction_id", "action_index", F.explode(problems).alias("problem"))


def match_farming_actions(actions: DataFrame, latest: DataFrame) -> DataFrame:
    """Actions of the latest extractions, by match."""
    return actions.join(latest.select("extraction_id", "match_id"), "extraction_id")
