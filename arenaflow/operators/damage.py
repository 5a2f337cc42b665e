"""Damage timelines: fixed intervals, credited side, via and mechanism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import blank_to_null
from arenaflow.functions.heroes import combat_log_name, pretty_name
from arenaflow.operators.versions import actual_game


def interval_start(seconds: Column, width: int = fixed.DAMAGE_INTERVAL_SECONDS) -> Column:
    """Start of the interval, also for times before the horn."""
    return (F.floor(seconds / F.lit(width)) * width).cast("bigint")


def via_kind(illusion: Column, unit: Column, credited: Column) -> Column:
    """Illusion outranks another unit, which outranks direct damage."""
    return F.when(illusion, "illusion").when(unit.isNotNull() & (unit != credited), "unit").otherwise("direct")


def via_name(kind: Column, unit: Column) -> Column:
    return F.when(kind != "direct", unit)


def via_label(kind: Column, unit: Column) -> Column:
    return (
        F.when(kind == "illusion", F.concat(
            F.when(unit.isNull(), F.lit("Unknown unit")).otherwise(pretty_name(unit)), F.lit(" illusion")))
        .when(kind == "unit", pretty_name(unit)).otherwise("Direct")
    )


def _damage(combat: DataFrame, bounds: DataFrame) -> DataFrame:
    return actual_game(
        combat.where((F.col("event_type") == fixed.DAMAGE) & F.col("game_time").isNotNull()
                     & F.col("value").isNotNull()), bounds)


def _heroes(players: DataFrame, name: str) -> DataFrame:
    return players.select(
        "extraction_id", "player_slot", F.col("team_id").alias("hero_team"),
        combat_log_name(F.col("hero_id")).alias(name)).where(F.col(name).isNotNull())


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def damage_taken_facts(combat: DataFrame, bounds: DataFrame, players: DataFrame) -> DataFrame:
    """Flat facts of damage taken by every roster hero: name and team must match."""
    heroes = _heroes(players, "target_name")
    rows = _damage(combat, bounds).where(~_flag("target_illusion")).join(
        heroes, (["extraction_id", "target_name"])).where(F.col("target_team") == F.col("hero_team"))
    attacker, source = blank_to_null(F.col("attacker_name")), blank_to_null(F.col("damage_source_name"))
    credited = F.coalesce(source, attacker, F.lit("Unknown source"))
    kind = via_kind(_flag("attacker_illusion"), attacker, credited)
    return rows.select(
        "extraction_id", "player_slot", "sequence", "game_time", "raw_time",
        interval_start(F.col("game_time")).alias("interval_start"),
        credited.alias("source_name"),
        kind.alias("via_kind"), via_name(kind, attacker).alias("via_name"),
        blank_to_null(F.col("inflictor_name")).alias("mechanism_name"),
        F.col("value").cast("bigint").alias("damage"), "attacker_team", "damage_type",
        _flag("spell_generated_attack").alias("spell_generated_attack"),
    )


def damage_done_facts(combat: DataFrame, bounds: DataFrame, players: DataFrame) -> DataFrame:
    """Flat facts of damage dealt by every roster hero; illusion targets are kept."""
    heroes = _heroes(players, "dealer_name")
    dealer = F.coalesce(F.nullif("damage_source_name", F.lit("")), F.nullif("attacker_name", F.lit("")))
    rows = _damage(combat, bounds).withColumn("dealer_name", dealer).join(
        heroes, ["extraction_id", "dealer_name"]).where(F.col("attacker_team") == F.col("hero_team"))
    target, attacker = blank_to_null(F.col("target_name")), blank_to_null(F.col("attacker_name"))
    credited = F.coalesce(blank_to_null(F.col("target_source_name")), target, F.lit("Unknown target"))
    kind = via_kind(_flag("target_illusion"), target, credited)
    credited_dealer = F.coalesce(blank_to_null(F.col("damage_source_name")), attacker)
    dealer_kind = via_kind(_flag("attacker_illusion"), attacker, credited_dealer)
    return rows.select(
        "extraction_id", "player_slot", "sequence", "game_time", "raw_time",
        interval_start(F.col("game_time")).alias("interval_start"),
        credited.alias("target_name"), "target_team",
        kind.alias("via_kind"), via_name(kind, target).alias("via_name"),
        blank_to_null(F.col("inflictor_name")).alias("mechanism_name"),
        dealer_kind.alias("dealer_via_kind"), via_name(dealer_kind, attacker).alias("dealer_via_name"),
        F.col("value").cast("bigint").alias("damage"), "attacker_team", "damage_type",
        _flag("spell_generated_attack").alias("spell_generated_attack"),
    )


TAKEN_LEVELS = (("interval_start",), ("source_name",), ("via_kind", "via_name"), ("mechanism_name",))
DONE_LEVELS = (("interval_start",), ("target_name", "target_team"), ("via_kind", "via_name"), ("mechanism_name",))


def damage_levels(facts: DataFrame, levels: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Sums at every level of the timeline in one pass.

    ``level`` 0 is the player's whole match, the last level is the mechanism.
    Each fact expands to its own levels only, and partial sums combine before
    the shuffle, so this is the cost of one aggregation.  NULL is a real name at
    some levels, so ``level`` tells it apart from "all".
    """
    names = [name for level in levels for name in level]

    def grouping(depth: int) -> Column:
        kept = {name for level in levels[:depth] for name in level}
        return F.struct(F.lit(depth).alias("level"), *[
            (F.col(name) if name in kept else F.lit(None).cast(facts.schema[name].dataType)).alias(name)
            for name in names])

    # Sum the finest level first: the expansion then works on groups, not facts.
    finest = facts.groupBy("extraction_id", "player_slot", *names).agg(
        F.sum("damage").alias("damage"), F.count("*").alias("event_count"))
    expanded = finest.select(
        "extraction_id", "player_slot", "damage", "event_count",
        F.inline(F.array(*[grouping(depth) for depth in range(len(levels) + 1)])))
    return expanded.groupBy("extraction_id", "player_slot", "level", *names).agg(
        F.sum("damage").alias("damage"), F.sum("event_count").alias("event_count"))


def damage_taken_by_source(combat: DataFrame, bounds: DataFrame, players: DataFrame) -> DataFrame:
    return damage_levels(damage_taken_facts(combat, bounds, players), TAKEN_LEVELS)


def damage_done_by_target(combat: DataFrame, bounds: DataFrame, players: DataFrame) -> DataFrame:
    return damage_levels(damage_done_facts(combat, bounds, players), DONE_LEVELS)


def labelled(levels: DataFrame, credited: str) -> DataFrame:
    """Display labels for aggregated timeline rows.

    Labels are looked up on the few aggregated rows, not on every event.
    """
    return levels.select(
        "*", pretty_name(F.col(credited)).alias("label"),
        F.when(F.col("via_kind").isNotNull(), via_label(F.col("via_kind"), F.col("via_name"))).alias("via_label"),
        F.coalesce(pretty_name(F.col("mechanism_name")), F.lit("Attack")).alias("mechanism_label"),
    )


def group_totals(facts: DataFrame, group: list[str], credited: str) -> DataFrame:
    """Damage per credited group and player with its label."""
    return facts.groupBy("extraction_id", "player_slot", *group).agg(
        F.sum("damage").alias("damage")).withColumn("label", pretty_name(F.col(credited)))


def leading_groups(totals: DataFrame, group: list[str], size: int = fixed.NAMED_SERIES) -> DataFrame:
    """The ``size`` largest groups per player: damage, then label, then name (binary order).

    A rank below a constant lets Spark keep only the best rows of every input
    partition before the shuffle.
    """
    order = Window.partitionBy("extraction_id", "player_slot").orderBy(
        F.col("damage").desc(), "label", *[F.col(name).asc_nulls_first() for name in group])
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
