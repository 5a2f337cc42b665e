"""Data quality: ingest reconciliation and field audits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, finite
from arenaflow.functions.heroes import HERO_NAME_PREFIX
from arenaflow.functions.ranks import exact_order_statistics
from arenaflow.operators.versions import actual_game
from arenaflow.sources.staged import apply_storage_policy, blob_owners


def ingest_reconciliation(staged: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """Stored against expected counts per extraction and table.

    ``expected_rows`` applies the storage policy to the staged rows.
    ``rejected_rows`` and ``orphan_rows`` must be zero, ``distinct_sequences``
    must equal ``stored_rows`` for property updates.
    """
    expected = apply_storage_policy(dict(staged))
    orphans = _orphans(stored)
    rejected = {
        "records": F.col("record_type").isin(*fixed.REJECTED_RECORD_TYPES),
        "entityInstances": F.col("class_name").isin(*fixed.REJECTED_ENTITY_CLASSES),
        "entityEvents": ~F.col("event_type").isin(*fixed.STORED_ENTITY_EVENTS),
        "checkpoints": ~F.col("checkpoint_kind").isin(*fixed.STORED_CHECKPOINT_KINDS),
    }
    parts = []
    for name in expected:
        measures = [F.count("*").alias("stored_rows"),
                    count_if(rejected.get(name, F.lit(False))).alias("rejected_rows")]
        if name == "propertyUpdates":
            measures.append(F.count_distinct("sequence").alias("distinct_sequences"))
        counted = stored[name].groupBy("extraction_id").agg(*measures)
        if name != "propertyUpdates":
            counted = counted.withColumn("distinct_sequences", F.lit(None).cast("bigint"))
        wanted = expected[name].groupBy("extraction_id").agg(F.count("*").alias("expected_rows"))
        lost = orphans[name].groupBy("extraction_id").agg(F.count("*").alias("orphan_rows")) if name in orphans else None
        joined = counted.join(wanted, "extraction_id", "full_outer")
        joined = joined.join(lost, "extraction_id", "left") if lost is not None else joined.withColumn(
            "orphan_rows", F.lit(0).cast("bigint"))
        parts.append(joined.select(
            "extraction_id", F.lit(name).alias("table_name"),
            *[F.coalesce(column, F.lit(0)).cast("bigint").alias(column)
              for column in ("stored_rows", "expected_rows", "rejected_rows", "orphan_rows")], "distinct_sequences"))
    combined = reduce(DataFrame.unionByName, parts)
    return combined.withColumn("consistent", (
        (F.col("stored_rows") == F.col("expected_rows")) & (F.col("rejected_rows") == 0) & (F.col("orphan_rows") == 0)
        & (F.col("distinct_sequences").isNull() | (F.col("distinct_sequences") == F.col("stored_rows")))))


def _orphans(stored: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    entity = ["extraction_id", "entity_instance_id"]
    owners = stored["entityInstances"].select(*entity)
    found = {name: stored[name].select(*entity).join(owners, entity, "left_anti")
             for name in ("entityEvents", "propertyUpdates", "checkpoints")}
    found["blobs"] = stored["blobs"].select("extraction_id", "record_sequence").join(
        blob_owners(stored["records"], stored["propertyUpdates"], stored["checkpoints"]),
        ["extraction_id", "record_sequence"], "left_anti")
    return found


def _is_hero_target() -> Column:
    return (F.col("target_hero") == F.lit(True)) & F.col("target_team").isin(fixed.RADIANT, fixed.DIRE)


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).isNotNull()


def _audited_fields() -> dict[str, Column]:
    """What an event can carry for a fight to use it, each as a condition on one row."""
    named = F.lower(F.coalesce("target_name", F.lit("")))
    other = ~F.col("damage_source_name").eqNullSafe(F.col("attacker_name"))
    sides = (fixed.RADIANT, fixed.DIRE)
    teams = F.col("attacker_team").isin(*sides) & F.col("target_team").isin(*sides) & (
        F.col("attacker_team") != F.col("target_team"))
    return {
        "amount": F.col("value").isNotNull(),
        "assist list": F.size(F.coalesce("assist_players", F.array().cast("array<int>"))) > 0,
        "attacker": _filled("attacker_name"),
        "barracks": named.contains("barracks") | named.contains("_rax"),
        "building": F.col("target_building"),
        "copy": F.coalesce("attacker_illusion", F.lit(False)) | F.coalesce("target_illusion", F.lit(False)),
        "enemy hit": teams & (F.col("value") > 0) & finite(F.col("game_time")),
        "hero source": F.col("damage_source_name").startswith(HERO_NAME_PREFIX),
        "own target": ~F.col("target_illusion"),
        "place": finite(F.col("location_x")) & finite(F.col("location_y")),
        "roshan": named.contains("roshan"),
        "source": _filled("damage_source_name"),
        "source apart from attacker": _filled("damage_source_name") & other,
        "target": _filled("target_name"),
        "time": finite(F.col("game_time")),
        "tormentor": named.contains("tormentor"),
        "tower": named.contains("tower"),
    }


def event_field_audit(combat: DataFrame, bounds: DataFrame) -> DataFrame:
    """How often each field is filled, per extraction and kind of event: ``events, filled, filled_on_hero``.

    One aggregation over the log; its few rows are turned into one row per field.
    """
    hero = F.coalesce(_is_hero_target(), F.lit(False))
    fields = _audited_fields()
    relevant = combat.where(F.col("event_type").isin(fixed.DEATH, fixed.DAMAGE, fixed.HEAL, fixed.XP))
    counted = actual_game(relevant, bounds).groupBy("extraction_id", "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        *[F.struct(count_if(condition), count_if(condition & hero)).alias(name) for name, condition in fields.items()])
    return counted.select("extraction_id", "event_type", "events", F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(f"`{name}`.col1").alias("filled"),
                 F.col(f"`{name}`.col2").alias("filled_on_hero")) for name in fields])))


def assist_mapping_audit(combat: DataFrame, bounds: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many assist credits resolve to exactly one, no or several metadata players."""
    ids = candidates.where("game_player_id >= 0").groupBy("extraction_id", "game_player_id").agg(
        F.count("*").alias("candidates"))
    listed = ids.groupBy("extraction_id").agg(
        F.count("*").alias("metadata_game_player_ids"),
        count_if(F.col("candidates") > 1).alias("ambiguous_metadata_ids"))
    credits = actual_game(combat.where((F.col("event_type") == fixed.DEATH) & _is_hero_target()), bounds).select(
        "extraction_id", F.explode("assist_players").alias("game_player_id"))
    # Credits shrink to one row per player before the lookup.
    counted = credits.groupBy("extraction_id", "game_player_id").agg(F.count("*").alias("credits")).join(
        ids, ["extraction_id", "game_player_id"], "left").groupBy("extraction_id").agg(
        F.sum("credits").alias("assist_credits"),
        F.sum(F.when(F.col("candidates") == 1, F.col("credits"))).alias("mapped_assist_credits"),
        F.sum(F.when(F.col("candidates").isNull(), F.col("credits"))).alias("unmapped_assist_credits"),
        F.sum(F.when(F.col("candidates") > 1, F.col("credits"))).alias("ambiguous_assist_credits"))
    names = ("metadata_game_player_ids", "ambiguous_metadata_ids", "assist_credits", "mapped_assist_credits",
             "unmapped_assist_credits", "ambiguous_assist_credits")
    ready = bounds.where("stop_sequence IS NOT NULL").select("extraction_id")
    return ready.join(listed, "extraction_id", "left").join(counted, "extraction_id", "left").select(
        "extraction_id", *[F.coalesce(name, F.lit(0)).alias(name) for name in names])


def position_audit(extractions: DataFrame, positions: DataFrame) -> DataFrame:
    """Position rows and whether all lie on a 100 ms boundary; NULL without rows."""
    counted = positions.groupBy("extraction_id").agg(
        F.count("*").alias("position_rows"),
        count_if(F.col("game_time_milliseconds") % fixed.SAMPLE_MS == 0).alias("exact_rows"))
    return extractions.select("extraction_id").distinct().join(counted, "extraction_id", "left").select(
        "extraction_id", F.coalesce("position_rows", F.lit(0)).alias("position_rows"),
        (F.col("exact_rows") == F.col("position_rows")).alias("on_exact_boundary"))


def nearest_rank_percentile(frame: DataFrame, keys: list[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles, exact and without gathering a group."""
    return exact_order_statistics(frame, keys, value, {
        name: F.greatest(F.lit(0), F.ceil(F.col("n") * F.lit(fraction)) - 1) for name, fraction in fractions.items()})


def upper_median(frame: DataFrame, keys: list[str], value: str, output: str) -> DataFrame:
    """Middle value, the upper one of two."""
    return exact_order_statistics(frame, keys, value, {output: F.floor(F.col("n") / 2)})
