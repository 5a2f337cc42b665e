"""Item snapshots: normalisation, history, differences and rename checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.functions.temporal import ordered_index

# Fixed value: image overrides by internal-name prefix.
PREFIX_OVERRIDES = {"item_recipe_": "recipe"}
FIELDS = ("name", "internal_name", "image_slug", "neutral_tier", "recipe")


def _words(text: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(text, "^item_", ""), "_"), lambda word: F.length(word) > 0)
    return F.array_join(F.transform(parts, lambda word: F.concat(
        F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))), " ")


def fallback_name(internal: Column) -> Column:
    recipe = F.concat(_words(F.regexp_replace(internal, "^item_recipe_", "item_")), F.lit(" Recipe"))
    return F.when(internal.startswith("item_recipe_"), recipe).otherwise(_words(internal))


def image_slug(item_id: Column, internal: Column, by_id: dict[int, str], by_prefix: dict[str, str]) -> Column:
    """Override by id, else by the longest matching prefix, else the name without its prefix.

    Overrides are a small hand-kept list, so they are literals of the expression.
    """
    options = [F.when(item_id == number, F.lit(slug)) for number, slug in by_id.items()]
    options += [F.when(internal.startswith(prefix), F.lit(slug))
                for prefix, slug in sorted(by_prefix.items(), key=lambda entry: -len(entry[0]))]
    return F.coalesce(*options, F.regexp_replace(internal, "^item_", ""))


def normalize_items(snapshots: DataFrame, by_id: dict[int, str] | None = None,
                    by_prefix: dict[str, str] | None = None) -> DataFrame:
    """``sequence, version`` and normalised fields of every source item.

    The source holds ``id, name, name_english_loc, name_loc, neutral_item_tier``.
    """
    prefixes = PREFIX_OVERRIDES if by_prefix is None else by_prefix
    internal = F.trim("source_name")
    localized = F.coalesce(F.nullif(F.trim("name_english_loc"), F.lit("")), F.nullif(F.trim("name_loc"), F.lit("")))
    return snapshots.withColumnRenamed("name", "source_name").select(
        "sequence", "version", F.col("id").alias("item_id"),
        F.coalesce(localized, fallback_name(internal)).alias("name"), internal.alias("internal_name"),
        image_slug(F.col("id"), internal, by_id or {}, prefixes).alias("image_slug"),
        F.col("neutral_item_tier").alias("neutral_tier"), internal.startswith("item_recipe_").alias("recipe"))


def snapshot_history(items: DataFrame) -> DataFrame:
    """First and last version, whether still present, and the latest attributes."""
    newest = items.agg(F.max("sequence").alias("newest_sequence"))
    history = items.groupBy("item_id").agg(
        F.min_by("version", "sequence").alias("first_seen_version"),
        F.max_by("version", "sequence").alias("last_seen_version"),
        F.max("sequence").alias("last_sequence"), F.max_by(F.struct(*FIELDS), "sequence").alias("row"))
    return history.crossJoin(F.broadcast(newest)).select(
        "item_id", "row.*", (F.col("last_sequence") == F.col("newest_sequence")).alias("active"),
        "first_seen_version", "last_seen_version")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``item_id, change, fields``: added, removed or changed, with the changed fields."""
    old = previous.select("item_id", F.struct(*FIELDS).alias("before"))
    new = current.select("item_id", F.struct(*FIELDS).alias("after"))
    compared = F.array(*[F.struct(
        F.lit(name).alias("field"), F.col(f"before.{name}").cast("string").alias("from"),
        F.col(f"after.{name}").cast("string").alias("to")) for name in FIELDS])
    return old.join(new, "item_id", "full_outer").select(
        "item_id",
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
        .alias("change"),
        F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.filter(
            compared, lambda entry: ~entry["from"].eqNullSafe(entry["to"]))).alias("fields"),
    ).where("change <> 'changed' OR size(fields) > 0")


def rename_guard(items: DataFrame, allowed: DataFrame) -> DataFrame:
    """Internal-name changes between an item's successive snapshots that are not allowed.

    ``allowed`` holds ``item_id, from_name, to_name``.  Runs of one item are its
    snapshots, joined by their position in the item's own history.
    """
    placed = ordered_index(items.select("item_id", "sequence", "internal_name"), ["item_id"], ["sequence"], 1000.0,
                           "place")
    following = placed.select("item_id", (F.col("place") - 1).alias("place"), F.col("sequence").alias("next_sequence"),
                              F.col("internal_name").alias("to_name"))
    changed = placed.join(following, ["item_id", "place"]).where("internal_name <> to_name").select(
        "item_id", F.col("next_sequence").alias("sequence"), F.col("internal_name").alias("from_name"), "to_name")
    return changed.join(allowed.select("item_id", "from_name", "to_name"), ["item_id", "from_name", "to_name"], "left_anti")


def snapshot_checks(snapshots: DataFrame) -> DataFrame:
    """``sequence, problem`` for snapshots that break a rule.

    The source adds ``recipes`` (NULL when it is not an array) and ``version``.
    """
    rows = snapshots.select("sequence", F.explode(F.array_compact(F.array(
        F.when(F.col("id").isNull() | (F.col("id") <= 0), "invalid id"),
        F.when(F.nullif(F.trim("name"), F.lit("")).isNull(), "empty internal name"),
        F.when(F.col("neutral_item_tier").isNull(), "invalid neutral item tier"),
        F.when(F.col("recipes").isNull(), "invalid recipes")))).alias("problem")).distinct()
    repeated = snapshots.groupBy("sequence", "version", "id").agg(F.count("*").alias("uses")).where("uses > 1").select(
        "sequence", F.lit("duplicate id").alias("problem")).distinct()
    shared = snapshots.select("sequence", "version").distinct().groupBy("sequence").agg(
        F.count("*").alias("versions")).where("versions > 1").select(
        "sequence", F.lit("repeated sequence").alias("problem"))
    return rows.unionByName(repeated).unionByName(shared)
