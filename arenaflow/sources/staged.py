"""Staged NDJSON: declared-schema scans, strict scans, and the storage policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import finite
from arenaflow.schemas import staged_name, staged_schema, table_schema


def read_staged(spark: SparkSession, path: str | list[str], logical: str) -> DataFrame:
    """Scan one logical table of any number of extractions in one read.

    The schema is declared, never inferred, so the scan needs no extra pass and
    a malformed row fails the load.
    """
    return to_warehouse(
        spark.read.schema(staged_schema(logical)).option("mode", "FAILFAST").json(path), logical
    )


def scan_staged(spark: SparkSession, path: str | list[str], logical: str) -> DataFrame:
    """Rows of staged files ``.../<extraction>/<file>`` with ``file_extraction_id``, ``file_name`` and ``rescued``.

    A line that is broken or has a field of another kind does not end the scan: its row holds what could be
    read and the whole line in ``rescued``, which is null for sound rows.
    """
    schema = T.StructType([*staged_schema(logical).fields, T.StructField("__rescued", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__rescued").json(path)
    return to_warehouse(rows, logical, {
        OWNER: _owner(), "file_name": F.col("_metadata.file_name"), "rescued": F.col("__rescued")})


def parse_staged_lines(lines: DataFrame, logical: str, column: str = "value") -> DataFrame:
    """The same mapping over NDJSON lines that already sit in a text column."""
    schema = staged_schema(logical)
    return to_warehouse(
        lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*"), logical
    )


def to_warehouse(staged: DataFrame, logical: str, besides: dict[str, Column] | None = None) -> DataFrame:
    """Rename and cast staged fields to the warehouse columns of ``logical``, with the columns ``besides``."""
    columns = []
    for field in table_schema(logical).fields:
        source = F.col(staged_name(logical, field.name))
        if isinstance(field.dataType, T.BinaryType):
            value = F.unbase64(source)
        else:
            value = source.cast(field.dataType)
        if (logical, field.name) == ("propertyUpdates", "value"):
            value = F.coalesce(value, F.lit("null"))
        columns.append(value.alias(field.name))
    return staged.select(*columns, *[value.alias(name) for name, value in (besides or {}).items()])


# --- strict scans ---------------------------------------------------------------------------


#: The extraction whose staged folder holds a row, whatever the row itself says.
OWNER = "file_extraction_id"


def _owner() -> Column:
    """The folder of the file, named ``<extraction>`` or ``<column>=<extraction>``."""
    return F.regexp_extract("_metadata.file_path", "([^/=]+)/[^/]+$", 1).alias(OWNER)


def strict_positions(staged: DataFrame) -> DataFrame:
    """Typed position rows next to their source text and an ``invalid`` flag.

    ``staged`` holds every field as text and the extraction of its file in
    ``OWNER``, which a row is charged to; the flag is true when the row names
    another extraction or none, when the text is not an integer where one is
    required, or when a value is out of range.
    """
    digits, signed = "^[0-9]+$", "^-?[0-9]+$"

    def text(name: str) -> Column:
        return F.col(staged_name("heroPositions", name))

    typed = staged.select(
        F.col(OWNER).alias("extraction_id"), text("extraction_id").alias("claimed"),
        *[text(name).alias(f"source_{name}") for name in
          ("sequence", "demo_tick", "game_time_milliseconds", "game_player_id", "hero_id", "team_id")],
        *[text(name).try_cast("bigint").alias(name) for name in
          ("sequence", "demo_tick", "game_time_milliseconds", "game_player_id")],
        *[text(name).try_cast("int").alias(name) for name in ("hero_id", "team_id")],
        *[text(name).try_cast("double").alias(name) for name in ("world_x", "world_y")],
    )

    def bad_integer(name: str, pattern: str = digits) -> Column:
        return ~F.coalesce(F.col(f"source_{name}").rlike(pattern), F.lit(False)) | F.col(name).isNull()

    def outside(name: str) -> Column:
        return ~finite(F.col(name)) | ~F.col(name).between(fixed.WORLD_MINIMUM, fixed.WORLD_MAXIMUM)

    invalid = (
        ~F.col("claimed").eqNullSafe(F.col("extraction_id")) | F.col("extraction_id").isNull()
        | bad_integer("sequence") | bad_integer("demo_tick", signed)
        | bad_integer("game_time_milliseconds") | (F.col("game_time_milliseconds") % fixed.SAMPLE_MS != 0)
        | (F.col("game_time_milliseconds") > 4294967295)
        | bad_integer("game_player_id") | (F.col("game_player_id") > 9)
        | bad_integer("hero_id") | (F.col("hero_id") <= 0)
        | bad_integer("team_id") | ~F.col("team_id").isin(fixed.RADIANT, fixed.DIRE)
        | outside("world_x") | outside("world_y")
    )
    return typed.withColumn("invalid", F.coalesce(invalid, F.lit(True))).drop("claimed")


def read_strict_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Strict rows of staged files ``.../<extraction>/<file>``; a broken line is an invalid row of its file."""
    rows = spark.read.schema(staged_schema("heroPositions")).option("mode", "PERMISSIVE").json(path)
    return strict_positions(rows.select("*", _owner()))


def read_probability_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of staged files with the extraction of their folder."""
    return spark.read.text(path).select("value", _owner())


def probability_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Probability rows checked by JSON *type*, as text lines of JSON objects with the extraction of their file.

    A quoted number is invalid even though it would cast, and so is a row that
    names another extraction than its file's.  ``invalid`` marks such rows and
    lines that are no object; a NULL never passes.
    """
    parsed = lines.select(OWNER, F.try_parse_json(column).alias("document"))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("document", f"$.{field}", "variant"))

    def get(field: str, target: str) -> Column:
        return F.try_variant_get("document", f"$.{field}", target)

    number = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    # One-row generator: a later filter on ``invalid`` cannot be pushed through it
    # and parse the document again for every field.
    typed = parsed.select(F.inline(F.array(F.struct(
        F.col(OWNER).alias("extraction_id"), get("extractionId", "string").alias("claimed"),
        get("sampleIndex", "bigint").alias("sample_index"),
        get("gameTimeSeconds", "double").alias("game_time_seconds"),
        get("radiantProbability", "double").alias("radiant_probability"),
        get("source", "string").alias("source"),
        (
            (kind("extractionId") == "STRING") & (kind("source") == "STRING")
            & (kind("sampleIndex") == "BIGINT")
            & kind("gameTimeSeconds").rlike(number) & kind("radiantProbability").rlike(number)
        ).alias("typed"),
    ))))
    valid = (
        F.col("typed") & (F.col("claimed") == F.col("extraction_id"))
        & F.col("sample_index").between(0, 4294967295)
        & finite(F.col("game_time_seconds")) & (F.col("game_time_seconds") >= 0)
        & finite(F.col("radiant_probability")) & F.col("radiant_probability").between(0.0, 1.0)
        & F.col("source").isin(fixed.GRAPH_HISTORY, fixed.SPECTATOR_UPDATES)
    )
    return typed.withColumn("invalid", ~F.coalesce(valid, F.lit(False))).drop("typed", "claimed")


def import_probabilities(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """Samples of the extractions whose rows are all valid, share one source and are as many as declared.

    ``declared`` holds ``extraction_id, declared_rows`` of the manifest.  One bad
    row rejects the whole extraction, as a load is all or nothing.
    """
    accepted = (
        objects.groupBy("extraction_id")
        .agg(F.max("invalid").alias("any_invalid"), F.count(F.lit(1)).alias("stored_rows"),
             F.min("source").alias("lowest"), F.max("source").alias("highest"))
        .join(declared, "extraction_id")
        .where("NOT any_invalid AND lowest = highest AND stored_rows = declared_rows")
    )
    return objects.join(accepted.select("extraction_id"), "extraction_id", "left_semi").drop("invalid")


# --- storage policy -------------------------------------------------------------------------


def keep_records(records: DataFrame) -> DataFrame:
    """Drop rejected record types; an unknown (NULL) type is kept."""
    kind = F.col("record_type")
    return records.where(kind.isNull() | ~kind.isin(*fixed.REJECTED_RECORD_TYPES))


def keep_instances(instances: DataFrame) -> DataFrame:
    """Drop rejected entity classes; an unknown (NULL) class is kept."""
    kind = F.col("class_name")
    return instances.where(kind.isNull() | ~kind.isin(*fixed.REJECTED_ENTITY_CLASSES))


def keep_entity_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*fixed.STORED_ENTITY_EVENTS))


def keep_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(F.col("checkpoint_kind").isin(*fixed.STORED_CHECKPOINT_KINDS))


def retain_children(children: DataFrame, instances: DataFrame) -> DataFrame:
    """Rows whose entity instance was kept."""
    return children.join(
        instances.select("extraction_id", "entity_instance_id"), ["extraction_id", "entity_instance_id"], "left_semi"
    )


def blob_owners(records: DataFrame, updates: DataFrame, checkpoints: DataFrame) -> DataFrame:
    keys = [frame.select("extraction_id", F.col("sequence").alias("record_sequence"))
            for frame in (records, updates, checkpoints)]
    return keys[0].unionByName(keys[1]).unionByName(keys[2])


def retain_owned_blobs(blobs: DataFrame, records: DataFrame, updates: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Blobs owned by any kept record, property update or checkpoint."""
    owners = blob_owners(records, updates, checkpoints)
    return blobs.join(owners, ["extraction_id", "record_sequence"], "left_semi")


def apply_storage_policy(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All raw tables after the policy, from the staged tables by logical name."""
    records = keep_records(staged["records"])
    instances = keep_instances(staged["entityInstances"])
    updates = retain_children(staged["propertyUpdates"], instances)
    checkpoints = retain_children(keep_checkpoints(staged["checkpoints"]), instances)
    return {
        "records": records,
        "combatEvents": staged["combatEvents"],
        "entityInstances": instances,
        "entityEvents": retain_children(keep_entity_events(staged["entityEvents"]), instances),
        "propertyUpdates": updates,
        "checkpoints": checkpoints,
        "blobs": retain_owned_blobs(staged["blobs"], records, updates, checkpoints),
    }


def blob_digest_violations(blobs: DataFrame) -> DataFrame:
    """Blobs whose identifier is not the SHA-256 of their bytes."""
    return blobs.where(~F.sha2("value", 256).eqNullSafe(F.col("blob_id")))
