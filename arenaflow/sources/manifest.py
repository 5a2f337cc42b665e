"""Manifest checks: staged file integrity, limits and extraction identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed

_FILE = "STRUCT<path: STRING, sha256: STRING, bytes: BIGINT, records: BIGINT>"
MANIFEST_SCHEMA = (
    "schemaVersion INT, extractionId STRING, matchId STRING, replaySha256 STRING, exporterVersion STRING, "
    "startedAt STRING, completedAt STRING, elapsedMs BIGINT, profile STRING, "
    "parser STRUCT<name: STRING, version: STRING, upstreamRelease: STRING, forkRevision: STRING>, "
    "config STRUCT<maxOutputBytes: BIGINT, maxRecords: BIGINT, maxInputBytes: BIGINT, timeoutSeconds: BIGINT, "
    "checkpointIntervalSeconds: DOUBLE, profile: STRING>, "
    "files STRUCT<" + ", ".join(f"{name}: {_FILE}" for name in fixed.STAGED_FILES) + ">"
)


def parse_manifests(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, MANIFEST_SCHEMA).alias("m")).select("m.*")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """One row per file that the manifest's schema version requires."""
    entries = F.array(*[
        F.struct(F.lit(logical).alias("logical"), F.lit(name).alias("expected_path"),
                 F.lit(since).alias("since"), F.col(f"files.{logical}").alias("entry"))
        for logical, (name, since) in fixed.STAGED_FILES.items()
    ])
    return (
        manifests.select(
            F.col("extractionId").alias("extraction_id"), F.col("schemaVersion").alias("schema_version"),
            F.explode(entries).alias("file"),
        )
        .where("file.since <= schema_version")
        .select("extraction_id", "schema_version", "file.logical", "file.expected_path", "file.entry.*")
    )


def manifest_violations(manifests: DataFrame, expected_match: Column | None = None) -> DataFrame:
    """``extraction_id, problem`` for every broken manifest rule."""
    digest = "^[a-f0-9]{64}$"
    rules = {
        "unsupported schema version": ~F.col("schemaVersion").isin(1, 2, 3),
        "invalid extraction id": ~F.col("extractionId").rlike(digest),
        "invalid replay digest": ~F.col("replaySha256").rlike(digest),
        "parser version and fork revision differ":
            F.col("parser.forkRevision").isNotNull() & (F.col("parser.forkRevision") != F.col("parser.version")),
        "missing required field": F.col("parser.name").isNull() | F.col("parser.version").isNull()
            | F.col("exporterVersion").isNull() | F.col("startedAt").isNull() | F.col("completedAt").isNull()
            | F.col("elapsedMs").isNull() | F.col("files").isNull() | F.col("config").isNull(),
    }
    if expected_match is not None:
        rules["match id mismatch"] = ~F.col("matchId").eqNullSafe(expected_match.cast("string"))
    problems = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()
    ]))
    from_fields = manifests.select(F.col("extractionId").alias("extraction_id"), F.explode(problems).alias("problem"))
    files = manifest_files(manifests)
    file_rules = (
        files.where(
            ~F.coalesce(F.col("path") == F.col("expected_path"), F.lit(False))
            | ~F.coalesce(F.col("sha256").rlike(digest), F.lit(False))
            | ~F.coalesce((F.col("bytes") >= 0) & (F.col("records") >= 0), F.lit(False))
        ).select("extraction_id", F.concat(F.lit("invalid file entry: "), "logical").alias("problem"))
    )
    return from_fields.unionByName(file_rules)


def enforce_limits(manifests: DataFrame) -> DataFrame:
    """Extractions whose staged files exceed the configured bytes or records."""
    totals = manifest_files(manifests).groupBy("extraction_id").agg(
        F.sum("bytes").alias("total_bytes"), F.sum("records").alias("total_records")
    )
    limits = manifests.select(
        F.col("extractionId").alias("extraction_id"),
        F.col("config.maxOutputBytes").alias("maximum_bytes"), F.col("config.maxRecords").alias("maximum_records"),
    )
    return totals.join(limits, "extraction_id").where(
        "total_bytes > maximum_bytes OR total_records > maximum_records"
    )


def verify_staged_files(files: DataFrame, inspected: DataFrame) -> DataFrame:
    """``extraction_id, logical, problem`` where a file differs from its manifest entry.

    ``inspected`` comes from ``inspection.inspect_files``, which has a row for empty files too.
    """
    joined = files.join(inspected, ["extraction_id", "path"], "left")
    problem = (
        F.when(F.col("actual_bytes").isNull(), "missing file")
        .when(F.col("actual_bytes") != F.col("bytes"), "size mismatch")
        .when(F.col("actual_sha256") != F.col("sha256"), "checksum mismatch")
        .when(~F.col("ends_with_newline"), "no trailing newline")
        .when(F.col("actual_records") != F.col("records"), "record count mismatch")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "extraction_id", "logical", "problem"
    )


def extraction_identity(replay_sha256: Column, parser_name: Column, parser_version: Column,
                        export_version: Column, canonical_config: Column) -> Column:
    """Deterministic identifier of one replay, parser, export format and configuration."""
    return F.sha2(F.concat_ws("\n", replay_sha256, parser_name, parser_version, export_version, canonical_config), 256)
