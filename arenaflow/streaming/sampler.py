"""Hourly ranked-match sampling: validation, windows, selection and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import stable_digest
from arenaflow.sources.catalog import coalescing_upsert

CANDIDATE_FIELDS = ("duration", "game_mode", "avg_rank_tier", "num_rank_tier", "cluster")
_SAFE = 9007199254740991


def parse_candidates(lines: DataFrame, column: str = "value") -> DataFrame:
    """Provider rows with an ``invalid`` flag.

    JSON types matter (a quoted number is invalid) so rows are read as VARIANT.
    An optional field that is present but out of range rejects its whole row.
    """
    fields = ("match_id", "start_time", "lobby_type", *CANDIDATE_FIELDS)
    carried = [name for name in lines.columns if name != column]
    documents = lines.select(*carried, F.try_parse_json(column).alias("__doc"))
    # Kinds and values leave through a one-row generator.  A later filter cannot
    # be pushed through it, so the document is parsed once per row and not once
    # per mention in the condition.
    read = documents.select(*carried, F.inline(F.array(F.struct(
        F.try_variant_get("__doc", "$.match_id", "string").alias("__id"),
        *[F.schema_of_variant(F.try_variant_get("__doc", f"$.{name}", "variant")).alias(f"__kind_{name}") for name in fields],
        *[F.try_variant_get("__doc", f"$.{name}", "bigint").alias(f"__value_{name}") for name in fields]))))
    typed = read.select(
        *carried, "__id", F.col("__kind_match_id").alias("__id_kind"),
        *[F.coalesce(F.col(f"__kind_{name}"), F.lit("VOID")).alias(f"__is_{name}") for name in fields],
        *[F.when(F.col(f"__kind_{name}") == "BIGINT", F.col(f"__value_{name}")).alias(f"__{name}") for name in fields])

    def in_range(field: str, low: int, high: int = _SAFE) -> Column:
        return F.coalesce(F.col(f"__{field}").between(low, high), F.lit(False))

    def optional(field: str, low: int, high: int = _SAFE) -> Column:
        return (F.col(f"__is_{field}") == "VOID") | in_range(field, low, high)

    match_ok = in_range("match_id", 1) | (
        (F.col("__is_match_id") == "STRING") & F.coalesce(F.col("__id").rlike("^[1-9][0-9]*$"), F.lit(False)))
    valid = (
        match_ok & in_range("start_time", 1) & in_range("lobby_type", 0)
        & optional("duration", 0) & optional("game_mode", 0) & optional("avg_rank_tier", 1, 99)
        & optional("num_rank_tier", 0) & optional("cluster", 0))
    return typed.select(
        *carried, F.col("__id").alias("match_id"), *[F.col(f"__{name}").alias(name) for name in fields[1:]],
        (~valid).alias("invalid"))


def ranked_candidates(parsed: DataFrame) -> DataFrame:
    """Valid candidates of the ranked lobby with their UTC hour."""
    return parsed.where(~F.col("invalid") & (F.col("lobby_type") == fixed.RANKED_LOBBY)).drop("invalid").withColumn(
        "start_ts", F.timestamp_seconds("start_time")).withColumn("window_start", window_start(F.col("start_time")))


def window_start(start_time: Column) -> Column:
    """ISO text of the UTC hour, independent of the session time zone."""
    hour = (F.floor(start_time / 3600) * 3600).cast("bigint")
    utc = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=hour.cast("decimal(18,6)"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def dedupe_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """First row per match wins; later known ranks replace its rank fields."""
    return coalescing_upsert(candidates, ["match_id"], order, ["avg_rank_tier", "num_rank_tier"])


@dataclass(frozen=True)
class Quota:
    target: int = 30
    priority: int = 24
    control: int = 6
    version: str = "ranked-hourly-v1"

    def __post_init__(self) -> None:
        if min(self.target, self.priority, self.control) < 0:
            raise ValueError("quota values must not be negative")
        if self.priority + self.control > self.target:
            raise ValueError("priority plus control cannot exceed target")
        if not self.version:
            raise ValueError("the sampling version cannot be empty")


def stratified_select(candidates: DataFrame, quota: Quota) -> DataFrame:
    """Per window: the best ranks, then a hashed control group, then a hashed fill.

    ``candidates`` holds one row per ``match_id`` with ``window_start`` and
    ``avg_rank_tier``.  Each step keeps a constant number of rows per window, so
    Spark limits every input partition before it shuffles.  Input order does not
    matter.
    """
    def digest(namespace: str) -> Column:
        return stable_digest(F.lit(quota.version), F.lit(namespace), F.col("window_start"), F.col("match_id"))

    def take(source: DataFrame, namespace: str, order: list[Column], amount: int) -> DataFrame:
        hashed = source.withColumn("selection_hash", digest(namespace))
        rank = F.row_number().over(Window.partitionBy("window_start").orderBy(*order))
        return hashed.withColumn("__rank", rank).where(F.col("__rank") <= amount).drop("__rank").withColumn(
            "selection_group", F.lit(namespace))

    def without(source: DataFrame, *taken: DataFrame) -> DataFrame:
        for part in taken:
            source = source.join(part.select("window_start", "match_id"), ["window_start", "match_id"], "left_anti")
        return source

    by_hash = [F.col("selection_hash"), F.col("match_id")]
    priority = take(candidates.where("avg_rank_tier IS NOT NULL"), "priority",
                    [F.col("avg_rank_tier").desc(), *by_hash], quota.priority)
    # The control group needs at most its size plus what priority may remove, so
    # hashes are cut to a constant number per window before the anti-join.
    reserve = take(candidates, "control", by_hash, quota.control + quota.priority)
    control = take(without(reserve.drop("selection_hash", "selection_group"), priority), "control", by_hash, quota.control)
    spare = take(candidates, "fill", by_hash, quota.target + quota.priority + quota.control)
    left = without(spare.drop("selection_hash", "selection_group"), priority, control)
    ranked = take(left, "fill", by_hash, quota.target)
    used = priority.select("window_start").unionByName(control.select("window_start")).groupBy("window_start").agg(
        F.count("*").alias("__used"))
    order = F.row_number().over(Window.partitionBy("window_start").orderBy(*by_hash))
    fill = ranked.withColumn("__rank", order).join(used, "window_start", "left").where(
        F.col("__rank") <= F.lit(quota.target) - F.coalesce("__used", F.lit(0))).drop("__rank", "__used")
    return priority.unionByName(control).unionByName(fill).withColumn("sampling_version", F.lit(quota.version))


def closed_windows(windows: DataFrame, now: Column, delay_minutes: int = fixed.WINDOW_DELAY_MINUTES) -> DataFrame:
    """Windows that ended at least ``delay_minutes`` before ``now`` (epoch seconds)."""
    return windows.where(F.col("window_seconds") + 3600 <= now - delay_minutes * 60)


def window_summary(candidates: DataFrame, selections: DataFrame, first_hour: int, last_hour: int,
                   quota: Quota) -> DataFrame:
    """One row per hour from ``first_hour`` to ``last_hour`` (epoch seconds), empty hours included."""
    spark = candidates.sparkSession
    hours = spark.range(first_hour, last_hour + 1, 3600).select(
        F.col("id").alias("window_seconds"), window_start(F.col("id")).alias("window_start"))
    found = candidates.groupBy("window_start").agg(
        F.count("*").alias("candidate_count"), F.count("avg_rank_tier").alias("known_rank_count"))
    chosen = selections.groupBy("window_start").agg(F.count("*").alias("selected_count"))
    return hours.join(found, "window_start", "left").join(chosen, "window_start", "left").select(
        "window_seconds", "window_start",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("candidate_count", "known_rank_count", "selected_count")],
        F.lit(quota.target).alias("target"),
        (F.coalesce("selected_count", F.lit(0)) < quota.target).alias("under_target"))


# --- streaming ------------------------------------------------------------------------------


def stream_window_counts(candidates: DataFrame, delay_minutes: int = fixed.WINDOW_DELAY_MINUTES) -> DataFrame:
    """Streaming counts of hourly windows, emitted once when the watermark closes them.

    The close is driven by event time: a window is final when the newest start
    time seen is ``delay_minutes`` past its end.  Rows that arrive later for a
    closed window are dropped and counted by the query's progress.
    """
    return candidates.withWatermark("start_ts", f"{delay_minutes} minutes").groupBy(
        F.window("start_ts", "1 hour")).agg(
        F.count("*").alias("candidate_count"), F.count("avg_rank_tier").alias("known_rank_count")).select(
        F.col("window.start").alias("window_start_ts"), F.col("window.end").alias("window_end_ts"),
        "candidate_count", "known_rank_count")


def stream_first_candidates(candidates: DataFrame, delay_minutes: int = fixed.WINDOW_DELAY_MINUTES) -> DataFrame:
    """Streaming de-duplication by match within the watermark."""
    return candidates.withWatermark("start_ts", f"{delay_minutes} minutes").dropDuplicatesWithinWatermark(["match_id"])


class WindowSampler:
    """``foreachBatch`` target: stores candidates and selects from windows as they close.

    State lives in tables of the shared folder, one folder per batch:
    ``candidates`` by day, the newest start time seen (``progress``) and
    ``selections``.  A repeated batch overwrites its own folders, so a restart
    neither repeats nor loses rows.  A batch selects the windows that closed
    since the batch before and reads only days that can still hold them, so its
    work does not grow with the age of the stream.  Late candidates of a closed
    window are stored but never selected.
    """

    def __init__(self, folder: str, quota: Quota, delay_minutes: int = fixed.WINDOW_DELAY_MINUTES,
                 order: tuple[str, ...] = ("batch_id", "start_time", "match_id")):
        self.folder, self.quota, self.delay, self.order = folder, quota, delay_minutes, list(order)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.withColumn("batch_id", F.lit(batch_id)).withColumn("day", self._day(F.col("start_time")))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(
            f"{self.folder}/candidates")
        before = self._newest_before(spark, batch_id)
        arrived = batch.agg(F.max("start_time")).first()[0]
        newest = max((time for time in (before, arrived) if time is not None), default=None)
        if newest is None:
            return
        spark.createDataFrame([(newest,)], "newest BIGINT").write.mode("overwrite").parquet(
            f"{self.folder}/progress/batch={batch_id}")
        settled = None if before is None else before - self.delay * 60
        stored = self._stored(spark, stamped.schema, batch_id, settled, newest)
        single = dedupe_candidates(stored.drop("day"), self.order).withColumn(
            "window_seconds", F.floor(F.col("start_time") / 3600) * 3600)
        closed = closed_windows(single, F.lit(newest), self.delay)
        if before is not None:
            closed = closed.where(F.col("window_seconds") + 3600 > settled)
        selected = stratified_select(closed.drop("window_seconds"), self.quota)
        selected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{self.folder}/selections/batch={batch_id}")

    @staticmethod
    def _day(start_time: Column) -> Column:
        return F.floor(start_time / 86400).cast("bigint")

    def _stored(self, spark, schema, batch_id: int, settled: int | None, newest: int) -> DataFrame:
        """Candidates of the days that can hold open windows, up to this batch; no other folder is listed."""
        days = "*"
        if settled is not None:
            days = "{" + ",".join(str(day) for day in range((settled - 3600) // 86400, newest // 86400 + 1)) + "}"
        rows = _read(spark, schema, f"{self.folder}/candidates/day={days}", f"{self.folder}/candidates")
        return rows.where(F.col("batch_id") <= batch_id)

    def _newest_before(self, spark, batch_id: int) -> int | None:
        """Newest start time up to the batch before: one row in that batch's folder."""
        if batch_id == 0:
            return None
        return _read(spark, "newest BIGINT", f"{self.folder}/progress/batch={batch_id - 1}").agg(F.max("newest")).first()[0]


def _read(spark, schema, path: str, base: str | None = None) -> DataFrame:
    """Rows below a path, none where it does not exist yet."""
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
