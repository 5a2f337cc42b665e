"""Aggregations, time series and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, half_up
from arenaflow.functions.temporal import asof_lookup
from arenaflow.operators.versions import _newest, known_matches, latest_status

ROLLING_WINDOWS = (1, 5, 10, 30, 60, 300)


def team_totals(players: DataFrame) -> DataFrame:
    """Player count and nine sums per team."""
    integers = ("kills", "deaths", "assists", "last_hits", "denies")
    wide = ("net_worth", "hero_damage", "tower_damage", "hero_healing")
    return players.groupBy("extraction_id", "team_id", "team").agg(
        F.count("*").cast("int").alias("players"),
        *[F.sum(name).cast("int").alias(name) for name in integers],
        *[F.sum(name).cast("bigint").alias(name) for name in wide],
    )


def net_worth_advantage(series: DataFrame) -> DataFrame:
    """Each team's lead at every sample both teams have.

    The sample has one row per team, so a sum over both minus twice the own
    value replaces the self-join: one shuffle instead of two.
    """
    both = series.groupBy("extraction_id", "sample_index").agg(
        F.max(F.when(F.col("team_id") == fixed.RADIANT, F.struct("net_worth"))).alias("radiant"),
        F.max(F.when(F.col("team_id") == fixed.DIRE, F.struct("net_worth"))).alias("dire"),
    ).where("radiant IS NOT NULL AND dire IS NOT NULL")
    sides = F.array(
        F.struct(F.lit(fixed.RADIANT).alias("team_id"), F.col("radiant.net_worth").alias("net_worth"),
                 (F.col("radiant.net_worth") - F.col("dire.net_worth")).alias("net_worth_advantage")),
        F.struct(F.lit(fixed.DIRE).alias("team_id"), F.col("dire.net_worth").alias("net_worth"),
                 (F.col("dire.net_worth") - F.col("radiant.net_worth")).alias("net_worth_advantage")),
    )
    return both.select("extraction_id", "sample_index", F.inline(sides))


def net_worth_leader(totals: DataFrame) -> DataFrame:
    """Leading side, and by how much, from team totals."""
    worth = totals.groupBy("extraction_id").agg(
        F.max(F.when(F.col("team_id") == fixed.RADIANT, F.col("net_worth"))).alias("radiant_net_worth"),
        F.max(F.when(F.col("team_id") == fixed.DIRE, F.col("net_worth"))).alias("dire_net_worth"),
    )
    radiant, dire = F.col("radiant_net_worth"), F.col("dire_net_worth")
    return worth.withColumn("advantage", F.abs(radiant - dire)).withColumn(
        "leader", F.when(radiant > dire, "Radiant").when(dire > radiant, "Dire").when(radiant == dire, "Even")
    )


def hero_stats(matches: DataFrame, latest: DataFrame, players: DataFrame, drafts: DataFrame) -> DataFrame:
    """Picks, bans, results and average rates per hero over the latest extractions."""
    scope = matches.join(latest.select("extraction_id", "match_id"), ["extraction_id", "match_id"], "left_semi").select(
        "extraction_id", "match_id", "winner_team_id")
    size = scope.agg(F.count_distinct("match_id").alias("match_count"))
    decided = F.col("winner_team_id").isin(fixed.RADIANT, fixed.DIRE)

    # A match counts once however many rows it has: first per hero and match, then per hero.
    per_match = players.where("hero_id > 0").join(scope, "extraction_id").groupBy("hero_id", "match_id").agg(
        F.max((decided & (F.col("team_id") == F.col("winner_team_id"))).cast("int")).alias("won"),
        F.max((decided & (F.col("team_id") != F.col("winner_team_id"))).cast("int")).alias("lost"),
        *[function(name).alias(f"{label}_{name}") for name in ("gold_per_min", "xp_per_min")
          for label, function in (("sum", F.sum), ("rows", F.count))])
    played = per_match.groupBy("hero_id").agg(
        F.count("match_id").alias("picks"), F.sum("won").alias("wins"), F.sum("lost").alias("losses"),
        *[(F.sum(f"sum_{name}") / F.nullif(F.sum(f"rows_{name}"), F.lit(0))).alias(average)
          for name, average in (("gold_per_min", "average_gpm"), ("xp_per_min", "average_xpm"))])
    banned = drafts.where("NOT is_pick").join(scope, "extraction_id").groupBy("hero_id", "match_id").agg(
        F.lit(1).alias("once")).groupBy("hero_id").agg(F.count("match_id").alias("bans"))
    # Both sides hold one row per hero and the scope is one row.
    combined = played.join(banned, "hero_id", "full_outer").crossJoin(F.broadcast(size))

    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def share(part: str, whole: Column) -> Column:
        return amount(part).cast("double") / F.nullif(whole, F.lit(0))

    results = amount("wins") + amount("losses")
    return combined.select(
        "hero_id", "match_count", *[amount(name).alias(name) for name in ("picks", "bans", "wins", "losses")],
        share("picks", F.col("match_count")).alias("pick_rate"), share("bans", F.col("match_count")).alias("ban_rate"),
        share("wins", results).alias("win_rate"), share("losses", results).alias("loss_rate"),
        "average_gpm", "average_xpm",
    )


def _grid_cell(offset: Column, grid: int) -> Column:
    share = offset / F.lit(fixed.WORLD_MAXIMUM - fixed.WORLD_MINIMUM)
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(share * grid).cast("int")))


def hero_heatmap(positions: DataFrame, start_ms: int, end_ms: int, player_slot: int | None = None,
                 team_id: int | None = None, grid: int = fixed.HEATMAP_GRID) -> DataFrame:
    """Samples per grid cell with the total and the maximum of the extraction.

    The image Y axis points down, so Y is inverted; positions outside the world
    are clamped to the border cells.
    """
    if not 0 <= start_ms <= end_ms:
        raise ValueError("times must not be negative, and the start not after the end")
    if grid < 1:
        raise ValueError("the grid needs a cell")
    if team_id is not None and team_id not in (fixed.RADIANT, fixed.DIRE):
        raise ValueError("unknown team")
    if player_slot is not None and player_slot < 0:
        raise ValueError("unknown player slot")
    chosen = positions.where(F.col("game_time_milliseconds").between(start_ms, end_ms))
    if player_slot is not None:
        chosen = chosen.where(F.col("player_slot") == player_slot)
    if team_id is not None:
        chosen = chosen.where(F.col("team_id") == team_id)
    x, y = F.col("world_x").cast("double"), F.col("world_y").cast("double")
    cells = chosen.groupBy(
        "extraction_id", _grid_cell(x - fixed.WORLD_MINIMUM, grid).alias("cell_x"),
        _grid_cell(F.lit(fixed.WORLD_MAXIMUM) - y, grid).alias("cell_y"),
    ).agg(F.count("*").alias("sample_count"))
    # At most grid x grid rows per extraction reach this window.
    whole = Window.partitionBy("extraction_id")
    return cells.withColumn("selected_sample_count", F.sum("sample_count").over(whole)).withColumn(
        "maximum_cell_count", F.max("sample_count").over(whole))


def rolling_gpm(matches: DataFrame, players: DataFrame, gold: DataFrame, window_seconds: int, step_seconds: int,
                team_size: int = 5, cell_seconds: float = 120.0) -> DataFrame:
    """Gold per minute over a rolling window, per player and per complete team.

    The grid runs from the first full window to the match duration.  Gold at
    ``t`` and at ``t - window`` are as-of values; a point needs both.  A team
    point needs every one of its players.
    """
    grid = matches.where(F.col("duration_seconds") >= window_seconds).select(
        "extraction_id", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("duration_seconds").cast("bigint"), F.lit(step_seconds).cast("bigint")
        )).alias("output_time"),
    ).where(F.col("output_time") >= window_seconds)
    lookups = (
        players.select("extraction_id", "player_slot", "team_id").join(grid, "extraction_id")
        .withColumn("back", F.explode(F.array(F.lit(0), F.lit(window_seconds))))
        .withColumn("lookup_time", (F.col("output_time") - F.col("back")).cast("double"))
    )
    resolved = asof_lookup(
        lookups, gold.withColumn("game_time_seconds", F.col("game_time_seconds").cast("double")),
        ["extraction_id", "player_slot"], "lookup_time", "game_time_seconds", ["sequence"],
        ["total_gold_earned"], cell_seconds, "found",
    )
    amount = F.col("found.total_gold_earned")
    player = resolved.groupBy("extraction_id", "player_slot", "team_id", "output_time").agg(
        F.max(F.when(F.col("back") == 0, amount)).alias("current"),
        F.max(F.when(F.col("back") != 0, amount)).alias("previous"),
    ).where("current IS NOT NULL AND previous IS NOT NULL").select(
        "extraction_id", "player_slot", "team_id", "output_time",
        (F.lit(60.0) * (F.col("current") - F.col("previous")) / F.lit(window_seconds)).alias("gpm"),
    )
    team = player.groupBy("extraction_id", "team_id", "output_time").agg(
        F.count("*").alias("members"), F.sum("gpm").alias("gpm")).where(F.col("members") == team_size)

    def shaped(frame: DataFrame, kind: str, slot: Column) -> DataFrame:
        return frame.select(
            "extraction_id", F.lit(kind).alias("series_kind"), slot.alias("player_slot"), "team_id",
            F.col("output_time").cast("double").alias("game_time_seconds"),
            F.lit(window_seconds).alias("window_seconds"), "gpm")

    return shaped(player, "player", F.col("player_slot").cast("bigint")).unionByName(
        shaped(team, "team", F.lit(None).cast("bigint")))


def win_probability(samples: DataFrame, latest: DataFrame) -> DataFrame:
    """Samples of the latest extractions with the complement for the other side."""
    return samples.join(latest.select("extraction_id", "match_id"), "extraction_id").select(
        "match_id", "extraction_id", "sample_index", "game_time_seconds", "radiant_probability",
        (F.lit(1.0) - F.col("radiant_probability")).alias("dire_probability"), "source")


def win_probability_violations(samples: DataFrame) -> DataFrame:
    """``extraction_id, problem``: mixed or unknown sources and values out of range."""
    return samples.groupBy("extraction_id").agg(
        F.min("source").alias("lowest"), F.max("source").alias("highest"),
        count_if(~F.col("source").isin(fixed.GRAPH_HISTORY, fixed.SPECTATOR_UPDATES)).alias("unknown"),
        count_if(~F.col("radiant_probability").between(0.0, 1.0) | (F.col("game_time_seconds") < 0)).alias("outside"),
    ).select("extraction_id", F.explode(F.array_compact(F.array(
        F.when(F.col("lowest") != F.col("highest"), "mixed sources"),
        F.when(F.col("unknown") > 0, "unknown source"), F.when(F.col("outside") > 0, "value out of range"),
    ))).alias("problem"))


# --- catalog --------------------------------------------------------------------------------


def catalog_stats(acquisitions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Stored matches, and records of each match's newest-started success."""
    ids = known_matches(acquisitions, extractions)
    newest = _newest(extractions.where("status = 'succeeded'"), "started_at", "extraction_id",
                     {"record_counts": "record_counts"})
    total = F.get_json_object("record_counts", "$.total").try_cast("decimal(20,0)")
    return ids.join(newest, "match_id", "left").agg(
        F.count("*").alias("stored_matches"),
        F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("total_records"))


# Stored counts of an extraction.
COUNT_FIELDS = {
    "records": "records", "combat_events": "combatEvents", "blobs": "blobs", "entity_instances": "entityInstances",
    "entity_events": "entityEvents", "property_updates": "propertyUpdates", "checkpoints": "checkpoints",
    "total": "total",
}


def catalog_list(acquisitions: DataFrame, extractions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Matches with their latest attempts and stored counts, newest first."""
    extraction = _newest(extractions, "started_at", "extraction_id", {
        "e_status": "status", "e_completed": "completed_at", "e_started": "started_at",
        "extraction_id": "extraction_id", "exporter_version": "exporter_version", "record_counts": "record_counts",
        "e_error_code": "error_code", "e_error_message": "error_message",
    }).withColumnRenamed("attempts", "extraction_count")
    acquisition = _newest(acquisitions, "requested_at", "acquisition_id", {
        "a_status": "status", "a_completed": "completed_at", "a_requested": "requested_at",
        "replay_bytes": "replay_size_bytes", "a_error_code": "error_code", "a_error_message": "error_message",
    }).withColumnRenamed("attempts", "acquisition_count")
    return (
        known_matches(acquisitions, extractions)
        .join(acquisition, "match_id", "left").join(extraction, "match_id", "left")
        .select(
            "match_id", F.coalesce("e_status", "a_status").alias("status"),
            F.coalesce("e_completed", "e_started", "a_completed", "a_requested").alias("acquired_at"),
            "replay_bytes", "extraction_id", "exporter_version",
            F.coalesce("extraction_count", F.lit(0)).alias("extraction_count"),
            F.coalesce("acquisition_count", F.lit(0)).alias("acquisition_count"),
            *[F.coalesce(F.get_json_object("record_counts", f"$.{field}"), F.lit("0")).alias(name)
              for name, field in COUNT_FIELDS.items()],
            F.coalesce("e_error_code", "a_error_code").alias("error_code"),
            F.coalesce("e_error_message", "a_error_message").alias("error_message"),
        )
        .orderBy(F.col("acquired_at").desc_nulls_last(), F.col("match_id").desc())
        .offset(offset).limit(limit)
    )


def match_list(acquisitions: DataFrame, extractions: DataFrame, analysed: DataFrame, limit: int = 500) -> DataFrame:
    """Known matches with status and summary, newest start first."""
    summary = analysed.select("match_id", "start_time", "duration_seconds", "winner_team", "radiant_score",
                              "dire_score", "radiant_team_name", "dire_team_name")
    return (
        latest_status(acquisitions, extractions, analysed).join(summary, "match_id", "left")
        .orderBy(F.col("start_time").desc_nulls_last(), F.col("match_id").desc()).limit(limit)
    )


def newest_matches(matches: DataFrame, latest: DataFrame, extractions: DataFrame, players: DataFrame,
                   limit: int) -> DataFrame:
    """Newest analysed matches with their profile and roster size."""
    chosen = (
        matches.join(latest.select("extraction_id"), "extraction_id", "left_semi")
        .orderBy(F.col("start_time").desc_nulls_last(), F.col("match_id").desc()).limit(limit)
    )
    details = extractions.select(
        "extraction_id", "exporter_version",
        F.get_json_object("manifest", "$.schemaVersion").try_cast("int").alias("manifest_schema_version"),
        F.coalesce(F.get_json_object("extraction_config", "$.profile"),
                   F.get_json_object("manifest", "$.config.profile")).alias("extraction_profile"))
    sizes = players.groupBy("extraction_id").agg(F.count("*").alias("roster_players"))
    return chosen.select("extraction_id", "match_id", "start_time", "duration_seconds").join(
        details, "extraction_id").join(sizes, "extraction_id", "left").withColumn(
        "roster_players", F.coalesce("roster_players", F.lit(0)))


# --- reconciliation -------------------------------------------------------------------------


def gold_reconciliation(matches: DataFrame, players: DataFrame, gold: DataFrame, tolerance: int = 1) -> DataFrame:
    """Rate computed from gold events against the scoreboard rate."""
    order = F.struct("game_time_seconds", "sequence")
    ends = gold.groupBy("extraction_id", "player_slot").agg(
        F.max_by("total_gold_earned", F.when(F.col("game_time_seconds") <= 0, order)).alias("baseline_gold"),
        F.max_by("total_gold_earned", order).alias("final_gold"))
    rate = F.lit(60.0) * (F.col("final_gold") - F.col("baseline_gold")) / F.col("duration_seconds")
    return (
        matches.select("extraction_id", "match_id", "duration_seconds")
        .join(players.select("extraction_id", "player_slot", "team_id", "gold_per_min"), "extraction_id")
        .join(ends, ["extraction_id", "player_slot"], "left")
        .withColumn("rounded_gold_per_minute", half_up(rate))
        .withColumn("difference", F.abs(F.col("rounded_gold_per_minute") - F.col("gold_per_min")))
        .withColumn("within_tolerance", F.coalesce(F.col("difference") <= tolerance, F.lit(False)))
    )


def centered_range(duration_ms: Column, requested_ms: int) -> tuple[Column, Column]:
    """Middle of the match, cut to 100 ms steps."""
    length = F.least(duration_ms, F.lit(requested_ms))
    start = F.floor((duration_ms - length) / 200) * 100
    return start, F.floor((start + length) / 100) * 100


def heatmap_reconciliation(matches: DataFrame, positions: DataFrame, requested_ms: int,
                           grid: int = fixed.HEATMAP_GRID) -> DataFrame:
    """Sum of heat-map cells against selected rows over each match's middle range."""
    start, end = centered_range(F.col("duration_seconds").cast("bigint") * 1000, requested_ms)
    ranges = matches.select("extraction_id", start.alias("start_ms"), end.alias("end_ms"))
    selected = positions.join(ranges, "extraction_id").where("game_time_milliseconds BETWEEN start_ms AND end_ms")
    rows = selected.groupBy("extraction_id").agg(F.count("*").alias("selected_rows"))
    cells = hero_heatmap(selected, 0, 2**62, grid=grid).groupBy("extraction_id").agg(
        F.sum("sample_count").alias("cell_rows"))
    return ranges.join(rows, "extraction_id", "left").join(cells, "extraction_id", "left").select(
        "extraction_id", "start_ms", "end_ms", F.coalesce("selected_rows", F.lit(0)).alias("selected_rows"),
        F.coalesce("cell_rows", F.lit(0)).alias("cell_rows")
    ).withColumn("agrees", F.col("selected_rows") == F.col("cell_rows"))


def series_completeness(rolling: DataFrame, matches: DataFrame, window_seconds: int, team_size: int = 5) -> DataFrame:
    """Whether every player and both teams have a rolling series."""
    counted = rolling.groupBy("extraction_id").agg(
        F.count_distinct(F.when(F.col("series_kind") == "player", F.col("player_slot"))).alias("player_series"),
        F.count_distinct(F.when(F.col("series_kind") == "team", F.col("team_id"))).alias("team_series"),
        *[F.count_distinct(F.when((F.col("series_kind") == "player") & (F.col("team_id") == team),
                                  F.col("player_slot"))).alias(f"{name.lower()}_players")
          for team, name in fixed.TEAM_NAMES.items()])
    names = ("player_series", "team_series", "radiant_players", "dire_players")
    joined = matches.select("extraction_id", "duration_seconds").join(counted, "extraction_id", "left").select(
        "extraction_id", (F.col("duration_seconds") >= window_seconds).alias("supports_window"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in names])
    complete = (
        (F.col("player_series") == 2 * team_size) & (F.col("team_series") == 2)
        & (F.col("radiant_players") == team_size) & (F.col("dire_players") == team_size))
    return joined.withColumn("complete", ~F.coalesce("supports_window", F.lit(False)) | complete)
