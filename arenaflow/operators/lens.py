"""Lens filters and chart-ready tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.operators.damage import group_totals, leading_groups

OTHER = "__other__"


@dataclass(frozen=True)
class Lens:
    """A closed time range and an optional team or player scope."""

    start_seconds: float
    end_seconds: float
    team_id: int | None = None
    player_slot: int | None = None

    def covers(self, seconds: Column) -> Column:
        return seconds.between(self.start_seconds, self.end_seconds)

    def players(self, players: DataFrame) -> DataFrame:
        """The scope's part of the roster."""
        if self.player_slot is not None:
            return players.where(F.col("player_slot") == self.player_slot)
        if self.team_id is not None:
            return players.where(F.col("team_id") == self.team_id)
        return players

    def fights(self, fights: DataFrame, anchors: DataFrame, participants: DataFrame) -> DataFrame:
        """Fights with a death in range and the scope taking part."""
        keys = ["extraction_id", "fight_id"]
        chosen = fights.join(anchors.where(self.covers(F.col("t"))).select(*keys), keys, "left_semi")
        if self.player_slot is not None:
            active = participants.where(
                (F.col("player_slot") == self.player_slot) & (F.col("kills") + F.col("deaths") + F.col("assists") > 0))
            return chosen.join(active.select(*keys), keys, "left_semi")
        if self.team_id is not None:
            return chosen.join(participants.where(F.col("team_id") == self.team_id).select(*keys), keys, "left_semi")
        return chosen

    def damage(self, facts: DataFrame) -> DataFrame:
        """Damage facts in range; aggregating them again rebuilds every level's sum."""
        return facts.where(self.covers(F.col("game_time")))

    def rolling(self, points: DataFrame) -> DataFrame:
        """Rolling-rate points in range: team series without a player scope, player series within the scope."""
        ranged = points.where(self.covers(F.col("game_time_seconds")))
        team, player = F.col("series_kind") == "team", F.col("series_kind") == "player"
        if self.player_slot is not None:
            return ranged.where(player & (F.col("player_slot") == self.player_slot))
        if self.team_id is not None:
            return ranged.where(F.col("team_id") == self.team_id)
        return ranged.where(team)

    def probability(self, points: DataFrame) -> DataFrame:
        return points.where(self.covers(F.col("game_time_seconds")))

    def farming(self, actions: DataFrame, players: DataFrame) -> DataFrame:
        """Actions wholly inside the range by players of the scope."""
        allowed = self.players(players).select("extraction_id", "player_slot")
        return actions.where(
            (F.col("start_game_time_ms") >= self.start_seconds * 1000)
            & (F.col("end_game_time_ms") <= self.end_seconds * 1000)
        ).join(allowed, ["extraction_id", "player_slot"], "left_semi")


def top_groups_plus_other(facts: DataFrame, group: list[str], credited: str,
                          size: int = fixed.NAMED_SERIES) -> DataFrame:
    """Dense interval x series matrix: the leading groups and one row for the rest.

    Every interval of a player has every series, zero where nothing happened.
    """
    key = ["extraction_id", "player_slot"]
    named = leading_groups(group_totals(facts, group, credited), group, size)
    finest = facts.groupBy(*key, "interval_start", *group).agg(F.sum("damage").alias("damage"))
    left, right = finest.alias("f"), named.alias("n")
    condition = F.lit(True)
    for name in [*key, *group]:
        condition = condition & F.col(f"f.{name}").eqNullSafe(F.col(f"n.{name}"))
    ranked = left.join(right, condition, "left").select(
        *[F.col(f"f.{name}").alias(name) for name in key], F.col("f.interval_start").alias("interval_start"),
        F.col("f.damage").alias("damage"), F.coalesce(F.col("n.rank"), F.lit(size + 1)).alias("series_rank"),
        F.coalesce(F.col("n.label"), F.lit("Other")).alias("series_label"))
    summed = ranked.groupBy(*key, "interval_start", "series_rank").agg(F.sum("damage").alias("damage"))
    series = ranked.groupBy(*key, "series_rank").agg(F.min("series_label").alias("series_label"))
    intervals = summed.groupBy(*key, "interval_start").agg(F.sum("damage").alias("interval_damage"))
    # At most eight series per player meet each interval.
    return intervals.join(series, key).join(summed, [*key, "interval_start", "series_rank"], "left").select(
        *key, "interval_start", "interval_damage", (F.col("series_rank") - 1).alias("series_order"), "series_label",
        F.coalesce("damage", F.lit(0)).alias("damage"))


def team_label(team: Column) -> Column:
    return (
        F.when(team.isNull(), F.lit("unknown team")).when(team == fixed.RADIANT, "Radiant")
        .when(team == fixed.DIRE, "Dire").otherwise(F.concat(F.lit("team "), team.cast("string"))))


def disambiguate_labels(visible: DataFrame, keys: list[str]) -> DataFrame:
    """Append the team to labels that repeat among the visible groups."""
    repeats = visible.groupBy(*keys, "label").agg(F.count("*").alias("__uses"))
    return visible.join(repeats, [*keys, "label"]).withColumn("shown_label", F.when(
        F.col("__uses") == 1, F.col("label")).otherwise(
        F.concat("label", F.lit(" ("), team_label(F.col("target_team")), F.lit(")")))).drop("__uses")


def heat_intensity(cells: DataFrame) -> DataFrame:
    """Square root of a cell's share of the fullest cell."""
    share = F.least(F.col("sample_count") / F.nullif("maximum_cell_count", F.lit(0)), F.lit(1.0))
    return cells.withColumn("intensity", F.coalesce(F.sqrt(share), F.lit(0.0)))


def project_to_bounds(x: Column, y: Column, bounds: dict[str, Column], inset: float = 0.0) -> tuple[Column, Column]:
    """Where the ray from the view's centre to a point meets the inset border."""
    low_x = F.least(bounds["maximum_x"], bounds["minimum_x"] + inset)
    high_x = F.greatest(bounds["minimum_x"], bounds["maximum_x"] - inset)
    low_y = F.least(bounds["maximum_y"], bounds["minimum_y"] + inset)
    high_y = F.greatest(bounds["minimum_y"], bounds["maximum_y"] - inset)
    center_x, center_y = (low_x + high_x) / 2, (low_y + high_y) / 2
    dx, dy = x - center_x, y - center_y

    def scale(delta: Column, low: Column, high: Column, center: Column) -> Column:
        edge = F.when(delta > 0, high - center).otherwise(low - center)
        return F.when(delta != 0, F.abs(edge / F.nullif(delta, F.lit(0.0))))

    # ``least`` skips NULL, so an axis without movement does not limit the ray.
    factor = F.coalesce(F.least(scale(dx, low_x, high_x, center_x), scale(dy, low_y, high_y, center_y)), F.lit(0.0))
    return center_x + dx * factor, center_y + dy * factor


def match_search(matches: DataFrame, text: str) -> DataFrame:
    """Matches whose id contains the text."""
    return matches.where(F.col("match_id").cast("string").contains(text.strip()))
