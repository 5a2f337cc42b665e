"""Fight detection: deaths anchor engagements, damage bounds them, metrics describe them.

All matches are detected in one plan.  Combat events are joined once to a small
per-extraction context (bounds, clock, roster maps); every later step works on
the deaths or on events near a fight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, finite, half_up
from arenaflow.functions.graph import connected_components
from arenaflow.functions.heroes import combat_log_name
from arenaflow.functions.ranks import exact_median
from arenaflow.functions.spatial import band_edges, densest_seed
from arenaflow.functions.temporal import asof_lookup, cell_number, gap_cells
from arenaflow.operators.versions import game_clock, marker_availability
from arenaflow.session import cut_lineage, write_once

FIGHT = ["extraction_id", "fight_id"]
_HERO = "struct<player_slot: bigint, team_id: int>"


def roster_context(players: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per extraction: unambiguous heroes by combat-log name and by game-player id.

    Both maps are bounded: names come from the fixed hero dimension and ids from
    0 to 9, and only keys that occur once are kept.
    """
    named = _roster_heroes(players)
    by_name = named.groupBy("extraction_id", "combat_log_name").agg(
        F.count("*").alias("heroes"), F.min(F.struct("player_slot", "team_id").cast(_HERO)).alias("hero")
    ).where("heroes = 1").groupBy("extraction_id").agg(
        F.map_from_entries(F.collect_list(F.struct("combat_log_name", "hero"))).alias("by_name"))
    by_id = named.join(metadata.select("extraction_id", "player_slot", "team_id", "game_player_id"),
                       ["extraction_id", "player_slot", "team_id"]).groupBy("extraction_id", "game_player_id").agg(
        F.count("*").alias("heroes"), F.min(F.struct("player_slot", "team_id").cast(_HERO)).alias("hero")
    ).where("heroes = 1").groupBy("extraction_id").agg(
        F.map_from_entries(F.collect_list(F.struct("game_player_id", "hero"))).alias("by_id"))
    return by_name.join(by_id, "extraction_id", "left")


def _roster_heroes(players: DataFrame) -> DataFrame:
    return players.where(F.col("team_id").isin(fixed.RADIANT, fixed.DIRE)).select(
        "extraction_id", F.col("player_slot").cast("bigint").alias("player_slot"),
        F.col("team_id").cast("int").alias("team_id"), "hero_id",
        combat_log_name(F.col("hero_id")).alias("combat_log_name")).where("combat_log_name IS NOT NULL")


def fight_events(combat: DataFrame, context: DataFrame) -> DataFrame:
    """Actual-game events on the rebased clock with their unambiguous heroes.

    ``context`` holds one row per extraction: bounds, clock and roster maps.

    ``target`` and ``source`` are roster heroes or NULL; the credited source
    falls back to the attacker when its own name does not resolve.
    """
    kinds = combat.where(F.col("event_type").isin(fixed.DEATH, fixed.DAMAGE, fixed.HEAL, fixed.XP)).select(
        "extraction_id", "sequence", "event_type", "game_time", "target_name", "attacker_name", "damage_source_name",
        "target_team", "assist_players", "target_illusion", "location_x", "location_y", "value",
        F.coalesce("target_building", F.lit(False)).alias("target_building"))
    x, y = F.col("location_x").cast("double"), F.col("location_y").cast("double")
    located = finite(x) & finite(y)
    return (
        kinds.join(context, "extraction_id")
        .where("sequence >= start_sequence AND sequence < stop_sequence")
        .select(
            "extraction_id", "sequence", "event_type", (F.col("game_time") - F.col("zero_time")).alias("t"),
            "target_name", "attacker_name", "damage_source_name", "target_team",
            F.coalesce("target_illusion", F.lit(False)).alias("target_illusion"), "target_building", "value",
            F.when(located, x).alias("x"), F.when(located, y).alias("y"),
            _hero("by_name", F.col("target_name")).alias("target"),
            F.coalesce(_hero("by_name", F.col("damage_source_name")), _hero("by_name", F.col("attacker_name")))
            .alias("source"),
            F.transform(F.coalesce("assist_players", F.array().cast("array<int>")),
                        lambda player: _hero("by_id", player)).alias("assist_heroes"),
        )
    )


def _hero(lookup: str, key: Column) -> Column:
    return F.try_element_at(F.col(lookup), key)


def anchor_deaths(events: DataFrame) -> DataFrame:
    """Deaths of roster heroes credited to an enemy killer or assists."""
    victim_team = F.col("target.team_id")
    enemy = F.when(victim_team == fixed.RADIANT, fixed.DIRE).otherwise(fixed.RADIANT)
    killer = F.when(F.col("source.team_id") == enemy, F.col("source.player_slot"))
    assists = F.array_sort(F.array_distinct(F.transform(
        F.filter("assist_heroes", lambda hero: F.coalesce(hero["team_id"] == F.col("enemy"), F.lit(False))),
        lambda hero: hero["player_slot"])))
    deaths = events.where(
        (F.col("event_type") == fixed.DEATH) & finite(F.col("t")) & (F.col("sequence") >= 0)
        & F.col("target_team").isin(fixed.RADIANT, fixed.DIRE) & ~F.col("target_illusion")
        & (victim_team == F.col("target_team"))
    ).withColumn("enemy", enemy).withColumn("killer_slot", killer).withColumn("all_assists", assists)
    return deaths.select(
        "extraction_id", "sequence", "t", F.col("target.player_slot").alias("victim_slot"),
        victim_team.alias("victim_team"), "killer_slot",
        F.filter("all_assists", lambda slot: ~slot.eqNullSafe(F.col("killer_slot"))).alias("assist_slots"), "x", "y",
    ).where("killer_slot IS NOT NULL OR size(assist_slots) > 0").withColumn(
        "active_slots", F.array_sort(F.array_distinct(F.array_compact(F.concat(
            F.array("victim_slot", "killer_slot"), F.col("assist_slots"))))))


def sample_floor(seconds: Column) -> Column:
    """Last 100 ms sample at or before a time, computed in doubles on the rebased clock."""
    return (F.floor(seconds * 10) * 100).cast("bigint")


def locate_anchors(anchors: DataFrame, positions: DataFrame) -> DataFrame:
    """Fill missing death locations from the victim's last position sample.

    The event's own location wins; times before zero have no sample.
    """
    asked = anchors.withColumn("sample_time", F.when(
        F.col("x").isNull() & (F.col("t") >= 0), sample_floor(F.col("t"))))
    located = asof_lookup(
        asked, positions.select("extraction_id", F.col("player_slot").cast("bigint").alias("victim_slot"),
                                F.col("game_time_milliseconds").cast("bigint").alias("sample_time"),
                                "sequence", "world_x", "world_y"),
        ["extraction_id", "victim_slot"], "sample_time", "sample_time", ["sequence"], ["world_x", "world_y"],
        60_000, "sample", few_requests=True, unique_times=True)
    x, y = F.col("sample.world_x").cast("double"), F.col("sample.world_y").cast("double")
    usable = finite(x) & finite(y)
    return located.withColumn("x", F.coalesce("x", F.when(usable, x))).withColumn(
        "y", F.coalesce("y", F.when(usable, y))).drop("sample", "sample_time")


def anchor_edges(anchors: DataFrame, gap: float = fixed.LINK_GAP_SECONDS,
                 distance: float = fixed.LINK_DISTANCE) -> DataFrame:
    """Edges whose connected components are the fights.

    Two located deaths link by distance; any other pair links by a shared
    active hero.  Both rules need the deaths to be at most ``gap`` apart.
    """
    points = anchors.where("x IS NOT NULL").select("extraction_id", F.col("sequence").alias("id"), "t", "x", "y")
    near = band_edges(points, ["extraction_id"], gap, distance)

    active = anchors.select("extraction_id", "sequence", "t", F.col("x").isNotNull().alias("located"),
                            F.explode("active_slots").alias("slot"))
    key = ["extraction_id", "slot"]
    # Consecutive unlocated deaths of one hero link whenever their gap allows, so
    # each gap session of them is one chain: its first member stands for it.
    unlocated = active.where("NOT located")
    cells = gap_cells(unlocated, key, "t", gap, {"member": F.min("sequence")})
    sessions = cells.groupBy(*key, "session_number").agg(
        F.min("__first").alias("opened"), F.max("__last").alias("closed"), F.min("member").alias("member"))
    session_of = cells.select(*key, "__cell", "session_number").join(sessions, [*key, "session_number"])
    inside = unlocated.withColumn("__cell", cell_number(F.col("t"), gap)).join(session_of, [*key, "__cell"]).select(
        "extraction_id", F.col("sequence").alias("left_id"), F.col("member").alias("right_id"))
    # A located death reaches a session when it lies inside it or within the gap
    # of one of its ends.
    located = active.where("located")
    width = 60.0
    before = asof_lookup(located, sessions, key, "t", "opened", ["member"], ["closed", "member"], width, "previous",
                         unique_times=True)
    both = asof_lookup(before, sessions, key, "t", "opened", ["member"], ["member"], width, "following", forward=True,
                       unique_times=True)
    reach = both.select("extraction_id", F.col("sequence").alias("left_id"), F.explode(F.array_compact(F.array(
        F.when(F.col("t") - F.col("previous.closed") <= gap, F.col("previous.member")),
        F.when(F.col("following.opened") - F.col("t") <= gap, F.col("following.member"))))).alias("right_id"))
    return near.unionByName(inside).unionByName(reach).where("left_id <> right_id").distinct()


def group_anchors(anchors: DataFrame, gap: float = fixed.LINK_GAP_SECONDS,
                  distance: float = fixed.LINK_DISTANCE) -> DataFrame:
    """Anchors with ``fight_id``: the sequence of the fight's first death."""
    edges = anchor_edges(anchors, gap, distance).select(
        F.struct("extraction_id", F.col("left_id").alias("sequence")).alias("left_id"),
        F.struct("extraction_id", F.col("right_id").alias("sequence")).alias("right_id"))
    labels = connected_components(edges, "left_id", "right_id").select(
        F.col("vertex.extraction_id").alias("extraction_id"), F.col("vertex.sequence").alias("sequence"),
        F.col("component.sequence").alias("component"))
    labelled = anchors.join(labels, ["extraction_id", "sequence"], "left").withColumn(
        "component", F.coalesce("component", "sequence"))
    first = labelled.groupBy("extraction_id", "component").agg(
        F.min_by("sequence", F.struct("t", "sequence")).alias("fight_id"))
    return labelled.join(first, ["extraction_id", "component"]).drop("component")


def fight_type(radiant: Column, dire: Column) -> Column:
    return (
        F.when((radiant == 0) | (dire == 0), F.lit(None).cast("string"))
        .when((radiant >= 3) & (dire >= 3), "team_fight")
        .when((radiant == 1) | (dire == 1), "pickoff")
        .otherwise("skirmish")
    )


@dataclass
class Fights:
    """Detected fights of all extractions, with their metrics as DataFrames.

    Inputs are the raw combat log, the players, the unambiguous metadata roster
    and the optional series.  Deaths and fights are small, so they are written
    to a reliable checkpoint once and reused by every metric.
    """

    combat: DataFrame
    players: DataFrame
    metadata: DataFrame
    bounds: DataFrame
    positions: DataFrame
    gold: DataFrame
    team_series: DataFrame
    probability: DataFrame

    @cached_property
    def events(self) -> DataFrame:
        """The log once: resolved, narrow rows that anchors, damage, metrics, objectives and availability all read."""
        return write_once(fight_events(self.combat, self.context), "fight-events")

    @cached_property
    def context(self) -> DataFrame:
        """Bounds, clock and roster maps: one row per extraction, written once and joined often."""
        roster = roster_context(self.players, self.metadata)
        return cut_lineage(game_clock(self.combat, self.bounds).join(roster, "extraction_id", "left"))

    @cached_property
    def anchors(self) -> DataFrame:
        return cut_lineage(group_anchors(cut_lineage(locate_anchors(anchor_deaths(self.events), self.positions))))

    @cached_property
    def participants(self) -> DataFrame:
        """``kills, deaths, assists`` of every participant of every fight."""
        roles = F.concat(
            F.array(F.struct(F.col("victim_slot").alias("player_slot"), F.lit("death").alias("role"))),
            F.when(F.col("killer_slot").isNotNull(), F.array(F.struct(
                F.col("killer_slot").alias("player_slot"), F.lit("kill").alias("role")))).otherwise(F.array().cast(
                    "array<struct<player_slot: bigint, role: string>>")),
            F.transform("assist_slots", lambda slot: F.struct(slot.alias("player_slot"), F.lit("assist").alias("role"))))
        counted = self.anchors.select(*FIGHT, F.inline(roles)).groupBy(*FIGHT, "player_slot").agg(
            *[count_if(F.col("role") == role).alias(name)
              for role, name in (("kill", "kills"), ("death", "deaths"), ("assist", "assists"))])
        return counted.join(_roster_heroes(self.players), ["extraction_id", "player_slot"])

    @cached_property
    def groups(self) -> DataFrame:
        """One row per fight: type, death times and the participants.

        Participants are roster heroes, so the collected arrays and the name map
        are bounded by the hero dimension.
        """
        deaths = self.anchors.groupBy(*FIGHT).agg(
            F.min("t").alias("first_death"), F.max("t").alias("last_death"), F.count("*").alias("death_count"))
        sides = self.participants.groupBy(*FIGHT).agg(
            count_if(F.col("team_id") == fixed.RADIANT).alias("radiant"),
            count_if(F.col("team_id") == fixed.DIRE).alias("dire"),
            F.array_sort(F.collect_list("player_slot")).alias("slots"))
        names = self.participants.groupBy(*FIGHT, "combat_log_name").agg(
            F.count("*").alias("heroes"), F.min(F.struct("player_slot", "team_id").cast(_HERO)).alias("hero")
        ).where("heroes = 1").groupBy(*FIGHT).agg(
            F.map_from_entries(F.collect_list(F.struct("combat_log_name", "hero"))).alias("by_name"))
        found = deaths.join(sides, FIGHT).join(names, FIGHT, "left").withColumn(
            "fight_type", fight_type(F.col("radiant"), F.col("dire"))).where("fight_type IS NOT NULL")
        return cut_lineage(found)

    @cached_property
    def nearby_events(self) -> DataFrame:
        """Events within the longest possible interval of each fight, joined by minute."""
        width = fixed.PRELUDE_SECONDS
        low = F.col("first_death") - fixed.PRELUDE_SECONDS
        high = F.col("last_death") + fixed.TAIL_SECONDS
        windows = self.groups.withColumn("minute", F.explode(F.sequence(
            cell_number(low, width), cell_number(high, width))))
        timed = self.events.where(finite(F.col("t")) & (F.col("event_type") != fixed.DEATH)).withColumn(
            "minute", cell_number(F.col("t"), width))
        return write_once(timed.join(windows, ["extraction_id", "minute"]).where(
            (F.col("t") >= low) & (F.col("t") <= high)).drop("minute"), "nearby-events")

    @cached_property
    def relevant_damage(self) -> DataFrame:
        """Damage between participants of opposite teams; its value does not matter."""
        return cut_lineage(self.nearby_events.where(
            (F.col("event_type") == fixed.DAMAGE) & ~F.col("target_illusion")
            & F.array_contains("slots", F.col("target.player_slot"))
            & F.array_contains("slots", F.col("source.player_slot"))
            & (F.col("target.player_slot") != F.col("source.player_slot"))
            & (F.col("target.team_id") != F.col("source.team_id"))
        ).select(*FIGHT, "first_death", "last_death", "sequence", "t", "x", "y"))

    @cached_property
    def intervals(self) -> DataFrame:
        """Combat start and end: damage chained to the first and last death by short pauses.

        Times are reduced to cells as wide as the allowed pause, counted from the
        death outwards; a pause can only be too long between two cells, so at
        most seven cells per fight and side are ordered.
        """
        idle = fixed.IDLE_GAP_SECONDS

        def chain(side: str, origin: str, offset: Column, limit: float) -> DataFrame:
            cells = self.relevant_damage.where((offset >= 0) & (offset <= limit)).groupBy(
                *FIGHT, origin, cell_number(offset, idle).alias("cell")
            ).agg(F.min("t").alias("low"), F.max("t").alias("high"))
            near, far = ("high", "low") if side == "start" else ("low", "high")
            order = Window.partitionBy(*FIGHT).orderBy("cell")
            pause = F.abs(F.col(near) - F.coalesce(F.lag(far).over(order), F.col(origin)))
            reached = cells.withColumn("broken", (pause > idle).cast("int")).withColumn(
                "broken", F.max("broken").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            ).where("broken = 0")
            bound = F.min("low") if side == "start" else F.max("high")
            return reached.groupBy(*FIGHT).agg(bound.alias(side))

        start = chain("start", "first_death", F.col("first_death") - F.col("t"), fixed.PRELUDE_SECONDS)
        end = chain("end", "last_death", F.col("t") - F.col("last_death"), fixed.TAIL_SECONDS)
        return cut_lineage(
            self.groups.join(start, FIGHT, "left").join(end, FIGHT, "left")
            .withColumn("combat_start", F.coalesce("start", "first_death"))
            .withColumn("combat_end", F.coalesce("end", "last_death")).drop("start", "end"))

    @cached_property
    def combat_points(self) -> DataFrame:
        """Located deaths, then located damage of the interval near any of them, in input order."""
        deaths = self.anchors.where("x IS NOT NULL").select(
            *FIGHT, F.lit(0).alias("kind"), "t", "sequence", "x", "y")
        damage = self.relevant_damage.where("x IS NOT NULL").join(
            self.intervals.select(*FIGHT, "combat_start", "combat_end"), FIGHT
        ).where("t BETWEEN combat_start AND combat_end").select(*FIGHT, F.lit(1).alias("kind"), "t", "sequence", "x", "y")
        return cut_lineage(deaths.unionByName(near_any(damage, deaths, FIGHT, fixed.LOCAL_RADIUS)))

    @cached_property
    def map_views(self) -> DataFrame:
        return cut_lineage(map_view(self.combat_points, FIGHT, ["kind", "t", "sequence"]))

    @cached_property
    def fights(self) -> DataFrame:
        """Intervals, views and clipped outcomes."""
        return cut_lineage(clip_outcomes(self.intervals.join(self.map_views, FIGHT, "left")))

    @cached_property
    def player_metrics(self) -> DataFrame:
        """Damage, healing and experience of each participant in the combat interval.

        Names resolve among the participants only; experience goes to the target.
        """
        within = self.nearby_events.join(self.intervals.select(*FIGHT, "combat_start", "combat_end"), FIGHT).where(
            (F.col("t") >= F.col("combat_start")) & (F.col("t") <= F.col("combat_end")) & (F.col("value") > 0))
        target = _hero("by_name", F.col("target_name"))
        source = F.coalesce(_hero("by_name", F.col("damage_source_name")), _hero("by_name", F.col("attacker_name")))
        resolved = within.select(*FIGHT, "event_type", F.col("value").cast("bigint").alias("value"),
                                 "target_illusion", target.alias("hit"), source.alias("actor"))
        fair = (
            (F.col("event_type") == fixed.DAMAGE) & ~F.col("target_illusion")
            & (F.col("hit.team_id") != F.col("actor.team_id")) & (F.col("hit.player_slot") != F.col("actor.player_slot")))
        entry = "struct<player_slot: bigint, metric: string>"

        def share(condition: Column, slot: str, metric: str) -> Column:
            return F.when(condition & F.col(slot).isNotNull(),
                          F.struct(F.col(slot).alias("player_slot"), F.lit(metric).alias("metric")).cast(entry))

        shares = F.array_compact(F.array(
            share(fair, "actor.player_slot", "damage_dealt"), share(fair, "hit.player_slot", "damage_taken"),
            share(F.col("event_type") == fixed.HEAL, "actor.player_slot", "healing"),
            share(F.col("event_type") == fixed.XP, "hit.player_slot", "experience")))
        sums = resolved.select(*FIGHT, "value", F.inline(shares)).groupBy(*FIGHT, "player_slot").agg(*[
            F.sum(F.when(F.col("metric") == metric, F.col("value"))).alias(metric)
            for metric in ("damage_dealt", "damage_taken", "healing", "experience")])
        return self.participants.join(self.groups.select(*FIGHT), FIGHT, "left_semi").join(
            sums, [*FIGHT, "player_slot"], "left").select(
            *FIGHT, "player_slot", "team_id", "hero_id", "kills", "deaths", "assists",
            *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
              for name in ("damage_dealt", "damage_taken", "healing", "experience")])

    def _boundaries(self, per_player: bool) -> DataFrame:
        sides = F.array(F.struct(F.lit("start").alias("side"), F.col("combat_start").alias("at")),
                        F.struct(F.lit("end").alias("side"), F.col("combat_end").alias("at")))
        rows = self.intervals.select(*FIGHT, F.inline(sides), "slots")
        if per_player:
            return rows.select(*FIGHT, "side", "at", F.explode("slots").alias("player_slot"))
        return rows.drop("slots")

    @cached_property
    def gold_changes(self) -> DataFrame:
        """Earned gold of each participant between the interval's ends; NULL without both values."""
        found = asof_lookup(
            self._boundaries(True), self.gold.select(
                "extraction_id", F.col("player_slot").cast("bigint").alias("player_slot"), "game_time_seconds",
                "sequence", "total_gold_earned"),
            ["extraction_id", "player_slot"], "at", "game_time_seconds", ["sequence"], ["total_gold_earned"],
            120.0, "found")
        return _both_ends(found, [*FIGHT, "player_slot"], F.col("found.total_gold_earned"), "earned_gold_change")

    @cached_property
    def net_worth_changes(self) -> DataFrame:
        """Net worth change per team on the minute graph, over its known points."""
        points = self.team_series.where("net_worth IS NOT NULL").select(
            "extraction_id", F.col("team_id").cast("int").alias("team_id"),
            F.col("sample_index").cast("bigint").alias("sample_index"), "net_worth")
        asked = self._boundaries(False).withColumn(
            "team_id", F.explode(F.array(F.lit(fixed.RADIANT), F.lit(fixed.DIRE)))).withColumn(
            "sample", F.greatest(F.lit(0), F.floor(F.col("at") / 60)).cast("bigint"))
        found = asof_lookup(asked, points, ["extraction_id", "team_id"], "sample", "sample_index", ["net_worth"],
                            ["net_worth"], 60, "found", unique_times=True)
        return _both_ends(found, [*FIGHT, "team_id"], F.col("found.net_worth"), "change").select(
            *FIGHT, "team_id", half_up(F.col("change")).alias("net_worth_change"))

    @cached_property
    def probability_changes(self) -> DataFrame:
        """Win-probability change; NULL when an end is missing or the source differs."""
        found = asof_lookup(
            self._boundaries(False), self.probability.select(
                "extraction_id", "game_time_seconds", "sample_index", "radiant_probability", "source"),
            ["extraction_id"], "at", "game_time_seconds", ["sample_index"], ["radiant_probability", "source"],
            120.0, "found", unique_times=True)
        ends = found.groupBy(*FIGHT).agg(*[
            F.max(F.when(F.col("side") == side, F.col("found"))).alias(side) for side in ("start", "end")])
        same = F.col("start.source") == F.col("end.source")
        return ends.select(
            *FIGHT, F.when(same, F.col("end.radiant_probability") - F.col("start.radiant_probability"))
            .alias("radiant_win_probability_change"), F.when(same, F.col("end.source")).alias("win_probability_source"))

    @cached_property
    def availability(self) -> DataFrame:
        """Which metrics an extraction can answer at all."""
        extractions = self.groups.select("extraction_id").distinct()
        flags = {
            "earned_gold_available": self.gold,
            "experience_available": self.events.where(F.col("event_type") == fixed.XP),
            "net_worth_available": self.team_series.where("net_worth IS NOT NULL"),
            "positions_available": self.positions,
        }
        for name, frame in flags.items():
            extractions = extractions.join(
                frame.select("extraction_id").distinct().withColumn(name, F.lit(True)), "extraction_id", "left"
            ).withColumn(name, F.coalesce(name, F.lit(False)))
        return extractions

    @cached_property
    def player_results(self) -> DataFrame:
        """Per-participant results; metrics without their stream are NULL."""
        return (
            self.player_metrics.join(self.gold_changes, [*FIGHT, "player_slot"], "left")
            .join(self.availability, "extraction_id")
            .withColumn("earned_gold_change", F.when(F.col("earned_gold_available"), F.col("earned_gold_change")))
            .withColumn("experience_change", F.when(F.col("experience_available"), F.col("experience")))
            .select(*FIGHT, "player_slot", "team_id", "hero_id", "kills", "deaths", "assists", "damage_dealt",
                    "damage_taken", "healing", "earned_gold_change", "experience_change"))

    @cached_property
    def team_results(self) -> DataFrame:
        """Two rows per fight; a team sum is NULL when any member's value is unknown."""
        def complete(name: str) -> Column:
            return F.when(F.count("*") == F.count(name), F.sum(name))

        teams = self.groups.select(*FIGHT, "death_count", F.explode(F.array(
            F.lit(fixed.RADIANT), F.lit(fixed.DIRE))).alias("team_id"))
        sums = self.player_results.groupBy(*FIGHT, "team_id").agg(
            F.count("*").alias("participants"), F.sum("deaths").alias("deaths"),
            F.sum("damage_dealt").alias("hero_damage"), F.sum("healing").alias("hero_healing"),
            complete("earned_gold_change").alias("earned_gold_change"),
            complete("experience_change").alias("experience_change"))
        return (
            teams.join(sums, [*FIGHT, "team_id"], "left").join(self.net_worth_changes, [*FIGHT, "team_id"], "left")
            .select(*FIGHT, "team_id",
                    *[F.coalesce(name, F.lit(0)).alias(name) for name in ("participants", "deaths")],
                    (F.col("death_count") - F.coalesce("deaths", F.lit(0))).alias("kills"),
                    *[F.coalesce(name, F.lit(0)).alias(name) for name in ("hero_damage", "hero_healing")],
                    "earned_gold_change", "experience_change", "net_worth_change"))

    @cached_property
    def objectives(self) -> DataFrame:
        """Bosses and buildings that fell from the start to the end of the outcome."""
        name = F.lower(F.coalesce("target_name", F.lit("")))
        building = F.col("target_building")
        kind = (
            F.when(name.contains("roshan"), "roshan")
            .when(name.contains("miniboss") | name.contains("tormentor"), "tormentor")
            .when(building & (name.contains("rax") | name.contains("barracks")), "barracks")
            .when(building & name.contains("tower"), "tower"))
        width = fixed.PRELUDE_SECONDS
        fallen = self.events.where((F.col("event_type") == fixed.DEATH) & F.col("t").isNotNull()
                                   & ~F.col("target_illusion")).withColumn("kind", kind).where("kind IS NOT NULL")
        windows = self.fights.select(*FIGHT, "combat_start", "outcome_end", F.explode(F.sequence(
            cell_number(F.col("combat_start"), width), cell_number(F.col("outcome_end"), width))).alias("minute"))
        return fallen.withColumn("minute", cell_number(F.col("t"), width)).join(
            windows, ["extraction_id", "minute"]).where("t BETWEEN combat_start AND outcome_end").select(
            *FIGHT, "sequence", "t", "kind", F.initcap("kind").alias("label"),
            F.when(F.col("target_team").isin(fixed.RADIANT, fixed.DIRE), F.col("target_team")).alias("team_id"))

    @cached_property
    def fight_list(self) -> DataFrame:
        """One record per fight with its metrics and availability flags."""
        fields = ("kills", "deaths", "hero_damage", "hero_healing", "earned_gold_change", "experience_change",
                  "net_worth_change")
        teams = self.team_results.groupBy(*FIGHT).agg(*[
            F.max(F.when(F.col("team_id") == code, F.col(field))).alias(f"{name.lower()}_{field}")
            for code, name in fixed.TEAM_NAMES.items() for field in fields])
        fallen = self.objectives.groupBy(*FIGHT).agg(F.count("*").alias("objective_count"))
        return (
            self.fights.join(teams, FIGHT)
            .join(self.probability_changes, FIGHT, "left").join(fallen, FIGHT, "left")
            .join(self.availability, "extraction_id")
            .select(
                *FIGHT, F.lit(fixed.FIGHT_VERSION).alias("detection_version"), "fight_type", "first_death", "last_death",
                "combat_start", "combat_end", (F.col("combat_end") - F.col("combat_start")).alias("duration_seconds"),
                "outcome_end", "death_count", F.col("radiant").alias("radiant_participants"),
                F.col("dire").alias("dire_participants"), "center_x", "center_y",
                F.col("center_x").isNotNull().alias("location_available"),
                *[f"{name.lower()}_{field}" for name in fixed.TEAM_NAMES.values() for field in fields],
                "radiant_win_probability_change", "win_probability_source",
                F.coalesce("objective_count", F.lit(0)).alias("objective_count"),
                "earned_gold_available", "experience_available", "net_worth_available", "positions_available",
                F.col("win_probability_source").isNotNull().alias("win_probability_available")))

    @cached_property
    def frame_positions(self) -> DataFrame:
        """Participant positions of every 100 ms frame inside the combat interval."""
        start = F.greatest(F.lit(0), F.ceil(F.col("combat_start") * 10) * 100).cast("bigint")
        end = F.greatest(F.lit(0), F.floor(F.col("combat_end") * 10) * 100).cast("bigint")
        width = 60_000
        windows = self.intervals.select(*FIGHT, "slots", start.alias("start_ms"), end.alias("end_ms")).where(
            "start_ms <= end_ms").withColumn("minute", F.explode(F.sequence(
                cell_number(F.col("start_ms"), width), cell_number(F.col("end_ms"), width)))).select(
            *FIGHT, "start_ms", "end_ms", "minute", F.explode("slots").alias("player_slot"))
        return self.positions.select(
            "extraction_id", F.col("player_slot").cast("bigint").alias("player_slot"),
            F.col("game_time_milliseconds").cast("bigint").alias("game_time_milliseconds"), "team_id", "hero_id",
            F.col("world_x").cast("double").alias("world_x"), F.col("world_y").cast("double").alias("world_y"),
            cell_number(F.col("game_time_milliseconds"), width).alias("minute"),
        ).join(windows, ["extraction_id", "player_slot", "minute"]).where(
            "game_time_milliseconds BETWEEN start_ms AND end_ms").select(
            *FIGHT, "game_time_milliseconds", "player_slot", "team_id", "hero_id", "world_x", "world_y")

    @cached_property
    def frames(self) -> DataFrame:
        """Positions grouped per frame; a frame holds at most one sample per participant."""
        return self.frame_positions.groupBy(*FIGHT, "game_time_milliseconds").agg(F.array_sort(F.collect_list(
            F.struct("player_slot", "team_id", "hero_id", "world_x", "world_y"))).alias("positions"))

    @cached_property
    def position_states(self) -> DataFrame:
        """``available``, ``empty`` or ``unavailable`` frames per fight."""
        counted = self.frame_positions.groupBy(*FIGHT).agg(
            F.count_distinct("game_time_milliseconds").alias("frame_count"))
        return self.intervals.select(*FIGHT).join(self.availability, "extraction_id").join(
            counted, FIGHT, "left").select(
            *FIGHT, F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
            F.when(~F.col("positions_available"), "unavailable").when(F.col("frame_count") > 0, "available")
            .otherwise("empty").alias("position_state"))

    @cached_property
    def death_markers(self) -> DataFrame:
        """Located deaths inside the view of their fight."""
        views = self.map_views.select(*FIGHT, "minimum_x", "maximum_x", "minimum_y", "maximum_y")
        return self.anchors.where("x IS NOT NULL").join(views, FIGHT, "left").where(
            F.col("minimum_x").isNull()
            | (F.col("x").between(F.col("minimum_x"), F.col("maximum_x"))
               & F.col("y").between(F.col("minimum_y"), F.col("maximum_y")))
        ).select(*FIGHT, "sequence", F.col("victim_slot").alias("player_slot"),
                 sample_floor(F.col("t")).alias("game_time_milliseconds"),
                 F.col("x").alias("world_x"), F.col("y").alias("world_y"))

    @cached_property
    def anchor_details(self) -> DataFrame:
        return self.anchors.select(*FIGHT, "sequence", F.col("t").alias("game_time_seconds"), "victim_slot",
                                   "killer_slot", "assist_slots", "x", "y")

    @cached_property
    def records(self) -> DataFrame:
        """The list with the death times, participants and objectives of each fight as arrays of rows.

        A fight has at most the roster's heroes; deaths and objectives are those of one fight.
        """
        times = self.anchors.groupBy(*FIGHT).agg(F.array_sort(F.collect_list("t")).alias("anchor_times"))
        people = self.participants.groupBy(*FIGHT).agg(F.array_sort(F.collect_list(F.struct(
            "player_slot", "team_id", "hero_id", "kills", "deaths", "assists"))).alias("participants"))
        fallen = self.objectives.groupBy(*FIGHT).agg(F.array_sort(F.collect_list(F.struct(
            "t", "sequence", "kind", "label", "team_id"))).alias("objectives"))
        return self.fight_list.join(times, FIGHT).join(people, FIGHT).join(fallen, FIGHT, "left").withColumn(
            "objectives", F.coalesce("objectives", F.array().cast(fallen.schema["objectives"].dataType)))

    def states(self, latest: DataFrame) -> DataFrame:
        """Every selected extraction with its availability, also without any fight."""
        combat = marker_availability(self.combat).select("extraction_id", "has_combat")
        placed = self.positions.select("extraction_id").distinct().withColumn("has_positions", F.lit(True))
        return latest.select("extraction_id").join(combat, "extraction_id", "left").join(placed, "extraction_id", "left").select(
            "extraction_id", *[F.coalesce(name, F.lit(False)).alias(name) for name in ("has_combat", "has_positions")])


def _both_ends(found: DataFrame, keys: list[str], value: Column, output: str) -> DataFrame:
    return found.groupBy(*keys).agg(
        (F.max(F.when(F.col("side") == "end", value)) - F.max(F.when(F.col("side") == "start", value))).alias(output))


def near_any(points: DataFrame, anchors: DataFrame, group: list[str], radius: float) -> DataFrame:
    """Points within ``radius`` of any anchor of their group; all points of a group without anchors.

    A semi-join on map cells: it stops at the first anchor in reach and never
    produces pairs.
    """
    sites = anchors.select(*group, F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    reach = sites.select(*group, "ax", "ay", F.inline(around)).select(
        *group, "ax", "ay", (cell_number(F.col("ax"), radius) + F.col("dx")).alias("cx"),
        (cell_number(F.col("ay"), radius) + F.col("dy")).alias("cy"))
    celled = points.withColumn("cx", cell_number(F.col("x"), radius)).withColumn("cy", cell_number(F.col("y"), radius))
    p, s = celled.alias("p"), reach.alias("s")
    same = [F.col(f"p.{name}") == F.col(f"s.{name}") for name in [*group, "cx", "cy"]]
    dx, dy = F.col("s.ax") - F.col("p.x"), F.col("s.ay") - F.col("p.y")
    condition = (dx * dx + dy * dy) <= radius * radius
    for part in same:
        condition = part & condition
    close = p.join(s, condition, "left_semi")
    free = celled.join(sites.select(*group).distinct(), group, "left_anti")
    return close.unionByName(free).drop("cx", "cy")


def map_view(points: DataFrame, group: list[str], order: list[str],
             world: tuple[float, float] = (fixed.WORLD_MINIMUM, fixed.WORLD_MAXIMUM)) -> DataFrame:
    """Centre and padded bounds around the densest neighbourhood of each group's points."""
    radius = fixed.LOCAL_RADIUS
    usable = points.where(finite(F.col("x")) & finite(F.col("y")))
    seeds = densest_seed(usable, group, radius, order)
    dx, dy = F.col("x") - F.col("seed.x"), F.col("y") - F.col("seed.y")
    local = usable.join(seeds, group).where(dx * dx + dy * dy <= radius * radius)
    axes = local.select(*group, F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("place")),
        F.struct(F.lit("y").alias("axis"), F.col("y").alias("place")))))
    extents = axes.groupBy(*group, "axis").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    centers = exact_median(axes, [*group, "axis"], "place", "center")
    size = F.least(F.lit(world[1] - world[0]), F.lit(fixed.VIEW_MAXIMUM), F.greatest(
        F.lit(fixed.VIEW_MINIMUM), F.col("high") - F.col("low") + 2 * fixed.VIEW_PADDING))
    lowest, highest = F.col("high") + fixed.VIEW_PADDING - F.col("size"), F.col("low") - fixed.VIEW_PADDING
    centered = F.col("center") - F.col("size") / 2
    fitted = F.when(lowest <= highest, F.least(highest, F.greatest(lowest, centered))).otherwise(centered)
    clamped = F.least(F.lit(world[1]) - F.col("size"), F.greatest(F.lit(world[0]), fitted))
    view = extents.join(centers, [*group, "axis"]).withColumn("size", size).withColumn("minimum", clamped)

    def axis_value(axis: str, value: Column) -> Column:
        return F.max(F.when(F.col("axis") == axis, value))

    columns = []
    for axis in ("x", "y"):
        columns += [
            axis_value(axis, F.col("center")).alias(f"center_{axis}"),
            axis_value(axis, F.col("minimum")).alias(f"minimum_{axis}"),
            axis_value(axis, F.col("minimum") + F.col("size")).alias(f"maximum_{axis}")]
    return view.groupBy(*group).agg(*columns)


def clip_outcomes(fights: DataFrame) -> DataFrame:
    """Outcome end: 30 s after combat, cut at the start of the first later fight nearby.

    A later fight can only cut when its combat starts before the outcome ends,
    and combat starts at most a prelude before the first death.  So only fights
    whose first death lies in that bounded window need to be compared.
    """
    horizon = fixed.OUTCOME_SECONDS + fixed.PRELUDE_SECONDS
    open_end = F.col("combat_end") + fixed.OUTCOME_SECONDS
    earlier = fights.where("center_x IS NOT NULL").select(
        *FIGHT, "first_death", "combat_end", "center_x", "center_y",
        F.explode(F.sequence(cell_number(F.col("first_death"), horizon),
                             cell_number(F.col("combat_end") + horizon, horizon))).alias("cell"))
    later = fights.where("center_x IS NOT NULL").select(
        "extraction_id", cell_number(F.col("first_death"), horizon).alias("cell"),
        F.struct("first_death", "fight_id").alias("place"), F.col("combat_start").alias("next_start"),
        F.col("center_x").alias("next_x"), F.col("center_y").alias("next_y"))
    dx, dy = F.col("next_x") - F.col("center_x"), F.col("next_y") - F.col("center_y")
    cuts = earlier.join(later, ["extraction_id", "cell"]).where(
        (F.col("place") > F.struct("first_death", "fight_id"))
        & (F.sqrt(dx * dx + dy * dy) <= fixed.LOCAL_RADIUS)
    ).groupBy(*FIGHT).agg(F.min_by("next_start", "place").alias("next_start"))
    cut = F.greatest(F.col("combat_end"), F.least(open_end, F.col("next_start")))
    return fights.join(cuts, FIGHT, "left").withColumn(
        "outcome_end", F.when(F.col("next_start").isNotNull(), cut).otherwise(open_end)).drop("next_start")
