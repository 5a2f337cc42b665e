"""Queries over the event-derived matches: bounds, series, grids, damage, fights, farming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.functions.heroes import pretty_name
from arenaflow.functions.temporal import asof_lookup, gap_sessions, nearest_lookup
from arenaflow import fixed_values as fixed
from arenaflow.operators import damage, farming, fights, lens, quality, series, versions
from arenaflow.plans import oracle
from arenaflow.plans.registry import query
from arenaflow.plans.tables import Telemetry

TEAM_SIZE = 9


def bounds(t: Telemetry) -> DataFrame:
    return versions.game_bounds(t.combat)


# --- actual game ----------------------------------------------------------------------------


@query("extraction_id:s start_sequence:i stop_sequence:i", "SELECT * FROM bounds")
def actual_game_bounds(t: Telemetry) -> DataFrame:
    return bounds(t)


@query("extraction_id:s sequence:i is_actual_game:b", """
SELECT c.extraction_id, c.sequence, coalesce(c.sequence >= b.start_sequence AND c.sequence < b.stop_sequence, false) AS is_actual_game
FROM combat c LEFT JOIN bounds b USING (extraction_id)""")
def actual_game_flags(t: Telemetry) -> DataFrame:
    return versions.is_actual_game(t.combat.select("extraction_id", "sequence"), bounds(t))


@query("extraction_id:s zero_time:d", "SELECT extraction_id, zero_time FROM clock")
def game_clock_zero(t: Telemetry) -> DataFrame:
    return versions.game_clock(t.combat, bounds(t))


@query("extraction_id:s has_ordered_markers:b has_combat:b", """
SELECT extraction_id, any_value(b.stop_sequence) IS NOT NULL AS has_ordered_markers,
  count(*) FILTER (WHERE c.value = 4) > 0 AND count(*) FILTER (WHERE c.value = 6) > 0 AS has_combat
FROM combat c LEFT JOIN bounds b USING (extraction_id)
WHERE c.event_type = 'DOTA_COMBATLOG_GAME_STATE' GROUP BY extraction_id""")
def marker_availability(t: Telemetry) -> DataFrame:
    return versions.marker_availability(t.combat)


# --- series and grids -----------------------------------------------------------------------

_TOTALS = "kills deaths assists last_hits denies net_worth hero_damage tower_damage hero_healing".split()


@query("extraction_id:s team_id:i team:s players:i " + " ".join(f"{name}:i" for name in _TOTALS),
       "SELECT extraction_id, team_id, team, count(*) AS players, "
       + ", ".join(f"sum({name}) AS {name}" for name in _TOTALS) + " FROM players GROUP BY ALL")
def team_totals(t: Telemetry) -> DataFrame:
    return series.team_totals(t.players)


@query("extraction_id:s team_id:i sample_index:i net_worth:d net_worth_advantage:d", """
SELECT a.extraction_id, a.team_id, a.sample_index, a.net_worth, a.net_worth - b.net_worth AS net_worth_advantage
FROM team_series a JOIN team_series b ON a.extraction_id = b.extraction_id AND a.sample_index = b.sample_index
  AND a.team_id <> b.team_id""")
def net_worth_advantage(t: Telemetry) -> DataFrame:
    return series.net_worth_advantage(t.team_series)


@query("extraction_id:s radiant_net_worth:i dire_net_worth:i advantage:i leader:s", """
SELECT *, abs(radiant_net_worth - dire_net_worth) AS advantage, CASE WHEN radiant_net_worth > dire_net_worth THEN 'Radiant'
  WHEN dire_net_worth > radiant_net_worth THEN 'Dire' WHEN radiant_net_worth = dire_net_worth THEN 'Even' END AS leader
FROM (SELECT extraction_id, sum(net_worth) FILTER (WHERE team_id = 2) AS radiant_net_worth,
  sum(net_worth) FILTER (WHERE team_id = 3) AS dire_net_worth FROM players GROUP BY extraction_id)""")
def net_worth_leader(t: Telemetry) -> DataFrame:
    return series.net_worth_leader(series.team_totals(t.players))


def _heat(condition: str, grid: int) -> str:
    return f"""
SELECT *, sum(sample_count) OVER (PARTITION BY extraction_id) AS selected_sample_count,
  max(sample_count) OVER (PARTITION BY extraction_id) AS maximum_cell_count
FROM (SELECT extraction_id, least({grid - 1}, greatest(0, floor((world_x + 8288) / 16576 * {grid}))) AS cell_x,
    least({grid - 1}, greatest(0, floor((8288 - world_y) / 16576 * {grid}))) AS cell_y, count(*) AS sample_count
  FROM positions WHERE game_time_milliseconds BETWEEN 300000 AND 1800000 {condition} GROUP BY ALL)"""


_HEAT = "extraction_id:s cell_x:i cell_y:i sample_count:i selected_sample_count:i maximum_cell_count:i"


@query(_HEAT, _heat("", 64))
def hero_heatmap(t: Telemetry) -> DataFrame:
    return series.hero_heatmap(t.positions, 300_000, 1_800_000)


@query(_HEAT, _heat("AND team_id = 3", 16))
def hero_heatmap_team(t: Telemetry) -> DataFrame:
    return series.hero_heatmap(t.positions, 300_000, 1_800_000, team_id=3, grid=16)


@query(_HEAT + " intensity:d", f"""
SELECT *, sqrt(least(sample_count / maximum_cell_count, 1)) AS intensity FROM ({_heat('AND player_slot = 4', 16)})""")
def heat_intensity(t: Telemetry) -> DataFrame:
    return lens.heat_intensity(series.hero_heatmap(t.positions, 300_000, 1_800_000, player_slot=4, grid=16))


def _rolling(window: int, step: int) -> dict[str, str]:
    return {
        "grid": f"""
SELECT extraction_id, unnest(generate_series({window}, duration_seconds, {step})) AS moment FROM (
  SELECT extraction_id, duration_seconds FROM matches WHERE duration_seconds >= {window})""",
        "single_gold": """
SELECT extraction_id, player_slot, game_time_seconds, arg_max(total_gold_earned, sequence) AS total
FROM gold GROUP BY extraction_id, player_slot, game_time_seconds""",
        "lookups": f"""
SELECT p.extraction_id, p.player_slot, p.team_id, g.moment, CAST(g.moment AS DOUBLE) AS now_at,
  CAST(g.moment - {window} AS DOUBLE) AS past_at FROM players p JOIN grid g USING (extraction_id)""",
        "current_gold": """
SELECT l.extraction_id, l.player_slot, l.team_id, l.moment, l.past_at, g.total AS now_total FROM lookups l
ASOF JOIN single_gold g ON g.extraction_id = l.extraction_id AND g.player_slot = l.player_slot AND l.now_at >= g.game_time_seconds""",
        "player_rates": f"""
SELECT l.extraction_id, l.player_slot, l.team_id, l.moment, 60.0 * (l.now_total - g.total) / {window} AS gpm FROM current_gold l
ASOF JOIN single_gold g ON g.extraction_id = l.extraction_id AND g.player_slot = l.player_slot AND l.past_at >= g.game_time_seconds""",
        "rates": f"""
SELECT extraction_id, 'player' AS series_kind, player_slot, team_id, moment AS game_time_seconds, gpm FROM player_rates
UNION ALL SELECT extraction_id, 'team', NULL, team_id, moment, sum(gpm) FROM player_rates
GROUP BY extraction_id, team_id, moment HAVING count(*) = {TEAM_SIZE}""",
    }


# The grid must start on multiples of the step, so windows here are multiples of it.
_RATES = "extraction_id:s series_kind:s player_slot:i team_id:i game_time_seconds:d gpm:d"


def _rolling_frame(t: Telemetry, window: int, step: int) -> DataFrame:
    return series.rolling_gpm(t.matches, t.players, t.gold, window, step, team_size=TEAM_SIZE)


@query(_RATES, "SELECT * FROM rates", _rolling(60, 10))
def rolling_gpm(t: Telemetry) -> DataFrame:
    return _rolling_frame(t, 60, 10)


@query(_RATES, "SELECT * FROM rates", _rolling(300, 60))
def rolling_gpm_long(t: Telemetry) -> DataFrame:
    return _rolling_frame(t, 300, 60)


@query(_RATES, """
SELECT * FROM rates WHERE game_time_seconds BETWEEN 300 AND 900 AND series_kind = 'team'""", _rolling(60, 30))
def lens_rolling(t: Telemetry) -> DataFrame:
    return lens.Lens(300, 900).rolling(_rolling_frame(t, 60, 30))


@query("match_id:i sample_index:i game_time_seconds:d radiant_probability:d dire_probability:d source:s", """
SELECT m.match_id, p.*, 1.0 - p.radiant_probability AS dire_probability FROM probability p JOIN matches m USING (extraction_id)""")
def win_probability(t: Telemetry) -> DataFrame:
    return series.win_probability(t.probability, t.latest)


@query("sample_index:i game_time_seconds:d radiant_probability:d",
       "SELECT * FROM probability WHERE game_time_seconds BETWEEN 300 AND 900")
def lens_probability(t: Telemetry) -> DataFrame:
    return lens.Lens(300, 900).probability(series.win_probability(t.probability, t.latest))


@query("extraction_id:s problem:s", """
SELECT * FROM (SELECT extraction_id, unnest([
  CASE WHEN count(DISTINCT source) > 1 THEN 'mixed sources' END,
  CASE WHEN bool_or(source = 'guess') THEN 'unknown source' END,
  CASE WHEN bool_or(radiant_probability > 1) THEN 'value out of range' END]) AS problem
FROM (SELECT extraction_id, CASE WHEN sample_index % 97 = 5 THEN 'guess' ELSE source END AS source,
    CASE WHEN sample_index % 89 = 7 THEN 1.5 ELSE radiant_probability END AS radiant_probability FROM probability)
GROUP BY extraction_id) AS found WHERE problem IS NOT NULL""")
def win_probability_violations(t: Telemetry) -> DataFrame:
    index = F.col("sample_index")
    return series.win_probability_violations(t.probability.withColumns({
        "source": F.when(index % 97 == 5, F.lit("guess")).otherwise(F.col("source")),
        "radiant_probability": F.when(index % 89 == 7, F.lit(1.5)).otherwise(F.col("radiant_probability"))}))


@query("extraction_id:s player_slot:i baseline_gold:i final_gold:i rounded_gold_per_minute:i difference:i within_tolerance:b", """
SELECT *, abs(rounded_gold_per_minute - gold_per_min) AS difference,
  coalesce(abs(rounded_gold_per_minute - gold_per_min) <= 1, false) AS within_tolerance
FROM (SELECT p.extraction_id, p.player_slot, p.gold_per_min, b.baseline_gold, b.final_gold,
    floor(60.0 * (b.final_gold - b.baseline_gold) / m.duration_seconds + 0.5) AS rounded_gold_per_minute
  FROM players p JOIN matches m USING (extraction_id) LEFT JOIN (
    SELECT extraction_id, player_slot,
      arg_max(total_gold_earned, (game_time_seconds, sequence)) FILTER (WHERE game_time_seconds <= 0) AS baseline_gold,
      arg_max(total_gold_earned, (game_time_seconds, sequence)) AS final_gold
    FROM gold GROUP BY extraction_id, player_slot) b USING (extraction_id, player_slot))""")
def gold_reconciliation(t: Telemetry) -> DataFrame:
    return series.gold_reconciliation(t.matches, t.players, t.gold)


@query("extraction_id:s start_ms:i end_ms:i selected_rows:i cell_rows:i agrees:b", """
SELECT r.extraction_id, start_ms, end_ms, count(p.sequence) AS selected_rows, count(p.sequence) AS cell_rows, true AS agrees
FROM (SELECT *, floor((start_ms + length) / 100) * 100 AS end_ms FROM (
    SELECT extraction_id, least(duration_seconds * 1000, 300000) AS length,
      floor((duration_seconds * 1000 - least(duration_seconds * 1000, 300000)) / 200) * 100 AS start_ms FROM matches)) r
LEFT JOIN positions p ON p.extraction_id = r.extraction_id AND p.game_time_milliseconds BETWEEN start_ms AND end_ms
GROUP BY ALL""")
def heatmap_reconciliation(t: Telemetry) -> DataFrame:
    return series.heatmap_reconciliation(t.matches, t.positions, 300_000)


@query("extraction_id:s supports_window:b player_series:i team_series:i radiant_players:i dire_players:i complete:b", f"""
SELECT *, NOT supports_window OR (player_series = {2 * TEAM_SIZE} AND team_series = 2 AND radiant_players = {TEAM_SIZE}
    AND dire_players = {TEAM_SIZE}) AS complete
FROM (SELECT m.extraction_id, any_value(m.duration_seconds) >= 300 AS supports_window,
    count(DISTINCT CASE WHEN series_kind = 'player' THEN player_slot END) AS player_series,
    count(DISTINCT CASE WHEN series_kind = 'team' THEN team_id END) AS team_series,
    count(DISTINCT CASE WHEN series_kind = 'player' AND team_id = 2 THEN player_slot END) AS radiant_players,
    count(DISTINCT CASE WHEN series_kind = 'player' AND team_id = 3 THEN player_slot END) AS dire_players
  FROM matches m LEFT JOIN rates r USING (extraction_id) GROUP BY m.extraction_id)""", _rolling(300, 60))
def series_completeness(t: Telemetry) -> DataFrame:
    return series.series_completeness(_rolling_frame(t, 300, 60), t.matches, 300, TEAM_SIZE)


_AUDIT_CONDITIONS = {
    "amount": "value IS NOT NULL", "assist list": "len(assist_players) > 0", "attacker": "attacker_name <> ''",
    "barracks": "regexp_matches(lower(target_name), 'barracks|_rax')", "building": "target_building",
    "copy": "attacker_illusion IS TRUE OR target_illusion IS TRUE",
    "enemy hit": "attacker_team + target_team = 5 AND attacker_team IN (2, 3) AND value > 0 AND game_time IS NOT NULL",
    "hero source": "starts_with(damage_source_name, 'npc_dota_hero_')", "own target": "NOT target_illusion",
    "place": "location_x + location_y IS NOT NULL", "roshan": "contains(lower(target_name), 'roshan')",
    "source": "damage_source_name <> ''",
    "source apart from attacker": "damage_source_name <> '' AND damage_source_name IS DISTINCT FROM attacker_name",
    "target": "target_name <> ''", "time": "game_time IS NOT NULL",
    "tormentor": "contains(lower(target_name), 'tormentor')", "tower": "contains(lower(target_name), 'tower')",
}
_AUDIT_SQL = """
SELECT extraction_id, event_type, f.field AS field, count(*) AS events, count(*) FILTER (WHERE f.met) AS filled,
  count(*) FILTER (WHERE f.met AND target_hero AND target_team IN (2, 3)) AS filled_on_hero
FROM (SELECT *, unnest([%s]) AS f FROM game WHERE NOT contains(event_type, 'GAME_STATE'))
GROUP BY extraction_id, event_type, f.field""" % ", ".join(
    f"{{'field': '{name}', 'met': {condition}}}" for name, condition in _AUDIT_CONDITIONS.items())


@query("extraction_id:s event_type:s field:s events:i filled:i filled_on_hero:i", _AUDIT_SQL)
def event_field_audit(t: Telemetry) -> DataFrame:
    return quality.event_field_audit(t.combat, bounds(t))


@query("extraction_id:s metadata_game_player_ids:i ambiguous_metadata_ids:i assist_credits:i mapped_assist_credits:i "
       "unmapped_assist_credits:i ambiguous_assist_credits:i", """
SELECT b.extraction_id,
  (SELECT count(*) FROM ids i WHERE i.extraction_id = b.extraction_id) AS metadata_game_player_ids,
  (SELECT count(*) FROM ids i WHERE i.extraction_id = b.extraction_id AND n > 1) AS ambiguous_metadata_ids,
  count(c.gp) AS assist_credits, count(c.gp) FILTER (WHERE i.n = 1) AS mapped_assist_credits,
  count(c.gp) FILTER (WHERE i.n IS NULL) AS unmapped_assist_credits,
  count(c.gp) FILTER (WHERE i.n > 1) AS ambiguous_assist_credits
FROM bounds b LEFT JOIN (SELECT extraction_id, unnest(assist_players) AS gp FROM game
  WHERE event_type = 'DOTA_COMBATLOG_DEATH' AND target_hero AND target_team IN (2, 3)) c USING (extraction_id)
LEFT JOIN ids i ON i.extraction_id = b.extraction_id AND i.game_player_id = c.gp
WHERE b.stop_sequence IS NOT NULL GROUP BY b.extraction_id""", {
    "ids": "SELECT extraction_id, game_player_id, count(*) AS n FROM candidates WHERE game_player_id >= 0 GROUP BY ALL"})
def assist_mapping_audit(t: Telemetry) -> DataFrame:
    return quality.assist_mapping_audit(t.combat, bounds(t), t.metadata_candidates)


@query("extraction_id:s position_rows:i on_exact_boundary:b", """
SELECT m.extraction_id, count(p.sequence) AS position_rows, CASE WHEN count(p.sequence) > 0 THEN
  count(*) FILTER (WHERE game_time_milliseconds % 100 = 0) = count(p.sequence) END AS on_exact_boundary
FROM matches m LEFT JOIN positions p USING (extraction_id) GROUP BY m.extraction_id""")
def position_audit(t: Telemetry) -> DataFrame:
    return quality.position_audit(t.matches, t.positions)


@query("kind:s p50:i p95:i", """
SELECT kind, list_sort(list(cents))[CAST(greatest(0, ceil(count(*) * 0.5) - 1) AS BIGINT) + 1] AS p50,
  list_sort(list(cents))[CAST(greatest(0, ceil(count(*) * 0.95) - 1) AS BIGINT) + 1] AS p95 FROM ev GROUP BY kind""")
def nearest_rank_percentiles(t: Telemetry) -> DataFrame:
    return quality.nearest_rank_percentile(t.ev, ["kind"], "cents", {"p50": 0.5, "p95": 0.95})


@query("extraction_id:s middle:i",
       "SELECT extraction_id, list_sort(list(cents))[count(*) // 2 + 1] AS middle FROM ev GROUP BY extraction_id")
def upper_median(t: Telemetry) -> DataFrame:
    return quality.upper_median(t.ev, ["extraction_id"], "cents", "middle")


# --- kernels --------------------------------------------------------------------------------


@query("sequence:i found_sequence:i found_ms:i", """
SELECT e.sequence, p.sequence AS found_sequence, p.t_ms AS found_ms FROM (SELECT * FROM ev WHERE kind = 'error') e
ASOF LEFT JOIN (SELECT extraction_id, slot, t_ms, max(sequence) AS sequence FROM ev WHERE kind = 'purchase' GROUP BY ALL) p
  ON p.extraction_id = e.extraction_id AND p.slot = e.slot AND e.t_ms >= p.t_ms""")
def asof_last(t: Telemetry) -> DataFrame:
    facts = t.ev.where("kind = 'purchase'").select("extraction_id", "slot", "t_ms", "sequence")
    asked = t.ev.where("kind = 'error'").select("extraction_id", "slot", "sequence", F.col("t_ms").alias("at"))
    return asof_lookup(asked, facts, ["extraction_id", "slot"], "at", "t_ms", ["sequence"], ["sequence"], 300_000,
                       "found").select("sequence", F.col("found.sequence").alias("found_sequence"),
                                       F.col("found.t_ms").alias("found_ms"))


@query("sequence:i found_ms:i", """
SELECT e.sequence, arg_min(p.t_ms, (abs(p.t_ms - e.t_ms), p.t_ms)) AS found_ms
FROM (SELECT * FROM ev WHERE kind = 'error') e LEFT JOIN (SELECT * FROM ev WHERE kind = 'purchase') p
  ON p.extraction_id = e.extraction_id AND p.slot = e.slot AND abs(p.t_ms - e.t_ms) <= 60000 GROUP BY e.sequence""")
def nearest_within(t: Telemetry) -> DataFrame:
    facts = t.ev.where("kind = 'purchase'").select("extraction_id", "slot", "t_ms", "sequence")
    asked = t.ev.where("kind = 'error'").select("extraction_id", "slot", "sequence", F.col("t_ms").alias("at"))
    return nearest_lookup(asked, facts, ["extraction_id", "slot"], "at", "t_ms", ["sequence"], ["sequence"], 60_000,
                          300_000, "found").select("sequence", F.col("found.t_ms").alias("found_ms"))


@query("extraction_id:s slot:i session_start:i session_end:i events:i cents:i", """
SELECT extraction_id, slot, min(t_ms) AS session_start, max(t_ms) AS session_end, count(*) AS events, sum(cents) AS cents
FROM (SELECT *, sum(fresh) OVER (PARTITION BY extraction_id, slot ORDER BY t_ms, sequence) AS n FROM (
  SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY extraction_id, slot ORDER BY t_ms, sequence) <= 30000
    THEN 0 ELSE 1 END AS fresh FROM ev))
GROUP BY extraction_id, slot, n""")
def activity_sessions(t: Telemetry) -> DataFrame:
    return gap_sessions(t.ev, ["extraction_id", "slot"], "t_ms", 30_000,
                        {"n": F.count("*"), "c": F.sum("cents")}, {"events": F.sum("n"), "cents": F.sum("c")})


# --- damage ---------------------------------------------------------------------------------

_TAKEN = {
    "taken": """
SELECT e.extraction_id, r.player_slot, e.sequence, e.game_time, CAST(floor(e.game_time / 30) * 30 AS BIGINT) AS interval_start,
  coalesce(nullif(trim(e.damage_source_name), ''), nullif(trim(e.attacker_name), ''), 'Unknown source') AS source_name,
  coalesce(e.attacker_illusion, false) AS illusion, nullif(trim(e.attacker_name), '') AS unit,
  nullif(trim(e.inflictor_name), '') AS mechanism_name, e.value AS damage
FROM game e JOIN roster r ON r.extraction_id = e.extraction_id AND r.name = e.target_name AND r.team_id = e.target_team
WHERE e.event_type = 'DOTA_COMBATLOG_DAMAGE' AND NOT coalesce(e.target_illusion, false) AND e.value IS NOT NULL""",
    "taken_facts": """
SELECT *, CASE WHEN illusion THEN 'illusion' WHEN unit <> source_name THEN 'unit' ELSE 'direct' END AS via_kind,
  CASE WHEN illusion OR unit <> source_name THEN unit END AS via_name FROM taken""",
}
_DONE = {
    "done": """
SELECT e.extraction_id, r.player_slot, e.sequence, e.game_time, CAST(floor(e.game_time / 30) * 30 AS BIGINT) AS interval_start,
  coalesce(nullif(trim(e.target_source_name), ''), nullif(trim(e.target_name), ''), 'Unknown target') AS target_name,
  e.target_team, coalesce(e.target_illusion, false) AS illusion, nullif(trim(e.target_name), '') AS unit,
  coalesce(e.attacker_illusion, false) AS dealer_illusion, nullif(trim(e.attacker_name), '') AS dealer_unit,
  coalesce(nullif(trim(e.damage_source_name), ''), nullif(trim(e.attacker_name), '')) AS dealer,
  nullif(trim(e.inflictor_name), '') AS mechanism_name, e.value AS damage
FROM game e JOIN roster r ON r.extraction_id = e.extraction_id
  AND r.name = coalesce(nullif(e.damage_source_name, ''), nullif(e.attacker_name, '')) AND r.team_id = e.attacker_team
WHERE e.event_type = 'DOTA_COMBATLOG_DAMAGE' AND e.value IS NOT NULL""",
    "done_facts": """
SELECT *, CASE WHEN illusion THEN 'illusion' WHEN unit <> target_name THEN 'unit' ELSE 'direct' END AS via_kind,
  CASE WHEN illusion OR unit <> target_name THEN unit END AS via_name,
  CASE WHEN dealer_illusion THEN 'illusion' WHEN dealer_unit <> dealer THEN 'unit' ELSE 'direct' END AS dealer_via_kind
FROM done""",
}


def _levels(table: str, levels: list[list[str]]) -> str:
    names = [name for level in levels for name in level]
    parts = []
    for depth in range(len(levels) + 1):
        kept = [name for level in levels[:depth] for name in level]
        shown = ", ".join(name if name in kept else f"NULL AS {name}" for name in names)
        keys = ", ".join(["extraction_id", "player_slot", *kept])
        parts.append(f"SELECT extraction_id, player_slot, {depth} AS level, {shown}, sum(damage) AS damage, "
                     f"count(*) AS event_count FROM {table} GROUP BY {keys}")
    return "\nUNION ALL ".join(parts)


_TAKEN_LEVELS = [list(level) for level in damage.TAKEN_LEVELS]
_DONE_LEVELS = [list(level) for level in damage.DONE_LEVELS]


@query("extraction_id:s player_slot:i level:i interval_start:i source_name:s via_kind:s via_name:s mechanism_name:s damage:i "
       "event_count:i", _levels("taken_facts", _TAKEN_LEVELS), _TAKEN)
def damage_taken_by_source(t: Telemetry) -> DataFrame:
    return damage.damage_taken_by_source(t.combat, bounds(t), t.players)


@query("extraction_id:s player_slot:i level:i interval_start:i target_name:s target_team:i via_kind:s via_name:s "
       "mechanism_name:s damage:i event_count:i", _levels("done_facts", _DONE_LEVELS), _DONE)
def damage_done_by_target(t: Telemetry) -> DataFrame:
    return damage.damage_done_by_target(t.combat, bounds(t), t.players)


@query("extraction_id:s player_slot:i sequence:i via_kind:s via_name:s dealer_via_kind:s", "SELECT * FROM done_facts", _DONE)
def via_attribution(t: Telemetry) -> DataFrame:
    return damage.damage_done_facts(t.combat, bounds(t), t.players)


@query("extraction_id:s player_slot:i interval_start:i source_name:s damage:i", """
SELECT extraction_id, player_slot, interval_start, source_name, sum(damage) AS damage FROM taken_facts
WHERE game_time BETWEEN 300 AND 900 GROUP BY ALL""", _TAKEN)
def lens_damage(t: Telemetry) -> DataFrame:
    facts = lens.Lens(300, 900).damage(damage.damage_taken_facts(t.combat, bounds(t), t.players))
    return facts.groupBy("extraction_id", "player_slot", "interval_start", "source_name").agg(
        F.sum("damage").alias("damage"))


_LABEL = f"""(CASE WHEN starts_with(source_name, 'npc_dota_hero_') THEN
  ([{oracle._LABELS}])[list_position([{oracle._SLUGS}], source_name[15:])]
  WHEN source_name = 'npc_dota_summon' THEN 'Summon' ELSE 'Unit ' || source_name[15:] END)"""
_TOP = {
    **_TAKEN,
    "source_totals": f"""
SELECT *, row_number() OVER (PARTITION BY extraction_id, player_slot ORDER BY damage DESC, label, source_name) AS rank
FROM (SELECT extraction_id, player_slot, source_name, sum(damage) AS damage, {_LABEL} AS label FROM taken_facts GROUP BY ALL)""",
    "placed": """
SELECT f.extraction_id, f.player_slot, f.interval_start, least(s.rank, 8) AS series_rank,
  CASE WHEN s.rank <= 7 THEN s.label ELSE 'Other' END AS series_label, f.damage
FROM taken_facts f JOIN source_totals s USING (extraction_id, player_slot, source_name)""",
}


@query("extraction_id:s player_slot:i interval_start:i interval_damage:i series_order:i series_label:s damage:i", """
SELECT i.extraction_id, i.player_slot, i.interval_start, i.interval_damage, s.series_rank - 1 AS series_order, s.series_label,
  coalesce(sum(p.damage), 0) AS damage
FROM (SELECT extraction_id, player_slot, interval_start, sum(damage) AS interval_damage FROM placed GROUP BY ALL) i
JOIN (SELECT DISTINCT extraction_id, player_slot, series_rank, series_label FROM placed) s USING (extraction_id, player_slot)
LEFT JOIN placed p ON p.extraction_id = i.extraction_id AND p.player_slot = i.player_slot
  AND p.interval_start = i.interval_start AND p.series_rank = s.series_rank
GROUP BY ALL""", _TOP)
def top_sources_plus_other(t: Telemetry) -> DataFrame:
    return lens.top_groups_plus_other(damage.damage_taken_facts(t.combat, bounds(t), t.players), ["source_name"],
                                      "source_name")


@query("extraction_id:s player_slot:i target_name:s target_team:i rank:i shown_label:s", f"""
SELECT *, CASE WHEN count(*) OVER (PARTITION BY extraction_id, player_slot, label) = 1 THEN label ELSE label || ' (' ||
    CASE WHEN target_team = 2 THEN 'Radiant' WHEN target_team = 3 THEN 'Dire' ELSE 'team ' || target_team END || ')' END AS shown_label
FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, player_slot ORDER BY damage DESC, label, target_name, target_team) AS rank
  FROM (SELECT extraction_id, player_slot, target_name, target_team, sum(damage) AS damage,
    {_LABEL.replace('source_name', 'target_name').replace("WHEN target_name = 'npc_dota_summon' THEN 'Summon' ELSE 'Unit ' || target_name[15:]",
     "WHEN target_name = 'npc_dota_owner' THEN 'Owner' ELSE 'Neutral Kobold'")} AS label FROM done_facts GROUP BY ALL)
  QUALIFY rank <= 7)""", _DONE)
def disambiguated_labels(t: Telemetry) -> DataFrame:
    facts = damage.damage_done_facts(t.combat, bounds(t), t.players)
    group = ["target_name", "target_team"]
    visible = damage.leading_groups(damage.group_totals(facts, group, "target_name"), group)
    return lens.disambiguate_labels(visible, ["extraction_id", "player_slot"])


@query("source_name:s label:s", f"SELECT DISTINCT source_name, {_LABEL} AS label FROM taken_facts", _TAKEN)
def display_names(t: Telemetry) -> DataFrame:
    return damage.damage_taken_facts(t.combat, bounds(t), t.players).select("source_name").distinct().withColumn(
        "label", pretty_name(F.col("source_name")))


# --- fights ---------------------------------------------------------------------------------


def detect(t: Telemetry) -> fights.Fights:
    from arenaflow.operators.documents import metadata_roster

    return fights.Fights(t.combat, t.players, metadata_roster(t.metadata_candidates, "both"), bounds(t), t.positions,
                         t.gold, t.team_series, t.probability)


@query("extraction_id:s sequence:i t:d victim_slot:i killer_slot:i assists:s", """
SELECT d.*, (SELECT coalesce(string_agg(a.slot, ',' ORDER BY a.slot), '') FROM assists a
  WHERE a.extraction_id = d.extraction_id AND a.sequence = d.sequence) AS assists FROM deaths d""")
def anchor_deaths(t: Telemetry) -> DataFrame:
    return fights.anchor_deaths(detect(t).events).withColumn("assists", F.array_join("assist_slots", ","))


@query("extraction_id:s sequence:i x:d y:d", "SELECT * FROM deaths")
def victim_positions(t: Telemetry) -> DataFrame:
    return fights.locate_anchors(fights.anchor_deaths(detect(t).events), t.positions)


@query("extraction_id:s sequence:i fight_id:i", "SELECT * FROM anchors")
def grouped_anchors(t: Telemetry) -> DataFrame:
    return detect(t).anchors


@query("extraction_id:s fight_id:i player_slot:i kills:i deaths:i assists:i", "SELECT * FROM participants")
def fight_participants(t: Telemetry) -> DataFrame:
    return detect(t).participants


@query("extraction_id:s fight_id:i fight_type:s radiant:i dire:i death_count:i", "SELECT * FROM groups")
def fight_types(t: Telemetry) -> DataFrame:
    return detect(t).groups


@query("extraction_id:s fight_id:i sequence:i t:d",
       "SELECT * FROM relevant WHERE t BETWEEN first_death - 60 AND last_death + 20")
def relevant_damage(t: Telemetry) -> DataFrame:
    return detect(t).relevant_damage


@query("extraction_id:s fight_id:i combat_start:d combat_end:d", "SELECT * FROM intervals")
def combat_intervals(t: Telemetry) -> DataFrame:
    return detect(t).intervals


@query("extraction_id:s fight_id:i sequence:i x:d y:d", "SELECT * FROM points")
def combat_points(t: Telemetry) -> DataFrame:
    return detect(t).combat_points


@query("extraction_id:s fight_id:i center_x:d center_y:d minimum_x:d maximum_x:d minimum_y:d maximum_y:d",
       "SELECT * FROM map_views")
def fight_map_views(t: Telemetry) -> DataFrame:
    return detect(t).map_views


@query("extraction_id:s fight_id:i outcome_end:d", "SELECT * FROM fights")
def clipped_outcomes(t: Telemetry) -> DataFrame:
    return detect(t).fights


@query("extraction_id:s fight_id:i player_slot:i damage_dealt:i damage_taken:i healing:i experience:i",
       "SELECT * FROM player_metrics")
def fight_player_metrics(t: Telemetry) -> DataFrame:
    return detect(t).player_metrics


@query("extraction_id:s fight_id:i player_slot:i kills:i deaths:i assists:i damage_dealt:i damage_taken:i healing:i "
       "earned_gold_change:i experience_change:i", "SELECT * FROM player_results")
def fight_player_results(t: Telemetry) -> DataFrame:
    return detect(t).player_results


@query("extraction_id:s fight_id:i team_id:i participants:i kills:i deaths:i hero_damage:i hero_healing:i "
       "earned_gold_change:i experience_change:i net_worth_change:i", "SELECT * FROM team_results")
def fight_team_results(t: Telemetry) -> DataFrame:
    return detect(t).team_results


@query("extraction_id:s fight_id:i radiant_win_probability_change:d win_probability_source:s",
       "SELECT * FROM probability_changes")
def fight_probability_changes(t: Telemetry) -> DataFrame:
    return detect(t).probability_changes


@query("extraction_id:s fight_id:i sequence:i kind:s label:s team_id:i", "SELECT * FROM objectives")
def fight_objectives(t: Telemetry) -> DataFrame:
    return detect(t).objectives


_SIDE = ("kills", "deaths", "hero_damage", "hero_healing", "earned_gold_change", "experience_change", "net_worth_change")
_LIST_SQL = """
SELECT f.*, 'death-anchored-fights-v1' AS detection_version, f.combat_end - f.combat_start AS duration_seconds,
  f.radiant AS radiant_participants, f.dire AS dire_participants, f.center_x IS NOT NULL AS location_available,
""" + "".join(f"  {side[0]}.{name} AS {side}_{name},\n" for side in ("radiant", "dire") for name in _SIDE) + """
  p.radiant_win_probability_change, p.win_probability_source,
  (SELECT count(*) FROM objectives o WHERE o.extraction_id = f.extraction_id AND o.fight_id = f.fight_id) AS objective_count,
  true AS earned_gold_available, EXISTS (SELECT 1 FROM fe WHERE fe.extraction_id = f.extraction_id
    AND fe.event_type = 'DOTA_COMBATLOG_XP') AS experience_available,
  EXISTS (SELECT 1 FROM team_series s WHERE s.extraction_id = f.extraction_id AND s.net_worth IS NOT NULL) AS net_worth_available,
  true AS positions_available, p.win_probability_source IS NOT NULL AS win_probability_available
FROM fights f JOIN team_results r ON r.extraction_id = f.extraction_id AND r.fight_id = f.fight_id AND r.team_id = 2
JOIN team_results d ON d.extraction_id = f.extraction_id AND d.fight_id = f.fight_id AND d.team_id = 3
LEFT JOIN probability_changes p ON p.extraction_id = f.extraction_id AND p.fight_id = f.fight_id"""


@query("extraction_id:s fight_id:i detection_version:s fight_type:s first_death:d combat_start:d combat_end:d "
       "duration_seconds:d outcome_end:d death_count:i radiant_participants:i dire_participants:i center_x:d center_y:d "
       "location_available:b " + " ".join(f"{side}_{name}:i" for side in ("radiant", "dire") for name in _SIDE)
       + " radiant_win_probability_change:d win_probability_source:s objective_count:i earned_gold_available:b "
       "experience_available:b net_worth_available:b positions_available:b win_probability_available:b", _LIST_SQL)
def fight_list(t: Telemetry) -> DataFrame:
    return detect(t).fight_list


@query("extraction_id:s fight_id:i duration_seconds:d anchor_times:s people:s fallen:s", """
SELECT f.extraction_id, f.fight_id, f.combat_end - f.combat_start AS duration_seconds,
  (SELECT string_agg(CAST(round(t * 1000) AS BIGINT), ',' ORDER BY t, sequence) FROM anchors a
    WHERE a.extraction_id = f.extraction_id AND a.fight_id = f.fight_id) AS anchor_times,
  (SELECT string_agg(player_slot || ':' || kills || ':' || deaths || ':' || assists, ',' ORDER BY player_slot) FROM participants p
    WHERE p.extraction_id = f.extraction_id AND p.fight_id = f.fight_id) AS people,
  coalesce((SELECT string_agg(kind || '@' || CAST(round(t * 1000) AS BIGINT), ',' ORDER BY t, sequence) FROM objectives o
    WHERE o.extraction_id = f.extraction_id AND o.fight_id = f.fight_id), '') AS fallen
FROM fights f""")
def fight_records(t: Telemetry) -> DataFrame:
    def text(array: str, shown: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(array, shown), ",")

    def milliseconds(value: Column) -> Column:
        return F.round(value * 1000).cast("bigint").cast("string")

    return detect(t).records.select(
        "extraction_id", "fight_id", "duration_seconds", text("anchor_times", milliseconds).alias("anchor_times"),
        text("participants", lambda p: F.concat_ws(":", *[p[name].cast("string") for name in (
            "player_slot", "kills", "deaths", "assists")])).alias("people"),
        text("objectives", lambda o: F.concat(o["kind"], F.lit("@"), milliseconds(o["t"]))).alias("fallen"))


@query("extraction_id:s fight_id:i sequence:i game_time_seconds:d victim_slot:i killer_slot:i assists:s x:d y:d", """
SELECT a.extraction_id, a.fight_id, a.sequence, a.t AS game_time_seconds, a.victim_slot, a.killer_slot, a.x, a.y,
  (SELECT coalesce(string_agg(s.slot, ',' ORDER BY s.slot), '') FROM assists s
    WHERE s.extraction_id = a.extraction_id AND s.sequence = a.sequence) AS assists FROM anchors a""")
def fight_anchor_details(t: Telemetry) -> DataFrame:
    return detect(t).anchor_details.withColumn(
        "assists", F.array_join(F.array_sort("assist_slots").cast("array<string>"), ","))


@query("extraction_id:s has_combat:b has_positions:b", """
SELECT 'x' || n AS extraction_id, EXISTS (SELECT 1 FROM combat c WHERE c.extraction_id = 'x' || n
    AND c.event_type = 'DOTA_COMBATLOG_GAME_STATE' AND c.value = 4) AND EXISTS (SELECT 1 FROM combat c
    WHERE c.extraction_id = 'x' || n AND c.event_type = 'DOTA_COMBATLOG_GAME_STATE' AND c.value = 6) AS has_combat,
  EXISTS (SELECT 1 FROM positions p WHERE p.extraction_id = 'x' || n) AS has_positions
FROM (SELECT unnest(range((SELECT max(ext) + 3 FROM ev))) AS n) AS wanted""")
def fight_states(t: Telemetry) -> DataFrame:
    """All extractions and two more that have no event."""
    wanted = t.ev.agg(F.max("ext").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") + 2)).alias("n"))
    return detect(t).states(wanted.select(F.concat(F.lit("x"), "n").alias("extraction_id")))


@query("extraction_id:s fight_id:i game_time_milliseconds:i slots:s", """
SELECT extraction_id, fight_id, game_time_milliseconds, string_agg(player_slot, ',' ORDER BY player_slot) AS slots
FROM frame_positions GROUP BY ALL""")
def fight_frames(t: Telemetry) -> DataFrame:
    return detect(t).frames.withColumn("slots", F.array_join("positions.player_slot", ","))


@query("extraction_id:s fight_id:i frame_count:i position_state:s", """
SELECT i.extraction_id, i.fight_id, count(DISTINCT p.game_time_milliseconds) AS frame_count,
  CASE WHEN count(p.player_slot) > 0 THEN 'available' ELSE 'empty' END AS position_state
FROM intervals i LEFT JOIN frame_positions p USING (extraction_id, fight_id) GROUP BY ALL""")
def fight_position_states(t: Telemetry) -> DataFrame:
    return detect(t).position_states


@query("extraction_id:s fight_id:i sequence:i player_slot:i game_time_milliseconds:i world_x:d world_y:d", """
SELECT a.extraction_id, a.fight_id, a.sequence, a.victim_slot AS player_slot, floor(a.t * 10) * 100 AS game_time_milliseconds,
  a.x AS world_x, a.y AS world_y
FROM anchors a LEFT JOIN map_views v USING (extraction_id, fight_id)
WHERE a.x IS NOT NULL AND (v.minimum_x IS NULL OR (a.x BETWEEN v.minimum_x AND v.maximum_x AND a.y BETWEEN v.minimum_y AND v.maximum_y))""")
def fight_death_markers(t: Telemetry) -> DataFrame:
    return detect(t).death_markers


@query("extraction_id:s fight_id:i", """
SELECT DISTINCT f.extraction_id, f.fight_id FROM fights f
WHERE EXISTS (SELECT 1 FROM anchors a WHERE a.extraction_id = f.extraction_id AND a.fight_id = f.fight_id AND a.t BETWEEN 300 AND 900)
  AND EXISTS (SELECT 1 FROM participants p WHERE p.extraction_id = f.extraction_id AND p.fight_id = f.fight_id
    AND p.player_slot = 4 AND p.kills + p.deaths + p.assists > 0)""")
def lens_fights(t: Telemetry) -> DataFrame:
    found = detect(t)
    return lens.Lens(300, 900, player_slot=4).fights(found.groups, found.anchors, found.participants)


@query("extraction_id:s fight_id:i sequence:i px:d py:d", """
SELECT *, cx + dx * s AS px, cy + dy * s AS py FROM (
  SELECT *, coalesce(least(CASE WHEN dx <> 0 THEN abs((CASE WHEN dx > 0 THEN hx - cx ELSE lx - cx END) / dx) END,
    CASE WHEN dy <> 0 THEN abs((CASE WHEN dy > 0 THEN hy - cy ELSE ly - cy END) / dy) END), 0) AS s
  FROM (SELECT a.extraction_id, a.fight_id, a.sequence, v.minimum_x + 50 AS lx, v.maximum_x - 50 AS hx, v.minimum_y + 50 AS ly,
      v.maximum_y - 50 AS hy, (lx + hx) / 2 AS cx, (ly + hy) / 2 AS cy, a.x - cx AS dx, a.y - cy AS dy
    FROM anchors a JOIN map_views v USING (extraction_id, fight_id) WHERE a.x IS NOT NULL))""")
def projected_points(t: Telemetry) -> DataFrame:
    found = detect(t)
    joined = found.anchors.where("x IS NOT NULL").join(found.map_views, ["extraction_id", "fight_id"])
    edges = {name: F.col(name) for name in ("minimum_x", "maximum_x", "minimum_y", "maximum_y")}
    px, py = lens.project_to_bounds(F.col("x"), F.col("y"), edges, 50.0)
    return joined.withColumn("px", px).withColumn("py", py)


# --- farming --------------------------------------------------------------------------------

RADIUS, GAP_MS = 4000, 120_000
_FARM = {"assigned": oracle.assigned_view(RADIUS), "sessions": oracle.sessions_view(GAP_MS),
         "actions": oracle.actions_view(GAP_MS)}


def _camps(t: Telemetry) -> DataFrame:
    return farming.camps(farming.spawner_facts(t.instances, t.checkpoints, t.entity_events))


def _creeps(t: Telemetry) -> DataFrame:
    return farming.creep_facts(t.instances, t.checkpoints, t.entity_events, t.updates)


def _assigned(t: Telemetry) -> tuple[DataFrame, DataFrame, DataFrame]:
    located, creeps, assigned = farming.assigned_damage(
        t.combat, t.players, t.positions, t.instances, t.checkpoints, t.entity_events, t.updates, RADIUS)
    return assigned, located, creeps


def _actions(t: Telemetry) -> DataFrame:
    return farming.farming_actions(*_assigned(t), gap_ms=GAP_MS)


@query("extraction_id:s entity_instance_id:i handle:i camp_type:i world_x:d world_y:d creation_ms:i deletion_ms:i",
       "SELECT *, sequence AS entity_instance_id, px AS world_x, py AS world_y FROM spawners")
def spawner_facts(t: Telemetry) -> DataFrame:
    return farming.spawner_facts(t.instances, t.checkpoints, t.entity_events)


@query("extraction_id:s entity_instance_id:i spawner_handle:i team_number:i creation_ms:i deletion_ms:i death_ms:i",
       "SELECT * FROM creeps")
def creep_facts(t: Telemetry) -> DataFrame:
    return _creeps(t)


@query("extraction_id:s entity_instance_id:i problem:s", """
SELECT c.extraction_id, c.entity_instance_id, 'spawner handle does not resolve exactly once' AS problem FROM creeps c
WHERE c.entity_instance_id % 9 NOT IN (4, 5)
  AND (SELECT count(*) FROM spawners s WHERE s.extraction_id = c.extraction_id AND s.handle = c.spawner_handle) <> 1
UNION ALL SELECT extraction_id, entity_instance_id, ['creep needs exactly one creation', 'creep has several deletions',
  'creep deletion has no time', 'creep has no creation time', 'creep has the invalid spawner handle',
  'creep has no spawner handle'][1 + entity_instance_id % 9] FROM creeps WHERE entity_instance_id % 9 < 6
UNION ALL SELECT extraction_id, sequence, ['spawner needs exactly one creation', 'spawner has several deletions',
  'spawner deletion has no time'][1 + sequence % 9] FROM spawners WHERE sequence % 9 < 3""")
def link_violations(t: Telemetry) -> DataFrame:
    """Entities whose number decides which rule they break besides the links that do not resolve."""
    kind = F.col("entity_instance_id") % 9

    def lives(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            "create_count": F.when(kind == 0, 2).otherwise(F.col("create_count")),
            "delete_count": F.when(kind == 1, 2).when(kind == 2, 1).otherwise(F.col("delete_count")),
            "deletion_ms": F.when(kind != 2, F.col("deletion_ms"))})

    creeps = lives(_creeps(t)).withColumns({
        "creation_ms": F.when(kind != 3, F.col("creation_ms")),
        "spawner_handle": F.when(kind == 4, F.lit(fixed.INVALID_HANDLE)).when(kind != 5, F.col("spawner_handle"))})
    return farming.link_violations(lives(farming.spawner_facts(t.instances, t.checkpoints, t.entity_events)), creeps)


@query("extraction_id:s camp_id:i entity_instance_id:i handle_count:i",
       "SELECT *, sequence AS entity_instance_id FROM spawners")
def camp_ids(t: Telemetry) -> DataFrame:
    return _camps(t)


@query("extraction_id:s player_slot:i sequence:i time_ms:i damage:i", "SELECT * FROM farm_damage")
def eligible_camp_damage(t: Telemetry) -> DataFrame:
    return farming.eligible_damage(t.combat, t.players)


@query("extraction_id:s sequence:i hero_x:d hero_y:d", "SELECT * FROM farm_located")
def nearest_hero_positions(t: Telemetry) -> DataFrame:
    return farming.locate_damage(farming.eligible_damage(t.combat, t.players), t.positions)


@query("extraction_id:s player_slot:i sequence:i camp_id:i", "SELECT * FROM assigned", _FARM)
def nearest_camps(t: Telemetry) -> DataFrame:
    return _assigned(t)[0]


@query("extraction_id:s player_slot:i camp_id:i session_number:i session_start:i session_end:i damage_event_count:i "
       "total_damage:i first_sequence:i", "SELECT * FROM sessions", _FARM)
def damage_sessions(t: Telemetry) -> DataFrame:
    return farming.damage_sessions(_assigned(t)[0], GAP_MS)


_ACTION = ("extraction_id:s action_index:i player_slot:i camp_id:i spawner_handle:i camp_type:i camp_world_x:d camp_world_y:d "
           "start_game_time_ms:i end_game_time_ms:i result:s damage_event_count:i total_damage:i initial_creep_count:i "
           "dead_initial_creep_count:i")


@query(_ACTION, "SELECT * FROM actions", _FARM)
def farming_actions(t: Telemetry) -> DataFrame:
    return _actions(t)


@query("extraction_id:s action_index:i problem:s", """
SELECT extraction_id, action_index, ['wrong definition', 'negative identifier', 'position is not finite', 'ends before it starts',
  'unknown result', 'no damage events', 'no damage', 'invalid creep counts', 'cleared with live creeps'][1 + n] AS problem
FROM (SELECT *, (action_index * 7 + player_slot) % 10 AS n FROM actions) WHERE n < 9""", _FARM)
def action_violations(t: Telemetry) -> DataFrame:
    """Actions of which nine in ten break one rule each."""
    kind = (F.col("action_index") * 7 + F.col("player_slot")) % 10

    def broken(name: str, *values: tuple[int, Column]) -> Column:
        column = F.col(name)
        for number, value in values:
            column = F.when(kind == number, value).otherwise(column)
        return column

    actions = _actions(t)
    return farming.action_violations(actions.select("extraction_id", "action_index", "player_slot", *[
        broken(name, *values).alias(name) for name, values in {
            "definition_name": [(0, F.lit("another"))], "camp_id": [(1, F.lit(-1))],
            "camp_world_x": [(2, F.lit(float("nan")))], "camp_world_y": [], "start_game_time_ms": [],
            "end_game_time_ms": [(3, F.col("start_game_time_ms") - 1)],
            "result": [(4, F.lit("unknown")), (7, F.lit("not_cleared")), (8, F.lit("cleared"))],
            "damage_event_count": [(5, F.lit(0))], "total_damage": [(6, F.lit(0))],
            "initial_creep_count": [(7, F.lit(0))], "dead_initial_creep_count": [(7, F.lit(0)), (8, F.lit(0))],
        }.items()]))


@query("match_id:i " + _ACTION, "SELECT m.match_id, a.* FROM actions a JOIN matches m USING (extraction_id)", _FARM)
def match_farming_actions(t: Telemetry) -> DataFrame:
    return farming.match_farming_actions(_actions(t), t.latest)


@query("extraction_id:s action_index:i", """
SELECT a.* FROM actions a JOIN players p ON p.extraction_id = a.extraction_id AND p.player_slot = a.player_slot AND p.team_id = 2
WHERE start_game_time_ms >= 300000 AND end_game_time_ms <= 1500000""", _FARM)
def lens_farming(t: Telemetry) -> DataFrame:
    return lens.Lens(300, 1500, team_id=2).farming(_actions(t), t.players)


@query("extraction_id:s player_slot:i", "SELECT * FROM players WHERE team_id = 3")
def lens_players(t: Telemetry) -> DataFrame:
    return lens.Lens(0, 1, team_id=3).players(t.players)
