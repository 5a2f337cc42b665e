"""The views of ``tables.py`` stated in SQL, for comparison runs."""

from __future__ import annotations

import re

# Fixed values, stated apart from the package's own hero table: names and labels of heroes 1 to 18.
_HERO_SLUGS = (
    "antimage", "axe", "bane", "bloodseeker", "crystal_maiden", "drow_ranger", "earthshaker", "juggernaut",
    "mirana", "morphling", "nevermore", "phantom_lancer", "puck", "pudge", "razor", "sand_king", "storm_spirit",
    "sven",
)
_HERO_LABELS = (
    "Anti-Mage", "Axe", "Bane", "Bloodseeker", "Crystal Maiden", "Drow Ranger", "Earthshaker", "Juggernaut",
    "Mirana", "Morphling", "Shadow Fiend", "Phantom Lancer", "Puck", "Pudge", "Razor", "Sand King", "Storm Spirit",
    "Sven",
)
_SLUGS = ", ".join(f"'{slug}'" for slug in _HERO_SLUGS)
_LABELS = ", ".join(f"'{name}'" for name in _HERO_LABELS)


def _name(slot: str) -> str:
    return f"'npc_dota_hero_' || ([{_SLUGS}])[1 + {slot} % 18]"


VIEWS: dict[str, str] = {}

VIEWS["ev"] = """
SELECT 'x' || (user_id // 19) AS extraction_id, user_id // 19 AS ext, user_id % 19 AS slot, user_id,
  CAST(2 + user_id % 2 AS INTEGER) AS team_id, event_id AS sequence, event_type AS kind,
  CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  (epoch_us(ts) - 1704067200000000) // 1080000 AS t_ms,
  (CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) * 120.0::DOUBLE AS px,
  (event_id * 37 % 100 - 50) * 120.0::DOUBLE AS py
FROM events"""

VIEWS["combat_base"] = """
SELECT *, (slot + 1 + k) % 19 AS other,
  CASE WHEN kind IN ('purchase', 'click') THEN (slot + 1 + k) % 19 ELSE slot END AS hit,
  CASE WHEN kind = 'error' THEN (slot + 1 + k) % 19 ELSE slot END AS actor,
  kind = 'signup' AND k < 12 AS marker, kind = 'click' AND k % 4 = 0 AS neutral,
  kind = 'error' AND k BETWEEN 90 AND 94 AS objective
FROM ev"""

VIEWS["combat"] = f"""
SELECT extraction_id, sequence, t_ms / 1000.0::DOUBLE AS game_time, t_ms / 1000.0::DOUBLE + 10 AS raw_time,
  CASE WHEN kind = 'error' THEN 'DOTA_COMBATLOG_DEATH' WHEN kind IN ('purchase', 'click') THEN 'DOTA_COMBATLOG_DAMAGE'
    WHEN kind = 'view' THEN 'DOTA_COMBATLOG_HEAL' WHEN marker THEN 'DOTA_COMBATLOG_GAME_STATE'
    ELSE 'DOTA_COMBATLOG_XP' END AS event_type,
  CASE WHEN neutral THEN 'npc_dota_neutral_kobold'
    WHEN objective THEN (['npc_dota_roshan', 'npc_dota_miniboss', 'npc_dota_badguys_tower1_mid',
      'npc_dota_goodguys_melee_rax_bot', 'npc_dota_badguys_tower2_top'])[k - 89]
    ELSE {_name('hit')} END AS target_name,
  CASE WHEN k % 5 = 0 THEN 'npc_dota_summon' ELSE {_name('actor')} END AS attacker_name,
  CASE WHEN k % 3 = 1 THEN {_name('actor')} WHEN k % 3 = 2 THEN 'npc_dota_unit_' || (k % 7) END AS damage_source_name,
  CASE k % 4 WHEN 1 THEN 'dota_fire_blast' WHEN 2 THEN 'item_dagon' WHEN 3 THEN '' END AS inflictor_name,
  CASE WHEN neutral THEN 4 ELSE 2 + (ext * 19 + hit) % 2 END AS target_team,
  2 + (ext * 19 + actor) % 2 AS attacker_team,
  CASE WHEN marker THEN CASE WHEN t_ms < 600000 THEN 4 WHEN t_ms < 1500000 THEN 5 ELSE 6 END
    WHEN k <> 99 THEN cents // 10 END AS value,
  CASE WHEN k % 4 <> 0 THEN px END AS location_x, CASE WHEN k % 4 <> 0 THEN py END AS location_y,
  CASE WHEN k % 2 = 0 THEN [(slot + 3) % 19, (slot + 5 + k % 4) % 19] END AS assist_players,
  NOT (neutral OR objective) AS target_hero, CASE WHEN objective THEN k IN (92, 93) END AS target_building,
  CASE WHEN k % 13 = 0 THEN true WHEN k % 13 = 1 THEN NULL ELSE false END AS attacker_illusion,
  CASE WHEN k % 17 = 0 THEN true WHEN k % 17 = 1 THEN NULL ELSE false END AS target_illusion,
  CASE WHEN k % 6 = 0 THEN {_name('hit')} WHEN k % 6 = 1 THEN 'npc_dota_owner' END AS target_source_name
FROM combat_base"""

VIEWS["players"] = """
SELECT extraction_id, ext, slot AS player_slot, team_id, CASE team_id WHEN 2 THEN 'Radiant' ELSE 'Dire' END AS team,
  slot // 2 AS team_slot, 1 + slot % 18 AS hero_id, sum(cents) // 40 AS gold_per_min,
  count(*) FILTER (WHERE kind = 'error') * 10 AS xp_per_min,
  count(*) FILTER (WHERE kind = 'error') AS kills, count(*) FILTER (WHERE kind = 'purchase') AS deaths,
  count(*) FILTER (WHERE kind = 'view') AS assists, count(*) FILTER (WHERE kind = 'click') AS last_hits,
  count(*) FILTER (WHERE kind = 'signup') AS denies, sum(cents) AS net_worth, max(cents) AS hero_damage,
  min(cents) AS tower_damage, sum(k) AS hero_healing
FROM ev GROUP BY extraction_id, ext, slot, team_id"""

VIEWS["candidates"] = """
SELECT extraction_id, CASE WHEN player_slot = 11 AND ext % 3 = 0 THEN 3 ELSE player_slot END AS game_player_id,
  player_slot, team_id FROM players"""

VIEWS["metadata"] = """
SELECT c.* FROM candidates c
WHERE game_player_id BETWEEN 0 AND 9
  AND (SELECT count(*) FROM candidates d WHERE d.extraction_id = c.extraction_id AND d.game_player_id = c.game_player_id) = 1"""

VIEWS["matches"] = """
SELECT extraction_id, ext + 1 AS match_id, max(t_ms) // 1000 AS duration_seconds, 2 + ext % 2 AS winner_team_id
FROM ev GROUP BY extraction_id, ext"""

VIEWS["gold"] = """
SELECT extraction_id, sequence, slot AS player_slot, team_id, (t_ms - 60000) / 1000.0::DOUBLE AS game_time_seconds,
  CAST(sum(cents) OVER (PARTITION BY extraction_id, slot ORDER BY t_ms, sequence
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_gold_earned
FROM ev"""

VIEWS["positions"] = """
SELECT extraction_id, max(sequence) AS sequence, t_ms // 100 * 100 AS game_time_milliseconds, slot AS player_slot,
  1 + slot % 18 AS hero_id, team_id, arg_max(px, sequence) AS world_x, arg_max(py, sequence) AS world_y
FROM ev GROUP BY extraction_id, slot, team_id, t_ms // 100 * 100"""

VIEWS["team_series"] = """
SELECT extraction_id, team_id, t_ms // 60000 AS sample_index,
  CASE WHEN (t_ms // 60000) % 7 <> 3 THEN CAST(sum(cents) AS DOUBLE) END AS net_worth,
  CAST(count(*) AS DOUBLE) AS gold_earned, CAST(sum(k) AS DOUBLE) AS experience
FROM ev GROUP BY extraction_id, team_id, t_ms // 60000"""

VIEWS["probability"] = """
SELECT extraction_id, max(sequence) AS sample_index, t_ms / 1000.0::DOUBLE AS game_time_seconds,
  arg_max(k, sequence) / 100.0::DOUBLE AS radiant_probability,
  CASE WHEN t_ms < 1200000 THEN 'graph_history' ELSE 'spectator_updates' END AS source
FROM ev WHERE kind = 'view' GROUP BY extraction_id, t_ms"""

VIEWS["bounds"] = """
SELECT s.extraction_id, s.start_sequence, (
    SELECT min(c.sequence) FROM combat c WHERE c.extraction_id = s.extraction_id
      AND c.event_type = 'DOTA_COMBATLOG_GAME_STATE' AND c.value = 6 AND c.sequence > s.start_sequence) AS stop_sequence
FROM (SELECT extraction_id, min(sequence) AS start_sequence FROM combat
      WHERE event_type = 'DOTA_COMBATLOG_GAME_STATE' AND value = 4 GROUP BY extraction_id) s"""

VIEWS["clock"] = """
SELECT b.extraction_id, b.start_sequence, b.stop_sequence, coalesce(
    min(c.game_time) FILTER (WHERE c.value = 5), min(c.game_time) FILTER (WHERE c.value = 4), 0) AS zero_time
FROM bounds b JOIN combat c ON c.extraction_id = b.extraction_id AND c.event_type = 'DOTA_COMBATLOG_GAME_STATE'
  AND c.sequence >= b.start_sequence AND c.sequence < b.stop_sequence
GROUP BY ALL"""

VIEWS["game"] = """
SELECT c.* FROM combat c JOIN bounds b ON c.extraction_id = b.extraction_id
  AND c.sequence >= b.start_sequence AND c.sequence < b.stop_sequence"""

VIEWS["roster"] = f"""
SELECT extraction_id, player_slot, team_id, hero_id, {_name('player_slot')} AS name FROM players"""

VIEWS["unique_names"] = """
SELECT extraction_id, name, min(player_slot) AS slot, min(team_id) AS team FROM roster
GROUP BY extraction_id, name HAVING count(*) = 1"""

VIEWS["fe"] = """
SELECT e.extraction_id, e.sequence, e.event_type, e.game_time - c.zero_time AS t, e.target_name, e.attacker_name,
  e.damage_source_name, e.target_team, coalesce(e.target_illusion, false) AS illusion,
  coalesce(e.target_building, false) AS building, e.value, e.location_x AS x, e.location_y AS y, e.assist_players,
  tn.slot AS target_slot, tn.team AS hit_team, coalesce(sn.slot, an.slot) AS source_slot,
  coalesce(sn.team, an.team) AS source_team
FROM game e JOIN clock c USING (extraction_id)
LEFT JOIN unique_names tn ON tn.extraction_id = e.extraction_id AND tn.name = e.target_name
LEFT JOIN unique_names sn ON sn.extraction_id = e.extraction_id AND sn.name = e.damage_source_name
LEFT JOIN unique_names an ON an.extraction_id = e.extraction_id AND an.name = e.attacker_name
WHERE e.event_type <> 'DOTA_COMBATLOG_GAME_STATE'"""

VIEWS["death_base"] = """
SELECT extraction_id, sequence, t, target_slot AS victim_slot, hit_team AS victim_team,
  CASE WHEN source_team = 5 - hit_team THEN source_slot END AS killer_slot, assist_players, x, y
FROM fe WHERE event_type = 'DOTA_COMBATLOG_DEATH' AND NOT illusion AND hit_team = target_team AND target_team IN (2, 3)"""

VIEWS["assists"] = """
SELECT DISTINCT d.extraction_id, d.sequence, m.player_slot AS slot
FROM (SELECT extraction_id, sequence, victim_team, killer_slot, unnest(assist_players) AS gp FROM death_base) d
JOIN metadata m ON m.extraction_id = d.extraction_id AND m.game_player_id = d.gp AND m.team_id = 5 - d.victim_team
WHERE m.player_slot IS DISTINCT FROM d.killer_slot"""

VIEWS["deaths"] = """
SELECT d.extraction_id, d.sequence, d.t, d.victim_slot, d.victim_team, d.killer_slot,
  coalesce(d.x, p.world_x) AS x, coalesce(d.y, p.world_y) AS y
FROM death_base d
LEFT JOIN positions p ON p.extraction_id = d.extraction_id AND p.player_slot = d.victim_slot AND d.x IS NULL
  AND d.t >= 0 AND p.game_time_milliseconds = (
    SELECT max(q.game_time_milliseconds) FROM positions q WHERE q.extraction_id = d.extraction_id
      AND q.player_slot = d.victim_slot AND q.game_time_milliseconds <= floor(d.t * 10) * 100)
WHERE d.killer_slot IS NOT NULL
  OR EXISTS (SELECT 1 FROM assists a WHERE a.extraction_id = d.extraction_id AND a.sequence = d.sequence)"""

VIEWS["active"] = """
SELECT extraction_id, sequence, victim_slot AS slot FROM deaths
UNION SELECT extraction_id, sequence, killer_slot FROM deaths WHERE killer_slot IS NOT NULL
UNION SELECT a.extraction_id, a.sequence, a.slot FROM assists a JOIN deaths d USING (extraction_id, sequence)"""

VIEWS["links"] = """
SELECT a.extraction_id, a.sequence AS s, b.sequence AS r
FROM deaths a JOIN deaths b ON a.extraction_id = b.extraction_id AND abs(a.t - b.t) <= 20 AND a.sequence <> b.sequence
WHERE CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2500.0 ** 2
  ELSE EXISTS (SELECT 1 FROM active i JOIN active j ON i.extraction_id = j.extraction_id AND i.slot = j.slot
    WHERE i.extraction_id = a.extraction_id AND i.sequence = a.sequence AND j.sequence = b.sequence) END"""

VIEWS["reach"] = """
SELECT extraction_id, sequence AS s, sequence AS r FROM deaths
UNION
SELECT reach.extraction_id, reach.s, links.r FROM reach JOIN links
  ON links.extraction_id = reach.extraction_id AND links.s = reach.r"""

VIEWS["anchors"] = """
SELECT d.*, f.fight_id FROM deaths d JOIN (
  SELECT r.extraction_id, r.s AS sequence, arg_min(o.sequence, (o.t, o.sequence)) AS fight_id
  FROM reach r JOIN deaths o ON o.extraction_id = r.extraction_id AND o.sequence = r.r
  GROUP BY r.extraction_id, r.s) f USING (extraction_id, sequence)"""

VIEWS["participants"] = """
SELECT q.extraction_id, q.fight_id, q.slot AS player_slot, r.team_id, r.hero_id, r.name,
  count(*) FILTER (WHERE role = 'kill') AS kills, count(*) FILTER (WHERE role = 'death') AS deaths,
  count(*) FILTER (WHERE role = 'assist') AS assists
FROM (SELECT extraction_id, fight_id, victim_slot AS slot, 'death' AS role FROM anchors
  UNION ALL SELECT extraction_id, fight_id, killer_slot, 'kill' FROM anchors WHERE killer_slot IS NOT NULL
  UNION ALL SELECT a.extraction_id, n.fight_id, a.slot, 'assist' FROM assists a JOIN anchors n USING (extraction_id, sequence)) q
JOIN roster r ON r.extraction_id = q.extraction_id AND r.player_slot = q.slot
GROUP BY ALL"""

VIEWS["groups"] = """
SELECT a.extraction_id, a.fight_id, min(a.t) AS first_death, max(a.t) AS last_death, count(*) AS death_count,
  any_value(p.radiant) AS radiant, any_value(p.dire) AS dire,
  any_value(CASE WHEN p.radiant >= 3 AND p.dire >= 3 THEN 'team_fight'
    WHEN p.radiant = 1 OR p.dire = 1 THEN 'pickoff' ELSE 'skirmish' END) AS fight_type
FROM anchors a JOIN (SELECT extraction_id, fight_id, count(*) FILTER (WHERE team_id = 2) AS radiant,
    count(*) FILTER (WHERE team_id = 3) AS dire FROM participants GROUP BY ALL) p USING (extraction_id, fight_id)
WHERE p.radiant > 0 AND p.dire > 0
GROUP BY a.extraction_id, a.fight_id"""

VIEWS["relevant"] = """
SELECT g.extraction_id, g.fight_id, g.first_death, g.last_death, e.sequence, e.t, e.x, e.y
FROM groups g JOIN fe e ON e.extraction_id = g.extraction_id AND e.event_type = 'DOTA_COMBATLOG_DAMAGE' AND NOT e.illusion
  AND e.target_slot <> e.source_slot AND e.hit_team <> e.source_team
JOIN participants a ON a.extraction_id = g.extraction_id AND a.fight_id = g.fight_id AND a.player_slot = e.target_slot
JOIN participants b ON b.extraction_id = g.extraction_id AND b.fight_id = g.fight_id AND b.player_slot = e.source_slot"""

VIEWS["walked"] = """
SELECT extraction_id, fight_id, side, min(t) AS low, max(t) AS high FROM (
  SELECT *, sum(CASE WHEN pause > 10 THEN 1 ELSE 0 END) OVER (
      PARTITION BY extraction_id, fight_id, side ORDER BY away, sequence ROWS UNBOUNDED PRECEDING) AS breaks
  FROM (SELECT *, away - coalesce(lag(away) OVER (PARTITION BY extraction_id, fight_id, side ORDER BY away, sequence), 0) AS pause
    FROM (SELECT extraction_id, fight_id, sequence, t, 'start' AS side, first_death - t AS away FROM relevant
          WHERE t BETWEEN first_death - 60 AND first_death
          UNION ALL SELECT extraction_id, fight_id, sequence, t, 'end', t - last_death FROM relevant
          WHERE t BETWEEN last_death AND last_death + 20)))
WHERE breaks = 0 GROUP BY ALL"""

VIEWS["intervals"] = """
SELECT g.*, coalesce(s.low, g.first_death) AS combat_start, coalesce(e.high, g.last_death) AS combat_end
FROM groups g LEFT JOIN walked s ON s.extraction_id = g.extraction_id AND s.fight_id = g.fight_id AND s.side = 'start'
LEFT JOIN walked e ON e.extraction_id = g.extraction_id AND e.fight_id = g.fight_id AND e.side = 'end'"""

VIEWS["points"] = """
SELECT extraction_id, fight_id, 0 AS rank, t, sequence, x, y FROM anchors WHERE x IS NOT NULL
UNION ALL
SELECT r.extraction_id, r.fight_id, 1, r.t, r.sequence, r.x, r.y
FROM relevant r JOIN intervals i USING (extraction_id, fight_id)
WHERE r.x IS NOT NULL AND r.t BETWEEN i.combat_start AND i.combat_end AND (
  EXISTS (SELECT 1 FROM anchors a WHERE a.extraction_id = r.extraction_id AND a.fight_id = r.fight_id AND a.x IS NOT NULL
    AND (a.x - r.x) ** 2 + (a.y - r.y) ** 2 <= 3500.0 ** 2)
  OR NOT EXISTS (SELECT 1 FROM anchors a WHERE a.extraction_id = r.extraction_id AND a.fight_id = r.fight_id AND a.x IS NOT NULL))"""

VIEWS["seeds"] = """
SELECT extraction_id, fight_id, arg_max((x, y), (near, -spread, -rank, -t, -sequence)) AS seed FROM (
  SELECT p.extraction_id, p.fight_id, p.rank, p.t, p.sequence, p.x, p.y, count(*) AS near,
    sum((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS spread
  FROM points p JOIN points q ON p.extraction_id = q.extraction_id AND p.fight_id = q.fight_id
    AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 3500.0 ** 2
  GROUP BY ALL)
GROUP BY extraction_id, fight_id"""

VIEWS["local_points"] = """
SELECT p.* FROM points p JOIN seeds s USING (extraction_id, fight_id)
WHERE (p.x - s.seed[1]) ** 2 + (p.y - s.seed[2]) ** 2 <= 3500.0 ** 2"""


def _axis(axis: str) -> str:
    low, high = f"min({axis})", f"max({axis})"
    return (f"median({axis}) AS center_{axis}, {low} AS low_{axis}, {high} AS high_{axis}, "
            f"least(6500.0, greatest(2400.0, {high} - {low} + 1600)) AS size_{axis}")


def _view(axis: str) -> str:
    centered = f"center_{axis} - size_{axis} / 2"
    lowest, highest = f"high_{axis} + 800 - size_{axis}", f"low_{axis} - 800"
    fitted = f"CASE WHEN {lowest} <= {highest} THEN least({highest}, greatest({lowest}, {centered})) ELSE {centered} END"
    minimum = f"least(8288 - size_{axis}, greatest(-8288, {fitted}))"
    return f"{minimum} AS minimum_{axis}, {minimum} + size_{axis} AS maximum_{axis}"


VIEWS["map_views"] = f"""
SELECT extraction_id, fight_id, center_x, center_y, {_view('x')}, {_view('y')} FROM (
  SELECT extraction_id, fight_id, {_axis('x')}, {_axis('y')} FROM local_points GROUP BY ALL)"""

VIEWS["fights"] = """
SELECT i.*, v.center_x, v.center_y, coalesce((
    SELECT greatest(i.combat_end, least(i.combat_end + 30, arg_min(n.combat_start, (n.first_death, n.fight_id))))
    FROM intervals n JOIN map_views w ON w.extraction_id = n.extraction_id AND w.fight_id = n.fight_id
    WHERE n.extraction_id = i.extraction_id AND (n.first_death, n.fight_id) > (i.first_death, i.fight_id)
      AND sqrt((w.center_x - v.center_x) ** 2 + (w.center_y - v.center_y) ** 2) <= 3500
    HAVING count(*) > 0), i.combat_end + 30) AS outcome_end
FROM intervals i LEFT JOIN map_views v USING (extraction_id, fight_id)"""

VIEWS["fight_names"] = """
SELECT extraction_id, fight_id, name, min(player_slot) AS slot, min(team_id) AS team FROM participants
GROUP BY ALL HAVING count(*) = 1"""

VIEWS["metric_events"] = """
SELECT i.extraction_id, i.fight_id, e.event_type, e.value, e.illusion, t.slot AS hit_slot, t.team AS hit_side,
  coalesce(s.slot, a.slot) AS actor_slot, coalesce(s.team, a.team) AS actor_side
FROM intervals i JOIN fe e ON e.extraction_id = i.extraction_id AND e.t BETWEEN i.combat_start AND i.combat_end AND e.value > 0
LEFT JOIN fight_names t ON t.extraction_id = i.extraction_id AND t.fight_id = i.fight_id AND t.name = e.target_name
LEFT JOIN fight_names s ON s.extraction_id = i.extraction_id AND s.fight_id = i.fight_id AND s.name = e.damage_source_name
LEFT JOIN fight_names a ON a.extraction_id = i.extraction_id AND a.fight_id = i.fight_id AND a.name = e.attacker_name"""

VIEWS["shares"] = """
SELECT extraction_id, fight_id, actor_slot AS player_slot, value, 'dealt' AS metric FROM metric_events
WHERE event_type = 'DOTA_COMBATLOG_DAMAGE' AND NOT illusion AND hit_side <> actor_side AND hit_slot <> actor_slot
UNION ALL SELECT extraction_id, fight_id, hit_slot, value, 'taken' FROM metric_events
WHERE event_type = 'DOTA_COMBATLOG_DAMAGE' AND NOT illusion AND hit_side <> actor_side AND hit_slot <> actor_slot
UNION ALL SELECT extraction_id, fight_id, actor_slot, value, 'healing' FROM metric_events
WHERE event_type = 'DOTA_COMBATLOG_HEAL' AND actor_slot IS NOT NULL
UNION ALL SELECT extraction_id, fight_id, hit_slot, value, 'experience' FROM metric_events
WHERE event_type = 'DOTA_COMBATLOG_XP' AND hit_slot IS NOT NULL"""

VIEWS["player_metrics"] = """
SELECT p.extraction_id, p.fight_id, p.player_slot, p.team_id, p.hero_id, p.kills, p.deaths, p.assists,
  CAST(coalesce(sum(value) FILTER (WHERE metric = 'dealt'), 0) AS BIGINT) AS damage_dealt,
  CAST(coalesce(sum(value) FILTER (WHERE metric = 'taken'), 0) AS BIGINT) AS damage_taken,
  CAST(coalesce(sum(value) FILTER (WHERE metric = 'healing'), 0) AS BIGINT) AS healing,
  CAST(coalesce(sum(value) FILTER (WHERE metric = 'experience'), 0) AS BIGINT) AS experience
FROM participants p JOIN groups g USING (extraction_id, fight_id)
LEFT JOIN shares s ON s.extraction_id = p.extraction_id AND s.fight_id = p.fight_id AND s.player_slot = p.player_slot
GROUP BY ALL"""


def _gold_at(moment: str) -> str:
    return f"""(SELECT arg_max(g.total_gold_earned, (g.game_time_seconds, g.sequence)) FROM gold g
      WHERE g.extraction_id = p.extraction_id AND g.player_slot = p.player_slot AND g.game_time_seconds <= i.{moment})"""


VIEWS["player_results"] = f"""
SELECT p.extraction_id, p.fight_id, p.player_slot, p.team_id, p.hero_id, p.kills, p.deaths, p.assists, p.damage_dealt,
  p.damage_taken, p.healing, {_gold_at('combat_end')} - {_gold_at('combat_start')} AS earned_gold_change,
  CASE WHEN EXISTS (SELECT 1 FROM fe WHERE fe.extraction_id = p.extraction_id AND fe.event_type = 'DOTA_COMBATLOG_XP')
    THEN p.experience END AS experience_change
FROM player_metrics p JOIN intervals i USING (extraction_id, fight_id)"""


def _worth_at(moment: str) -> str:
    return f"""(SELECT arg_max(s.net_worth, s.sample_index) FROM team_series s WHERE s.extraction_id = i.extraction_id
      AND s.team_id = d.team_id AND s.net_worth IS NOT NULL AND s.sample_index <= greatest(0, floor(i.{moment} / 60)))"""


VIEWS["team_results"] = f"""
SELECT i.extraction_id, i.fight_id, d.team_id, count(p.player_slot) AS participants,
  CAST(coalesce(sum(p.deaths), 0) AS BIGINT) AS deaths,
  CAST(i.death_count - coalesce(sum(p.deaths), 0) AS BIGINT) AS kills,
  CAST(coalesce(sum(p.damage_dealt), 0) AS BIGINT) AS hero_damage,
  CAST(coalesce(sum(p.healing), 0) AS BIGINT) AS hero_healing,
  CASE WHEN count(p.player_slot) = count(p.earned_gold_change) THEN CAST(sum(p.earned_gold_change) AS BIGINT) END AS earned_gold_change,
  CASE WHEN count(p.player_slot) = count(p.experience_change) THEN CAST(sum(p.experience_change) AS BIGINT) END AS experience_change,
  CAST(floor(any_value({_worth_at('combat_end')} - {_worth_at('combat_start')}) + 0.5) AS BIGINT) AS net_worth_change
FROM intervals i CROSS JOIN (SELECT unnest([2, 3]) AS team_id) d
LEFT JOIN player_results p ON p.extraction_id = i.extraction_id AND p.fight_id = i.fight_id AND p.team_id = d.team_id
GROUP BY i.extraction_id, i.fight_id, d.team_id, i.death_count"""


def _chance_at(moment: str, field: str) -> str:
    return f"""(SELECT arg_max(w.{field}, w.game_time_seconds) FROM probability w
      WHERE w.extraction_id = i.extraction_id AND w.game_time_seconds <= i.{moment})"""


VIEWS["probability_changes"] = f"""
SELECT extraction_id, fight_id, CASE WHEN s0 = s1 THEN p1 - p0 END AS radiant_win_probability_change,
  CASE WHEN s0 = s1 THEN s1 END AS win_probability_source
FROM (SELECT i.extraction_id, i.fight_id, {_chance_at('combat_start', 'radiant_probability')} AS p0,
    {_chance_at('combat_end', 'radiant_probability')} AS p1, {_chance_at('combat_start', 'source')} AS s0,
    {_chance_at('combat_end', 'source')} AS s1 FROM intervals i)"""

VIEWS["objectives"] = """
SELECT f.extraction_id, f.fight_id, e.sequence, e.t, e.kind,
  upper(e.kind[1]) || e.kind[2:] AS label, CASE WHEN e.target_team IN (2, 3) THEN e.target_team END AS team_id
FROM fights f JOIN (SELECT *, CASE WHEN target_name LIKE '%roshan%' THEN 'roshan'
    WHEN target_name LIKE '%miniboss%' OR target_name LIKE '%tormentor%' THEN 'tormentor'
    WHEN building AND (target_name LIKE '%rax%' OR target_name LIKE '%barracks%') THEN 'barracks'
    WHEN building AND target_name LIKE '%tower%' THEN 'tower' END AS kind
  FROM fe WHERE event_type = 'DOTA_COMBATLOG_DEATH' AND NOT illusion) e
  ON e.extraction_id = f.extraction_id AND e.kind IS NOT NULL AND e.t BETWEEN f.combat_start AND f.outcome_end"""

VIEWS["frame_positions"] = """
SELECT i.extraction_id, i.fight_id, p.game_time_milliseconds, p.player_slot, p.team_id, p.hero_id, p.world_x, p.world_y
FROM intervals i JOIN participants a USING (extraction_id, fight_id)
JOIN positions p ON p.extraction_id = i.extraction_id AND p.player_slot = a.player_slot
  AND p.game_time_milliseconds BETWEEN greatest(0, ceil(i.combat_start * 10) * 100) AND greatest(0, floor(i.combat_end * 10) * 100)
WHERE greatest(0, ceil(i.combat_start * 10) * 100) <= greatest(0, floor(i.combat_end * 10) * 100)"""

# --- farming --------------------------------------------------------------------------------

VIEWS["spawners"] = """
SELECT *, 1000 + k AS handle, k % 4 AS camp_type,
  CASE WHEN k = 12 THEN -9007199254740991 ELSE t_ms END AS creation_ms, CASE WHEN k = 13 THEN t_ms + 600000 END AS deletion_ms,
  row_number() OVER (PARTITION BY extraction_id ORDER BY py, px, 1000 + k, sequence) - 1 AS camp_id,
  count(*) OVER (PARTITION BY extraction_id, k) AS handle_count
FROM (SELECT * FROM ev WHERE kind = 'signup' AND k BETWEEN 12 AND 17
  QUALIFY k = 17 OR row_number() OVER (PARTITION BY extraction_id, k ORDER BY sequence) = 1)"""

VIEWS["creeps"] = """
SELECT extraction_id, sequence AS entity_instance_id, 1012 + k % 6 AS spawner_handle,
  CASE WHEN k % 11 = 0 THEN 3 ELSE 4 END AS team_number, t_ms AS creation_ms,
  CASE WHEN k % 5 = 0 THEN t_ms + 120000 END AS deletion_ms,
  CASE WHEN k % 3 <> 0 THEN t_ms + 1000 * (20 + k * 7 % 90) END AS death_ms
FROM ev WHERE kind = 'view'"""

VIEWS["camp_creeps"] = """
SELECT s.camp_id, c.* FROM creeps c JOIN spawners s ON s.extraction_id = c.extraction_id AND s.handle = c.spawner_handle
WHERE s.handle_count = 1 AND c.team_number = 4"""

VIEWS["farm_damage"] = """
SELECT c.extraction_id, u.slot AS player_slot, c.sequence, CAST(floor(c.game_time * 1000 + 0.5) AS BIGINT) AS time_ms,
  c.value AS damage
FROM combat c JOIN unique_names u ON u.extraction_id = c.extraction_id AND u.name = c.attacker_name
WHERE c.event_type = 'DOTA_COMBATLOG_DAMAGE' AND c.value > 0 AND c.target_team = 4
  AND starts_with(c.target_name, 'npc_dota_neutral_') AND c.attacker_illusion = false"""

VIEWS["farm_located"] = """
SELECT d.*, p.world_x AS hero_x, p.world_y AS hero_y FROM farm_damage d JOIN positions p
  ON p.extraction_id = d.extraction_id AND p.player_slot = d.player_slot
  AND abs(p.game_time_milliseconds - d.time_ms) <= 250
QUALIFY row_number() OVER (PARTITION BY d.extraction_id, d.sequence
  ORDER BY abs(p.game_time_milliseconds - d.time_ms), p.game_time_milliseconds) = 1"""


def assigned_view(radius: int) -> str:
    return f"""
SELECT d.extraction_id, d.player_slot, d.sequence, d.time_ms, d.damage, s.camp_id
FROM farm_located d JOIN spawners s ON s.extraction_id = d.extraction_id
  AND (s.px - d.hero_x) ** 2 + (s.py - d.hero_y) ** 2 <= {radius}.0 ** 2
  AND s.creation_ms <= d.time_ms AND (s.deletion_ms IS NULL OR s.deletion_ms > d.time_ms)
WHERE EXISTS (SELECT 1 FROM camp_creeps c WHERE c.extraction_id = d.extraction_id AND c.camp_id = s.camp_id
  AND c.creation_ms <= d.time_ms AND (c.deletion_ms IS NULL OR c.deletion_ms > d.time_ms)
  AND (c.death_ms IS NULL OR c.death_ms >= d.time_ms))
QUALIFY row_number() OVER (PARTITION BY d.extraction_id, d.sequence
  ORDER BY (s.px - d.hero_x) ** 2 + (s.py - d.hero_y) ** 2, s.camp_id) = 1"""


def sessions_view(gap_ms: int) -> str:
    return f"""
SELECT extraction_id, player_slot, camp_id, n AS session_number, min(time_ms) AS session_start, max(time_ms) AS session_end,
  count(*) AS damage_event_count, CAST(sum(damage) AS BIGINT) AS total_damage,
  arg_min(sequence, (time_ms, sequence)) AS first_sequence
FROM (SELECT *, sum(fresh) OVER (PARTITION BY extraction_id, player_slot, camp_id ORDER BY time_ms, sequence
    ROWS UNBOUNDED PRECEDING) - 1 AS n
  FROM (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER (PARTITION BY extraction_id, player_slot, camp_id
      ORDER BY time_ms, sequence) <= {gap_ms} THEN 0 ELSE 1 END AS fresh FROM assigned))
GROUP BY ALL"""


def actions_view(gap_ms: int) -> str:
    return f"""
SELECT extraction_id, row_number() OVER (PARTITION BY extraction_id
    ORDER BY session_start, player_slot, camp_id, first_sequence) - 1 AS action_index,
  player_slot, camp_id, handle AS spawner_handle, camp_type, px AS camp_world_x, py AS camp_world_y,
  session_start AS start_game_time_ms, CASE WHEN cleared THEN last_death ELSE session_end END AS end_game_time_ms,
  CASE WHEN cleared THEN 'cleared' ELSE 'not_cleared' END AS result, damage_event_count, total_damage,
  initial_creep_count, dead_initial_creep_count
FROM (SELECT *, initial_creep_count > 0 AND dead_initial_creep_count = initial_creep_count
    AND last_death <= session_end + {gap_ms} AS cleared FROM fates)"""


VIEWS["fates"] = """
SELECT s.*, a.handle, a.camp_type, a.px, a.py, f.initial_creep_count, f.dead_initial_creep_count, f.last_death
FROM sessions s JOIN spawners a ON a.extraction_id = s.extraction_id AND a.camp_id = s.camp_id
JOIN (SELECT s.extraction_id, s.player_slot, s.camp_id, s.session_number, count(c.camp_id) AS initial_creep_count,
    count(c.death_ms) AS dead_initial_creep_count, max(c.death_ms) AS last_death
  FROM sessions s LEFT JOIN camp_creeps c ON c.extraction_id = s.extraction_id AND c.camp_id = s.camp_id
    AND c.creation_ms <= s.session_start AND (c.deletion_ms IS NULL OR c.deletion_ms > s.session_start)
    AND (c.death_ms IS NULL OR c.death_ms >= s.session_start)
  GROUP BY ALL) f ON f.extraction_id = s.extraction_id AND f.player_slot = s.player_slot AND f.camp_id = s.camp_id
  AND f.session_number = s.session_number"""

RECURSIVE = {"reach"}


def compose(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` preceded by the views it needs, in dependency order."""
    available = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in available:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", available[name]):
                visit(other)
        ordered.append(name)

    for name in available:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", select):
            visit(name)
    if not ordered:
        return select
    parts = [f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({available[name]}\n)" for name in ordered]
    recursive = "RECURSIVE " if any(name in RECURSIVE for name in ordered) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select
