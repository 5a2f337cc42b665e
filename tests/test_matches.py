"""Operators on literal match rows with boundary values."""

import pytest
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.operators import damage, documents, farming, fights, lens, quality, series, versions
from arenaflow.schemas import table_schema
from arenaflow.session import cut_lineage


def combat(spark, *events):
    """Combat rows from dictionaries; absent columns are NULL."""
    schema = table_schema("combatEvents")
    return spark.createDataFrame(
        [tuple({"extraction_id": "m1", **event}.get(name) for name in schema.fieldNames()) for event in events], schema)


def state(sequence, time, value, **more):
    return {"sequence": sequence, "game_time": float(time), "event_type": fixed.GAME_STATE, "value": value, **more}


def event(kind, sequence, time, target=None, source=None, team=None, **more):
    def hero(name):
        return None if name is None else f"npc_dota_hero_{name}"

    return {"sequence": sequence, "game_time": float(time), "event_type": kind, "target_name": hero(target),
            "attacker_name": hero(source), "damage_source_name": hero(source), "target_team": team,
            "target_illusion": False, **more}


EXTRACTIONS = "extraction_id STRING, match_id BIGINT, status STRING, started_at STRING, completed_at STRING"


def test_latest_success_outranks_failures_and_unknown_completion(spark):
    frame = spark.createDataFrame([
        ("old", 7, "succeeded", "2026-01-01", "2026-01-02"), ("new", 7, "succeeded", "2026-01-03", "2026-01-04"),
        ("failed", 7, "failed", "2026-01-05", "2026-01-06"), ("open", 7, "succeeded", "2026-01-09", None),
        ("b", 8, "succeeded", "2026-01-01", None), ("a", 8, "succeeded", "2026-01-01", None)], EXTRACTIONS)
    assert {row.match_id: row.extraction_id for row in versions.latest_successful(frame).collect()} == {7: "new", 8: "b"}


def test_bounds_are_half_open_by_sequence(spark):
    log = combat(
        spark, state(15, -100, 6), event(fixed.DAMAGE, 19, -90), state(20, -90, 4), event(fixed.DAMAGE, 21, -90),
        state(22, -80, 4), event(fixed.DAMAGE, 39, 120), state(40, 120, 6), event(fixed.DAMAGE, 41, 120), state(45, 130, 6))
    bounds = versions.game_bounds(log)
    kept = versions.actual_game(log, bounds).select("sequence").collect()
    assert sorted(row.sequence for row in kept) == [20, 21, 22, 39]
    flags = versions.marker_availability(log).first()
    assert flags.has_ordered_markers and flags.has_combat


def test_stop_before_start_differs_between_availabilities(spark):
    log = combat(spark, state(1, 0, 6), state(2, 1, 4), event(fixed.DAMAGE, 3, 2))
    bounds = versions.game_bounds(log)
    assert versions.actual_game(log, bounds).count() == 0
    flags = versions.marker_availability(log).first()
    assert not flags.has_ordered_markers and flags.has_combat
    answers = versions.is_actual_game(log.select("extraction_id", "sequence"), bounds)
    assert not any(row.is_actual_game for row in answers.collect())


def test_clock_zero_falls_back(spark):
    def zero(*events):
        log = combat(spark, *events)
        return [row.zero_time for row in versions.game_clock(log, versions.game_bounds(log)).collect()]

    assert zero(state(1, 90, 4), state(2, 100, 5), state(3, 300, 6)) == [100.0]
    assert zero(state(1, 90, 4), state(3, 300, 6)) == [90.0]
    assert zero(state(1, 90, 4)) == []


def roster(spark, extraction="m1"):
    slots = [0, 1, 2, 3, 4, 128, 129, 130, 131, 132]
    return [(extraction, slot, 2 if slot < 5 else 3) for slot in slots]


def test_rolling_gpm_needs_both_ends_and_whole_teams(spark):
    players = spark.createDataFrame(roster(spark), "extraction_id STRING, player_slot BIGINT, team_id INT")
    matches = spark.createDataFrame([("m1", 61)], "extraction_id STRING, duration_seconds INT")
    gold = []
    for number, (_, slot, team) in enumerate(roster(spark)[:-1]):
        for step, (time, amount) in enumerate([(-5.0, 500), (1.0, 502), (60.0, 562)]):
            gold.append(("m1", number * 10 + step, slot, team, time, amount))
    gold.append(("m1", 900, 0, 2, 1.0, 520))
    frame = spark.createDataFrame(
        gold, "extraction_id STRING, sequence BIGINT, player_slot BIGINT, team_id INT, game_time_seconds DOUBLE, "
              "total_gold_earned BIGINT")

    def points(window, time):
        rolled = series.rolling_gpm(matches, players, frame, window, 1).where(F.col("game_time_seconds") == time)
        return {(row.series_kind, row.player_slot, row.team_id): row.gpm for row in rolled.collect()}

    short = points(1, 1.0)
    # The later sequence wins at the same time; a player without gold has no point.
    assert short[("player", 0, 2)] == 1200.0 and short[("player", 1, 2)] == 120.0
    assert short[("team", None, 2)] == 1200.0 + 4 * 120.0
    assert ("team", None, 3) not in short and ("player", 132, 3) not in short
    assert points(60, 60.0)[("player", 1, 2)] == 62.0
    assert points(60, 59.0) == {}
    complete = series.series_completeness(series.rolling_gpm(matches, players, frame, 60, 1), matches, 60).first()
    assert complete.player_series == 9 and not complete.complete


def test_heatmap_clamps_and_inverts(spark):
    corners = [(-8288.0, 8288.0), (8288.0, 8288.0), (-8288.0, -8288.0), (8288.0, -8288.0)]
    frame = spark.createDataFrame(
        [("m1", number * 100, 0, 2, x, y) for number, (x, y) in enumerate(corners)],
        "extraction_id STRING, game_time_milliseconds BIGINT, player_slot BIGINT, team_id INT, world_x FLOAT, world_y FLOAT")
    cells = series.hero_heatmap(frame, 0, 1000)
    assert sorted((row.cell_x, row.cell_y, row.selected_sample_count) for row in cells.collect()) == [
        (0, 0, 4), (0, 63, 4), (63, 0, 4), (63, 63, 4)]
    assert series.hero_heatmap(frame, 0, 0).count() == 1
    with pytest.raises(ValueError):
        series.hero_heatmap(frame, 5, 4)


def test_hero_stats_count_matches_once_and_keep_unknown(spark):
    matches = spark.createDataFrame(
        [("old", 1, 3), ("a", 1, 2), ("b", 2, 2), ("c", 3, None)], "extraction_id STRING, match_id BIGINT, winner_team_id INT")
    latest = matches.where("extraction_id <> 'old'").select("extraction_id", "match_id")
    players = spark.createDataFrame(
        [("old", 3, 8, 900, 900), ("a", 2, 5, 300, 400), ("b", 3, 5, 500, None), ("c", 2, 5, None, 600), ("a", 3, 0, 1, 1)],
        "extraction_id STRING, team_id INT, hero_id INT, gold_per_min INT, xp_per_min INT")
    drafts = spark.createDataFrame(
        [("old", 9, False), ("a", 6, False), ("a", 6, False), ("b", 5, True)], "extraction_id STRING, hero_id INT, is_pick BOOLEAN")
    found = {row.hero_id: row for row in series.hero_stats(matches, latest, players, drafts).collect()}
    assert set(found) == {5, 6}
    five, six = found[5], found[6]
    assert (five.picks, five.wins, five.losses, five.bans) == (3, 1, 1, 0)
    assert (five.win_rate, five.average_gpm, five.average_xpm) == (0.5, 400.0, 500.0)
    assert (six.picks, six.bans, six.win_rate, six.average_gpm) == (0, 1, None, None)
    assert six.ban_rate == pytest.approx(1 / 3)


def test_draft_types_are_strict_and_positions_stay(spark):
    payload = ('{"picks_bans":[{"hero_id":1,"is_pick":true,"team":0},{"hero_id":0,"is_pick":true,"team":0},'
               '{"hero_id":"2","is_pick":true,"team":0},{"hero_id":3,"is_pick":"true","team":0},'
               '{"hero_id":4,"is_pick":false,"team":2},{"hero_id":5,"is_pick":false,"team":1},{"hero_id":6.5,"is_pick":true,"team":1}]}')
    records = spark.createDataFrame([("m1", 1, fixed.OVERVIEW_DOCUMENT, payload)],
                                    "extraction_id STRING, sequence BIGINT, record_type STRING, payload STRING")
    found = documents.hero_draft_events(records).collect()
    assert sorted((row.draft_order, row.hero_id, row.is_pick, row.team_index) for row in found) == [
        (0, 1, True, 0), (5, 5, False, 1)]


def two_heroes(spark):
    return spark.createDataFrame([("m1", 0, 2, 1), ("m1", 128, 3, 2)],
                                 "extraction_id STRING, player_slot BIGINT, team_id INT, hero_id INT")


def test_damage_taken_needs_name_team_and_time(spark):
    log = combat(
        spark, state(1, -90, 4),
        event(fixed.DAMAGE, 2, -1, "axe", "antimage", 3, value=5),
        event(fixed.DAMAGE, 3, 31, "axe", "antimage", 3, value=7, attacker_illusion=True),
        event(fixed.DAMAGE, 4, 32, "axe", None, 3, value=9, attacker_name="npc_dota_wolf", damage_source_name="npc_dota_hero_antimage"),
        event(fixed.DAMAGE, 5, 33, "axe", None, 3, value=11, inflictor_name="  "),
        event(fixed.DAMAGE, 6, 34, "axe", "antimage", 2, value=1000),
        event(fixed.DAMAGE, 7, 35, "axe", "antimage", 3, value=1000, target_illusion=True),
        event(fixed.DAMAGE, 8, 36, "axe", "antimage", 3),
        {**event(fixed.DAMAGE, 9, 36, "axe", "antimage", 3, value=1000), "game_time": None},
        state(10, 100, 6), event(fixed.DAMAGE, 11, 101, "axe", "antimage", 3, value=1000))
    facts = damage.damage_taken_facts(log, versions.game_bounds(log), two_heroes(spark))
    got = sorted((row.interval_start, row.source_name, row.via_kind, row.via_name, row.mechanism_name, row.damage)
                 for row in facts.collect())
    hero = "npc_dota_hero_antimage"
    assert got == [(-30, hero, "direct", None, None, 5), (30, "Unknown source", "direct", None, None, 11),
                   (30, hero, "illusion", hero, None, 7), (30, hero, "unit", "npc_dota_wolf", None, 9)]
    levels = damage.damage_levels(facts, damage.TAKEN_LEVELS)
    assert {row.level: row.damage for row in levels.groupBy("level").sum("damage").withColumnRenamed(
        "sum(damage)", "damage").collect()} == {level: 32 for level in range(5)}
    labels = damage.labelled(levels.where("level = 4"), "source_name").collect()
    assert {row.via_label for row in labels} == {"Direct", "Anti-Mage illusion", "Wolf"}
    assert {row.mechanism_label for row in labels} == {"Attack"}


def test_damage_done_keeps_illusion_targets_and_teams(spark):
    log = combat(
        spark, state(1, 0, 4),
        event(fixed.DAMAGE, 2, 5, "axe", "antimage", 3, value=5, attacker_team=2, target_illusion=True),
        event(fixed.DAMAGE, 3, 6, None, "antimage", None, value=7, attacker_team=2),
        event(fixed.DAMAGE, 4, 7, "axe", "antimage", 3, value=100, attacker_team=3), state(9, 60, 6))
    facts = damage.damage_done_facts(log, versions.game_bounds(log), two_heroes(spark))
    assert sorted((row.target_name, row.target_team, row.via_kind, row.damage) for row in facts.collect()) == [
        ("Unknown target", None, "direct", 7), ("npc_dota_hero_axe", 3, "illusion", 5)]


def test_top_groups_keep_every_amount(spark):
    facts = spark.createDataFrame(
        [("m1", 0, interval, f"npc_dota_unit_{number}", 1000 if number == 0 else 100 - number) for number in range(12) for interval in (0, 30)
         if not (number == 0 and interval == 30)],
        "extraction_id STRING, player_slot BIGINT, interval_start BIGINT, source_name STRING, damage BIGINT")
    table = lens.top_groups_plus_other(facts, ["source_name"], "source_name").collect()
    assert len(table) == 16 and sum(row.damage for row in table) == facts.agg(F.sum("damage")).first()[0]
    zero = [row for row in table if row.damage == 0]
    assert len(zero) == 1 and zero[0].interval_start == 30
    assert {row.series_label for row in table if row.series_order == 7} == {"Other"}


# --- fights ---------------------------------------------------------------------------------


def many_heroes(spark):
    """Ten heroes: slots 0-4 on one side, 128-132 on the other; hero ids 1 to 10."""
    return spark.createDataFrame([
        ("m1", slot, team, number + 1) for number, (_, slot, team) in enumerate(roster(spark))],
        "extraction_id STRING, player_slot BIGINT, team_id INT, hero_id INT")


NAMES = {0: "antimage", 1: "axe", 2: "bane", 3: "bloodseeker", 4: "crystal_maiden", 128: "drow_ranger", 129: "earthshaker",
         130: "juggernaut", 131: "mirana", 132: "morphling"}


def death(sequence, time, victim, killer, assists=(), place=None, **more):
    team = 2 if victim < 5 else 3
    where = {} if place is None else {"location_x": float(place[0]), "location_y": float(place[1])}
    return event(fixed.DEATH, sequence, time, NAMES[victim], None if killer is None else NAMES[killer], team,
                 assist_players=list(assists), **where, **more)


def hit(sequence, time, target, source, value=10, **more):
    return event(fixed.DAMAGE, sequence, time, NAMES[target], NAMES[source], 2 if target < 5 else 3, value=value, **more)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


POSITIONS = ("extraction_id STRING, sequence BIGINT, game_time_milliseconds BIGINT, player_slot BIGINT, hero_id INT, "
             "team_id INT, world_x FLOAT, world_y FLOAT")
GOLD = "extraction_id STRING, sequence BIGINT, player_slot BIGINT, game_time_seconds DOUBLE, total_gold_earned BIGINT"
SERIES = "extraction_id STRING, team_id INT, sample_index BIGINT, net_worth DOUBLE"
CHANCE = "extraction_id STRING, sample_index BIGINT, game_time_seconds DOUBLE, radiant_probability DOUBLE, source STRING"


def found(spark, *events, positions=(), gold=(), team=(), chance=(), players=None):
    log = combat(spark, state(1, 90, 4), state(2, 100, 5), *events, state(100000, 5000, 6))
    metadata = spark.createDataFrame(
        [("m1", number, slot, team_id) for number, (_, slot, team_id) in enumerate(roster(spark))],
        "extraction_id STRING, game_player_id INT, player_slot BIGINT, team_id INT")
    return fights.Fights(
        log, many_heroes(spark) if players is None else players, metadata, versions.game_bounds(log),
        spark.createDataFrame(list(positions), POSITIONS), spark.createDataFrame(list(gold), GOLD),
        spark.createDataFrame(list(team), SERIES), spark.createDataFrame(list(chance), CHANCE))


def grouping(fights_found):
    groups = {}
    for row in fights_found.anchors.collect():
        groups.setdefault(row.fight_id, set()).add(row.sequence)
    return groups


def test_deaths_link_at_exact_limits(spark):
    linked = found(
        spark, death(10, 200, 0, 128, place=(0, 0)), death(11, 220, 1, 129, place=(2500, 0)),
        death(12, 240.5, 2, 130, place=(2500, 0)), death(13, 241, 3, 131, place=(5001, 0)))
    assert grouping(linked) == {10: {10, 11}, 12: {12}, 13: {13}}


def test_unlocated_deaths_link_by_a_shared_hero(spark):
    linked = found(
        spark, death(10, 200, 0, 128), death(11, 215, 1, 128), death(12, 216, 2, 129),
        death(13, 235, 3, 128, place=(0, 0)), death(14, 256, 4, 128, place=(9000, 0)))
    assert grouping(linked) == {10: {10, 11, 13}, 12: {12}, 14: {14}}


def test_distance_is_not_bridged_by_a_shared_hero(spark):
    apart = found(spark, death(10, 200, 0, 128, place=(0, 0)), death(11, 210, 1, 128, place=(3000, 0)))
    assert grouping(apart) == {10: {10}, 11: {11}}
    bridged = found(spark, death(10, 200, 0, 128, place=(0, 0)), death(12, 205, 2, 128), death(11, 210, 1, 128, place=(3000, 0)))
    assert grouping(bridged) == {10: {10, 11, 12}}


def test_anchor_rules(spark):
    anchors = found(
        spark, death(10, 200, 0, 1), death(11, 300, 0, None, assists=[5, 0, 77]), death(12, 400, 0, 128, target_illusion=True),
        {**death(13, 500, 0, 128), "target_team": 3}, death(14, 600, 0, 128, assists=[5, 6, 6]))
    rows = {row.sequence: (row.killer_slot, row.assist_slots) for row in anchors.anchors.collect()}
    # A friendly killer does not count, and assists map by game-player id.
    assert rows == {11: (None, [128]), 14: (128, [129])}


def test_ambiguous_hero_names_are_left_out(spark):
    players = many_heroes(spark).unionByName(spark.createDataFrame(
        [("m1", 7, 2, 1)], "extraction_id STRING, player_slot BIGINT, team_id INT, hero_id INT"))
    assert found(spark, death(10, 200, 0, 128), death(11, 300, 1, 128), players=players).anchors.count() == 1


def test_combat_interval_walks_over_short_pauses(spark):
    got = found(
        spark, hit(10, 135, 0, 128), hit(11, 180, 0, 128), hit(12, 190, 128, 0), hit(13, 195, 1, 0), death(14, 200, 0, 128),
        hit(15, 210, 128, 0, value=0), hit(16, 220, 0, 128), hit(17, 221, 0, 128)).intervals.first()
    # 135 lies beyond a long pause; friendly damage does not count; value does not matter; the tail ends after 20 s.
    assert (got.first_death, got.combat_start, got.combat_end) == (100.0, 80.0, 120.0)


def test_fight_types(spark):
    skirmish = found(spark, death(10, 200, 0, 128, assists=[6], place=(0, 0)), death(11, 201, 129, 1, place=(0, 0)))
    assert [row.fight_type for row in skirmish.groups.collect()] == ["skirmish"]
    team = found(spark, death(10, 200, 0, 128, assists=[6, 7], place=(0, 0)), death(11, 201, 129, 1, assists=[2], place=(0, 0)))
    assert [row.fight_type for row in team.groups.collect()] == ["team_fight"]


def test_whole_record(spark):
    samples = [("m1", number * 10 + slot, number * 100, slot, 1, 2 if slot < 5 else 3, float(50 + slot), 70.0)
               for number in range(50, 121) for slot in (0, 128)]
    got = found(
        spark, hit(10, 106, 128, 0, value=80), event(fixed.XP, 11, 107, NAMES[0], None, None, value=33),
        event(fixed.HEAL, 12, 108, NAMES[0], NAMES[0], 2, value=21), death(13, 112, 128, 0),
        event(fixed.DEATH, 14, 120, None, NAMES[0], 3, target_building=True) | {"target_name": "npc_dota_badguys_tower1_mid"},
        positions=samples, gold=[("m1", 1, 0, 0.0, 10), ("m1", 2, 0, 12.0, 95), ("m1", 3, 128, 11.0, 4)],
        team=[("m1", 2, 0, 500.0)], chance=[("m1", 0, 0.0, 0.25, fixed.GRAPH_HISTORY), ("m1", 1, 12.0, 0.5, fixed.GRAPH_HISTORY)])
    record = got.fight_list.first()
    assert (record.fight_id, record.fight_type, record.first_death, record.combat_start) == (13, "pickoff", 12.0, 6.0)
    assert (record.radiant_hero_damage, record.radiant_hero_healing, record.radiant_experience_change) == (80, 21, 33)
    assert (record.radiant_earned_gold_change, record.dire_earned_gold_change) == (85, None)
    assert (record.radiant_net_worth_change, record.dire_net_worth_change) == (0, None)
    assert record.radiant_win_probability_change == pytest.approx(0.25)
    assert (record.objective_count, record.outcome_end) == (1, 42.0)
    assert [row.kind for row in got.objectives.collect()] == ["tower"]
    frames = sorted(row.game_time_milliseconds for row in got.frames.collect())
    assert frames == list(range(6000, 12001, 100))
    assert [row.position_state for row in got.position_states.collect()] == ["available"]
    marker = got.death_markers.first()
    assert (marker.player_slot, marker.world_x, marker.game_time_milliseconds) == (128, 178.0, 12000)


def test_missing_streams_stay_unknown(spark):
    record = found(spark, death(10, 112, 128, 0)).fight_list.first()
    assert (record.radiant_earned_gold_change, record.radiant_experience_change, record.location_available) == (None, None, False)
    assert not record.earned_gold_available and not record.win_probability_available


def test_outcome_is_cut_by_the_first_near_fight(spark):
    got = found(
        spark, death(10, 200, 0, 128, place=(0, 0)), death(11, 223, 1, 129, place=(8000, 0)),
        death(12, 225, 2, 130, place=(3400, 0)), death(13, 227, 3, 131, place=(-3400, 0)))
    ends = {row.fight_id: row.outcome_end for row in got.fights.collect()}
    assert ends == {10: 125.0, 11: 153.0, 12: 155.0, 13: 157.0}


def view(spark, *points):
    frame = spark.createDataFrame([(1, number, float(x), float(y)) for number, (x, y) in enumerate(points)],
                                  "g INT, place BIGINT, x DOUBLE, y DOUBLE")
    return fights.map_view(frame, ["g"], ["place"]).first()


def test_map_views(spark):
    lone = view(spark, (-100, 0), (0, 100), (100, -100), (8000, 8000))
    assert (lone.center_x, lone.center_y, lone.minimum_x, lone.maximum_x) == (0.0, 0.0, -1200.0, 1200.0)
    wide = view(spark, (-1200, -400), (1900, 900))
    assert (wide.minimum_x, wide.maximum_x, wide.minimum_y, wide.maximum_y) == (-2000.0, 2700.0, -1200.0, 1700.0)
    border = view(spark, (8200, 8200), (8280, 8280))
    assert (border.maximum_x, border.maximum_y, border.minimum_x) == (8288.0, 8288.0, 5888.0)


# --- farming --------------------------------------------------------------------------------


def farm(spark, deaths=((1, 10_700), (2, 10_900)), damages=((10_000, 70), (10_500, 80)), **options):
    spawner = spark.createDataFrame([("m1", 1, 10, 3, 100.0, 200.0, 0, None)],
                                    "extraction_id STRING, entity_instance_id BIGINT, handle BIGINT, camp_type INT, "
                                    "world_x DOUBLE, world_y DOUBLE, creation_ms BIGINT, deletion_ms BIGINT")
    creeps = spark.createDataFrame(
        [("m1", number, 10, 4, options.get("created", 0), None, time) for number, time in deaths],
        "extraction_id STRING, entity_instance_id BIGINT, spawner_handle BIGINT, team_number INT, creation_ms BIGINT, "
        "deletion_ms BIGINT, death_ms BIGINT")
    log = combat(spark, *[
        {"sequence": number, "game_time": time / 1000, "event_type": fixed.DAMAGE, "target_name": "npc_dota_neutral_kobold",
         "attacker_name": "npc_dota_hero_axe", "target_team": 4, "value": value, "attacker_illusion": options.get("illusion", False)}
        for number, (time, value) in enumerate(damages)])
    players = spark.createDataFrame([("m1", 0, 2)], "extraction_id STRING, player_slot BIGINT, hero_id INT")
    shift = options.get("shift", 0)
    positions = spark.createDataFrame(
        [("m1", time, time + shift, 0, options.get("x", 100.0), 200.0) for time, _ in damages],
        "extraction_id STRING, sequence BIGINT, game_time_milliseconds BIGINT, player_slot BIGINT, world_x FLOAT, world_y FLOAT")
    located = cut_lineage(farming.camps(spawner))
    alive = cut_lineage(farming.camp_creeps(located, creeps))
    damage_rows = cut_lineage(farming.locate_damage(farming.eligible_damage(log, players), positions))
    assigned = cut_lineage(farming.nearest_camp(damage_rows, located, alive))
    actions = cut_lineage(farming.farming_actions(assigned, located, alive))
    assert farming.action_violations(actions).count() == 0
    return [(row.result, row.start_game_time_ms, row.end_game_time_ms, row.total_damage, row.initial_creep_count,
             row.dead_initial_creep_count) for row in actions.orderBy("action_index").collect()]


def test_cleared_and_open_camps(spark):
    assert farm(spark) == [("cleared", 10_000, 10_900, 150, 2, 2)]
    assert farm(spark, deaths=((1, 10_700), (2, None))) == [("not_cleared", 10_000, 10_500, 150, 2, 1)]
    assert farm(spark, deaths=((1, 10_700), (2, 18_501))) == [("not_cleared", 10_000, 10_500, 150, 2, 2)]
    assert farm(spark, deaths=((1, 18_500),)) == [("cleared", 10_000, 18_500, 150, 1, 1)]


def test_sessions_split_after_eight_seconds(spark):
    alive = ((1, None),)
    assert len(farm(spark, deaths=alive, damages=((1_000, 5), (9_000, 5)))) == 1
    assert len(farm(spark, deaths=alive, damages=((1_000, 5), (9_001, 5)))) == 2


def test_damage_needs_position_radius_and_live_creeps(spark):
    single = ((10_000, 5),)
    assert farm(spark, damages=single, shift=250) != [] and farm(spark, damages=single, shift=251) == []
    assert farm(spark, x=1300.0) != [] and farm(spark, x=1300.5) == []
    assert farm(spark, illusion=None) == [] and farm(spark, illusion=True) == []
    assert farm(spark, deaths=((1, 9_999),)) == []
    assert farm(spark, deaths=((1, 10_000),), damages=((10_000, 5),)) == [("cleared", 10_000, 10_000, 5, 1, 1)]
    assert farm(spark, created=10_600) == []


def test_percentiles_follow_nearest_rank(spark):
    frame = spark.createDataFrame([("g", value) for value in range(1, 21)], "g STRING, v BIGINT")
    row = quality.nearest_rank_percentile(frame, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row.p50, row.p95) == (10, 19)
    assert quality.upper_median(frame, ["g"], "v", "m").first().m == 11


def test_exploded_documents_are_not_broadcast(spark, rows):
    """Spark sizes an exploded array like its document, so a broadcast of players would not be known to be large."""
    def exploded(count, *fields):
        return spark.range(3).select(F.concat(F.lit("d"), "id").alias("extraction_id"), F.explode(
            F.sequence(F.lit(0), F.lit(count - 1))).alias("at")).select("extraction_id", *fields)

    players = exploded(10, F.col("at").cast("bigint").alias("player_slot"), F.lit(2).alias("team_id"))
    items = exploded(20, (F.col("at") % 10).cast("bigint").alias("player_slot"), (
        F.col("at") / 10).cast("int").alias("item_slot"), F.lit(7).alias("item_id"))
    latest = spark.createDataFrame([("d0", 1), ("d2", 3), ("x", 4)], "extraction_id STRING, match_id BIGINT")
    found = versions.match_players(players, latest, items)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "match_id", "player_slot", "items") == sorted(
        ((match, slot, [(0, 7), (1, 7)]) for match in (1, 3) for slot in range(10)), key=repr)

    candidates = exploded(10, "at", F.col("at").alias("game_player_id"), F.col("at").cast("bigint").alias("player_slot"),
                          F.lit(3).alias("team_id"))
    # Number 4 of d1 has the id of 3, number 6 of d2 the slot of 5; a row without an extraction is one like any other.
    mixed = candidates.select(
        F.when(F.col("extraction_id") != "d0", F.col("extraction_id")).alias("extraction_id"),
        F.when((F.col("extraction_id") == "d1") & (F.col("at") == 4), 3).otherwise(F.col("game_player_id")).alias("game_player_id"),
        F.when((F.col("extraction_id") == "d2") & (F.col("at") == 6), 5).otherwise(F.col("player_slot")).alias("player_slot"), "team_id")
    both = documents.metadata_roster(mixed, "both")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    left_out = {"d1": (3, 4), "d2": (5, 6)}
    assert rows(both, "extraction_id", "game_player_id", "player_slot", "team_id") == sorted(
        ((name, number, number, 3) for name in (None, "d1", "d2") for number in range(10)
         if number not in left_out.get(name, ())), key=repr)


def test_match_summary_reads_documents_once(spark, rows, tmp_path):
    overview, metadata = fixed.OVERVIEW_DOCUMENT, fixed.METADATA_DOCUMENT
    records = spark.createDataFrame([
        ("a", 1, overview, '{"match_id": 7, "lobby_type": "ODD", "duration": 60, "match_outcome": "k_EMatchOutcome_RadVictory"}'),
        ("a", 2, metadata, '{"version": 4}'),
        ("b", 3, overview, '{"match_id": 8, "lobby_type": "LATER"}'), ("b", 2, overview, '{"match_id": 8, "lobby_type": 12}'),
        ("c", 4, overview, "no document"), ("d", 5, overview, '{"match_id": 9}'), (None, 6, overview, '{"match_id": 10}')],
        "extraction_id STRING, sequence LONG, record_type STRING, payload STRING")
    latest = spark.createDataFrame([("a", 7), ("b", 8), ("c", 1), ("d", 1), (None, 10)], "extraction_id STRING, match_id LONG").withColumn(
        "match_id", F.col("match_id").cast("decimal(20,0)"))
    documents.match_texts(records).write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    found = versions.match_summary(documents.matches(records, texts), latest, texts)
    # The two of b are two rows, which both take the name that the first one gives.
    assert rows(found.withColumn("match_id", F.col("match_id").cast("int")), "extraction_id", "match_id", "lobby_type",
                "lobby_type_name", "metadata_version") == [
        ("a", 7, None, "ODD", 4), ("b", 8, 12, "12", None), ("b", 8, None, "12", None)]
    plan = versions.match_summary(documents.matches(records, texts).drop("metadata_version"), latest, texts)
    assert "json" not in plan._jdf.queryExecution().executedPlan().toString().lower()


def test_players_of_the_final_checkpoint(spark, rows):
    def listed(*entries):
        return "[" + ",".join(f'{{"propertyPath": "{path}", "valueType": "t", "value": {value}}}' for path, value in entries) + "]"

    def player(index, team=2, name="n", valid="true", handle=5):
        data, more = f"m_vecPlayerData.{index:04d}", f"m_vecPlayerTeamData.{index:04d}"
        return [(f"{data}.m_bIsValid", f'"{valid}"'), (f"{data}.m_iPlayerTeam", f'"{team}"'),
                (f"{data}.m_iszPlayerName", f'"{name}"'), (f"{more}.m_hSelectedHero", f'"{handle}"')]

    final = listed(*player(0), *player(1, team=3, handle=-1), *player(2, valid="false"), *player(3, team=5), *player(12),
                   ("m_vecPlayerTeamData.0000.m_iKills", '"9"'), ("m_vecPlayerTeamData.0000.m_iKills", '"10"'),
                   ("m_vecPlayerTeamData.0000.m_iKills", "null"), ("other", '"1"'))
    checkpoints = spark.createDataFrame([
        ("a", 1, 10, "completion", listed(*player(0, name="old"))), ("a", 1, 30, "completion", final),
        ("a", 1, 30, "completion", listed(("m_vecPlayerData.0000.m_iszPlayerName", '"z"'), ("m_vecPlayerTeamData.0000.m_iLevel", '"4"'))),
        ("a", 1, 40, "creation", listed(*player(5))), ("a", 2, 50, "completion", listed(*player(6))),
        ("b", 1, 30, "completion", "[" + listed(*player(0))), ("c", 1, 7, "completion", listed(*player(7)).replace("m_vecPlayer", "m_vec\\u0050layer")),
        ("d", 1, 8, "completion", listed(*player(8))), ("d", 1, 9, "completion", listed(("other", '"1"')))],
        "extraction_id STRING, entity_instance_id LONG, sequence LONG, checkpoint_kind STRING, properties STRING")
    instances = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).crossJoin(spark.createDataFrame(
        [(name,) for name in "abcd"], "extraction_id STRING")).where("n < 6 OR extraction_id = 'a'").select(
        "extraction_id", F.col("n").cast("bigint").alias("sequence"), F.col("n").cast("bigint").alias("entity_instance_id"),
        F.least("n", F.lit(5)).cast("decimal(20,0)").alias("handle"),
        F.when(F.col("n") <= 2, fixed.PLAYER_RESOURCE_CLASS).otherwise(F.concat(F.lit("C"), "n")).alias("class_name"))
    latest = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), ("d", 10)], "extraction_id STRING, match_id LONG")
    found = versions.players_from_checkpoint(instances, checkpoints, latest)
    assert rows(found, "match_id", "player_index", "team_id", "player_name", "hero_class", "kills", "level") == [
        (7, 0, 2, "z", "C5", 9, 4), (7, 0, 2, "z", "C6", 9, 4), (7, 1, 3, "n", None, None, None), (9, 7, 2, "n", "C5", None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "RLIKE" not in plan


def test_tables_of_one_parse_are_those_of_the_records(spark, rows, tmp_path):
    payload = ('{"match_id": 7, "players": [{"player_slot": 1, "team_number": "DOTA_GC_TEAM_GOOD_GUYS", "item_0": 5, "item_3": "x"}, '
               '{"player_slot": 128, "team_number": "DOTA_GC_TEAM_BAD_GUYS"}, {"player_slot": 9, "team_number": "OTHER"}], '
               '"picks_bans": [{"hero_id": 3, "is_pick": true, "team": 1}, {"hero_id": "4", "is_pick": true, "team": 0}]}')
    records = spark.createDataFrame([("a", 1, fixed.OVERVIEW_DOCUMENT, payload), ("b", 2, fixed.OVERVIEW_DOCUMENT, "no document"),
                                     (None, 3, fixed.OVERVIEW_DOCUMENT, payload)],
                                    "extraction_id STRING, sequence LONG, record_type STRING, payload STRING")
    documents.overviews(records, "players", "draft").write.parquet(str(tmp_path / "parsed"))
    parsed = spark.read.parquet(str(tmp_path / "parsed"))
    for of_parsed, of_records, count in ((documents.player_rows, documents.players, 4), (documents.item_rows, documents.player_items, 40),
                                         (documents.draft_rows, documents.hero_draft_events, 2)):
        found, wanted = of_parsed(parsed), of_records(records)
        assert rows(found, *wanted.columns) == rows(wanted, *wanted.columns) and found.count() == count
