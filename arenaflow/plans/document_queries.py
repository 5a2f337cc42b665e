"""Queries over the catalog and the JSON match documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.operators import documents, series, versions
from arenaflow.operators.lens import match_search
from arenaflow.plans.registry import query
from arenaflow.plans.tables import Telemetry
from arenaflow.session import write_once
from arenaflow.sources import catalog

# --- catalog --------------------------------------------------------------------------------

_CATALOG = {
    "attempts": """
SELECT printf('e%010d', o_orderkey) AS extraction_id, o_custkey AS match_id, o_orderkey, o_totalprice,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'started' ELSE 'failed' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_orderdate END AS completed_at
FROM orders""",
    "fetches": """
SELECT printf('a%010d-%d-%d-%d-%s', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS acquisition_id,
  l_partkey AS match_id, l_shipdate AS requested_at, CAST(l_quantity AS BIGINT) AS replay_bytes,
  CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'replay_unavailable' ELSE 'failed' END AS status FROM lineitem""",
    "latest": """
SELECT * FROM attempts WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY match_id
  ORDER BY completed_at DESC NULLS LAST, started_at DESC NULLS LAST, extraction_id DESC) = 1""",
    "ids": "SELECT match_id FROM fetches UNION SELECT match_id FROM attempts",
    "newest_attempt": """
SELECT *, count(*) OVER (PARTITION BY match_id) AS n FROM attempts
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY started_at DESC, extraction_id DESC) = 1""",
    "newest_fetch": """
SELECT *, count(*) OVER (PARTITION BY match_id) AS n FROM fetches
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY requested_at DESC, acquisition_id DESC) = 1""",
    "analysed": """
SELECT match_id, started_at AS start_time, CAST(floor(o_totalprice) AS BIGINT) AS duration_seconds FROM latest
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "states": """
SELECT i.match_id, CASE WHEN s.match_id IS NOT NULL THEN 'succeeded' ELSE coalesce(a.status, f.status, 'unknown') END AS status,
  s.start_time, s.duration_seconds
FROM ids i LEFT JOIN newest_attempt a USING (match_id) LEFT JOIN newest_fetch f USING (match_id) LEFT JOIN analysed s USING (match_id)""",
}


def _analysed(t: Telemetry) -> DataFrame:
    documented = t.table("lineitem").where("l_returnflag = 'R'").select(
        F.format_string("e%010d", "l_orderkey").alias("extraction_id"))
    return versions.latest_successful(t.extractions).join(documented, "extraction_id", "left_semi").select(
        "match_id", F.col("started_at").alias("start_time"), F.floor("o_totalprice").cast("bigint").alias("duration_seconds"),
        *[F.lit(None).cast("string").alias(name) for name in (
            "winner_team", "radiant_score", "dire_score", "radiant_team_name", "dire_team_name")])


@query("match_id:i extraction_id:s", "SELECT * FROM latest", _CATALOG)
def latest_successful(t: Telemetry) -> DataFrame:
    return versions.latest_successful(t.extractions)


@query("match_id:i status:s", "SELECT * FROM states", _CATALOG)
def latest_status(t: Telemetry) -> DataFrame:
    return versions.latest_status(t.acquisitions, t.extractions, _analysed(t))


@query("match_id:i status:s duration_seconds:i",
       "SELECT * FROM states ORDER BY start_time DESC NULLS LAST, match_id DESC LIMIT 500", _CATALOG)
def match_list(t: Telemetry) -> DataFrame:
    return series.match_list(t.acquisitions, t.extractions, _analysed(t))


@query("match_id:i status:s", "SELECT * FROM states WHERE contains(CAST(match_id AS VARCHAR), '77')", _CATALOG)
def found_matches(t: Telemetry) -> DataFrame:
    return match_search(versions.latest_status(t.acquisitions, t.extractions, _analysed(t)), " 77 ")


@query("stored_matches:i total_records:i", """
SELECT count(*) AS stored_matches, coalesce(sum(o_orderkey % 1000), 0) AS total_records FROM ids LEFT JOIN (
  SELECT * FROM attempts WHERE status = 'succeeded'
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY started_at DESC, extraction_id DESC) = 1) USING (match_id)""", _CATALOG)
def catalog_stats(t: Telemetry) -> DataFrame:
    return series.catalog_stats(t.acquisitions, t.extractions)


@query("match_id:i status:s extraction_id:s replay_bytes:i extraction_count:i acquisition_count:i records:s total:s", """
SELECT i.match_id, coalesce(a.status, f.status) AS status, a.extraction_id, f.replay_bytes, coalesce(a.n, 0) AS extraction_count,
  coalesce(f.n, 0) AS acquisition_count, coalesce(CAST(a.o_orderkey % 100 AS VARCHAR), '0') AS records,
  coalesce(CAST(a.o_orderkey % 1000 AS VARCHAR), '0') AS total
FROM ids i LEFT JOIN newest_attempt a USING (match_id) LEFT JOIN newest_fetch f USING (match_id)
ORDER BY coalesce(a.completed_at, a.started_at, f.requested_at) DESC, i.match_id DESC LIMIT 100 OFFSET 20""", _CATALOG)
def catalog_list(t: Telemetry) -> DataFrame:
    return series.catalog_list(t.acquisitions, t.extractions, 100, 20)


@query("extraction_id:s positions_available:b", """
SELECT extraction_id, o_orderkey % 3 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) AS positions_available
FROM attempts""", _CATALOG)
def position_availability(t: Telemetry) -> DataFrame:
    present = t.table("lineitem").where("l_linenumber = 7").select(
        F.format_string("e%010d", "l_orderkey").alias("extraction_id"))
    return versions.position_availability(t.extractions, present)


@query("extraction_id:s farming_available:b",
       "SELECT extraction_id, o_orderkey % 2 = 0 AS farming_available FROM attempts", _CATALOG)
def farming_availability(t: Telemetry) -> DataFrame:
    return versions.farming_availability(t.extractions)


@query("match_id:i extraction_id:s", """
SELECT match_id, extraction_id FROM attempts WHERE status = 'succeeded' AND o_orderkey % 2 = 1
  AND match_id IN (SELECT c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY completed_at DESC NULLS LAST, extraction_id DESC) = 1""", _CATALOG)
def find_loaded(t: Telemetry) -> DataFrame:
    requests = t.table("customer").select(
        F.col("c_custkey").cast("decimal(20,0)").alias("match_id"),
        F.sha2(F.concat(F.lit("r"), "c_custkey"), 256).alias("replay_sha256"), F.lit("reader").alias("parser_name"),
        F.lit("v1").alias("parser_version"), F.lit("3").alias("exporter_version"), F.lit("1").alias("maxInputBytes"),
        F.lit("2").alias("maxOutputBytes"), F.lit("3").alias("maxRecords"), F.lit("1").alias("timeoutSeconds"),
        F.lit("30").alias("checkpointIntervalSeconds"))
    return catalog.find_loaded(requests, t.extractions)


@query("match_id:i extraction_id:s status:s", """
SELECT match_id, extraction_id, status FROM attempts
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY started_at DESC, o_orderkey % 2 DESC, extraction_id DESC) = 1""", _CATALOG)
def upsert_latest(t: Telemetry) -> DataFrame:
    rows = t.extractions.withColumn("odd", F.substring("extraction_id", -1, 1).cast("int") % 2).select(
        "match_id", "extraction_id", "status", "started_at", "odd")
    return catalog.upsert_latest(rows.where("odd = 0"), rows.where("odd = 1"), ["match_id"],
                                 ["started_at", "odd", "extraction_id"])


@query("extraction_id:s match_id:i",
       "SELECT extraction_id, match_id FROM attempts WHERE status <> 'succeeded'", _CATALOG)
def unpublished(t: Telemetry) -> DataFrame:
    return catalog.unpublished(t.extractions.select("extraction_id", "match_id"), t.extractions)


# --- documents ------------------------------------------------------------------------------

_P = "range(10) AS slots(p)"
_DOCUMENTS = {
    "current_docs": """
SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'""",
    "docs": "SELECT 'd' || o_orderkey AS extraction_id, o_orderkey AS o FROM orders",
    "doc_matches": """
SELECT extraction_id, o, o + 1 AS match_id, 1700000000 + o AS start_seconds, 1200 + o % 2400 AS duration_seconds,
  CASE o % 4 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 12 END AS lobby_type,
  CASE o % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS winner_team_id, CASE o % 3 WHEN 0 THEN 'Radiant' WHEN 1 THEN 'Dire' END AS winner_team,
  o % 60 AS radiant_score, o % 55 AS dire_score, CASE WHEN o % 2 = 0 THEN 'team ' || (o % 40) END AS radiant_team_name,
  o % 300 AS cluster, o % 30 AS metadata_version FROM docs""",
    "doc_players": f"""
SELECT extraction_id, o, CASE WHEN p < 5 THEN p ELSE p + 123 END AS player_slot, CASE WHEN p < 5 THEN 2 ELSE 3 END AS team_id,
  p % 5 AS team_slot, o * 10 + p AS account_id, CASE WHEN p % 4 <> 0 THEN 'p' || (o * 10 + p) END AS player_name,
  1 + (o * 7 + p * 13) % 114 AS hero_id, 10 + (o + p) % 20 AS level, (o + p) % 20 AS kills, (o + 2 * p) % 15 AS deaths,
  (o + 3 * p) % 30 AS assists, CASE WHEN (o + p) % 11 <> 0 THEN 200 + (o * 3 + p * 17) % 500 END AS gold_per_min,
  CASE WHEN (o + p) % 13 <> 0 THEN 300 + (o * 5 + p * 19) % 400 END AS xp_per_min, (o * 11 + p * 7) % 30000 AS net_worth,
  (o + p) % 250 AS item_0, (o + p * 3) % 250 AS item_3
FROM docs, {_P} WHERE NOT (p = 9 AND o % 7 = 0)""",
    "doc_drafts": """
SELECT extraction_id, o, i AS draft_order, 1 + (o * 5 + i * 17) % 114 AS hero_id, i % 3 <> 0 AS is_pick, i % 2 AS team_index
FROM docs, range(4) AS entries(i) WHERE NOT (i = 2 AND o % 5 = 0) AND NOT (i = 3 AND o % 6 = 0)""",
    "doc_candidates": f"""
SELECT extraction_id, CASE WHEN p % 5 = 4 AND p = 4 AND o % 8 = 0 THEN 3 ELSE p END AS game_player_id,
  CASE WHEN p < 5 THEN p ELSE p + 123 END AS player_slot, CASE WHEN p < 5 THEN 2 ELSE 3 END AS team_id FROM docs, {_P}""",
}


def _latest(t: Telemetry) -> DataFrame:
    """One attempt per order that fails for pending ones, and a newer one without documents for urgent ones."""
    orders = t.table("orders")
    match_id = (F.col("o_orderkey") + 1).cast("decimal(20,0)").alias("match_id")
    first = orders.select(
        F.concat(F.lit("d"), "o_orderkey").alias("extraction_id"), match_id,
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    second = orders.where("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("r"), "o_orderkey").alias("extraction_id"), match_id, F.lit("succeeded").alias("status"),
        *[(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias(name)
          for name in ("started_at", "completed_at")])
    return versions.latest_successful(first.unionByName(second)).select("extraction_id", "match_id")


@query("extraction_id:s match_id:i start_seconds:i duration_seconds:i lobby_type:i winner_team_id:i winner_team:s "
       "radiant_score:i dire_score:i radiant_team_name:s cluster:i metadata_version:i", "SELECT * FROM doc_matches", _DOCUMENTS)
def document_matches(t: Telemetry) -> DataFrame:
    return documents.matches(t.records).withColumn("start_seconds", F.unix_seconds("start_time"))


@query("extraction_id:s player_slot:i team_id:i team_slot:i account_id:i player_name:s hero_id:i level:i kills:i deaths:i "
       "assists:i gold_per_min:i xp_per_min:i net_worth:i", "SELECT * FROM doc_players", _DOCUMENTS)
def document_players(t: Telemetry) -> DataFrame:
    return documents.players(t.records)


@query("extraction_id:s player_slot:i item_slot:i item_id:i", """
SELECT extraction_id, player_slot, s AS item_slot, CASE s WHEN 0 THEN item_0 WHEN 3 THEN item_3 END AS item_id
FROM doc_players, range(10) AS strip(s)""", _DOCUMENTS)
def player_items(t: Telemetry) -> DataFrame:
    return documents.player_items(t.records)


@query("extraction_id:s draft_order:i hero_id:i is_pick:b team_index:i", "SELECT * FROM doc_drafts", _DOCUMENTS)
def hero_draft_events(t: Telemetry) -> DataFrame:
    return documents.hero_draft_events(t.records)


@query("extraction_id:s team_id:i sample_index:i net_worth:d gold_earned:d experience:d", """
SELECT extraction_id, team AS team_id, m AS sample_index, o % 1000 + m * 100 * team AS net_worth,
  CASE WHEN m < 3 THEN m * 50 + team END AS gold_earned, m * 70 + team AS experience
FROM docs, (SELECT unnest([2, 3]) AS team) teams, range(6) AS minutes(m) WHERE m <= o % 6""", _DOCUMENTS)
def team_time_series(t: Telemetry) -> DataFrame:
    return documents.team_time_series(t.records)


def _roster_sql(key: str) -> str:
    return (f"SELECT * FROM doc_candidates WHERE game_player_id BETWEEN 0 AND 9 "
            f"QUALIFY count(*) OVER (PARTITION BY extraction_id, {key}) = 1")


_ROSTER = "extraction_id:s game_player_id:i player_slot:i team_id:i"


@query(_ROSTER, _roster_sql("game_player_id"), _DOCUMENTS)
def metadata_roster_by_player(t: Telemetry) -> DataFrame:
    return documents.metadata_roster(documents.metadata_candidates(t.records), "game_player_id")


@query(_ROSTER, _roster_sql("player_slot"), _DOCUMENTS)
def metadata_roster_by_slot(t: Telemetry) -> DataFrame:
    return documents.metadata_roster(documents.metadata_candidates(t.records), "player_slot", None)


@query(_ROSTER, f"{_roster_sql('game_player_id')} INTERSECT {_roster_sql('player_slot')}", _DOCUMENTS)
def metadata_roster_by_both(t: Telemetry) -> DataFrame:
    return documents.metadata_roster(documents.metadata_candidates(t.records), "both")


@query("extraction_id:s problem:s", """
SELECT extraction_id, CASE WHEN o % 9 = 4 THEN 'one overview and one metadata document required'
  ELSE 'reported match differs' END AS problem FROM docs WHERE o % 9 IN (4, 5)""", _DOCUMENTS)
def document_violations(t: Telemetry) -> DataFrame:
    key = F.substring("extraction_id", 2, 20).cast("bigint")
    broken = t.records.where((F.col("record_type") == fixed.OVERVIEW_DOCUMENT) | (key % 9 != 4))
    requested = t.table("orders").select(
        F.concat(F.lit("d"), "o_orderkey").alias("extraction_id"),
        F.when(F.col("o_orderkey") % 9 == 5, 7000000000).otherwise(F.col("o_orderkey") + 1).cast("decimal(20,0)")
        .alias("match_id"))
    return documents.document_violations(broken, requested)


_HERO_SQL = """
SELECT coalesce(p.hero_id, b.hero_id) AS hero_id, match_count,
  coalesce(picks, 0) AS picks, coalesce(bans, 0) AS bans, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses,
  coalesce(picks, 0)::DOUBLE / nullif(match_count, 0) AS pick_rate, coalesce(bans, 0)::DOUBLE / nullif(match_count, 0) AS ban_rate,
  coalesce(wins, 0)::DOUBLE / nullif(coalesce(wins, 0) + coalesce(losses, 0), 0) AS win_rate,
  coalesce(losses, 0)::DOUBLE / nullif(coalesce(wins, 0) + coalesce(losses, 0), 0) AS loss_rate, average_gpm, average_xpm
FROM (SELECT hero_id, count(DISTINCT match_id) AS picks,
    count(DISTINCT CASE WHEN team_id = winner_team_id THEN match_id END) AS wins,
    count(DISTINCT CASE WHEN team_id <> winner_team_id THEN match_id END) AS losses,
    avg(gold_per_min) AS average_gpm, avg(xp_per_min) AS average_xpm
  FROM doc_players JOIN doc_matches USING (extraction_id, o) WHERE o IN (SELECT o FROM current_docs) GROUP BY hero_id) p
FULL JOIN (SELECT hero_id, count(DISTINCT o) AS bans FROM doc_drafts WHERE NOT is_pick AND o IN (SELECT o FROM current_docs) GROUP BY hero_id) b
  ON p.hero_id = b.hero_id
CROSS JOIN (SELECT count(*) AS match_count FROM doc_matches WHERE o IN (SELECT o FROM current_docs)) scope"""


@query("hero_id:i match_count:i picks:i bans:i wins:i losses:i pick_rate:d ban_rate:d win_rate:d loss_rate:d average_gpm:d "
       "average_xpm:d", _HERO_SQL, _DOCUMENTS)
def hero_stats(t: Telemetry) -> DataFrame:
    # One parse of the documents serves the three tables.
    parsed = write_once(documents.overviews(t.records), "overviews")
    return series.hero_stats(documents.match_rows(parsed), _latest(t), documents.player_rows(parsed), documents.draft_rows(parsed))


@query("extraction_id:s match_id:i lobby_type:i lobby_type_name:s winner_team:s", """
SELECT *, CASE o % 4 WHEN 0 THEN '7' WHEN 1 THEN '1' WHEN 2 THEN '12' ELSE 'OTHER' END AS lobby_type_name
FROM doc_matches WHERE o IN (SELECT o FROM current_docs)""", _DOCUMENTS)
def match_summary(t: Telemetry) -> DataFrame:
    # One parse of the documents serves the typed rows and the names of their lobbies.
    texts = write_once(documents.match_texts(t.records), "match-texts")
    return versions.match_summary(documents.matches(t.records, texts), _latest(t), texts)


@query("match_id:i player_slot:i team_id:i team_slot:i hero_id:i strip:s", """
SELECT o + 1 AS match_id, *, '0:' || item_0 || ',1:-,2:-,3:' || item_3 || ',4:-,5:-,6:-,7:-,8:-,9:-' AS strip
FROM doc_players WHERE o IN (SELECT o FROM current_docs)""", _DOCUMENTS)
def match_players(t: Telemetry) -> DataFrame:
    found = versions.match_players(documents.players(t.records), _latest(t), documents.player_items(t.records))
    return found.withColumn("strip", F.array_join(F.transform("items", lambda item: F.concat(
        item["item_slot"].cast("string"), F.lit(":"), F.coalesce(item["item_id"].cast("string"), F.lit("-")))), ","))


@query("match_id:i duration_seconds:i exporter_version:s manifest_schema_version:i extraction_profile:s roster_players:i", """
SELECT m.match_id, m.duration_seconds, '3' AS exporter_version, 3 AS manifest_schema_version, 'p' || (o % 3) AS extraction_profile,
  CASE WHEN o % 7 = 0 THEN 9 ELSE 10 END AS roster_players
FROM doc_matches m WHERE o IN (SELECT o FROM current_docs) ORDER BY start_seconds DESC NULLS LAST, match_id DESC LIMIT 50""", _DOCUMENTS)
def newest_matches(t: Telemetry) -> DataFrame:
    key = F.substring("extraction_id", 2, 20).cast("bigint")
    catalogued = t.extractions.withColumn("extraction_id", F.concat(F.lit("d"), key))
    return series.newest_matches(documents.matches(t.records), _latest(t), catalogued, documents.players(t.records), 50)


# --- final checkpoints ----------------------------------------------------------------------


def _entities(t: Telemetry) -> tuple[DataFrame, DataFrame]:
    """A rules and a resource entity per order, with two checkpoints each."""
    o = F.col("o_orderkey")
    # A key of a few bytes grows to kilobytes of JSON: spread the keys first.
    spread = t.table("orders").select("o_orderkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    orders = spread.select("o_orderkey", F.concat(F.lit("d"), o).alias("extraction_id"))
    kinds = orders.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    instances = kinds.select(
        "extraction_id", F.col("part").cast("bigint").alias("sequence"), F.col("part").cast("bigint").alias(
            "entity_instance_id"), F.when(F.col("part") == 3, o + 500).otherwise(F.col("part")).cast("decimal(20,0)")
        .alias("handle"), F.element_at(F.array(F.lit(fixed.RULES_CLASS), F.lit(fixed.PLAYER_RESOURCE_CLASS),
                                               F.lit("CHero")), F.col("part")).alias("class_name"))
    entry = "struct<propertyPath: string, valueType: string, value: string>"

    def prop(path: Column, value: Column) -> Column:
        return F.struct(path.alias("propertyPath"), F.lit("t").alias("valueType"), value.cast("string").alias("value")).cast(entry)

    def rules(shift: int) -> Column:
        base = "m_pGameRules."
        return F.array(
            prop(F.lit(base + "m_nGameWinner"), 2 + (o + shift) % 3), prop(F.lit(base + "m_iGameMode"), F.lit(22)),
            prop(F.lit(base + "m_flGameStartTime"), (o % 100) * 1.5), prop(F.lit(base + "m_flGameEndTime"), 2000 + o % 700 + shift))

    def player(i: int) -> list[Column]:
        def data(field: str) -> Column:
            return F.lit(f"m_vecPlayerData.{i:04d}.{field}")

        def team(field: str) -> Column:
            return F.lit(f"m_vecPlayerTeamData.{i:04d}.{field}")

        return [
            prop(data("m_bIsValid"), (o + i) % 9 != 0), prop(data("m_iPlayerTeam"), F.lit(2 if i < 5 else 3)),
            prop(data("m_iszPlayerName"), F.lit(f"n{i}")), prop(team("m_nSelectedHeroID"), 1 + (o + i) % 100),
            prop(team("m_hSelectedHero"), o + 500 if i == 2 else F.lit(-i - 1)),
            prop(team("m_iKills"), (o + i) % 20), prop(team("m_iLevel"), (o + i) % 30)]

    # Ten players are written out: paths that a lambda formats for every row take longer than the rest of the document.
    resource = F.array(*[entry for i in range(10) for entry in player(i)])

    def checkpoint(entity: int, sequence: int, kind: str, listed: Column) -> DataFrame:
        return orders.select("extraction_id", F.lit(sequence).cast("bigint").alias("sequence"),
                             F.lit(entity).cast("bigint").alias("entity_instance_id"), F.lit(kind).alias("checkpoint_kind"),
                             F.to_json(listed).alias("properties"))

    checkpoints = checkpoint(1, 10, "creation", rules(5)).unionByName(checkpoint(1, 20, "completion", rules(1))).unionByName(
        checkpoint(1, 30, "completion", rules(0))).unionByName(checkpoint(2, 40, "completion", resource))
    return instances, checkpoints


@query("match_id:i winner_team_id:i winner_team:s game_mode_id:i game_start_time:d game_end_time:d duration_seconds:d", """
SELECT o + 1 AS match_id, 2 + o % 3 AS winner_team_id, CASE o % 3 WHEN 0 THEN 'Radiant' WHEN 1 THEN 'Dire' ELSE 'Unknown' END AS winner_team,
  22 AS game_mode_id, (o % 100) * 1.5 AS game_start_time, 2000 + o % 700 AS game_end_time,
  2000 + o % 700 - (o % 100) * 1.5 AS duration_seconds FROM docs WHERE o IN (SELECT o FROM current_docs)""", _DOCUMENTS)
def summary_from_checkpoint(t: Telemetry) -> DataFrame:
    instances, checkpoints = _entities(t)
    return versions.summary_from_checkpoint(instances, checkpoints, _latest(t))


@query("match_id:i player_index:i team_id:i team:s player_name:s hero_id:i hero_class:s kills:i level:i", f"""
SELECT o + 1 AS match_id, p AS player_index, CASE WHEN p < 5 THEN 2 ELSE 3 END AS team_id,
  CASE WHEN p < 5 THEN 'Radiant' ELSE 'Dire' END AS team, 'n' || p AS player_name, 1 + (o + p) % 100 AS hero_id,
  CASE WHEN p = 2 THEN 'CHero' END AS hero_class, (o + p) % 20 AS kills, (o + p) % 30 AS level
FROM docs, {_P} WHERE o IN (SELECT o FROM current_docs) AND (o + p) % 9 <> 0""", _DOCUMENTS)
def players_from_checkpoint(t: Telemetry) -> DataFrame:
    instances, checkpoints = _entities(t)
    return versions.players_from_checkpoint(instances, checkpoints, _latest(t))
