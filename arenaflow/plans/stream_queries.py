"""Queries over sampling windows, streams and tick timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from arenaflow import fixed_values as fixed
from arenaflow.plans.registry import query
from arenaflow.plans.tables import Telemetry
from arenaflow.session import cut_lineage, scratch_path
from arenaflow.streaming import sampler, stateful, timelines

QUOTA = sampler.Quota(6, 3, 1, "sample-v1")

_SAMPLE = {
    "offers": """
SELECT *, sequence + 1 AS match_id, 1704067200 + t_ms * 1080 // 1000 AS start_time, CASE WHEN k % 3 <> 0 THEN k END AS rank,
  CASE WHEN k % 4 <> 0 THEN k % 12 END AS rank_count, k % 20 IN (7, 8) OR (k % 3 <> 0 AND k NOT BETWEEN 1 AND 99) AS invalid FROM ev""",
    "ranked": """
SELECT *, start_time // 3600 * 3600 AS hour, strftime(make_timestamp((start_time // 3600 * 3600) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS window_start
FROM offers WHERE NOT invalid AND k % 10 <> 9""",
    "priority": """
SELECT *, 'priority' AS selection_group, sha256('sample-v1' || chr(0) || 'priority' || chr(0) || window_start || chr(0) || match_id) AS h
FROM ranked WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY rank DESC, h) <= 3""",
    "control": """
SELECT *, 'control' AS selection_group, sha256('sample-v1' || chr(0) || 'control' || chr(0) || window_start || chr(0) || match_id) AS h
FROM ranked WHERE match_id NOT IN (SELECT match_id FROM priority)
QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY h) <= 1""",
    "taken": "SELECT window_start, match_id FROM priority UNION ALL SELECT window_start, match_id FROM control",
    "fill": """
SELECT *, 'fill' AS selection_group, sha256('sample-v1' || chr(0) || 'fill' || chr(0) || window_start || chr(0) || match_id) AS h
FROM ranked WHERE match_id NOT IN (SELECT match_id FROM taken) QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY h)
  <= 6 - (SELECT count(*) FROM taken WHERE taken.window_start = ranked.window_start)""",
    "chosen": "SELECT * FROM priority UNION ALL SELECT * FROM control UNION ALL SELECT * FROM fill",
    "newest": "SELECT max(start_time) AS top, min(start_time) // 3600 * 3600 AS low FROM ranked",
}


def _ranked(t: Telemetry) -> DataFrame:
    return sampler.ranked_candidates(sampler.parse_candidates(t.candidate_lines))


@query("sequence:i match_id:i start_time:i avg_rank_tier:i num_rank_tier:i invalid:b", """
SELECT sequence, match_id, CASE WHEN k % 20 <> 7 THEN start_time END AS start_time, rank AS avg_rank_tier,
  rank_count AS num_rank_tier, invalid FROM offers""", _SAMPLE)
def validated_candidates(t: Telemetry) -> DataFrame:
    return sampler.parse_candidates(t.candidate_lines)


@query("match_id:i window_start:s", "SELECT match_id, window_start FROM ranked", _SAMPLE)
def ranked_candidates(t: Telemetry) -> DataFrame:
    return _ranked(t)


@query("match_id:i sequence:i avg_rank_tier:i num_rank_tier:i", """
SELECT g AS match_id, min(sequence) AS sequence, arg_max(rank, sequence) FILTER (WHERE rank IS NOT NULL) AS avg_rank_tier,
  arg_max(rank_count, sequence) FILTER (WHERE rank_count IS NOT NULL) AS num_rank_tier
FROM (SELECT *, match_id // 3 AS g FROM ranked) GROUP BY g""", _SAMPLE)
def deduplicated_candidates(t: Telemetry) -> DataFrame:
    shared = _ranked(t).withColumn("match_id", F.floor(F.col("match_id").cast("bigint") / 3).cast("string"))
    return sampler.dedupe_candidates(shared, ["sequence"])


@query("match_id:i window_start:s selection_group:s selection_hash:s",
       "SELECT match_id, window_start, selection_group, h AS selection_hash FROM chosen", _SAMPLE)
def stratified_selection(t: Telemetry) -> DataFrame:
    return sampler.stratified_select(cut_lineage(_ranked(t)), QUOTA)


@query("match_id:i window_start:s", """
SELECT match_id, window_start FROM ranked CROSS JOIN newest WHERE hour + 3600 <= top - 5400""", _SAMPLE)
def closed_window_candidates(t: Telemetry) -> DataFrame:
    found = _ranked(t).withColumn("window_seconds", F.floor(F.col("start_time") / 3600) * 3600)
    newest = found.agg(F.max("start_time").alias("top"))
    return sampler.closed_windows(found.crossJoin(F.broadcast(newest)), F.col("top"))


@query("window_start:s candidate_count:i known_rank_count:i selected_count:i target:i under_target:b", """
SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS window_start, coalesce(n, 0) AS candidate_count,
  coalesce(known, 0) AS known_rank_count, coalesce(c, 0) AS selected_count, 6 AS target, coalesce(c, 0) < 6 AS under_target
FROM (SELECT unnest(generate_series((SELECT min(hour) - 7200 FROM ranked), (SELECT max(hour) + 3600 FROM ranked), 3600)) AS s) hours
LEFT JOIN (SELECT hour, count(*) AS n, count(rank) AS known FROM ranked GROUP BY hour) r ON r.hour = s
LEFT JOIN (SELECT hour, count(*) AS c FROM chosen GROUP BY hour) x ON x.hour = s""", _SAMPLE)
def window_summaries(t: Telemetry) -> DataFrame:
    found = cut_lineage(_ranked(t))
    first, last = found.agg(F.min("start_time"), F.max("start_time")).first()
    first, last = (value // 3600 * 3600 for value in (first, last))
    return sampler.window_summary(found, sampler.stratified_select(found, QUOTA), first - 7200, last + 3600, QUOTA)


# --- streams --------------------------------------------------------------------------------


#: What a provider delivers: every candidate once, some held back to the last delivery, some offered again.
_DELIVERED = _SAMPLE | {
    "delivered": """
SELECT match_id, hour, window_start, start_time, rank, rank_count, sequence AS ord,
  CASE WHEN k % 10 = 3 THEN 3 ELSE least(t_ms // 600000, 3) END AS delivery FROM ranked
UNION ALL
SELECT match_id, hour, window_start, start_time, CASE WHEN k % 2 = 0 THEN k // 2 + 1 END, CASE WHEN k % 4 = 0 THEN 5 END,
  sequence + 1000000000, least(CASE WHEN k % 10 = 3 THEN 3 ELSE least(t_ms // 600000, 3) END + k % 5 - 1, 3)
FROM ranked WHERE k % 5 IN (1, 2)""",
    "marks": """
SELECT d AS delivery, (SELECT max(start_time) FROM delivered b WHERE b.delivery < d) AS seen, (SELECT max(start_time) FROM delivered) AS last
FROM (SELECT DISTINCT delivery AS d FROM delivered) x""",
    "judged": """
SELECT x.*, hour + 3600 <= coalesce(seen - 259200, 0) AS late, hour + 3600 <= last - 259200 AS closed
FROM delivered x JOIN marks USING (delivery)""",
}
DELIVERIES, DELAY_MINUTES = 4, 4320


def _deliveries(t: Telemetry) -> DataFrame:
    """Lines with their ``sequence`` and ``delivery``."""
    k = F.col("k")
    start = F.lit(1704067200) + F.floor(F.col("t_ms") * 1080 / 1000).cast("bigint")
    first = F.when(k % 10 == 3, 3).otherwise(F.least(F.floor(F.col("t_ms") / 600000), F.lit(3)))
    again = F.to_json(F.struct(
        (F.col("sequence") + 1).alias("match_id"), start.alias("start_time"), F.lit(7).alias("lobby_type"),
        F.when(k % 2 == 0, F.floor(k / 2) + 1).alias("avg_rank_tier"), F.when(k % 4 == 0, 5).alias("num_rank_tier")))
    at = t.ev.select("sequence", first.cast("int").alias("delivery"))
    offered = t.ev.where("k % 5 IN (1, 2) AND k % 20 NOT IN (7, 8) AND k % 10 <> 9 AND (k % 3 = 0 OR k BETWEEN 1 AND 99)")
    return t.candidate_lines.join(at, "sequence").select("sequence", "value", "delivery").unionByName(offered.select(
        (F.col("sequence") + 1000000000).alias("sequence"), again.alias("value"),
        F.least(first + k % 5 - 1, F.lit(3)).cast("int").alias("delivery")))


def _fed(t: Telemetry, rows: DataFrame, start: Callable[[DataFrame, str], DataStreamWriter], label: str) -> str:
    """Run a stream over deliveries, stopping it after each and starting it again from its checkpoint.

    Returns the folder given to ``start`` beside the stream of rows.
    """
    folder = scratch_path(t.spark, label)
    kept = cut_lineage(rows)
    schema = kept.drop("delivery").schema
    for delivery in range(DELIVERIES):
        kept.where(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(f"{folder}/inbox")
        stream = t.spark.readStream.schema(schema).parquet(f"{folder}/inbox")
        start(stream, folder).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


def _to_rows(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], DataStreamWriter]:
    return lambda stream, folder: made(stream).writeStream.outputMode("append").format("parquet").option(
        "path", f"{folder}/rows")


def _streamed(t: Telemetry, rows: DataFrame, made: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    return t.spark.read.parquet(f"{_fed(t, rows, _to_rows(made), label)}/rows")


def _parsed(stream: DataFrame) -> DataFrame:
    return sampler.ranked_candidates(sampler.parse_candidates(stream))


def _coalesced(t: Telemetry) -> DataFrame:
    stateful.use_keyed_state(t.spark)
    return _streamed(t, _deliveries(t), lambda stream: stateful.coalesce_candidates(
        _parsed(stream), delay_minutes=DELAY_MINUTES), "coalesced")


@query("match_id:i window_start:s avg_rank_tier:i num_rank_tier:i offers:i", """
SELECT match_id, window_start, arg_max(rank, ord) FILTER (WHERE rank IS NOT NULL) AS avg_rank_tier,
  arg_max(rank_count, ord) FILTER (WHERE rank_count IS NOT NULL) AS num_rank_tier, count(*) AS offers
FROM judged WHERE NOT late AND closed GROUP BY match_id, window_start""", _DELIVERED)
def streamed_coalesced_candidates(t: Telemetry) -> DataFrame:
    return _coalesced(t).where("NOT late")


@query("window_start:s late_count:i",
       "SELECT window_start, count(*) AS late_count FROM judged WHERE late GROUP BY window_start", _DELIVERED)
def streamed_late_candidates(t: Telemetry) -> DataFrame:
    return stateful.late_counts(_coalesced(t))


@query("window_seconds:i candidate_count:i known_rank_count:i", """
SELECT hour AS window_seconds, count(*) AS candidate_count, count(rank) AS known_rank_count FROM judged
WHERE NOT late AND closed GROUP BY hour""", _DELIVERED)
def streamed_window_counts(t: Telemetry) -> DataFrame:
    return _streamed(t, _deliveries(t), lambda stream: sampler.stream_window_counts(_parsed(stream), DELAY_MINUTES),
                     "window-counts").withColumn("window_seconds", F.unix_seconds("window_start_ts"))


@query("match_id:i", "SELECT DISTINCT match_id FROM delivered", _DELIVERED)
def streamed_first_candidates(t: Telemetry) -> DataFrame:
    # The delay spans the whole stream: within it a match leaves once, however often it is offered.
    return _streamed(t, _deliveries(t), lambda stream: sampler.stream_first_candidates(
        _parsed(stream), 60 * 24 * 60), "first-candidates")


_PICKED = _DELIVERED | {
    "merged": """
SELECT match_id, window_start, arg_max(rank, ord) FILTER (WHERE rank IS NOT NULL) AS rank
FROM judged WHERE NOT late AND closed GROUP BY match_id, window_start""",
    "priority": _SAMPLE["priority"].replace("FROM ranked", "FROM merged"),
    "control": _SAMPLE["control"].replace("FROM ranked", "FROM merged"),
    "fill": _SAMPLE["fill"].replace("FROM ranked", "FROM merged").replace("ranked.window_start", "merged.window_start"),
}


@query("match_id:i window_start:s selection_group:s", "SELECT match_id, window_start, selection_group FROM chosen", _PICKED)
def streamed_selection(t: Telemetry) -> DataFrame:
    folder = _fed(t, _deliveries(t), lambda stream, folder: _parsed(stream).drop("start_ts").writeStream.foreachBatch(
        sampler.WindowSampler(
            f"{folder}/kept", QUOTA, DELAY_MINUTES, ("batch_id", "sequence"))), "selection")
    return t.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/kept/selections")


_SITTINGS = {"sittings": """
SELECT extraction_id, slot, count(*) AS damage_event_count, sum(cents) AS total_damage, min(t_ms) AS first_ms, max(t_ms) AS last_ms
FROM (SELECT *, sum(fresh) OVER (PARTITION BY extraction_id, slot ORDER BY t_ms, sequence) AS n FROM (
  SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY extraction_id, slot ORDER BY t_ms, sequence) <= 30000
    THEN 0 ELSE 1 END AS fresh FROM ev))
GROUP BY extraction_id, slot, n"""}


def _hits(t: Telemetry) -> DataFrame:
    return t.ev.select("extraction_id", F.col("slot").alias("player_slot"), F.lit(0).alias("camp_id"), "t_ms",
                       F.timestamp_millis("t_ms").alias("at"), F.col("cents").alias("damage"))


def _timed(sessions: DataFrame) -> DataFrame:
    return sessions.withColumnRenamed("player_slot", "slot").withColumn(
        "first_ms", F.unix_millis("first_damage")).withColumn("last_ms", F.unix_millis("last_damage"))


@query("extraction_id:s slot:i damage_event_count:i total_damage:i first_ms:i last_ms:i", "SELECT * FROM sittings", _SITTINGS)
def session_window_actions(t: Telemetry) -> DataFrame:
    return _timed(timelines.session_window_actions(_hits(t), "at", "30 seconds"))


@query("extraction_id:s slot:i damage_event_count:i total_damage:i first_ms:i last_ms:i", """
SELECT * FROM sittings WHERE last_ms + 30000 <= (SELECT max(t_ms) - 60000 FROM ev)""", _SITTINGS)
def streamed_sessions(t: Telemetry) -> DataFrame:
    """Sessions over deliveries of ten minutes: those across a border are merged in state and leave by the watermark."""
    delivered = _hits(t).withColumn("delivery", F.least(F.floor(F.col("t_ms") / 600000), F.lit(3)).cast("int"))
    return _timed(_streamed(t, delivered, lambda stream: timelines.session_window_actions(
        stream.withWatermark("at", "60 seconds"), "at", "30 seconds"), "sessions"))


# --- linked entities ------------------------------------------------------------------------

_CAPTURE = {
    "created": """
SELECT extraction_id, sequence * 10 AS sequence, sequence AS entity, handle, 'spawner' AS kind, handle % 3 <> 0 AS complete FROM spawners
UNION ALL SELECT extraction_id, sequence * 10, sequence, CASE WHEN k % 9 = 0 THEN 16777215 ELSE 1012 + k % 6 END, 'creep', k % 8 <> 0
FROM ev WHERE kind = 'view'""",
    "seen": "SELECT extraction_id, handle, min(sequence) AS seen_at FROM created WHERE kind = 'spawner' GROUP BY ALL",
    "linked": """
SELECT c.*, seen_at, CASE WHEN entity % 5 = 0 THEN (entity + 700) * 10 + 3 END AS deleted_at
FROM created c JOIN seen USING (extraction_id, handle) WHERE kind = 'creep' AND complete AND handle <> 16777215""",
    "told": """
SELECT extraction_id, entity, 'update' AS emission, entity * 10 + 1 AS sequence, seen_at, deleted_at, 'm_iHealth' AS path, '40' AS value FROM linked
UNION ALL SELECT extraction_id, entity, 'update', (entity + 900) * 10 + 2, seen_at, deleted_at, 'm_lifeState', '1' FROM linked WHERE entity % 2 = 0
UNION ALL SELECT extraction_id, entity, 'deletion', deleted_at, seen_at, deleted_at, NULL, NULL FROM linked WHERE deleted_at IS NOT NULL""",
    "captured": """
SELECT extraction_id, entity, unnest(['identity', 'creation', 'checkpoint']) AS emission, sequence, greatest(sequence, seen_at) AS released_at,
  NULL AS path, NULL AS value FROM linked
UNION ALL SELECT extraction_id, entity, emission, sequence, greatest(sequence, seen_at), path, value FROM told
WHERE deleted_at IS NULL OR sequence <= deleted_at OR seen_at > deleted_at
UNION ALL SELECT extraction_id, entity, unnest(CASE WHEN complete THEN ['identity', 'creation', 'checkpoint'] ELSE ['identity', 'creation'] END),
  sequence, sequence, NULL, NULL FROM created WHERE kind = 'spawner'
UNION ALL SELECT extraction_id, entity, 'checkpoint', sequence + 4, sequence + 4, NULL, NULL FROM created WHERE kind = 'spawner' AND NOT complete
UNION ALL SELECT extraction_id, entity, 'deletion', sequence + 6000, sequence + 6000, NULL, NULL FROM created WHERE kind = 'spawner'""",
}
_CAPTURED = "SELECT *, entity AS entity_instance_id FROM captured"
_CAPTURED_COLUMNS = "extraction_id:s entity_instance_id:i emission:s sequence:i released_at:i path:s value:s"


def _entity_log(t: Telemetry) -> DataFrame:
    """Creations, updates and deletions by sequence: a creep may come long before its spawner and be gone by then."""
    def shape(frame: DataFrame, kind: str, sequence, handle, complete, path=None, value=None) -> DataFrame:
        return frame.select(
            "extraction_id", sequence.cast("bigint").alias("sequence"), F.lit(kind).alias("kind"),
            F.col("sequence").alias("entity_instance_id"), handle.cast("decimal(20,0)").alias("handle"),
            complete.alias("complete"), F.lit(path).cast("string").alias("path"), F.lit(value).cast("string").alias("value"))

    k, at, none, no = F.col("k"), F.col("sequence"), F.lit(None), F.lit(False)
    creeps, spawners, handle = t.creep_rows, t.spawner_rows, F.lit(1000) + F.col("k")
    parts = [
        shape(spawners, stateful.SPAWNER, at * 10, handle, handle % 3 != 0),
        shape(spawners, stateful.UPDATE, at * 10 + 4, none, F.lit(True), "m_Type", "2"),
        shape(spawners, stateful.DELETE, at * 10 + 6000, none, no),
        shape(creeps, stateful.CREEP, at * 10, F.when(k % 9 == 0, fixed.INVALID_HANDLE).otherwise(
            F.col("spawner_handle")), k % 8 != 0),
        shape(creeps, stateful.UPDATE, at * 10 + 1, none, no, "m_iHealth", "40"),
        shape(creeps.where("sequence % 2 = 0"), stateful.UPDATE, (at + 900) * 10 + 2, none, no, "m_lifeState", "1"),
        shape(creeps.where("sequence % 5 = 0"), stateful.DELETE, (at + 700) * 10 + 3, none, no)]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


@query(_CAPTURED_COLUMNS, _CAPTURED, _CAPTURE)
def captured_entities(t: Telemetry) -> DataFrame:
    return stateful.linked_entities(_entity_log(t))


@query(_CAPTURED_COLUMNS, _CAPTURED, _CAPTURE)
def streamed_capture(t: Telemetry) -> DataFrame:
    stateful.use_keyed_state(t.spark)
    log = cut_lineage(_entity_log(t))
    span = log.agg((F.max("sequence") + 1).alias("__span"))
    delivered = log.crossJoin(F.broadcast(span)).withColumn(
        "delivery", F.floor(F.col("sequence") * DELIVERIES / F.col("__span")).cast("int")).drop("__span")
    return _streamed(t, delivered, stateful.stream_linked_entities, "capture")


# --- timelines ------------------------------------------------------------------------------


def _filled(column: str, name: str) -> str:
    return (f"last_value({column} IGNORE NULLS) OVER (PARTITION BY extraction_id ORDER BY sequence "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name}")


_CLOCK = {
    "observed": """
SELECT extraction_id, sequence, t_ms // 30 AS net_tick, CASE WHEN kind = 'signup' AND k < 3 THEN k + 1.0::DOUBLE END AS start_at,
  CASE WHEN kind = 'view' AND k < 20 THEN k * 10 END AS pauses,
  CASE WHEN kind = 'error' AND k < 5 THEN true WHEN kind = 'error' AND k < 15 THEN false END AS paused,
  CASE WHEN kind = 'click' AND k < 50 THEN k * 1.5::DOUBLE END AS direct FROM ev""",
    "held": "SELECT extraction_id, sequence, net_tick, " + ", ".join(_filled(column, name) for column, name in (
        ("start_at", "s_start"), ("pauses", "s_pauses"), ("paused", "s_paused"), ("direct", "s_direct"))) + " FROM observed",
    "running": """
SELECT *, CASE WHEN NOT coalesce(s_paused, false) THEN coalesce(net_tick * 30.0::DOUBLE / 1000.0 - s_start
    - coalesce(s_pauses, 0) * 30.0::DOUBLE / 1000.0, s_direct) END AS value,
  CASE WHEN coalesce(s_paused, false) THEN s_direct END AS waiting FROM held""",
}


@query("extraction_id:s sequence:i clock:d", """
SELECT extraction_id, sequence, coalesce(last_value(value IGNORE NULLS) OVER w, first_value(waiting IGNORE NULLS) OVER w) AS clock
FROM running WINDOW w AS (PARTITION BY extraction_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", _CLOCK)
def pause_safe_clock(t: Telemetry) -> DataFrame:
    k, kind = F.col("k"), F.col("kind")
    rows = t.ev.select(
        "extraction_id", "sequence", F.floor(F.col("t_ms") / 30).cast("bigint").alias("net_tick"),
        F.lit(30.0).alias("millis_per_tick"), F.when((kind == "signup") & (k < 3), (k + 1).cast("double")).alias("game_start_time"),
        F.when((kind == "view") & (k < 20), k * 10).alias("total_paused_ticks"),
        F.when((kind == "error") & (k < 5), True).when((kind == "error") & (k < 15), False).alias("paused"),
        F.when((kind == "click") & (k < 50), k * 1.5).alias("direct_game_time"))
    return timelines.pause_safe_clock(rows)


_COUNTERS = {
    "ticks": """
SELECT DISTINCT extraction_id, t_ms // 10000 AS tick, CASE WHEN t_ms // 10000 >= 20 THEN (t_ms // 10000) * 10.0::DOUBLE - 205 END AS game_time
FROM ev""",
    "starts": """
SELECT extraction_id, first_tick, first_time, (SELECT min(tick) FROM ticks u WHERE u.extraction_id = s.extraction_id
    AND u.tick > s.first_tick AND u.game_time IS NOT NULL) AS second_tick
FROM (SELECT extraction_id, min(tick) AS first_tick, arg_min(game_time, tick) AS first_time FROM ticks
  WHERE game_time IS NOT NULL GROUP BY extraction_id) s""",
    "seen": """
SELECT e.extraction_id, slot, t_ms // 10000 AS tick, arg_max(cents // 2000, sequence) AS total, s.* EXCLUDE (extraction_id)
FROM ev e JOIN starts s USING (extraction_id) GROUP BY ALL""",
    "opening": """
SELECT extraction_id, slot, first_tick, first_time, second_tick, arg_max(total, tick) FILTER (WHERE tick < first_tick) AS untimed,
  max(total) FILTER (WHERE tick = first_tick) AS pending FROM seen WHERE tick <= first_tick GROUP BY ALL""",
    "series": """
SELECT extraction_id, slot, first_tick AS tick, least(first_time, 0) AS game_time, coalesce(untimed, pending) AS total FROM opening
UNION ALL SELECT c.extraction_id, c.slot, c.tick, t.game_time, arg_max(c.total, c.fresh) FROM (
  SELECT extraction_id, slot, tick, total, 1 AS fresh FROM seen WHERE tick > first_tick
  UNION ALL SELECT extraction_id, slot, second_tick, pending, 0 FROM opening WHERE untimed <> pending AND second_tick IS NOT NULL) c
JOIN ticks t ON t.extraction_id = c.extraction_id AND t.tick = c.tick AND t.game_time IS NOT NULL
GROUP BY c.extraction_id, c.slot, c.tick, t.game_time""",
}


@query("extraction_id:s slot:i tick:i game_time:d total:i", """
SELECT * FROM series QUALIFY lag(total) OVER (PARTITION BY extraction_id, slot ORDER BY tick) IS NULL
  OR lag(total) OVER (PARTITION BY extraction_id, slot ORDER BY tick) <> total""", _COUNTERS)
def coalesced_counters(t: Telemetry) -> DataFrame:
    tick = F.floor(F.col("t_ms") / 10000).cast("bigint")
    seen = t.ev.select("extraction_id", "slot", tick.alias("tick"), "sequence",
                       F.floor(F.col("cents") / 2000).cast("bigint").alias("total"))
    ticks = seen.select("extraction_id", "tick").distinct().withColumn(
        "game_time", F.when(F.col("tick") >= 20, F.col("tick") * 10.0 - 205))
    return timelines.coalesce_counters(seen, ticks, ["slot"])


_GRID = {
    "marks": """
SELECT extraction_id, t_ms // 5000 AS tick, max(t_ms) AS reached FROM ev GROUP BY extraction_id, t_ms // 5000""",
    "steps": """
SELECT extraction_id, tick, unnest(generate_series(CASE WHEN before IS NULL THEN 0 ELSE (before // 100 + 1) * 100 END,
    least(reached, 1000 * duration_seconds) // 100 * 100, 100)) AS g
FROM (SELECT *, max(reached) OVER (PARTITION BY extraction_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks JOIN matches USING (extraction_id))""",
    "changes": """
SELECT extraction_id, slot, t_ms // 5000 AS tick, arg_max(k, sequence) AS k, arg_max(sequence, sequence) AS s FROM ev
GROUP BY extraction_id, slot, t_ms // 5000""",
    "lives": "SELECT extraction_id, slot, min(tick) AS born FROM changes GROUP BY ALL",
    "asked": "SELECT s.extraction_id, l.slot, s.tick, s.g FROM steps s JOIN lives l ON l.extraction_id = s.extraction_id AND s.tick >= l.born",
}


def _ticks(t: Telemetry) -> DataFrame:
    return t.ev.groupBy("extraction_id", F.floor(F.col("t_ms") / 5000).cast("bigint").alias("tick")).agg(
        (F.max("t_ms") / 1000.0).alias("game_time"))


def _grid(t: Telemetry) -> DataFrame:
    end = t.matches.select("extraction_id", (F.col("duration_seconds").cast("bigint") * 1000).alias("end_ms"))
    return timelines.sample_grid(_ticks(t), end)


@query("extraction_id:s tick:i game_time_milliseconds:i",
       "SELECT extraction_id, tick, g AS game_time_milliseconds FROM steps", _GRID)
def position_grid(t: Telemetry) -> DataFrame:
    return _grid(t)


@query("extraction_id:s game_time_milliseconds:i game_player_id:i hero_id:i team_id:i world_x:d world_y:d", """
SELECT a.extraction_id, a.g AS game_time_milliseconds, a.slot AS game_player_id, 1 + a.slot AS hero_id, 2 + a.slot % 2 AS team_id,
  (64 + c.k) * 128 - 16384 + c.k * 0.5 AS world_x, (c.s % 128 + 64) * 128 - 16384 AS world_y
FROM asked a ASOF JOIN changes c ON c.extraction_id = a.extraction_id AND c.slot = a.slot AND a.tick >= c.tick
WHERE a.slot < 10 AND c.k % 10 <> 0 AND c.k % 13 <> 1 AND (64 + c.k) * 128 - 16384 + c.k * 0.5 BETWEEN -8288 AND 8288""", _GRID)
def resampled_positions(t: Telemetry) -> DataFrame:
    changed = t.ev.groupBy(
        "extraction_id", "slot", F.floor(F.col("t_ms") / 5000).cast("bigint").alias("tick")).agg(
        F.max_by(F.struct("k", F.col("sequence").alias("s")), "sequence").alias("r"))
    k = F.col("r.k")
    states = changed.select(
        "extraction_id", F.col("slot").alias("entity_uid"), F.lit(1).cast("bigint").alias("generation"), "tick",
        F.lit(False).alias("deleted"), (F.lit(100) + F.col("slot")).alias("entity_handle"),
        F.col("slot").cast("int").alias("game_player_id"), (1 + F.col("slot")).cast("int").alias("hero_id"),
        (2 + F.col("slot") % 2).cast("int").alias("team_id"), F.when(k % 10 == 0, 1).otherwise(0).alias("life_state"),
        (k % 13 == 1).alias("illusion"), F.lit(False).alias("clone"), F.lit(False).alias("phantom"),
        F.lit(fixed.INVALID_HANDLE).cast("bigint").alias("replicating_handle"), (64 + k).alias("cell_x"),
        (F.col("r.s") % 128 + 64).alias("cell_y"), (k * 0.5).alias("offset_x"), F.lit(0.0).alias("offset_y"))
    roster = t.ev.where("slot % 2 = 0").select("extraction_id", "slot").distinct().select(
        "extraction_id", F.col("slot").cast("int").alias("game_player_id"),
        (1 + F.col("slot")).cast("int").alias("roster_hero_id"), (2 + F.col("slot") % 2).cast("int").alias("roster_team_id"),
        (F.lit(100) + F.col("slot")).alias("selected_handle"))
    return timelines.resample_positions(states, _grid(t), roster)


_CHANCE = {
    "graph": """
SELECT extraction_id, slot * 3 + k % 5 AS position, arg_max(k * 2 - 20, sequence) AS value FROM ev
WHERE kind = 'purchase' AND slot * 3 + k % 5 < 64 GROUP BY ALL""",
    "usable": "SELECT * FROM graph WHERE value BETWEEN 0 AND 100",
    "spans": "SELECT extraction_id, 100.0::DOUBLE AS a, CASE WHEN ext % 3 = 1 THEN 50.0::DOUBLE ELSE duration_seconds END AS b, duration_seconds AS d FROM (SELECT *, match_id - 1 AS ext FROM matches)",
    "from_graph": """
SELECT u.extraction_id, (d - (b - a)) + (b - a) * position / 63.0::DOUBLE AS game_time_seconds, value / 100.0::DOUBLE AS radiant_probability,
  'graph_history' AS source FROM usable u JOIN spans USING (extraction_id) WHERE b > a AND (d - (b - a)) + (b - a) * position / 63.0::DOUBLE >= 0
  AND extraction_id IN (SELECT extraction_id FROM usable WHERE value <> 0)""",
    "last_seen": """
SELECT extraction_id, t_ms // 1000 AS tick, arg_max(k / 90.0::DOUBLE, sequence) AS value FROM ev WHERE kind = 'view' GROUP BY ALL""",
}


@query("extraction_id:s game_time_seconds:d radiant_probability:d source:s", """
SELECT * FROM from_graph UNION ALL SELECT extraction_id, tick - 100.0::DOUBLE, value, 'spectator_updates' FROM last_seen
WHERE value BETWEEN 0 AND 1 AND tick >= 100 AND extraction_id NOT IN (SELECT extraction_id FROM from_graph)""", _CHANCE)
def probability_timeline(t: Telemetry) -> DataFrame:
    k, slot = F.col("k"), F.col("slot")
    graph = t.ev.where("kind = 'purchase'").select(
        "extraction_id", "sequence", (slot * 3 + k % 5).cast("int").alias("position"), (k * 2 - 20).cast("int").alias("value"))
    spans = t.matches.select(
        "extraction_id", F.lit(100.0).alias("graph_start"), F.when((F.col("match_id") - 1) % 3 == 1, 50.0).otherwise(
            F.col("duration_seconds").cast("double")).alias("graph_end"), F.col("duration_seconds").cast("double").alias(
            "match_duration"))
    tick = F.floor(F.col("t_ms") / 1000).cast("bigint")
    spectator = t.ev.where("kind = 'view'").select("extraction_id", "sequence", tick.alias("tick"),
                                                  (tick - 100.0).alias("game_time"), (k / 90.0).alias("value"))
    return timelines.probability_samples(graph, spans, spectator)


def _creep_states(t: Telemetry) -> DataFrame:
    k = F.col("k")
    return t.creep_rows.select(
        "extraction_id", F.col("sequence").alias("entity_instance_id"),
        F.when(k % 9 == 0, fixed.INVALID_HANDLE).otherwise(F.col("spawner_handle")).cast("decimal(20,0)").alias("spawner_handle"),
        F.when(k % 8 != 0, 0).alias("life_state"), F.lit(100).alias("health"), F.lit(4).alias("team_number"),
        F.lit(False).alias("summoned"))


def _spawner_handles(t: Telemetry) -> DataFrame:
    return t.spawner_rows.select("extraction_id", (F.lit(1000) + F.col("k")).cast("decimal(20,0)").alias("handle"))


_LINKED = {"states": """
SELECT extraction_id, sequence AS entity_instance_id, CASE WHEN k % 9 = 0 THEN 16777215 ELSE 1012 + k % 6 END AS spawner_handle,
  k % 8 <> 0 AS complete FROM ev WHERE kind = 'view'"""}


@query("extraction_id:s entity_instance_id:i spawner_handle:i", """
SELECT * FROM states s WHERE complete AND EXISTS (SELECT 1 FROM spawners p WHERE p.extraction_id = s.extraction_id
  AND p.handle = s.spawner_handle)""", _LINKED)
def linked_creeps(t: Telemetry) -> DataFrame:
    return timelines.capture_linked_creeps(_creep_states(t), _spawner_handles(t))


@query("extraction_id:s spawner_count:i linked_creeps:i invalid_handles:i unresolved_handles:i", """
SELECT s.extraction_id, any_value(n) AS spawner_count, count(*) FILTER (WHERE complete AND seen) AS linked_creeps,
  count(*) FILTER (WHERE spawner_handle = 16777215) AS invalid_handles,
  count(*) FILTER (WHERE spawner_handle <> 16777215 AND NOT seen) AS unresolved_handles
FROM (SELECT *, EXISTS (SELECT 1 FROM spawners p WHERE p.extraction_id = s.extraction_id AND p.handle = s.spawner_handle) AS seen FROM states s) s
LEFT JOIN (SELECT extraction_id, count(*) AS n FROM spawners GROUP BY extraction_id) c USING (extraction_id)
GROUP BY s.extraction_id""", _LINKED)
def creep_link_statistics(t: Telemetry) -> DataFrame:
    return timelines.link_statistics(_creep_states(t), _spawner_handles(t))


@query("sequence:i game_time:d raw_time:d", """
SELECT sequence, CASE WHEN k % 3 <> 0 THEN t_ms / 1000.0::DOUBLE END AS game_time,
  CASE WHEN k % 2 = 0 THEN k * 1.5::DOUBLE ELSE k + 0.25::DOUBLE END AS raw_time FROM ev""")
def combat_clock(t: Telemetry) -> DataFrame:
    k = F.col("k")
    game = F.when(k % 3 != 0, F.col("t_ms") / 1000.0).otherwise(F.lit(float("nan")))
    raw = F.when(k % 2 == 0, (k * 1.5).cast("float")).otherwise(F.lit(float("inf")).cast("float"))
    game_time, raw_time = timelines.combat_times(game, raw, (k + 0.25).cast("float"))
    return t.ev.select("sequence", game_time.alias("game_time"), raw_time.alias("raw_time"))
