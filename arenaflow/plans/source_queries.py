"""Queries over staged rows, the storage policy, entity state, item snapshots and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.operators import documents, items, quality, versions
from arenaflow.plans import document_queries, match_queries  # noqa: F401  whose entries are counted
from arenaflow.plans.match_queries import bounds
from arenaflow.plans.registry import ENTRIES, query
from arenaflow.plans.tables import Telemetry
from arenaflow.schemas import staged_name, table_schema
from arenaflow.session import scratch_path, write_once
from arenaflow.sources import blobs, catalog, inspection, manifest, staged

# --- staged rows ----------------------------------------------------------------------------


def _staged_lines(frame: DataFrame, logical: str) -> DataFrame:
    """Warehouse rows written back as staged NDJSON lines; absent columns stay NULL."""
    fields = [F.col(field.name).alias(staged_name(logical, field.name))
              for field in table_schema(logical).fields if field.name in frame.columns]
    return frame.select(F.to_json(F.struct(*fields)).alias("value"))


@query("extraction_id:s sequence:i event_type:s game_time:d value:i target_team:i location_x:d target_illusion:b assists:s", """
SELECT *, array_to_string(assist_players, ',') AS assists FROM combat""")
def staged_combat_events(t: Telemetry) -> DataFrame:
    return staged.parse_staged_lines(_staged_lines(t.combat, "combatEvents"), "combatEvents").withColumn(
        "assists", F.array_join(F.col("assist_players").cast("array<string>"), ","))


def _position_lines(t: Telemetry) -> DataFrame:
    k, person = F.col("k"), F.col("slot") % 10
    milliseconds = (F.floor(F.col("t_ms") / 100) * 100).cast("string")
    claimed = F.when((F.col("ext") % 4 == 1) & (k == 52), F.lit("other")).when(
        (F.col("ext") % 4 != 1) | (k != 53), F.col("extraction_id"))
    return t.ev.select(F.col("extraction_id").alias(staged.OWNER), F.to_json(F.struct(
        claimed.alias("extractionId"), F.col("sequence"), F.col("sequence").alias("demoTick"),
        F.when((F.col("ext") % 4 == 1) & (k == 50), F.concat(milliseconds, F.lit(".5"))).otherwise(milliseconds)
        .alias("gameTimeMilliseconds"), person.alias("gamePlayerId"),
        (1 + person).alias("heroId"), (2 + (F.col("ext") * 19 + person) % 2).alias("teamId"),
        F.when((F.col("ext") % 4 == 1) & (k == 51), F.lit("9000")).otherwise(F.col("px").cast("string")).alias("worldX"),
        F.col("py").alias("worldY"))).alias("value"))


def _strict(t: Telemetry) -> DataFrame:
    from arenaflow.schemas import staged_schema

    return staged.strict_positions(_position_lines(t).select(
        staged.OWNER, F.from_json("value", staged_schema("heroPositions")).alias("r")).select(staged.OWNER, "r.*"))


@query("extraction_id:s rows:i invalid_rows:i", """
SELECT extraction_id, count(*) AS rows, count(*) FILTER (WHERE ext % 4 = 1 AND k IN (50, 51, 52, 53)) AS invalid_rows
FROM ev GROUP BY extraction_id""")
def strict_position_rows(t: Telemetry) -> DataFrame:
    return _strict(t).groupBy("extraction_id").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("invalid"), 1)).alias("invalid_rows"))


_IMPORT = {
    "mapped": """
SELECT extraction_id, game_player_id, player_slot FROM candidates WHERE game_player_id BETWEEN 0 AND 9
QUALIFY count(*) OVER (PARTITION BY extraction_id, game_player_id) = 1""",
    "judged": """
SELECT e.*, m.player_slot, (e.ext % 4 = 1 AND e.k IN (50, 51, 52, 53)) OR e.ext % 7 = 3 OR m.player_slot IS NULL AS rejected,
  m.player_slot IS NULL OR m.player_slot <> e.slot % 10 AS mismatch
FROM ev e LEFT JOIN mapped m ON m.extraction_id = e.extraction_id AND m.game_player_id = e.slot % 10""",
}


@query("extraction_id:s sequence:i", "SELECT extraction_id, sequence FROM judged WHERE mismatch", _IMPORT)
def position_mismatches(t: Telemetry) -> DataFrame:
    return documents.position_mismatches(_strict(t), t.metadata_candidates, t.players)


@query("extraction_id:s sequence:i game_time_milliseconds:i player_slot:i hero_id:i team_id:i world_x:d world_y:d", """
SELECT extraction_id, sequence, t_ms // 100 * 100 AS game_time_milliseconds, player_slot, 1 + slot % 10 AS hero_id,
  2 + (ext * 19 + slot % 10) % 2 AS team_id, px AS world_x, py AS world_y FROM judged
WHERE extraction_id NOT IN (SELECT extraction_id FROM judged WHERE rejected)""", _IMPORT)
def imported_positions(t: Telemetry) -> DataFrame:
    declared = t.ev.groupBy("extraction_id", "ext").agg(
        (F.count("*") + F.when(F.col("ext") % 7 == 3, 1).otherwise(0)).alias("declared_rows"))
    return documents.hero_position_samples(_strict(t), t.metadata_candidates, t.players, declared)


def _probability_lines(t: Telemetry) -> DataFrame:
    k = F.col("k")
    index = F.when((F.col("ext") % 4 == 1) & (k == 50), F.concat(F.lit('"'), "sequence", F.lit('"'))).otherwise(
        F.col("sequence").cast("string"))
    mixed = (F.col("ext") % 5 == 2) & (k < 50)
    claimed = F.when((F.col("ext") % 4 == 3) & (k == 51), F.lit("other")).otherwise(F.col("extraction_id"))
    return t.ev.where("kind = 'view'").select(F.col("extraction_id").alias(staged.OWNER), F.concat(
        F.lit('{"extractionId":"'), claimed, F.lit('","sampleIndex":'), index, F.lit(',"gameTimeSeconds":'),
        (F.col("t_ms") / 1000.0).cast("string"), F.lit(',"radiantProbability":'), (k / 100.0).cast("string"),
        F.lit(',"source":"'), F.when(mixed, fixed.SPECTATOR_UPDATES).otherwise(fixed.GRAPH_HISTORY), F.lit('"'),
        F.when((F.col("ext") % 4 == 3) & (k == 52), F.lit("")).otherwise(F.lit("}"))).alias("value"))


@query("extraction_id:s sample_index:i game_time_seconds:d radiant_probability:d source:s", """
SELECT extraction_id, sequence AS sample_index, t_ms / 1000.0::DOUBLE AS game_time_seconds, k / 100.0::DOUBLE AS radiant_probability,
  'graph_history' AS source FROM ev WHERE kind = 'view' AND extraction_id NOT IN (
  SELECT extraction_id FROM ev WHERE kind = 'view' AND ((ext % 4 = 1 AND k = 50) OR (ext % 4 = 3 AND k IN (51, 52)) OR ext % 5 = 2 OR ext % 7 = 3))""")
def imported_probabilities(t: Telemetry) -> DataFrame:
    declared = t.ev.groupBy("extraction_id", "ext").agg(
        (F.count_if(F.col("kind") == "view") + F.when(F.col("ext") % 7 == 3, 1).otherwise(0)).alias("declared_rows"))
    return staged.import_probabilities(staged.probability_objects(_probability_lines(t)), declared)


@query("extraction_id:s events:i sequences:i", """
SELECT extraction_id, count(*) AS events, sum(sequence) AS sequences FROM combat GROUP BY extraction_id""")
def published_events(t: Telemetry) -> DataFrame:
    """Three loads of the log: some extractions, then all under the same label, then all again under another."""
    warehouse = scratch_path(t.spark, "published")
    rows = t.ev.select("extraction_id", "ext").distinct().withColumn("status", F.lit("succeeded"))
    log = {"events": t.combat.select("extraction_id", "sequence", "event_type")}
    for label, part in (("first", rows.where("ext % 2 = 0")), ("first", rows), ("second", rows)):
        catalog.publish_extractions(t.spark, warehouse, log, part, label)
    return catalog.read_published(t.spark, warehouse, "events").groupBy("extraction_id").agg(
        F.count("*").alias("events"), F.sum("sequence").alias("sequences"))


# --- storage policy -------------------------------------------------------------------------

_KINDS = ["CSVCMsg_VoiceData", "CSVCMsg_PacketEntities", "CMsgDOTAMatch"]


def _staged_tables(t: Telemetry) -> dict[str, DataFrame]:
    k, kind = F.col("k"), F.col("kind")
    ev = t.ev
    users = ev.select("extraction_id", "slot").distinct()
    entity = (F.col("slot") + F.when(k % 3 == 0, 100).otherwise(0)).alias("entity_instance_id")
    text = F.concat(F.lit("blob "), "sequence")

    def pick(options: list[str], number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(option) for option in options]), (number + 1).cast("int"))

    return {
        "records": ev.select("extraction_id", "sequence", F.when(k % 4 < 3, pick(_KINDS, k % 4 % 3)).alias("record_type")),
        "combatEvents": ev.where(kind == "purchase").select("extraction_id", "sequence"),
        "entityInstances": users.select("extraction_id", F.col("slot").alias("entity_instance_id"), F.when(
            F.col("slot") % 6 == 0, "CParticleSystem").when(F.col("slot") % 6 > 1, "CHero").alias("class_name")),
        "entityEvents": ev.where(kind == "click").select(
            "extraction_id", "sequence", entity, pick(["create", "delete", "update"], k % 7 % 3).alias("event_type")),
        "propertyUpdates": ev.where(kind == "view").select("extraction_id", "sequence", entity),
        "checkpoints": ev.where(kind == "purchase").select(
            "extraction_id", "sequence", entity, pick(["creation", "completion", "interval"], k % 5 % 3)
            .alias("checkpoint_kind")),
        "blobs": ev.where(kind == "error").select(
            "extraction_id", "sequence", (F.col("sequence") - k % 7).alias("record_sequence"),
            F.base64(text.cast("binary")).alias("encoded"),
            F.when(k == 3, "0").otherwise(F.sha2(text, 256)).alias("blob_id")),
    }


_POLICY = {
    "s_records": """
SELECT extraction_id, sequence, k, CASE k % 4 WHEN 0 THEN 'CSVCMsg_VoiceData' WHEN 1 THEN 'CSVCMsg_PacketEntities'
  WHEN 2 THEN 'CMsgDOTAMatch' END AS record_type FROM ev""",
    "s_instances": """
SELECT DISTINCT extraction_id, slot AS entity_instance_id,
  CASE WHEN slot % 6 = 0 THEN 'CParticleSystem' WHEN slot % 6 > 1 THEN 'CHero' END AS class_name FROM ev""",
    "k_records": """
SELECT * FROM s_records WHERE record_type IS NULL OR record_type NOT IN ('CSVCMsg_VoiceData', 'CSVCMsg_PacketEntities')""",
    "k_instances": "SELECT * FROM s_instances WHERE class_name IS NULL OR class_name <> 'CParticleSystem'",
    "children": """
SELECT *, slot + CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END AS entity_instance_id FROM ev""",
    "kept": "SELECT c.* FROM children c SEMI JOIN k_instances i USING (extraction_id, entity_instance_id)",
    "k_events": "SELECT * FROM kept WHERE kind = 'click' AND k % 7 % 3 < 2",
    "k_updates": "SELECT * FROM kept WHERE kind = 'view'",
    "k_checkpoints": "SELECT * FROM kept WHERE kind = 'purchase' AND k % 5 % 3 < 2",
    "owners": """
SELECT extraction_id, sequence, false AS lost FROM k_records UNION ALL SELECT extraction_id, sequence, k = 42 FROM k_updates
UNION ALL SELECT extraction_id, sequence, false FROM k_checkpoints""",
    "k_blobs": """
SELECT b.* FROM ev b WHERE kind = 'error' AND EXISTS (SELECT 1 FROM owners o
  WHERE o.extraction_id = b.extraction_id AND o.sequence = b.sequence - b.k % 7)""",
}
_STORED_SQL = [("records", "k_records"), ("combatEvents", "(SELECT * FROM ev WHERE kind = 'purchase')"),
               ("entityInstances", "k_instances"), ("entityEvents", "k_events"), ("propertyUpdates", "k_updates"),
               ("checkpoints", "k_checkpoints"), ("blobs", "k_blobs")]


_LOST = """count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM owners o WHERE o.extraction_id = k_blobs.extraction_id
    AND o.sequence = k_blobs.sequence - k_blobs.k % 7 AND NOT o.lost))"""


@query("extraction_id:s sequence:i record_type:s", "SELECT * FROM k_records", _POLICY)
def kept_records(t: Telemetry) -> DataFrame:
    return staged.keep_records(_staged_tables(t)["records"])


@query("extraction_id:s sequence:i entity_instance_id:i", "SELECT * FROM k_updates", _POLICY)
def retained_children(t: Telemetry) -> DataFrame:
    tables = _staged_tables(t)
    return staged.retain_children(tables["propertyUpdates"], staged.keep_instances(tables["entityInstances"]))


@query("extraction_id:s sequence:i", "SELECT * FROM k_blobs", _POLICY)
def owned_blobs(t: Telemetry) -> DataFrame:
    return staged.apply_storage_policy(_staged_tables(t))["blobs"]


@query("extraction_id:s sequence:i", "SELECT extraction_id, sequence FROM ev WHERE kind = 'error' AND k = 3")
def blob_digest_violations(t: Telemetry) -> DataFrame:
    return staged.blob_digest_violations(_staged_tables(t)["blobs"].withColumn("value", F.unbase64("encoded")))


# --- staged files ---------------------------------------------------------------------------

_SCANNED = {
    "records": "SELECT extraction_id, sequence AS key FROM ev",
    "combatEvents": "SELECT extraction_id, sequence FROM ev",
    "entityInstances": "SELECT DISTINCT extraction_id, slot FROM ev",
    "entityEvents": "SELECT extraction_id, sequence FROM ev WHERE kind = 'click'",
    "propertyUpdates": "SELECT extraction_id, sequence FROM ev WHERE kind = 'view'",
    "checkpoints": "SELECT extraction_id, sequence FROM ev WHERE kind = 'purchase'",
    "blobs": "SELECT extraction_id, sequence FROM ev WHERE kind = 'error'",
    "heroPositions": "SELECT extraction_id, max(sequence) FROM ev GROUP BY extraction_id, slot, t_ms // 100",
    "winProbability": "SELECT extraction_id, max(sequence) FROM ev WHERE kind = 'view' GROUP BY extraction_id, t_ms",
}
_KEYS = {"entityInstances": "entity_instance_id", "winProbability": "sample_index"}


def _write_lines(lines: DataFrame, folder: str) -> None:
    """NDJSON files in a folder for each extraction; every 97th row arrives cut off."""
    text = F.when(F.col("key") % 97 == 5, F.expr("substring(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    lines.select("extraction_id", text.alias("value")).repartition("extraction_id").write.partitionBy(
        "extraction_id").text(folder)


@query("extraction_id:s table_name:s rows:i rescued_rows:i foreign_rows:i key_sum:i", """
SELECT extraction_id, table_name, count(*) AS rows, count(*) FILTER (WHERE key % 97 = 5) AS rescued_rows, 0 AS foreign_rows,
  sum(key) FILTER (WHERE key % 97 <> 5) AS key_sum
FROM (""" + " UNION ALL ".join(f"SELECT '{name}' AS table_name, x.* FROM ({sql}) x" for name, sql in _SCANNED.items())
       + ") GROUP BY ALL")
def scanned_staged_tables(t: Telemetry) -> DataFrame:
    """All nine staged tables written as files, one folder an extraction, and scanned."""
    folder = scratch_path(t.spark, "staged")
    tables = _staged_tables(t) | {
        "combatEvents": t.combat,
        "heroPositions": t.positions.withColumnRenamed("player_slot", "game_player_id"), "winProbability": t.probability}
    found = None
    for name, frame in tables.items():
        key = _KEYS.get(name, "sequence")
        if name == "winProbability":
            lines = frame.select("extraction_id", F.col(key).alias("key"), F.to_json(F.struct(
                F.col("extraction_id").alias("extractionId"), F.col("sample_index").alias("sampleIndex"),
                F.col("game_time_seconds").alias("gameTimeSeconds"),
                F.col("radiant_probability").alias("radiantProbability"), "source")).alias("value"))
        else:
            fields = [F.col("encoded" if (name, field.name) == ("blobs", "value") else field.name).alias(
                staged_name(name, field.name)) for field in table_schema(name).fields
                if field.name in frame.columns or (name, field.name) == ("blobs", "value")]
            lines = frame.select("extraction_id", F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("value"))
        _write_lines(lines, f"{folder}/{name}")
        if name == "winProbability":
            scanned = staged.probability_objects(staged.read_probability_lines(t.spark, f"{folder}/{name}/*")).select(
                F.col("extraction_id").alias(staged.OWNER), F.col("extraction_id"), F.col(key).alias("key"),
                F.col("invalid").alias("broken"))
        else:
            scanned = staged.scan_staged(t.spark, f"{folder}/{name}/*", name).select(
                staged.OWNER, "extraction_id", F.col(key).alias("key"), F.col("rescued").isNotNull().alias("broken"))
        scanned = scanned.withColumn("table_name", F.lit(name))
        found = scanned if found is None else found.unionByName(scanned)
    sound = ~F.col("broken")
    return found.groupBy(F.col(staged.OWNER).alias("owner"), "table_name").agg(
        F.count("*").alias("rows"), F.count_if("broken").alias("rescued_rows"),
        F.count_if(sound & (F.col("extraction_id") != F.col(staged.OWNER))).alias("foreign_rows"),
        F.sum(F.when(sound, F.col("key"))).alias("key_sum")).withColumnRenamed("owner", "extraction_id")


_FILES = {"lines": """
SELECT o_orderkey // 1000 AS n, 'f' || (o_orderkey // 1000) AS extraction_id, o_orderkey,
  '{"order":' || o_orderkey || ',"customer":' || o_custkey || '}' || chr(10) AS line FROM orders"""}


def _order_lines(t: Telemetry) -> DataFrame:
    return t.table("orders").select(
        F.expr("o_orderkey div 1000").alias("n"), F.concat(F.lit("f"), F.expr("o_orderkey div 1000")).alias("extraction_id"),
        "o_orderkey", F.concat(F.lit('{"order":'), "o_orderkey", F.lit(',"customer":'), "o_custkey", F.lit("}")).alias("value"))


def _inspected(t: Telemetry) -> DataFrame:
    folder = scratch_path(t.spark, "order-files")
    _order_lines(t).repartition("extraction_id").sortWithinPartitions("extraction_id", "o_orderkey").select(
        "extraction_id", "value").write.partitionBy("extraction_id").text(folder)
    # Pieces far smaller than a file, so that digests and counts run over several.
    return inspection.inspect_files(t.spark, folder, ".txt", piece_bytes=4096).withColumn("path", F.lit("orders.ndjson"))


@query("extraction_id:s actual_bytes:i actual_sha256:s actual_records:i ends_with_newline:b", """
SELECT extraction_id, sum(strlen(line)) AS actual_bytes, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS actual_sha256,
  count(*) AS actual_records, true AS ends_with_newline FROM lines GROUP BY extraction_id""", _FILES)
def inspected_files(t: Telemetry) -> DataFrame:
    return _inspected(t)


@query("extraction_id:s logical:s problem:s", """
SELECT DISTINCT extraction_id, 'records' AS logical, CASE n % 7 WHEN 1 THEN 'size mismatch' WHEN 2 THEN 'checksum mismatch'
  WHEN 3 THEN 'record count mismatch' END AS problem FROM lines WHERE n % 7 IN (1, 2, 3)
UNION ALL SELECT DISTINCT 'g' || extraction_id, 'records', 'missing file' FROM lines WHERE n % 7 = 4""", _FILES)
def staged_file_violations(t: Telemetry) -> DataFrame:
    """Files against what a manifest says of them; three kinds of entries are wrong and some files are not there."""
    number = F.col("n") % 7
    declared = _order_lines(t).groupBy("n", "extraction_id").agg(
        F.sum(F.length("value") + 1).alias("bytes"), F.count("*").alias("records"), F.sha2(F.concat(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("o_orderkey", "value"))), lambda row: row["value"]), "\n"), F.lit("\n")).cast(
            "binary"), 256).alias("sha256")).select(
        F.when(number == 4, F.concat(F.lit("g"), "extraction_id")).otherwise(F.col("extraction_id")).alias("extraction_id"),
        F.lit("records").alias("logical"), F.lit("orders.ndjson").alias("path"),
        (F.col("bytes") + F.when(number == 1, 1).otherwise(0)).alias("bytes"),
        (F.col("records") + F.when(number == 3, 1).otherwise(0)).alias("records"),
        F.when(number == 2, "0" * 64).otherwise(F.col("sha256")).alias("sha256"))
    return manifest.verify_staged_files(declared, _inspected(t))


# --- binary values --------------------------------------------------------------------------

_NOTE = r'{\"encoding\":\"base64\",\"valueBase64\":\"QQ==\"}'


def _bytes_json(path: str, value: str) -> str:
    return f"""'{{"encoding":"base64","fieldPath":"{path}","valueBase64":"' || to_base64(encode({value})) || '"}}'"""


_BINARY = {
    "written": f"""
SELECT coalesce(source, '') AS extraction_id, doc_id AS sequence, coalesce(text, '') AS body, coalesce(lang, '') AS tag FROM documents""",
    "whole": f"""
SELECT extraction_id, sequence, '{{"doc":' || sequence || ',"note":"{_NOTE}","parts":[{{"data":' || {_bytes_json("parts[0].data", "body")}
  || '}},{{"data":' || {_bytes_json("parts[1].data", "tag")} || ',"deep":[[' || {_bytes_json("parts[1].deep[0][0]", "tag")}
  || ']]}}]}}' AS payload FROM written""",
    "taken": f"""
SELECT extraction_id, sequence, '{{"doc":' || sequence || ',"note":"{_NOTE}","parts":[{{"data":{{"blobId":"' || sha256(body)
  || '"}}}},{{"data":{{"blobId":"' || sha256(tag) || '"}},"deep":[[{{"blobId":"' || sha256(tag) || '"}}]]}}]}}' AS payload FROM written""",
}


def _binary_documents(t: Telemetry) -> DataFrame:
    """Every document as a record that holds its text and language as bytes, two of them equal and one deep inside."""
    def data(path: str, value: Column) -> Column:
        coded = F.regexp_replace(F.base64(F.coalesce(value, F.lit("")).cast("binary")), r"\s", "")
        return F.struct(coded.alias("valueBase64"), F.lit("base64").alias("encoding"), F.lit(path).alias("fieldPath"))

    text, lang = F.col("text"), F.col("lang")
    parts = F.concat(F.lit("["), F.to_json(F.struct(data("parts[0].data", text).alias("data"))), F.lit(", "), F.to_json(F.struct(
        F.array(F.array(data("parts[1].deep[0][0]", lang))).alias("deep"), data("parts[1].data", lang).alias("data"))), F.lit("]"))
    return t.table("documents").select(
        F.coalesce("source", F.lit("")).alias("extraction_id"), F.col("doc_id").alias("sequence"), F.concat(
            F.lit('{"parts": '), parts, F.lit(', "note": "' + _NOTE + '", "doc": '), "doc_id", F.lit("}")).alias("payload"))


@query("extraction_id:s record_sequence:i field_path:s blob_id:s size:i", """
SELECT extraction_id, sequence AS record_sequence, 'parts[0].data' AS field_path, sha256(body) AS blob_id, strlen(body) AS size FROM written
UNION ALL SELECT extraction_id, sequence, unnest(['parts[1].data', 'parts[1].deep[0][0]']), sha256(tag), strlen(tag) FROM written""", _BINARY)
def extracted_blobs(t: Telemetry) -> DataFrame:
    return blobs.extract_blobs(_binary_documents(t))[1].withColumn("size", F.octet_length("value"))


@query("extraction_id:s sequence:i payload:s", "SELECT * FROM taken", _BINARY)
def blob_documents(t: Telemetry) -> DataFrame:
    return blobs.extract_blobs(_binary_documents(t))[0]


@query("extraction_id:s sequence:i payload_sha256:s", "SELECT *, sha256(payload) AS payload_sha256 FROM whole", _BINARY)
def restored_documents(t: Telemetry) -> DataFrame:
    documents_, taken = blobs.extract_blobs(_binary_documents(t))
    return blobs.restore_blobs(documents_, taken).withColumn("payload_sha256", F.sha2("payload", 256))


@query("extraction_id:s table_name:s stored_rows:i expected_rows:i rejected_rows:i orphan_rows:i distinct_sequences:i consistent:b",
       """
SELECT *, stored_rows = expected_rows AND rejected_rows = 0 AND orphan_rows = 0
  AND coalesce(distinct_sequences = stored_rows, true) AS consistent FROM (
""" + "\nUNION ALL ".join(f"""SELECT extraction_id, '{name}' AS table_name, {'count(*) FILTER (WHERE k <> 42)' if name == 'propertyUpdates' else 'count(*)'} AS stored_rows,
  count(*) AS expected_rows, 0 AS rejected_rows, {_LOST if name == 'blobs' else '0'} AS orphan_rows,
  {'count(*) FILTER (WHERE k <> 42)' if name == 'propertyUpdates' else 'NULL'} AS distinct_sequences FROM {source} GROUP BY extraction_id"""
                              for name, source in _STORED_SQL) + ")", _POLICY)
def ingest_reconciliation(t: Telemetry) -> DataFrame:
    tables = _staged_tables(t)
    tables["propertyUpdates"] = tables["propertyUpdates"].join(t.ev.select("sequence", "k"), "sequence")
    stored = staged.apply_storage_policy(tables)
    # Some stored updates are lost; blobs they owned become orphans.
    stored["propertyUpdates"] = stored["propertyUpdates"].where("k <> 42")
    return quality.ingest_reconciliation(tables, stored)


#: The nine derived tables and the queries that fill them.
_DERIVED = {
    "matches": "document_matches", "players": "document_players", "player_items": "player_items",
    "team_time_series": "team_time_series", "player_gold_events": "player_gold_events",
    "hero_draft_events": "hero_draft_events", "hero_position_samples": "imported_positions",
    "neutral_camp_farming_actions": "farming_actions", "win_probability_samples": "imported_probabilities",
}

#: Those of them whose queries give the rows of parsed overviews.
_FROM_OVERVIEWS = {"players": documents.player_rows, "player_items": documents.item_rows,
                   "hero_draft_events": documents.draft_rows}


@query("extraction_id:s record_counts:s", """
SELECT extraction_id, '{"players":' || p || ',"positions":' || q || ',"total":' || (p + q) || '}' AS record_counts
FROM (SELECT extraction_id, count(*) AS p FROM players GROUP BY 1) JOIN (SELECT extraction_id, count(*) AS q FROM positions GROUP BY 1)
USING (extraction_id)""")
def record_counts(t: Telemetry) -> DataFrame:
    return catalog.record_counts_json(catalog.analysis_row_counts({"players": t.players, "positions": t.positions}),
                                      ["players", "positions"])


@query("order_key:i extraction_id:s", """
SELECT o_orderkey AS order_key, sha256('r' || o_custkey || chr(10) || 'reader' || chr(10) || 'v' || (o_orderkey % 2) || chr(10) || '3'
  || chr(10) || o_orderpriority) AS extraction_id FROM orders""")
def extraction_identities(t: Telemetry) -> DataFrame:
    return t.table("orders").select(F.col("o_orderkey").alias("order_key"), manifest.extraction_identity(
        F.concat(F.lit("r"), "o_custkey"), F.lit("reader"), F.concat(F.lit("v"), F.col("o_orderkey") % 2), F.lit("3"),
        F.col("o_orderpriority")).alias("extraction_id"))


# --- manifests ------------------------------------------------------------------------------


def _manifests(t: Telemetry) -> DataFrame:
    o = F.col("o_orderkey")
    digest = F.sha2(o.cast("string"), 256)
    files = {logical: F.struct(
        F.lit(name).alias("path"), digest.alias("sha256"),
        F.when((o % 13 == 0) & F.lit(logical == "blobs"), -1).otherwise(o % 100 + number).alias("bytes"),
        (o % 10).alias("records")).alias(logical) for number, (logical, (name, _)) in enumerate(fixed.STAGED_FILES.items())}
    document = F.struct(
        F.when(o % 17 == 0, 9).otherwise(1 + o % 3).alias("schemaVersion"), digest.alias("extractionId"),
        (o + 1).cast("string").alias("matchId"), digest.alias("replaySha256"), F.lit("3").alias("exporterVersion"),
        F.lit("a").alias("startedAt"), F.lit("b").alias("completedAt"), F.lit(5).alias("elapsedMs"),
        F.struct(F.lit("reader").alias("name"), F.lit("v1").alias("version")).alias("parser"),
        F.struct(F.lit(600).alias("maxOutputBytes"), F.lit(60).alias("maxRecords")).alias("config"),
        F.struct(*files.values()).alias("files"))
    return manifest.parse_manifests(t.table("orders").select(F.to_json(document).alias("value")))


_MANIFEST = {
    "manifests": """
SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS extraction_id, o_orderkey AS o,
  CASE WHEN o_orderkey % 17 = 0 THEN 9 ELSE 1 + o_orderkey % 3 END AS version FROM orders""",
    "entries": """
SELECT m.*, n, CASE WHEN n < 7 THEN 1 ELSE n - 5 END AS since, CASE WHEN o % 13 = 0 AND n = 2 THEN -1 ELSE o % 100 + n END AS bytes,
  o % 10 AS records FROM manifests m, range(9) AS files(n)""",
}


@query("extraction_id:s total_bytes:i total_records:i", """
SELECT extraction_id, sum(bytes) AS total_bytes, sum(records) AS total_records FROM entries WHERE since <= version
GROUP BY extraction_id HAVING sum(bytes) > 600 OR sum(records) > 60""", _MANIFEST)
def limit_violations(t: Telemetry) -> DataFrame:
    return manifest.enforce_limits(_manifests(t))


@query("extraction_id:s problem:s", """
SELECT extraction_id, 'unsupported schema version' AS problem FROM manifests WHERE version = 9
UNION ALL SELECT extraction_id, 'invalid file entry: blobs' FROM manifests WHERE o % 13 = 0""", _MANIFEST)
def manifest_violations(t: Telemetry) -> DataFrame:
    return manifest.manifest_violations(_manifests(t))


# --- entity state ---------------------------------------------------------------------------


def _state_tables(t: Telemetry) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = t.ev.withColumn("entity_instance_id", F.col("slot"))
    common = ["extraction_id", "entity_instance_id", "sequence", F.col("sequence").alias("demo_tick"),
              F.lit(None).cast("bigint").alias("net_tick")]
    entry = "struct<propertyPath: string, valueType: string, value: string>"
    listed = F.array(*[F.struct(F.lit(path).alias("propertyPath"), F.lit("int").alias("valueType"),
                                value.cast("string").alias("value")).cast(entry)
                       for path, value in (("click", F.col("k")), ("base", F.col("k") + 1))])
    checkpoints = ev.where("kind = 'signup'").select(
        *common, F.lit("creation").alias("checkpoint_kind"),
        F.when(F.col("k") % 10 != 9, F.col("t_ms") / 1000.0).alias("checkpoint_game_time"), F.to_json(listed).alias("properties"))
    updates = ev.where("kind IN ('click', 'view')").select(
        *common, F.col("kind").alias("property_path"), F.lit("int").alias("value_type"),
        F.col("cents").cast("string").alias("value"), F.when(F.col("k") % 10 != 8, F.col("t_ms") / 1000.0).alias("game_time"))
    requests = ev.where("kind = 'error'").select(
        F.col("sequence").alias("request_id"), "extraction_id", "entity_instance_id",
        (F.col("t_ms") / 1000.0 + 30).alias("selected_game_time"))
    return checkpoints, updates, requests


_STATE = {
    "requests": "SELECT sequence AS request_id, extraction_id, slot, t_ms / 1000.0::DOUBLE + 30 AS asked FROM ev WHERE kind = 'error'",
    "points": "SELECT extraction_id, slot, sequence, k, t_ms / 1000.0::DOUBLE AS game_time FROM ev WHERE kind = 'signup' AND k % 10 <> 9",
    "writes": """
SELECT extraction_id, slot, sequence, kind AS property_path, CAST(cents AS VARCHAR) AS value, t_ms / 1000.0::DOUBLE AS game_time
FROM ev WHERE kind IN ('click', 'view') AND k % 10 <> 8""",
    "bases": """
SELECT r.*, p.sequence AS base_sequence, p.k, p.game_time AS base_time FROM requests r
LEFT JOIN points p ON p.extraction_id = r.extraction_id AND p.slot = r.slot AND p.game_time <= r.asked
QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY p.game_time DESC NULLS LAST, p.sequence DESC) = 1""",
    "candidate_values": """
SELECT request_id, 'click' AS property_path, CAST(k AS VARCHAR) AS value, base_sequence AS sequence, base_time AS game_time,
  'checkpoint' AS source FROM bases WHERE base_sequence IS NOT NULL
UNION ALL SELECT request_id, 'base', CAST(k + 1 AS VARCHAR), base_sequence, base_time, 'checkpoint' FROM bases
WHERE base_sequence IS NOT NULL
UNION ALL SELECT b.request_id, w.property_path, w.value, w.sequence, w.game_time, 'update' FROM bases b
JOIN writes w ON w.extraction_id = b.extraction_id AND w.slot = b.slot AND w.game_time <= b.asked
  AND w.sequence > coalesce(b.base_sequence, 0)""",
}


@query("request_id:i property_path:s value:s source_sequence:i source_game_time:d source:s", """
SELECT request_id, property_path, value, sequence AS source_sequence, game_time AS source_game_time, source FROM candidate_values
QUALIFY row_number() OVER (PARTITION BY request_id, property_path ORDER BY sequence DESC) = 1""", _STATE)
def entity_state_at(t: Telemetry) -> DataFrame:
    return versions.entity_state_at(*_state_tables(t))


@query("extraction_id:s entity_instance_id:i sequence:i value:s", """
SELECT extraction_id, slot AS entity_instance_id, sequence, CAST(cents AS VARCHAR) AS value FROM ev WHERE kind = 'click'
  AND (extraction_id, slot) IN (SELECT extraction_id, slot FROM ev WHERE kind = 'error' AND k = 5)""")
def entity_property_history(t: Telemetry) -> DataFrame:
    requests = t.ev.where("kind = 'error' AND k = 5").select(
        "extraction_id", F.col("slot").alias("entity_instance_id"), F.lit("click").alias("property_path"))
    return versions.entity_property_history(_state_tables(t)[1], requests)


@query("extraction_id:s sequence:i property_path:s value:s", """
SELECT extraction_id, sequence, 'click' AS property_path, CAST(k AS VARCHAR) AS value FROM ev WHERE kind = 'signup'
UNION ALL SELECT extraction_id, sequence, 'base', CAST(k + 1 AS VARCHAR) FROM ev WHERE kind = 'signup'""")
def checkpoint_properties(t: Telemetry) -> DataFrame:
    return versions.checkpoint_properties(_state_tables(t)[0])


_GOLD_SQL = """
SELECT e.extraction_id, e.sequence, c.game_player_id, e.slot AS player_slot, e.team_id, e.t_ms / 1000.0::DOUBLE AS game_time_seconds,
  e.cents AS total_gold_earned
FROM ev e JOIN bounds b ON b.extraction_id = e.extraction_id AND e.sequence >= b.start_sequence AND e.sequence < b.stop_sequence
JOIN candidates c ON c.extraction_id = e.extraction_id AND c.player_slot = e.slot AND c.team_id = e.team_id
WHERE e.k % 9 <> 0 AND e.k % 25 <> 0 AND e.k % 31 <> 0"""


@query("extraction_id:s sequence:i game_player_id:i player_slot:i team_id:i game_time_seconds:d total_gold_earned:i", _GOLD_SQL)
def player_gold_events(t: Telemetry) -> DataFrame:
    k = F.col("k")
    slot = F.format_string("%04d", F.floor(F.col("slot") / 2).cast("int"))
    updates = t.ev.select(
        "extraction_id", "sequence", F.col("team_id").cast("bigint").alias("entity_instance_id"), F.concat(
            F.lit("m_vecDataTeam."), slot, F.when(k % 9 == 0, ".m_iOther").otherwise(".m_iTotalEarnedGold"))
        .alias("property_path"), F.when(k % 25 == 0, -F.col("cents") - 1).otherwise(F.col("cents")).cast("string").alias("value"),
        F.when(k % 31 != 0, F.col("t_ms") / 1000.0).alias("game_time"))
    classes = t.ev.select("extraction_id", "team_id").distinct().select(
        "extraction_id", F.col("team_id").cast("bigint").alias("entity_instance_id"), F.when(
            F.col("team_id") == 2, fixed.RADIANT_DATA_CLASS).otherwise(fixed.DIRE_DATA_CLASS).alias("class_name"))
    return documents.player_gold_events(updates, classes, bounds(t), t.players, t.metadata_candidates)


# --- item snapshots -------------------------------------------------------------------------


def _snapshots(t: Telemetry) -> DataFrame:
    key, step = F.col("p_partkey"), F.col("step")
    label = F.when((key % 7 == 0) & (step == 3), F.lit("renamed thing")).otherwise(F.col("p_name"))
    return t.table("part").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(
        (key + step) % 4 != 0).select(
        step.alias("sequence"), F.concat(F.lit("v"), step).alias("version"), (key + 1).alias("id"),
        F.concat(F.when(key % 5 == 0, "item_recipe_").otherwise("item_"), F.replace(label, F.lit(" "), F.lit("_"))).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name_english_loc"),
        F.when(key % 3 == 1, F.col("p_brand")).alias("name_loc"), (F.col("p_size") + F.when(
            (key % 11 == 0) & (step == 2), 1).otherwise(0)).alias("neutral_item_tier"))


_ITEMS = {
    "sources": """
SELECT step AS sequence, 'v' || step AS version, p_partkey AS p, p_partkey + 1 AS item_id, p_name, p_brand, p_size,
  CASE WHEN p_partkey % 7 = 0 AND step = 3 THEN 'renamed thing' ELSE p_name END AS label
FROM part, (SELECT unnest([1, 2, 3]) AS step) steps WHERE (p_partkey + step) % 4 <> 0""",
    "items": """
SELECT sequence, version, item_id, p % 5 = 0 AS recipe,
  CASE WHEN p % 5 = 0 THEN 'item_recipe_' ELSE 'item_' END || replace(label, ' ', '_') AS internal_name,
  CASE p % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE
    array_to_string(list_transform(string_split(label, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
    || CASE WHEN p % 5 = 0 THEN ' Recipe' ELSE '' END END AS name,
  CASE WHEN p % 5 = 0 THEN 'recipe' ELSE replace(label, ' ', '_') END AS image_slug,
  p_size + CASE WHEN p % 11 = 0 AND sequence = 2 THEN 1 ELSE 0 END AS neutral_tier FROM sources""",
}
_ITEM = "item_id:i name:s internal_name:s image_slug:s neutral_tier:i recipe:b"


@query("sequence:i " + _ITEM, "SELECT * FROM items", _ITEMS)
def normalized_items(t: Telemetry) -> DataFrame:
    return items.normalize_items(_snapshots(t))


@query(_ITEM + " active:b first_seen_version:s last_seen_version:s", """
SELECT *, last_sequence = (SELECT max(sequence) FROM items) AS active FROM (
  SELECT item_id, arg_max(name, sequence) AS name, arg_max(internal_name, sequence) AS internal_name,
    arg_max(image_slug, sequence) AS image_slug, arg_max(neutral_tier, sequence) AS neutral_tier, arg_max(recipe, sequence) AS recipe,
    min(version) AS first_seen_version, max(version) AS last_seen_version, max(sequence) AS last_sequence FROM items GROUP BY item_id)""",
       _ITEMS)
def item_history(t: Telemetry) -> DataFrame:
    return items.snapshot_history(items.normalize_items(_snapshots(t)))


@query("item_id:i change:s changes:s", """
SELECT *, CASE WHEN change = 'changed' THEN array_to_string(list_filter([
  CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.internal_name <> b.internal_name THEN 'internal_name' END,
  CASE WHEN a.image_slug <> b.image_slug THEN 'image_slug' END, CASE WHEN a.neutral_tier <> b.neutral_tier THEN 'neutral_tier' END],
  lambda f: f IS NOT NULL), ',') END AS changes
FROM (SELECT coalesce(a.item_id, b.item_id) AS item_id, a, b, CASE WHEN a.item_id IS NULL THEN 'added' WHEN b.item_id IS NULL THEN 'removed'
    ELSE 'changed' END AS change
  FROM (SELECT * FROM items WHERE sequence = 2) a FULL JOIN (SELECT * FROM items WHERE sequence = 3) b ON a.item_id = b.item_id)
WHERE change <> 'changed' OR a.name <> b.name OR a.internal_name <> b.internal_name OR a.image_slug <> b.image_slug
  OR a.neutral_tier <> b.neutral_tier""", _ITEMS)
def item_changes(t: Telemetry) -> DataFrame:
    normal = items.normalize_items(_snapshots(t))
    return items.snapshot_diff(normal.where("sequence = 2"), normal.where("sequence = 3")).withColumn(
        "changes", F.array_join("fields.field", ","))


@query("item_id:i sequence:i from_name:s to_name:s", """
SELECT item_id, sequence, previous AS from_name, internal_name AS to_name FROM (
  SELECT *, lag(internal_name) OVER (PARTITION BY item_id ORDER BY sequence) AS previous FROM items)
WHERE previous <> internal_name AND item_id % 2 = 0""", _ITEMS)
def item_renames(t: Telemetry) -> DataFrame:
    normal = items.normalize_items(_snapshots(t))
    names = normal.groupBy("item_id").agg(F.min_by("internal_name", "sequence").alias("from_name"),
                                          F.max_by("internal_name", "sequence").alias("to_name"))
    return items.rename_guard(normal, names.where("item_id % 2 = 1"))


@query("sequence:i problem:s", """
SELECT DISTINCT step AS sequence, problem FROM part, (SELECT unnest([1, 2]) AS step) steps, LATERAL (SELECT unnest([
  CASE WHEN p_partkey % 50 = 0 AND step = 1 THEN 'invalid id' END, CASE WHEN p_partkey % 60 = 1 AND step = 2 THEN 'empty internal name' END,
  CASE WHEN p_size = 50 THEN 'invalid recipes' END]) AS problem) WHERE problem IS NOT NULL
UNION SELECT 1, 'duplicate id' FROM part WHERE p_partkey % 50 = 0 HAVING count(*) > 1""")
def item_snapshot_checks(t: Telemetry) -> DataFrame:
    key, step = F.col("p_partkey"), F.col("step")
    source = t.table("part").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        step.alias("sequence"), F.concat(F.lit("v"), step).alias("version"),
        F.when((key % 50 == 0) & (step == 1), 0).otherwise(key + 1).alias("id"),
        F.when((key % 60 == 1) & (step == 2), " ").otherwise(F.col("p_name")).alias("name"),
        F.col("p_size").alias("neutral_item_tier"), F.when(F.col("p_size") != 50, F.array("p_type")).alias("recipes"))
    return items.snapshot_checks(source)


# --- counts of all derived tables -----------------------------------------------------------


@query("extraction_id:s table_name:s row_count:i", " UNION ALL ".join(
    f"SELECT extraction_id, '{name}' AS table_name, count(*) AS row_count FROM ({ENTRIES[source].statement()}) AS x GROUP BY extraction_id"
    for name, source in _DERIVED.items()))
def analysis_row_counts(t: Telemetry) -> DataFrame:
    tables = {name: ENTRIES[source].build(t) for name, source in _DERIVED.items() if name not in _FROM_OVERVIEWS}
    # One parse of the documents serves the tables of their parts.
    parsed = write_once(documents.overviews(t.records, "players", "draft"), "overviews")
    tables |= {name: rows(parsed) for name, rows in _FROM_OVERVIEWS.items()}
    return catalog.analysis_row_counts({name: tables[name] for name in _DERIVED})
