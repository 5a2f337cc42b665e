"""Staged files, policy, publication, documents, sampling and streams on literal rows."""

import base64
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.operators import documents, items, quality, series, versions
from arenaflow.operators.lens import project_to_bounds
from arenaflow.sources import catalog, inspection, manifest, staged
from arenaflow.streaming import sampler, timelines


def write_lines(path, objects):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(entry) + "\n" for entry in objects))


def staged_tables(spark, folder):
    blob = base64.b64encode(b"bytes").decode()
    digest = hashlib.sha256(b"bytes").hexdigest()
    data = {
        "records": [("CMsgDOTAMatch", 1), ("CSVCMsg_VoiceData", 2), (None, 3)],
        "instances": [("CHero", 11), ("CParticleSystem", 12)],
    }
    write_lines(folder / "records.ndjson", [
        {"extractionId": "e", "sequence": str(number), "category": "c", "recordType": kind, "payload": {"a": [1, "x"]}}
        for kind, number in data["records"]])
    write_lines(folder / "entity_instances.ndjson", [
        {"extractionId": "e", "sequence": number, "entityInstanceId": str(number), "entityIndex": 1, "serial": 1,
         "handle": 18446744073709551615, "classId": 1, "className": kind} for kind, number in data["instances"]])
    write_lines(folder / "entity_events.ndjson", [
        {"extractionId": "e", "sequence": 20 + number, "entityInstanceId": str(entity), "eventType": kind, "synthetic": False}
        for number, (kind, entity) in enumerate([("create", 11), ("delete", 11), ("enter", 11), ("create", 12)])])
    write_lines(folder / "property_updates.ndjson", [
        {"extractionId": "e", "sequence": 30 + number, "entityInstanceId": str(entity), "propertyPath": "p",
         "valueType": "t", "value": value} for number, (entity, value) in enumerate([(11, 5), (11, None), (12, "x")])])
    write_lines(folder / "checkpoints.ndjson", [
        {"extractionId": "e", "sequence": 40 + number, "entityInstanceId": str(entity), "checkpointKind": kind,
         "checkpointGameTime": 1.5, "properties": [{"propertyPath": "p", "valueType": "t", "value": 7}]}
        for number, (kind, entity) in enumerate([("creation", 11), ("interval", 11), ("completion", 12)])])
    write_lines(folder / "blobs.ndjson", [
        {"extractionId": "e", "sequence": 50 + owner, "recordSequence": owner, "fieldPath": "f", "blobId": digest,
         "valueBase64": blob} for owner in (1, 2, 30, 32, 40, 42)])
    write_lines(folder / "combat_events.ndjson", [
        {"extractionId": "e", "sequence": "60", "eventType": fixed.DEATH, "gameTime": 1.0, "assistPlayers": [1, 2]}])
    return {logical: staged.read_staged(spark, str(folder / name), logical)
            for logical, (name, since) in fixed.STAGED_FILES.items() if since == 1}


def test_policy_and_reconciliation(spark, tmp_path):
    tables = staged_tables(spark, tmp_path / "e")
    stored = staged.apply_storage_policy(tables)
    assert {name: frame.count() for name, frame in stored.items()} == {
        "records": 2, "combatEvents": 1, "entityInstances": 1, "entityEvents": 2, "propertyUpdates": 2, "checkpoints": 1,
        "blobs": 3}
    assert stored["entityInstances"].first().handle == 18446744073709551615
    assert [row.value for row in stored["propertyUpdates"].orderBy("sequence").collect()] == ["5", "null"]
    assert versions.checkpoint_properties(stored["checkpoints"]).first().value == "7"
    assert staged.blob_digest_violations(stored["blobs"]).count() == 0
    assert all(row.consistent for row in quality.ingest_reconciliation(tables, stored).collect())
    broken = {**stored, "records": tables["records"], "entityInstances": stored["entityInstances"].limit(0)}
    wrong = {row.table_name: row for row in quality.ingest_reconciliation(tables, broken).where("NOT consistent").collect()}
    assert wrong["records"].rejected_rows == 1
    assert wrong["entityEvents"].orphan_rows == 2 and wrong["entityInstances"].stored_rows == 0


def test_malformed_rows_fail_the_scan(spark, tmp_path):
    path = tmp_path / "records.ndjson"
    path.write_text('{"extractionId":"e","sequence":1}\n{"extractionId":\n')
    with pytest.raises(Exception):
        staged.read_staged(spark, str(path), "records").collect()


def test_staged_files_are_verified(spark, tmp_path):
    content = {"records.ndjson": b"{}\n{}\n", "combat_events.ndjson": b"{}\n{}", "blobs.ndjson": b"",
               "entity_instances.ndjson": b"{}\n", "entity_events.ndjson": b"{}\n", "property_updates.ndjson": b"{}\n"}
    folder = tmp_path / "e1"
    folder.mkdir()
    files = {}
    for logical, (name, _) in fixed.STAGED_FILES.items():
        data = content.get(name, b"")
        files[logical] = {"path": name, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "records": data.count(b"\n")}
        if logical != "checkpoints":
            (folder / name).write_bytes(data)
    files["entityInstances"]["records"] = 2
    files["entityEvents"]["sha256"] = "0" * 64
    files["propertyUpdates"]["bytes"] = 99
    files["checkpoints"]["bytes"] = 3
    document = {"schemaVersion": 1, "extractionId": "e1", "files": files, "config": {"maxOutputBytes": 1000, "maxRecords": 5}}
    parsed = manifest.parse_manifests(spark.createDataFrame([(json.dumps(document),)], "value STRING"))
    listed = manifest.manifest_files(parsed)
    assert listed.count() == 7
    problems = manifest.verify_staged_files(listed, inspection.inspect_files(spark, str(tmp_path), ".ndjson", piece_bytes=3))
    assert {row.logical: row.problem for row in problems.collect()} == {
        "combatEvents": "no trailing newline", "entityInstances": "record count mismatch", "entityEvents": "checksum mismatch",
        "propertyUpdates": "size mismatch", "checkpoints": "missing file"}
    assert [row.total_records for row in manifest.enforce_limits(parsed).collect()] == [7]


def _attempts(spark, *names):
    return spark.createDataFrame([(name, "succeeded") for name in names], "extraction_id STRING, status STRING")


def _published(spark, warehouse, **only):
    return sorted(row.n for row in catalog.read_published(spark, warehouse, "facts", **only).collect())


def test_publication_is_idempotent_and_keeps_every_load(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    rows = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "extraction_id STRING, n INT")
    assert catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, "e1"), "b1") == "loaded"
    assert catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, "e1"), "b2") == "already_loaded"
    # The same label with a superset adds the new extraction and hides nothing.
    assert catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, "e1", "e2"), "b1") == "loaded"
    assert _published(spark, warehouse) == [1, 2, 3]
    assert _published(spark, warehouse, extraction_id="e1") == [1, 2]


def test_a_failed_load_is_recorded_and_can_be_repeated(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    rows = spark.createDataFrame([("e1", 1), ("e1", 2)], "extraction_id STRING, n INT")
    broken = rows.select("extraction_id", F.raise_error(F.lit("no")).alias("m"))
    with pytest.raises(Exception):
        catalog.publish_extractions(spark, warehouse, {"facts": rows, "more": broken}, _attempts(spark, "e1"), "b1")
    kept = spark.read.parquet(f"{warehouse}/catalog/extractions").collect()
    assert [(row.status, row.error_code is not None) for row in kept] == [("failed", True)]
    assert _published(spark, warehouse) == []
    assert catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, "e1"), "b2") == "loaded"
    assert _published(spark, warehouse) == [1, 2]


def test_of_two_loads_at_once_one_counts(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    loads = {label: spark.createDataFrame([("e1", number), ("e1", number + 1)], "extraction_id STRING, n INT")
             for label, number in (("a", 1), ("b", 11))}
    with ThreadPoolExecutor(2) as pool:
        ends = list(pool.map(lambda label: catalog.publish_extractions(
            spark, warehouse, {"facts": loads[label]}, _attempts(spark, "e1"), label), loads))
    assert sorted(ends) == ["already_loaded", "loaded"]
    assert _published(spark, warehouse) == ([1, 2] if ends[0] == "loaded" else [11, 12])


def test_a_version_of_the_log_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "log" / "0.json")
    assert catalog._create(spark, path, "one") and not catalog._create(spark, path, "two")
    assert (tmp_path / "log" / "0.json").read_text() == "one"


def test_small_loads_write_one_file_a_bucket_and_are_compacted(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    rows = spark.createDataFrame([(f"e{number}", number) for number in range(40)], "extraction_id STRING, n INT").repartition(9)
    for part in range(3):
        names = [f"e{number}" for number in range(40) if number % 3 <= part]
        catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, *names), f"b{part}")
    attempts = list((tmp_path / "w" / "facts").glob("attempt=*"))
    assert len(attempts) == 3
    for bucket in (tmp_path / "w" / "facts").glob("attempt=*/bucket=*"):
        assert len(list(bucket.glob("part-*"))) == 1
    made = catalog.compact(spark, warehouse, ["facts"])
    assert _published(spark, warehouse) == list(range(40))
    assert {row.attempt for row in catalog.committed_attempts(spark, warehouse).collect()} == {made}
    assert catalog.compact(spark, warehouse, ["facts"]) is None
    assert catalog.publish_extractions(spark, warehouse, {"facts": rows}, _attempts(spark, "e5"), "again") == "already_loaded"


def test_positions_reject_the_whole_extraction(spark):
    def line(extraction, **changes):
        return {"extractionId": extraction, "sequence": "1", "demoTick": "-5", "gameTimeMilliseconds": "100",
                "gamePlayerId": "0", "heroId": "1", "teamId": "2", "worldX": "10.5", "worldY": "-20", **changes}

    bad = [{"gameTimeMilliseconds": "150"}, {"gamePlayerId": "10"}, {"heroId": "1.0"}, {"teamId": "4"}, {"worldX": "9000"},
           {"worldY": "NaN"}, {"sequence": None}, {"heroId": "2"}]
    data = [line("good")] + [line(f"bad{number}", **changes) for number, changes in enumerate(bad)] + [
        line(f"bad{number}") for number in range(len(bad))]
    from arenaflow.schemas import staged_schema
    schema = staged_schema("heroPositions")
    frame = spark.createDataFrame([tuple(entry[name] for name in schema.fieldNames()) for entry in data], schema)
    strict = staged.strict_positions(frame.withColumn(staged.OWNER, F.col("extractionId")))
    names = ["good"] + [f"bad{number}" for number in range(len(bad))]
    candidates = spark.createDataFrame([(name, 0, 0, 2) for name in names],
                                       "extraction_id STRING, game_player_id INT, player_slot BIGINT, team_id INT")
    players = spark.createDataFrame([(name, 0, 2, 1) for name in names],
                                    "extraction_id STRING, player_slot BIGINT, team_id INT, hero_id INT")
    declared = strict.groupBy("extraction_id").agg(F.count("*").alias("declared_rows"))
    kept = documents.hero_position_samples(strict, candidates, players, declared).collect()
    assert [(row.extraction_id, row.world_x) for row in kept] == [("good", 10.5)]
    assert [row.extraction_id for row in documents.position_mismatches(
        strict.where("NOT invalid"), candidates, players).collect()] == ["bad7"]


def test_probability_types_are_strict(spark):
    good = '{"extractionId":"%s","sampleIndex":%s,"gameTimeSeconds":%s,"radiantProbability":%s,"source":"%s"}'
    lines = [good % ("a", 0, 0, 1, "graph_history"), good % ("a", 1, 1.5, 0.25, "graph_history"),
             good % ("b", '"0"', 0, 1, "graph_history"), good % ("c", 0, 0, 1.5, "graph_history"),
             good % ("d", 0, 0, 1, "graph_history"), good % ("d", 1, 0, 1, "spectator_updates"),
             good % ("e", 0, -1, 1, "graph_history"), good % ("f", 0, 0, 1, "guess"), good % ("g", "1.0", 0, 1, "graph_history")]
    owner = F.coalesce(F.get_json_object("value", "$.extractionId"), F.lit("h")).alias(staged.OWNER)
    frame = spark.createDataFrame([(line,) for line in lines] + [("[]",)], "value STRING").select("value", owner)
    declared = frame.groupBy(F.col(staged.OWNER).alias("extraction_id")).agg(F.count("*").alias("declared_rows"))
    kept = staged.import_probabilities(staged.probability_objects(frame), declared).collect()
    assert sorted((row.extraction_id, row.sample_index, row.radiant_probability) for row in kept) == [
        ("a", 0, 1.0), ("a", 1, 0.25)]


def test_coalescing_upsert_keeps_first_and_refreshes(spark):
    frame = spark.createDataFrame([("m", 1, "first", 5, None), ("m", 2, "second", None, 3), ("m", 3, "third", 7, None)],
                                  "match_id STRING, n INT, origin STRING, rank INT, count INT")
    row = catalog.coalescing_upsert(frame, ["match_id"], ["n"], ["rank", "count"]).first()
    assert (row.n, row.origin, row.rank, row["count"]) == (1, "first", 7, 3)


QUOTA = sampler.Quota()


def candidates(spark, ranks, window="2026-01-01T10:00:00.000Z"):
    return spark.createDataFrame([(str(number + 1), window, rank) for number, rank in enumerate(ranks)],
                                 "match_id STRING, window_start STRING, avg_rank_tier INT")


def chosen(frame):
    return sorted((row.match_id, row.selection_group, row.selection_hash)
                  for row in sampler.stratified_select(frame, QUOTA).collect())


def test_selection_groups_and_order(spark):
    frame = candidates(spark, range(20, 80))
    picked = chosen(frame)
    assert sorted(int(match) + 19 for match, group, _ in picked if group == "priority") == list(range(56, 80))
    assert sum(group == "control" for _, group, _ in picked) == 6 and len({match for match, _, _ in picked}) == 30
    assert picked == chosen(frame.orderBy(F.col("avg_rank_tier").desc()).repartition(1))
    window = "2026-01-01T10:00:00.000Z"
    for match, group, digest in picked:
        text = "\0".join([QUOTA.version, group, window, match])
        assert digest == hashlib.sha256(text.encode()).hexdigest()


def test_selection_fills_and_falls_short(spark):
    counts = {}
    for _, group, _ in chosen(candidates(spark, [80, 79, 78, 77] + [None] * 31)):
        counts[group] = counts.get(group, 0) + 1
    assert counts == {"priority": 4, "control": 6, "fill": 20}
    assert len(chosen(candidates(spark, [50] * 8))) == 8
    with pytest.raises(ValueError):
        sampler.Quota(5, 4, 2)


def test_candidates_are_validated(spark):
    base = {"match_id": 5, "start_time": 1767225600, "lobby_type": 7}
    cases = [(base, False), ({**base, "match_id": "77"}, False), ({**base, "match_id": "077"}, True), ({**base, "match_id": 0}, True),
             ({**base, "avg_rank_tier": 0}, True), ({**base, "avg_rank_tier": 100}, True), ({**base, "avg_rank_tier": None}, False),
             ({**base, "duration": -1}, True), ({**base, "start_time": "1"}, True), ({**base, "cluster": 1.5}, True), ([], True)]
    frame = spark.createDataFrame([(number, json.dumps(value)) for number, (value, _) in enumerate(cases)], "n INT, value STRING")
    parsed = sampler.parse_candidates(frame)
    assert [row.invalid for row in parsed.orderBy("n").collect()] == [invalid for _, invalid in cases]
    assert sampler.ranked_candidates(parsed).first().window_start == "2026-01-01T00:00:00.000Z"


def test_late_candidates_are_stored_but_not_selected(spark, tmp_path):
    store = sampler.WindowSampler(str(tmp_path), sampler.Quota(2, 1, 1, "v"))
    hour = 1767225600

    def batch(rows):
        return spark.createDataFrame(
            [(str(match), "w%d" % ((time - hour) // 3600), time, 50, None) for match, time in rows],
            "match_id STRING, window_start STRING, start_time BIGINT, avg_rank_tier INT, num_rank_tier INT")

    def selected():
        frame = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/selections")
        return sorted(row.match_id for row in frame.collect())

    store(batch([(1, hour + 10), (2, hour + 3600)]), 0)
    assert selected() == []
    store(batch([(3, hour + 3600 + 5400)]), 1)
    assert selected() == ["1"]
    store(batch([(4, hour + 20)]), 2)
    store(batch([(4, hour + 20)]), 2)
    assert selected() == ["1"]
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/candidates")
    assert stored.count() == 4


def test_empty_hours_are_reported(spark):
    frame = candidates(spark, [5], "1970-01-01T01:00:00.000Z")
    found = sampler.window_summary(frame, sampler.stratified_select(frame, QUOTA), 0, 7200, QUOTA).orderBy("window_seconds")
    assert [(row.candidate_count, row.selected_count, row.under_target) for row in found.collect()] == [
        (0, 0, True), (1, 1, True), (0, 0, True)]


def test_clock_freezes_while_paused(spark):
    schema = ("extraction_id STRING, sequence BIGINT, net_tick BIGINT, millis_per_tick DOUBLE, game_start_time DOUBLE, "
              "total_paused_ticks BIGINT, paused BOOLEAN, direct_game_time DOUBLE")
    frame = spark.createDataFrame([
        ("m", 1, 10, 100.0, None, None, None, None), ("m", 2, None, None, None, None, None, 7.0),
        ("m", 3, 50, 100.0, 2.0, None, None, None), ("m", 4, 60, None, None, None, True, None),
        ("m", 5, 80, None, None, 20, None, None), ("m", 6, 81, None, None, None, False, None)], schema)
    found = timelines.pause_safe_clock(frame, cell=2).orderBy("sequence").collect()
    assert [row.clock for row in found] == [None, 7.0, 3.0, 3.0, 3.0, pytest.approx(4.1)]


def test_counters_have_a_baseline_and_no_repeats(spark):
    seen = spark.createDataFrame(
        [("m", "a", 1, 1, 5), ("m", "a", 3, 2, 9), ("m", "a", 5, 3, 9), ("m", "a", 6, 4, 11), ("m", "a", 6, 5, 12), ("m", "b", 3, 6, 4),
         ("m", "a", 7, 7, 12), ("m", "c", 6, 8, -1)],
        "extraction_id STRING, key STRING, tick BIGINT, sequence BIGINT, total BIGINT")
    ticks = spark.createDataFrame([("m", tick, None if tick < 3 else float(tick)) for tick in range(1, 8)],
                                  "extraction_id STRING, tick BIGINT, game_time DOUBLE")
    found = timelines.coalesce_counters(seen, ticks, ["key"], cell=2)
    # Value 9 of the first timed tick differs from the baseline and waits for tick 4.
    assert sorted((row.key, row.game_time, row.total) for row in found.collect()) == [
        ("a", 0.0, 5), ("a", 4.0, 9), ("a", 6.0, 12), ("b", 0.0, 4)]


def test_graph_of_zeros_falls_back_to_updates(spark):
    graph = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 40), ("b", 2, 63, 101), ("b", 3, 32, 60)],
                                  "extraction_id STRING, sequence BIGINT, position INT, value INT")
    spans = spark.createDataFrame([("a", 0.0, 63.0, 63.0), ("b", 0.0, 63.0, 60.0)],
                                  "extraction_id STRING, graph_start DOUBLE, graph_end DOUBLE, match_duration DOUBLE")
    spectator = spark.createDataFrame([("a", 1, 1, 5.0, 0.5), ("a", 2, 1, 5.0, 0.75), ("a", 3, 2, -1.0, 0.5), ("b", 1, 1, 5.0, 0.5)],
                                      "extraction_id STRING, sequence BIGINT, tick BIGINT, game_time DOUBLE, value DOUBLE")
    found = timelines.probability_samples(graph, spans, spectator)
    assert sorted((row.extraction_id, row.game_time_seconds, row.radiant_probability, row.source) for row in found.collect()) == [
        ("a", 5.0, 0.75, fixed.SPECTATOR_UPDATES), ("b", 29.0, 0.6, fixed.GRAPH_HISTORY)]


def test_state_overlay_without_checkpoint(spark):
    updates = spark.createDataFrame(
        [("m", 1, 5, "p", "int", "1", 1.0), ("m", 1, 9, "p", "int", "2", 9.0), ("m", 1, 7, "q", "int", "3", None),
         ("m", 1, 0, "z", "int", "4", 1.0)],
        "extraction_id STRING, entity_instance_id BIGINT, sequence BIGINT, property_path STRING, value_type STRING, value STRING, "
        "game_time DOUBLE").withColumns({"demo_tick": F.lit(1), "net_tick": F.lit(1)})
    points = spark.createDataFrame(
        [("m", 1, 4, 8.0, '[{"propertyPath":"p","valueType":"int","value":50},{"propertyPath":"r","valueType":"int","value":60}]')],
        "extraction_id STRING, entity_instance_id BIGINT, sequence BIGINT, checkpoint_game_time DOUBLE, properties STRING"
    ).withColumns({"demo_tick": F.lit(1), "net_tick": F.lit(1)})
    asked = spark.createDataFrame([(1, "m", 1, 5.0), (2, "m", 1, 8.5), (3, "m", 1, 9.0)],
                                  "request_id INT, extraction_id STRING, entity_instance_id BIGINT, selected_game_time DOUBLE")
    found = versions.entity_state_at(points, updates, asked)
    assert sorted((row.request_id, row.property_path, row.value, row.source) for row in found.collect()) == [
        (1, "p", "1", "update"), (2, "p", "1", "update"), (2, "r", "60", "checkpoint"), (3, "p", "2", "update"),
        (3, "r", "60", "checkpoint")]


def test_item_rules(spark):
    source = spark.createDataFrame(
        [(1, "v1", 5, "item_blade", None, " ", 1), (2, "v2", 5, "item_sword", "Sword", None, 1), (1, "v1", 6, "item_recipe_big_axe", "", None, 0)],
        "sequence INT, version STRING, id INT, name STRING, name_english_loc STRING, name_loc STRING, neutral_item_tier INT")
    normal = items.normalize_items(source, {6: "special"}, {"item_": "any", "item_sw": "long"})
    assert sorted((row.item_id, row.name, row.image_slug, row.recipe) for row in normal.collect()) == [
        (5, "Blade", "any", False), (5, "Sword", "long", False), (6, "Big Axe Recipe", "special", True)]
    history = {row.item_id: row for row in items.snapshot_history(normal).collect()}
    assert history[5].active and not history[6].active and history[5].name == "Sword"
    allowed = spark.createDataFrame([(5, "item_blade", "item_sword")], "item_id INT, from_name STRING, to_name STRING")
    assert items.rename_guard(normal, allowed.limit(0)).count() == 1 and items.rename_guard(normal, allowed).count() == 0


def test_projection_to_the_border(spark):
    bounds = {name: F.lit(value) for name, value in (("minimum_x", 0.0), ("maximum_x", 100.0), ("minimum_y", 0.0), ("maximum_y", 100.0))}
    frame = spark.createDataFrame([(250.0, 50.0), (50.0, 50.0), (150.0, 250.0)], "x DOUBLE, y DOUBLE")
    px, py = project_to_bounds(F.col("x"), F.col("y"), bounds)
    assert [(row[0], row[1]) for row in frame.select(px, py).collect()] == [(100.0, 50.0), (50.0, 50.0), (75.0, 100.0)]


def test_catalog_order_differs_between_statistics(spark):
    extractions = spark.createDataFrame(
        [("a", 1, "succeeded", "2026-01-01", '{"total":5}'), ("b", 1, "succeeded", "2026-01-02", '{"total":"7"}'),
         ("c", 1, "failed", "2026-01-03", None)],
        "extraction_id STRING, match_id INT, status STRING, started_at STRING, record_counts STRING")
    acquisitions = spark.createDataFrame([(2, "x", "2026-01-01", "succeeded")],
                                         "match_id INT, acquisition_id STRING, requested_at STRING, status STRING")
    row = series.catalog_stats(acquisitions, extractions).first()
    assert (row.stored_matches, row.total_records) == (2, 7)
    status = versions.latest_status(acquisitions, extractions, extractions.limit(0))
    assert {row.match_id: row.status for row in status.collect()} == {1: "failed", 2: "succeeded"}


def test_broken_rows_reject_the_extraction_of_their_file(spark, tmp_path):
    good = '{"extractionId":"%s","sampleIndex":%s,"gameTimeSeconds":0,"radiantProbability":1,"source":"graph_history"}'
    position = ('{"extractionId":%s,"sequence":"%s","demoTick":"1","gameTimeMilliseconds":"100","gamePlayerId":"0","heroId":"1",'
                '"teamId":"2","worldX":"1","worldY":"2"}')
    files = {
        "a": ([good % ("a", 0), good % ("a", 1)], [position % ('"a"', 1)]),
        "b": ([good % ("b", 0), '{"extractionId":"b","samp', '{"sampleIndex":1}', '{"extractionId":7}'],
              [position % ('"b"', 1), position % ("null", 2)]),
        "c": ([good % ("c", 0), good % ("a", 1)], [position % ('"c"', 1), position % ('"a"', 2)]),
        "d": ([good % ("d", 0)], [position % ('"d"', 1), "{"]),
    }
    for name, (chances, positions) in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "probability.ndjson").write_text("".join(f"{line}\n" for line in chances))
        (tmp_path / name / "positions.ndjson").write_text("".join(f"{line}\n" for line in positions))
    declared = spark.createDataFrame([("a", 2), ("b", 4), ("c", 2), ("d", 2)], "extraction_id STRING, declared_rows BIGINT")
    objects = staged.probability_objects(staged.read_probability_lines(spark, f"{tmp_path}/*/probability.ndjson"))
    kept = staged.import_probabilities(objects, declared).collect()
    assert sorted((row.extraction_id, row.sample_index) for row in kept) == [("a", 0), ("a", 1)]
    strict = staged.read_strict_positions(spark, f"{tmp_path}/*/positions.ndjson")
    assert {(row.extraction_id, row.bad) for row in strict.groupBy("extraction_id").agg(
        F.max("invalid").alias("bad")).collect()} == {("a", False), ("b", True), ("c", True), ("d", True)}
