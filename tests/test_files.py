"""Staged files read in pieces, rescued rows, and binary values taken out of documents and put back."""

import base64
import hashlib
import io
import json
import os

from pyspark.sql import functions as F

from arenaflow.sources import blobs, inspection, staged


def test_a_file_larger_than_a_cell_is_read_in_pieces(spark, tmp_path):
    size = 3 << 30
    (tmp_path / "e9").mkdir()
    with open(tmp_path / "e9" / "records.ndjson", "wb") as file:
        file.truncate(size - 1)
        file.seek(size - 1)
        file.write(b"\n")
    (tmp_path / "e9" / "blobs.ndjson").touch()
    (tmp_path / "e9" / "_SUCCESS").touch()
    found = {row.path: row for row in inspection.inspect_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"records.ndjson", "blobs.ndjson"}
    assert (found["records.ndjson"].actual_bytes, found["records.ndjson"].actual_records) == (size, 1)
    assert found["records.ndjson"].ends_with_newline and found["records.ndjson"].extraction_id == "e9"
    assert found["blobs.ndjson"].actual_sha256 == hashlib.sha256(b"").hexdigest() and found["blobs.ndjson"].ends_with_newline


def test_a_stream_is_never_held():
    class Endless(io.RawIOBase):
        def __init__(self):
            self.left, self.largest = 1000, 0

        def read(self, size=-1):
            self.largest = max(self.largest, size)
            self.left -= 1
            return b"ab\n" * (size // 3) if self.left >= 0 else b""

    source = Endless()
    digest = hashlib.sha256(b"ab\n" * 10 * 1000).hexdigest()
    assert inspection.inspect_stream(source, 30) == (30_000, digest, 10_000, True) and source.largest == 30
    assert inspection.inspect_stream(io.BytesIO(b"a\nb"), 2) == (3, hashlib.sha256(b"a\nb").hexdigest(), 1, False)


def test_files_are_dealt_by_size(tmp_path):
    for number in range(30):
        (tmp_path / f"e{number}").mkdir()
        (tmp_path / f"e{number}" / "a.ndjson").write_bytes(b"x" * (1000 if number == 3 else 10))
    reader = inspection.StagedFiles({"path": str(tmp_path), "taskBytes": "100"}).reader(inspection.INSPECTED)
    reader.task_bytes = 100
    dealt = [sum(os.path.getsize(path) for path in part.locations) for part in reader.partitions()]
    assert sum(dealt) == 1290 and sorted(dealt)[-1] == 1000 and sorted(dealt)[-2] <= 40


def test_broken_lines_are_rescued(spark, tmp_path):
    folder = tmp_path / "e1"
    folder.mkdir()
    (folder / "combat_events.ndjson").write_text(
        '{"extractionId":"e1","sequence":1,"value":5}\n{"extractionId":"e1","sequence":2,"val\n'
        '{"extractionId":"e2","sequence":3,"value":"much"}\n')
    rows = staged.scan_staged(spark, f"{tmp_path}/*/combat_events.ndjson", "combatEvents").orderBy("sequence").collect()
    assert [(row.sequence, row.value, row.file_extraction_id, row.file_name, row.rescued) for row in rows] == [
        (None, None, "e1", "combat_events.ndjson", '{"extractionId":"e1","sequence":2,"val'),
        (1, 5, "e1", "combat_events.ndjson", None),
        (3, None, "e1", "combat_events.ndjson", '{"extractionId":"e2","sequence":3,"value":"much"}')]


def coded(path, value):
    return {"valueBase64": base64.b64encode(value).decode(), "encoding": "base64", "fieldPath": path}


def test_blobs_go_out_and_come_back(spark):
    deep = {"a": [{"b": [[coded("a[0].b[0][0]", b"\x00\xff" * 500)]]}], "same": coded("same", b"x"), "again": coded("again", b"x"),
            "empty": coded("empty", b""), "odd \"key\"": coded('odd \\"key\\"', b"q"), "note": json.dumps(coded("no", b"no"))}
    documents = [("e", 1, json.dumps(deep, indent=2)), ("e", 2, '{"plain": [1, 2.5, null, "t"]}'), ("f", 1, "{broken"), ("f", 2, None),
                 ("f", 3, json.dumps([coded("[0]", b"x")]))]
    frame = spark.createDataFrame(documents, "extraction_id string, sequence long, payload string")
    taken, found = blobs.extract_blobs(frame)
    rows = found.collect()
    assert sorted((row.extraction_id, row.record_sequence, row.field_path, bytes(row.value)) for row in rows) == sorted([
        ("e", 1, "a[0].b[0][0]", b"\x00\xff" * 500), ("e", 1, "same", b"x"), ("e", 1, "again", b"x"), ("e", 1, "empty", b""),
        ("e", 1, 'odd \\"key\\"', b"q"), ("f", 3, "[0]", b"x")])
    assert all(row.blob_id == hashlib.sha256(row.value).hexdigest() for row in rows)
    changed = {(row.extraction_id, row.sequence): row.payload for row in taken.collect()}
    assert json.loads(changed["e", 1])["a"] == [{"b": [[{"blobId": hashlib.sha256(b"\x00\xff" * 500).hexdigest()}]]}]
    assert json.loads(changed["e", 1])["note"] == deep["note"] and changed["f", 1] is None and changed["f", 2] is None
    back = {(row.extraction_id, row.sequence): row.payload for row in blobs.restore_blobs(taken, found).collect()}
    assert json.loads(back["e", 1]) == deep and json.loads(back["e", 2]) == json.loads(documents[1][2])
    assert json.loads(back["f", 3]) == [coded("[0]", b"x")]
    lost = blobs.restore_blobs(taken, found.where(F.col("field_path") != "empty")).where("extraction_id = 'e' AND sequence = 1")
    assert lost.collect()[0].payload is None
