"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last ``WINDOW`` bytes ends a chunk wherever its high bits
are zero, so that chunks far from an edit stay what they were.  Every chunk
leaves one letter.  A fingerprint is ``block size:letters:letters at twice the
block size``; two are compared by edit distance where they have letters of one
block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.frames import partitions, texts_of, with_columns

WINDOW = 7
SMALLEST = 4
LETTERS_WANTED = 64
COMMON_RUN = 3
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTORS = [pow(0x9E3779B1, power + 1, 1 << 32) for power in range(WINDOW)]


def rolling(data: bytes) -> np.ndarray:
    """The hash of the last ``WINDOW`` bytes at every byte; before the start the bytes count as zero."""
    values = np.zeros(len(data) + WINDOW - 1, np.uint32)
    values[WINDOW - 1:] = np.frombuffer(data, np.uint8)
    values += np.uint32(1)
    total = np.zeros(len(data), np.uint32)
    for back, factor in enumerate(_FACTORS):
        total += values[WINDOW - 1 - back:len(values) - back] * np.uint32(factor)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return total


def _letters(data: bytes, ends: np.ndarray) -> str:
    """One letter for each chunk; the last chunk ends with the text."""
    marks, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            marks.append(_ALPHABET[zlib.crc32(data[start:end]) & 63])
            start = end
    return "".join(marks)


def fingerprint(text: str) -> str:
    """Equal texts have equal fingerprints; the empty text has no letters."""
    data = text.encode()
    shift = SMALLEST.bit_length() - 1
    while len(data) > LETTERS_WANTED << shift:
        shift += 1
    hashes = rolling(data)
    at = np.flatnonzero(hashes < np.uint32(1 << (32 - shift)))
    finer = _letters(data, at + 1)
    coarser = _letters(data, at[hashes[at] < np.uint32(1 << (31 - shift))] + 1)
    return f"{1 << shift}:{finer}:{coarser}"


def edit_distance(left: str, right: str) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of one integer."""
    if not left or not right:
        return len(left) + len(right)
    size = len(left)
    places: dict[str, int] = {}
    for at, letter in enumerate(left):
        places[letter] = places.get(letter, 0) | 1 << at
    full, last = (1 << size) - 1, 1 << size - 1
    up, down, distance = full, 0, size
    for letter in right:
        match = places.get(letter, 0)
        same = (((match & up) + up) ^ up) | match | down
        rise = down | ~(same | up) & full
        fall = up & same
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise = rise << 1 | 1
        fall <<= 1
        up = (fall | ~(same | rise)) & full
        down = rise & same & full
    return distance


def _alike(left: str, right: str) -> float:
    """Share of letters that need no edit; unrelated letters without a common run count as nothing alike."""
    if left == right:
        return 1.0
    run = min(COMMON_RUN, len(left), len(right))
    if not run or {left[at:at + run] for at in range(len(left) - run + 1)}.isdisjoint(
            right[at:at + run] for at in range(len(right) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(left, right) / max(len(left), len(right))


def likeness(left: str, right: str) -> float:
    """From 0 to 1: the best over the block sizes that both fingerprints have letters for."""
    if left == right:
        return 1.0
    (size, finer, coarser), (other, finer2, coarser2) = left.split(":"), right.split(":")
    if size == other:
        return max(_alike(finer, finer2), _alike(coarser, coarser2) if coarser and coarser2 else 0.0)
    if int(size) == 2 * int(other):
        return _alike(finer, coarser2)
    return _alike(coarser, finer2) if int(other) == 2 * int(size) else 0.0


def with_fingerprint(frame: DataFrame, text: str = "text") -> DataFrame:
    """Append ``fingerprint``; a null text counts as empty, and a column of that name is replaced."""
    def start():
        return lambda batch: [[fingerprint(value) for value in texts_of(batch, text)]]

    return with_columns(frame, [T.StructField("fingerprint", T.StringType())], start, text)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_following(documents: DataFrame, key: str, columns: list[str], pieces: int) -> DataFrame:
    """Rows in ranges of ``key``: ``_range`` and ``_guest``; every range ends with the first row of the next as a guest.

    The order is by key (nulls first), then by a hash of the text, and closes
    to a ring.  Only the first keys of the ranges, one row each, reach the driver.
    """
    cuts = sorted(set(documents.approxQuantile(key, [at / pieces for at in range(1, pieces)], 0.0005))) if pieces > 1 else []
    order = documents.select(*columns).withColumn("_order", F.xxhash64("text"))
    spans = F.lit(0)
    if cuts:
        spans = F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(
            F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(key))))
    ranged = order.withColumn("_range", spans.cast("int"))
    heads = {row["_range"]: row["head"] for row in ranged.groupBy("_range").agg(
        F.min(F.struct(key, "_order")).alias("head")).collect()}
    present = sorted(heads)
    before = {span: present[at - 1] for at, span in enumerate(present)}
    first = F.lit(None).cast("int")
    if heads:
        table = documents.sparkSession.createDataFrame(
            [(span, heads[span][key], heads[span]["_order"], before[span]) for span in present],
            "_range int, _head long, _head_order long, _before int")
        # One row for each range, so the table is as small as the number of partitions.
        ranged = ranged.join(F.broadcast(table), "_range")
        first = F.when(F.col(key).eqNullSafe(F.col("_head")) & (F.col("_order") == F.col("_head_order")),
                       F.col("_before"))
    places = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")),
                     F.struct(first.alias("at"), F.lit(True).alias("guest")))
    return ranged.withColumn("_place", F.explode(places)).where("_place.at IS NOT NULL").select(
        *columns, "_order", F.col("_place.at").alias("_range"), F.col("_place.guest").alias("_guest"))


def compare_edited(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    Null texts count as empty.  Rows with equal ids follow each other by a hash
    of their text; a null id comes first; a single document follows itself.
    """
    pieces = partitions(documents.sparkSession)
    rows = with_following(documents, "doc_id", ["doc_id", "text"], pieces)
    dealt = rows.repartition(pieces, "_range").sortWithinPartitions(
        "_range", "_guest", F.col("doc_id").asc_nulls_first(), "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, span = None, None
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(name)).to_pylist() for name in ("doc_id", "_range", "_guest")]
            found = []
            for doc_id, at, guest, text in zip(*columns, texts_of(batch, "text")):
                if at != span:
                    held, span = None, at
                elif held is None:
                    continue
                own = fingerprint(text)
                if held is not None:
                    found.append(_compared(*held, text, own))
                held = None if guest else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(zip(*found), _RESULT)], schema=_RESULT
            ) if found else pa.RecordBatch.from_pylist([], schema=_RESULT)

    return dealt.mapInArrow(run, _RESULT_DDL)


def _compared(doc_id: int | None, text: str, own: str, following: str, next_fingerprint: str) -> tuple:
    changed = edited(text, following)
    changed_fingerprint = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, changed_fingerprint,
            likeness(own, changed_fingerprint), likeness(own, next_fingerprint))
