"""Fuzzy line dedup by MinHash, with DataFrame and SQL functions only.

A line's shingles are its runs of ``SHINGLE`` characters, lower-cased.  All of
them are hashed, one row each, and the smallest hash of every bin is kept; a bin without
one takes that of the next bin that has one, in a ring.  A band is ``VALUES`` bins, which are equal in two lines about as
often as their similarity to that power.  Bands bring lines together, the exact
Jaccard similarity of their shingle sets decides, and distributed union-find
keeps the first line of every component.

Two lines of a band value meet where their odd sketches (Mitzenmacher, Pagh and
Pham, "Efficient Estimation for High Similarities using Odd Sketches") allow that
similarity.  The sketches bound the difference of the sets, so no pair is lost by them.
Within a band value each line first meets two others, the ones with the smallest
and the largest number.  Where that leaves several components, rounds follow in
which ever more members (``LEADERS`` times as many each time) meet the rest, until
every two lines of a band value have been compared or are connected: lines of one
component are not compared again.  Equal lines are one line from the start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.components import components
from arenaflow.llm.frames import partitions, stored
from arenaflow.session import scratch_path

SHINGLE = 8
SIMILARITY = 0.8
BANDS = 6
VALUES = 3
#: Words of a sketch.
WORDS = 16
LEADERS = 64
CHUNK = 4096


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _with_shingles(lines: DataFrame, size: int, ordered: bool = True) -> DataFrame:
    """Append ``hashes``, the hashes of the shingles of every ``line``, sorted if ``ordered``.

    A shorter line is one shingle.  Characters are UTF-16 units, two bytes each.
    """
    hashes = _bound("encode(line, 'UTF-16BE')", "units",
                    f"transform(sequence(1, greatest(octet_length(units) - {2 * size - 2}, 1), 2), "
                    f"at -> xxhash64(substring(units, at, {2 * size})))")
    distinct = f"array_distinct({hashes})"
    made = lines.withColumn("made", F.expr(f"sort_array({distinct})" if ordered else distinct))
    # Expressions are not carried over an explode, so that hashes are made once for all that asks for them.
    return made.select(*lines.columns, F.explode(F.array("made")).alias("hashes"))


def _starts(parts: int) -> list[int]:
    """The points that cut the ring of hashes into equal parts."""
    return [-(1 << 63) + part * (1 << 64) // parts for part in range(parts)]


def _before(start: int) -> str:
    """Place of the last of the sorted ``hashes`` below ``start``, by jumps of falling size; -1 where there is none."""
    return f"aggregate(jumps, -1, (at, jump) -> if(get(hashes, at + jump) < {start}L, at + jump, at))"


def _with_jumps(body: str) -> str:
    jumps = ", ".join(str(1 << power) for power in range(30, -1, -1))
    return _bound("size(hashes)", "count", _bound(f"filter(array({jumps}), jump -> jump <= count)", "jumps", body))


def _low_hashes(lines: DataFrame, size: int, bins: int = BANDS * VALUES) -> DataFrame:
    """``id`` and ``low0, low1, ...``: the smallest hash of the shingles of every ``line`` in each bin, null where it has none.

    Shingles are those of ``_with_shingles``, as rows of their own, which are compiled; lambdas over arrays are not.
    """
    units = lines.select("id", F.encode("line", "UTF-16BE").alias("units"))
    hashed = units.select("id", "units", F.expr(
        f"explode(sequence(1, greatest(octet_length(units) - {2 * size - 2}, 1), 2)) AS at")).select(
        "id", F.expr(f"xxhash64(substring(units, at, {2 * size}))").alias("hash"))
    lowest = hashed.groupBy("id", F.expr(f"cast(shiftright(shiftrightunsigned(hash, 32) * {bins}, 32) AS int)").alias("bin")).agg(
        F.min("hash").alias("low"))
    return lowest.groupBy("id").agg(*[F.min(F.when(F.col("bin") == at, F.col("low"))).alias(f"low{at}") for at in range(bins)])


def band_keys(bands: int = BANDS, values: int = VALUES) -> Column:
    """One key for each band of the MinHash values ``low0, low1, ...`` of a line."""
    bins = bands * values

    def value(at: int) -> Column:
        return F.coalesce(*[F.col(f"low{(at + step) % bins}") for step in range(bins)])

    return F.array(*[F.xxhash64(F.lit(band), *[value(band + place * bands) for place in range(values)]) for band in range(bands)])


def odd_sketch(words: int = WORDS) -> Column:
    """``WORDS`` words of 64 bits, one for each part of the ring: a bit tells whether an odd number of ``hashes`` has it.

    Sets that differ in d hashes have sketches that differ in d bits at most.
    """
    ends = [*(_before(start) for start in _starts(words)[1:]), "count - 1"]
    odd = ", ".join(
        f"aggregate(slice(hashes, ends[{word}] + 2, ends[{word + 1}] - ends[{word}]), 0L, "
        f"(bits, hash) -> bits ^ shiftleft(1L, cast(hash & 63 AS int)))" for word in range(words))
    return F.expr(_with_jumps(_bound(f"array(-1, {', '.join(ends)})", "ends", f"array({odd})")))


def _may_resemble(one: str, two: str, least: float, words: int = WORDS) -> Column:
    """Whether sketches allow two lines (prefixes of their columns) to be as similar as ``least``.

    Sets of this similarity differ in no more than (1 - least) / (1 + least) of the sum of their sizes, nor does the
    smaller one hold less than ``least`` of the larger one's size.
    """
    bits = " + ".join(f"bit_count({one}odd{word} ^ {two}odd{word})" for word in range(words))
    return F.expr(f"{1 + least}D * ({bits}) <= {1 - least}D * ({one}count + {two}count) + 1e-6D "
                  f"AND least({one}count, {two}count) >= {least}D * greatest({one}count, {two}count) - 1e-6D")


def similarity(one: str, two: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = _bound(f"size(array_intersect({one}, {two}))", "both", f"both / (size({one}) + size({two}) - both)")
    return F.expr(both)


def lines_of(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, _row, line_no, line`` for every line with a letter in it, trimmed and lower-cased.

    ``_row`` names a row by its id and text; rows that share both are one document.
    """
    split = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("_row"),
                             F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    return split.select("doc_id", "_row", "line_no", F.lower(F.trim("_line")).alias("line")).where("line <> ''")


def line_groups(lines: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``vertex, root`` of the lines (by hash) that resemble another line, directly or through others.

    Lines are written once in buckets of their number, so that pairs come to
    the lines and no line is shuffled again.
    """
    spark = lines.sparkSession
    name = f"lines_{uuid.uuid4().hex}"
    buckets = partitions(spark)
    # Equal lines fall together before the shuffle, which deals rows as the buckets do.
    lines.groupBy(F.xxhash64("line").alias("id")).agg(F.min("line").alias("line")).write.bucketBy(
        buckets, "id").option("path", scratch_path(spark, "lines")).saveAsTable(name)
    unique = spark.table(name)
    met = stored(_low_hashes(unique, size).select("id", F.explode(band_keys()).alias("key")), "bands")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # Turns follow the line's number alone, so that band values of the same lines have the same leaders and ask for the
    # same pairs.
    members = stored(met.join(shared, "key").select(
        "key", "id", "size", F.expr("(pmod(xxhash64(id), 1073741824L) * size) div 1073741824L").alias("turn")), "members")
    # Only lines that share a band value are looked at again.
    crowded_name = f"{name}_crowded"
    unique.join(members.select("id").distinct().hint("shuffle_hash"), "id").write.bucketBy(
        buckets, "id").option("path", scratch_path(spark, "crowded-lines")).saveAsTable(crowded_name)
    crowded = spark.table(crowded_name)
    sketches = stored(_with_shingles(crowded, size).select("id", F.size("hashes").alias("count"), odd_sketch().alias("odd")).select(
        "id", "count", *[F.col("odd")[word].alias(f"odd{word}") for word in range(WORDS)]), "sketches")
    def linked(pairs: DataFrame) -> DataFrame:
        # Few pairs fall into a bucket, so they are hashed there and the lines stream past unsorted.
        one = crowded.select(F.col("id").alias("a"), F.col("line").alias("left"))
        two = crowded.select(F.col("id").alias("b"), F.col("line").alias("right"))
        known = pairs.hint("shuffle_hash").join(one, "a").hint("shuffle_hash").join(two, "b")
        both = _with_shingles(known.withColumnRenamed("left", "line"), size, ordered=False).select(
            "a", "b", F.col("hashes").alias("one"), F.col("right").alias("line"))
        return stored(_with_shingles(both, size, ordered=False).where(similarity("one", "hashes") >= least).select("a", "b"), "line-links")

    ends = members.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    met = members.join(ends, "key").select("id", F.explode(F.array("first", "last")).alias("other")).where("id <> other").select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    one, two = (sketches.select(*[F.col(name).alias(side if name == "id" else f"{side}_{name}") for name in sketches.columns])
                for side in ("a", "b"))
    found = linked(met.join(one, "a").join(two, "b").where(_may_resemble("a_", "b_", least)).select("a", "b"))
    # With three members or fewer, every pair has the first or the last in it.
    inner = members.where("size > 3").join(sketches, "id")
    groups = stored(components(found), "line-groups")
    low, high = 0, LEADERS
    while True:
        inner = _unsettled(inner.where(F.col("size") > low), groups)
        if inner.isEmpty():
            break
        groups = _merged(groups, linked(_led_pairs(inner, low, high, least)))
        low, high = high, high * LEADERS
    for table in (name, crowded_name):
        spark.sql(f"DROP TABLE {table}")
    return groups


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``vertex, root`` with these links (``a, b``) added: only the roots that they connect are contracted again."""
    def rooted(frame: DataFrame, end: str) -> DataFrame:
        own = groups.select(F.col("vertex").alias(end), F.col("root").alias("own"))
        return frame.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")

    later = stored(components(rooted(rooted(links, "a"), "b")), "root-groups").select(
        F.col("vertex").alias("root"), F.col("root").alias("last"))
    kept = groups.join(later, "root", "left").select("vertex", F.coalesce("last", "root").alias("root"))
    # Lines that were alone are no vertices yet.
    alone = later.select(F.col("root").alias("vertex"), F.col("last").alias("root")).join(
        groups.select("vertex"), "vertex", "left_anti")
    return stored(kept.unionAll(alone), "line-groups")


def _unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the band values that still hold lines of several components, with the component as ``label``."""
    own = [name for name in members.columns if name != "label"]
    labelled = members.select(*own).join(groups, F.col("id") == F.col("vertex"), "left").select(
        *own, F.coalesce("root", "id").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return stored(labelled.join(several.select("key"), "key", "left_semi"), "open-bands")


def _led_pairs(members: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """Pairs of members of two components that may resemble each other, the earlier one having a turn from ``low`` to below ``high``.

    Large band values are cut into chunks, and leaders meet every chunk.
    """
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("long")
    met = members.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).drop("size")
    leaders = members.where(F.col("turn").between(low, high - 1)).select(
        "key", *[F.col(name).alias(f"lead_{name}") for name in members.columns if name not in ("key", "size")],
        F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    later = (F.col("turn") > F.col("lead_turn")) | (F.col("turn") == F.col("lead_turn")) & (F.col("id") > F.col("lead_id"))
    return met.join(leaders, ["key", "chunk"]).where(
        later & (F.col("label") != F.col("lead_label")) & _may_resemble("", "lead_", least)).select(
        F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()


def mark_lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE,
               least: float = SIMILARITY) -> DataFrame:
    """Every line with a letter: ``doc_id, _row, line_no``, the line kept in its place, and whether that is itself.

    The line kept is the component's first by document id (null last), text
    hash and place.  A null text has no lines; an empty table gives none.
    """
    lines = lines_of(documents, text, doc_id)
    groups = line_groups(lines, size, least)
    placed = lines.select("doc_id", "_row", "line_no", F.xxhash64("line").alias("vertex")).join(
        groups, "vertex", "left").select("doc_id", "_row", "line_no", F.coalesce("root", "vertex").alias("root"))
    placed = stored(placed, "placed-lines")
    first = placed.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row", "line_no")).alias("first"))
    return placed.join(first, "root").select(
        "doc_id", "_row", "line_no", F.col("first.doc_id").alias("kept_doc_id"),
        F.col("first.line_no").alias("kept_line_no"),
        ((F.col("_row") == F.col("first._row")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"))


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE,
                least: float = SIMILARITY) -> DataFrame:
    """Documents without the lines that resemble one kept elsewhere.

    A document that loses its last line goes; one that had none stays, and so
    do all columns.  Lines without a letter are left where they are.
    """
    marked = mark_lines(documents, text, doc_id, size, least)
    changed = marked.groupBy("_row").agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("_gone"), F.count_if("kept").alias("_left")).where(
        F.size("_gone") > 0)
    joined = documents.withColumn("_row", F.xxhash64(doc_id, text)).join(changed, "_row", "left")
    shorter = F.array_join(F.filter(
        F.split(text, "\n"), lambda line, at: ~F.array_contains(F.col("_gone"), at)), "\n")
    return joined.where("_left IS NULL OR _left > 0").withColumn(
        text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(shorter)).select(*documents.columns)
