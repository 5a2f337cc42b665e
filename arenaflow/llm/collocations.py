"""Phrase collocations by vertical partitioning of a suffix tree, after ERA.

The suffixes of all pieces of text, cut off after ``DEPTH`` words, form a tree whose
node totals are the counts of all phrases.  It is never built whole.  Prefixes of suffixes are
counted, those above a memory budget are extended by a word until they fit or
reach the depth, and consecutive prefixes are put together into groups of about
the budget.  Every group is a subtree of its own: its suffixes come to one task
in order, branch where neighbours differ, and a node is complete, its total
the sum of its leaves, when the next suffix leaves it.  A prefix cut into several
groups hands over partial totals, which are added up.

Suffixes are read only as far as they can matter: bitmaps of fixed size
hold which hashed pairs and triples of words can be frequent, triples being counted only where both of their pairs can,
and a suffix ends where one cannot be.  Phrases that share a bit only make suffixes longer, never a count wrong.
Equal suffixes are added up before they travel, so a passage found everywhere is one row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.frames import numbered, partitions, slices, stored

DEPTH = 4
#: Suffixes of a group at least; a group is larger only where there are more than ``GROUPS`` of this size.
BUDGET = 1 << 17
GROUPS = 1 << 14
BITS = 26
#: Words of the phrases that have a bitmap.
MARKED = (2, 3)
SLICE_BYTES = 8 << 20
#: Bytes of text that are split, and words whose phrases are looked at, at once: what a slice takes besides its codes.
SPLIT_BYTES = 1 << 20
WORDS_AT_ONCE = 1 << 17
#: Bytes of suffixes that a task holds to add up equal ones, and rows that it hands over at once.
HELD_BYTES = 64 << 20
ROWS_OUT = 1 << 16
SEED = 42
_GOLDEN = 0x9E3779B97F4A7C15
_SEPARATORS = bytes.maketrans(b",;:!?\n\v\f\r", b"." * 9)
_STOP = b"."
#: Stands after every word of a suffix, the last too: what starts with a phrase is one run in byte order.
_GAP = " "


# words of texts

def _split(texts: pa.Array, at: list[int]) -> Iterator[pa.Array]:
    """Words of these texts and a stop between pieces, as arrays of about ``SPLIT_BYTES``."""
    held: list[bytes] = []
    size = 0
    for place in at:
        held.append(texts[place].as_py().encode().lower().translate(_SEPARATORS).replace(_STOP, b" . "))
        size += len(held[-1])
        if size >= SPLIT_BYTES:
            yield pa.array(b" . ".join([*held, b""]).split(), pa.binary())
            held, size = [], 0
    yield pa.array(b" . ".join(held).split(), pa.binary())


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """For every language of a batch (``lang, text``): its name, word codes in order (-1 between pieces), the words."""
    places: dict[str, list[int]] = {}
    for at, lang in enumerate(batch.column(0).to_pylist()):
        places.setdefault(lang, []).append(at)
    for lang, at in places.items():
        words = pa.chunked_array(_split(batch.column(1), at), pa.binary()).dictionary_encode().combine_chunks()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        names = words.dictionary
        stop = pc.index(names, pa.scalar(_STOP, names.type)).as_py()
        del words
        codes[codes == stop] = -1
        yield lang, codes, names


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SLICE_BYTES``, put together from small batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _word_hashes(lang: str, names: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    own = np.fromiter((xxh64_intdigest(word, SEED) for word in names.to_pylist()), np.uint64, len(names))
    return _mix(own + np.uint64(xxh64_intdigest(lang.encode(), SEED)))


def _phrase_bits(hashes: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """The bit of the phrase of ``size`` words that starts at every word, -1 where it would leave the piece."""
    found = np.full(len(codes), -1, np.int32)
    if not len(hashes):
        return found
    for start in range(0, len(codes) - size + 1, WORDS_AT_ONCE):
        part = codes[start:start + WORDS_AT_ONCE + size - 1]
        count = len(part) - size + 1
        own, inside = hashes[np.maximum(part, 0)], part >= 0
        code, whole = own[:count], inside[:count].copy()
        for at in range(1, size):
            code = _mix(code * np.uint64(3) + _mix(own[at:at + count]))
            whole &= inside[at:at + count]
        found[start:start + count] = np.where(whole, (code >> np.uint64(64 - BITS)).astype(np.int32), -1)
    return found


def _shifted(flags: np.ndarray, by: int) -> np.ndarray:
    return np.append(flags[by:], np.zeros(by, bool))


def _may_be_frequent(hashes: np.ndarray, codes: np.ndarray, bitmaps: list[np.ndarray]) -> list[np.ndarray]:
    """For every bitmap, where a phrase of its size starts that may be frequent and whose parts may be."""
    found: list[np.ndarray] = []
    for size, bitmap in zip(MARKED, bitmaps):
        bits = _phrase_bits(hashes, codes, size)
        flags = (bits >= 0) & ((bitmap[np.maximum(bits, 0) >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)
        if found:
            flags &= found[-1] & _shifted(found[-1], 1)
        found.append(flags)
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
    for batch in _each_slice(batches):
        for lang, codes, names in _streams(batch):
            counts = np.bincount(codes[codes >= 0], minlength=len(names))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(seen), pa.string()), names.take(pa.array(seen)).cast(pa.string()), pa.array(counts[seen])],
                schema=schema)


def _count_bits(batches: Iterator[pa.RecordBatch], size: int, bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Bits of the phrases of ``size`` words, with their counts, where the parts of the phrase may be frequent."""
    schema = pa.schema([("bit", pa.int32()), ("n", pa.int64())])
    for batch in _each_slice(batches):
        for lang, codes, names in _streams(batch):
            hashes = _word_hashes(lang, names)
            bits = _phrase_bits(hashes, codes, size)
            if bitmaps:
                shorter = _may_be_frequent(hashes, codes, bitmaps)[-1]
                bits = bits[shorter & _shifted(shorter, 1)]
            bits, counts = np.unique(bits[bits >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32)), pa.array(counts.astype(np.int64))], schema=schema)


def _slice_suffixes(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray]) -> Iterator[pa.Table]:
    """For every slice and language, suffixes of two to ``DEPTH`` words as far as they may be frequent, equal ones added up."""
    schema = pa.schema([("lang", pa.string()), ("suffix", pa.string()), ("n", pa.int64())])
    for batch in _each_slice(batches):
        for lang, codes, names in _streams(batch):
            pairs, triples = _may_be_frequent(_word_hashes(lang, names), codes, bitmaps)
            starts = np.flatnonzero(pairs)
            if not len(starts):
                continue
            padded = np.append(codes, np.full(DEPTH, -1, np.int32))
            reach = (pairs, triples, triples & _shifted(triples, 1))
            joined = []
            for first in range(0, len(starts), WORDS_AT_ONCE):
                start = starts[first:first + WORDS_AT_ONCE]
                columns = [names.take(pa.array(padded[start]))]
                for step in range(1, DEPTH):
                    alive = reach[step - 1][start]
                    columns.append(names.take(pa.array(np.where(alive, padded[start + step], 0), mask=~alive)))
                columns.append(pa.array([b""] * len(start), pa.binary()))
                joined.append(pc.binary_join_element_wise(*columns, pa.scalar(_GAP.encode(), pa.binary()), null_handling="skip"))
            counted = pc.value_counts(pa.chunked_array(joined))
            del joined, columns
            yield pa.Table.from_arrays([
                pa.array([lang] * len(counted), pa.string()), counted.field("values").cast(pa.string()),
                counted.field("counts")], schema=schema)


def _suffixes(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Suffixes as far as they may be frequent, equal ones of a task added up while no more than ``HELD_BYTES`` are held."""
    held: list[pa.Table] = []
    size = 0

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "suffix"], use_threads=False).aggregate([("n", "sum")]).rename_columns(
            ["lang", "suffix", "n"])

    for made in _slice_suffixes(batches, bitmaps):
        held.append(made)
        size += made.nbytes
        if size >= HELD_BYTES:
            whole = added()
            held, size = [whole], whole.nbytes
            if size >= HELD_BYTES // 2:
                yield from whole.to_batches(ROWS_OUT)
                held, size = [], 0
    if held:
        yield from added().to_batches(ROWS_OUT)


def _bitmap(documents: DataFrame, size: int, shorter: list, least: int) -> np.ndarray:
    """The bits of phrases of ``size`` words that are found ``least`` times together: 2^BITS of them whatever the input."""
    bits = documents.mapInArrow(
        lambda batches: _count_bits(batches, size, [shared.value for shared in shorter]), "bit int, n long").groupBy("bit").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("bit").cast("long").alias("bit"))
    rows = bits.groupBy((F.col("bit") / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    found = np.zeros((1 << BITS) >> 3, np.uint8)
    for at, part in rows.collect():
        found[at * 4096:(at + 1) * 4096] = np.frombuffer(part, np.uint8)
    return found


# vertical partitioning

def _prefix(words: int) -> Column:
    return F.concat(F.rtrim(F.substring_index("suffix", _GAP, words)), F.lit(_GAP))


def partition_starts(suffixes: DataFrame, budget: int = BUDGET) -> list[tuple[str, str]]:
    """The first ``(lang, prefix)`` of every group but the first, in order: at most about ``3 * GROUPS`` of them.

    Prefixes above the budget are extended word by word; runs of prefixes
    that follow each other in order share a group.
    """
    total = suffixes.count()
    budget = max(budget, -(-total // GROUPS))
    fitting: list[DataFrame] = []
    open_ = suffixes.select("lang", "suffix")
    for words in range(1, DEPTH + 1):
        counts = stored(open_.groupBy("lang", _prefix(words).alias("prefix")).agg(F.count(F.lit(1)).alias("size")), "prefixes")
        fitting.append(counts if words == DEPTH else counts.where(F.col("size") <= budget))
        heavy = counts.where(F.col("size") > budget)
        if words == DEPTH or heavy.isEmpty():
            break
        open_ = stored(open_.withColumn("prefix", _prefix(words)).join(
            heavy.select("lang", "prefix"), ["lang", "prefix"], "left_semi").select("lang", "suffix"), "heavy-suffixes")
    prefixes = fitting[0]
    for more in fitting[1:]:
        prefixes = prefixes.unionAll(more)
    # A running total in ranges: every range counts from its own start, which costs a group a range at most.
    ranged = prefixes.repartitionByRange(partitions(suffixes.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")

    def starts(batches):
        filled = budget
        for batch in batches:
            found = []
            for at, size in enumerate(batch.column(2).to_pylist()):
                if filled + size > budget:
                    found.append(at)
                    filled = 0
                filled += size
            yield batch.select([0, 1]).take(pa.array(found, pa.int64()))

    cuts = ranged.select("lang", "prefix", "size").mapInArrow(starts, "lang string, prefix string").collect()
    return sorted(((row["lang"], row["prefix"]) for row in cuts), key=_order)[1:]


def _order(key: tuple[str, str]) -> tuple[bytes, bytes]:
    return key[0].encode(), key[1].encode()


def _to_groups(batches: Iterator[pa.RecordBatch], starts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Append the group of every suffix (``lang, suffix, n``)."""
    for batch in batches:
        keys = zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
        yield batch.append_column("part", pa.array([bisect.bisect_right(starts, key) for key in keys], pa.int32()))


# subtrees

class Subtree:
    """Counts of the nodes of one subtree from its suffixes in order.

    Only the path to the latest suffix is held.  A node closes when a suffix
    leaves it; its total, the sum of the leaves below it, goes to its parent.
    Nodes on the path of the first or the last suffix may go on in the
    neighbouring group and are handed over whatever their total.
    """

    def __init__(self, least: int):
        self.least = least
        self.words: list[str] = []
        self.totals: list[int] = []
        self.first: tuple[str, ...] | None = None
        self.found: list[tuple[str, int]] = []

    def add(self, suffix: str, count: int) -> None:
        words = suffix[:-1].split(_GAP)
        if self.first is None:
            self.first = tuple(words)
        shared = 0
        while shared < len(self.words) and shared < len(words) and self.words[shared] == words[shared]:
            shared += 1
        self._close(shared)
        self.words += words[shared:]
        self.totals += [0] * (len(words) - shared)
        self.totals[-1] += count

    def _close(self, depth: int, last: bool = False) -> None:
        while len(self.words) > depth:
            total, size = self.totals.pop(), len(self.words)
            if size > 1 and (total >= self.least or last or tuple(self.words) == self.first[:size]):
                self.found.append((_GAP.join(self.words), total))
            self.words.pop()
            if self.totals:
                self.totals[-1] += total

    def finish(self) -> None:
        self._close(0, last=True)


def _subtree_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrase counts of the groups of a task; rows ``part, lang, suffix, n`` come sorted."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    tree, current = None, None

    def emitted(lang):
        found, tree.found = tree.found, []
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(found), pa.string()), pa.array([phrase for phrase, _ in found], pa.string()),
            pa.array([total for _, total in found], pa.int64())], schema=schema)

    for batch in batches:
        for part, lang, suffix, count in zip(*(column.to_pylist() for column in batch.columns)):
            if (part, lang) != current:
                if tree is not None:
                    tree.finish()
                    yield emitted(current[1])
                tree, current = Subtree(least), (part, lang)
            tree.add(suffix, count)
        if tree is not None and len(tree.found) > 4096:
            yield emitted(current[1])
    if tree is not None:
        tree.finish()
        yield emitted(current[1])


# counts and scores

def phrase_counts(documents: DataFrame, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of two to four words found ``least`` times, and ``lang, word, f`` of all words.

    ``documents`` has ``lang`` and ``text`` without nulls.
    """
    spark = documents.sparkSession
    words = stored(documents.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(
        F.sum("f").alias("f")), "words")
    bitmaps: list = []
    for size in MARKED:
        bitmaps.append(spark.sparkContext.broadcast(_bitmap(documents, size, bitmaps, least)))
    suffixes = stored(documents.mapInArrow(
        lambda batches: _suffixes(batches, [shared.value for shared in bitmaps]), "lang string, suffix string, n long").groupBy(
        "lang", "suffix").agg(F.sum("n").alias("n")), "suffixes")
    for shared in bitmaps:
        shared.destroy()
    starts = [_order(key) for key in partition_starts(suffixes, budget)]
    grouped = suffixes.mapInArrow(lambda batches: _to_groups(batches, starts), "lang string, suffix string, n long, part int")
    dealt = grouped.select("part", "lang", "suffix", "n").repartition(partitions(spark), "part").sortWithinPartitions(
        "part", "lang", "suffix")
    phrases = stored(dealt.mapInArrow(
        lambda batches: _subtree_counts(batches, least), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(
        F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    return phrases, words


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, covered: int = 80,
                 top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to four words of every language.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs.
    ``a`` counts the phrase, ``l`` and ``r`` the parts at its lowest-scoring
    cut (ties to the earliest), ``n`` all words of the language; the score is
    floor(2000000 a / (l + r)).  Phrases found fewer than ``least`` times do not
    count, nor do those inside a longer one that has ``covered`` % of their count or more.
    Ties in score go by ``a`` (larger first), then by the phrase in bytes.
    A null language is ``und``, like one of that name; a null or empty text has no words. Very
    long texts are one row; repeated rows count each time; other columns are not looked at; an
    empty table gives no rows.
    """
    whole = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    phrases, words = phrase_counts(whole, least, budget)
    known = phrases.select("lang", F.col("phrase").alias("part"), "f").unionAll(
        words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f"))
    split = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", _GAP).alias("w"))

    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), _GAP).alias("part"),
        F.array_join(F.slice("w", F.col("k") + 1, DEPTH), _GAP).alias("rest"))
    valued = cuts.join(known.withColumnRenamed("f", "l"), ["lang", "part"]).drop("part").join(
        known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Decimals, because the product may pass 64 bits.
    scored = valued.withColumn("score", F.expr(
        "cast(2000000 * cast(a AS decimal(20, 0)) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0))) AS long)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    inner = split.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.expr(
        "flatten(transform(sequence(2, size(w) - 1), width -> transform(sequence(1, size(w) - width + 1), at -> slice(w, at, width))))"
    )).alias("inside"))
    around = inner.groupBy("lang", F.array_join("inside", _GAP).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.select("lang", "phrase", "cut.*").join(around, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR 100 * cast(longer AS decimal(20, 0)) < {covered} * cast(a AS decimal(20, 0))"))
    ranked = numbered(kept.select(
        F.col("lang").alias("tree"), (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"), "phrase", "l", "r"),
        ["by_score", "by_count", "phrase"]).where(F.col("number") < top)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.withColumnRenamed("tree", "lang").join(sizes, "lang").select(
        "lang", (F.col("number") + 1).alias("rank"), "phrase", (-F.col("by_count")).alias("a"), "l", "r", "n",
        (-F.col("by_score")).alias("score"))
