"""Near-duplicates by SimHash, with a bit-sliced comparison of fingerprints.

Fingerprints meet in blocks that share some of their bits.  In a block the bits
are stored as planes, one machine word holding one bit of 64 fingerprints, and
the distances of 64 pairs grow at once in carry-save counters that start so
high that passing the radius overflows them.  Words in which every pair has
overflowed are abandoned.

A block gives a spanning forest of its links, never all pairs: members already
known to be connected are not compared again.  Blocks above ``BLOCK`` members
are cut into chunks that meet pairwise in tasks of their own.

Where texts decide, fingerprints only name candidates: pairs are verified by
their shingle sets, and blocks go on past pairs that fail.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.components import components
from arenaflow.llm.frames import partitions, stored, texts_of, with_columns

SEED = 42
BLOCK = 4096
SMALL = 32
PAIRWISE = 256
QUERIES_AT_ONCE = 64
PLANES_AT_ONCE = 12
_ROWS_AT_ONCE = 1 << 14
_GOLDEN = 0x9E3779B97F4A7C15


# fingerprints

def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _ROWS_AT_ONCE):
        counts += np.unpackbits(hashes[start:start + _ROWS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return counts


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the shingles of a text, eight bytes in a row; a shorter text is one shingle."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()
    if not words:
        return np.empty((0, 8), np.uint8)
    shingles = [b" ".join(words)] if len(words) < size else map(
        b" ".join, zip(*(words[at:] for at in range(size))))
    return np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)


def fingerprint(text: str, size: int = 3, width: int = 1) -> list[int]:
    """``width`` unsigned 64-bit words; the first is the SimHash of XXH64, the others of hashes mixed from it."""
    return _fingerprint_of(_shingle_hashes(text, size), width)


def _fingerprint_of(hashes: np.ndarray, width: int) -> list[int]:
    if not len(hashes):
        return [0] * width
    found = []
    for word in range(width):
        if word:
            mixed = hashes.view(">u8").astype(np.uint64) + np.uint64(word * _GOLDEN % (1 << 64))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            bits = _bit_counts(mixed.astype(">u8").view(np.uint8).reshape(-1, 8))
        else:
            bits = _bit_counts(hashes)
        found.append(int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big"))
    return found


def _word_names(width: int) -> list[str]:
    return [f"_w{word}" for word in range(width)]


def with_fingerprints(frame: DataFrame, text: str = "text", size: int = 3, width: int = 1) -> DataFrame:
    """Append the fingerprint as longs ``_w0``, ``_w1``, ...  A null text has no words, like an empty one."""
    def start():
        def make(batch):
            rows = np.array([fingerprint(value, size, width) for value in texts_of(batch, text)], dtype=np.uint64)
            return [pa.array(column) for column in rows.reshape(-1, width).view(np.int64).T]

        return make

    return with_columns(frame, [T.StructField(name, T.LongType()) for name in _word_names(width)], start, text)


def with_signatures(frame: DataFrame, text: str, size: int, width: int) -> DataFrame:
    """Append the fingerprint, as ``with_fingerprints`` does, and ``_set``, a digest of the set of shingles."""
    def start():
        def make(batch):
            hashes = [_shingle_hashes(value, size) for value in texts_of(batch, text)]
            rows = np.array([_fingerprint_of(own, width) for own in hashes], dtype=np.uint64)
            digests = [hashlib.blake2b(np.unique(own.view(np.int64)).tobytes(), digest_size=16).digest() for own in hashes]
            return [*(pa.array(column) for column in rows.reshape(-1, width).view(np.int64).T), digests]

        return make

    fields = [T.StructField(name, T.LongType()) for name in _word_names(width)]
    return with_columns(frame, [*fields, T.StructField("_set", T.BinaryType())], start, text)


def hexadecimal(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


# blocks

def exact_masks(radius: int, bands: int | None = None) -> list[list[int]]:
    """Masks over 64 bits such that fingerprints within ``radius`` bits agree under at least one of them."""
    bands = bands or 2 * radius
    edges = [round(64 * band / bands) for band in range(bands + 1)]
    parts = [((1 << edges[band + 1]) - 1) ^ ((1 << edges[band]) - 1) for band in range(bands)]
    return [[sum(chosen)] for chosen in itertools.combinations(parts, bands - radius)]


def sampled_masks(width: int, share: float, rows: int, missed: float = 0.02, per_block: int = 16) -> list[list[int]]:
    """Masks of bits drawn at random: pairs that differ in ``share`` of their bits agree under one but for ``missed``.

    The bits of a mask follow the logarithm of the number of fingerprints, so
    that unrelated ones meet in blocks of about ``per_block`` at every size.
    """
    taken = max(8, math.ceil(math.log2(max(2.0, rows / per_block))))
    count = math.ceil(math.log(missed) / math.log(1 - (1 - share) ** taken))
    draw = np.random.default_rng(SEED)
    masks = []
    for _ in range(count):
        words = [0] * width
        for bit in draw.choice(64 * width, taken, replace=False):
            words[bit // 64] |= 1 << int(bit % 64)
        masks.append(words)
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keyed(prints: DataFrame, masks: list[list[int]], width: int) -> DataFrame:
    """One row for each fingerprint and mask, with the ``key`` of its block."""
    names = _word_names(width)
    keys = [F.xxhash64(F.lit(number), *[F.col(name).bitwiseAND(F.lit(_signed(mask)))
                                        for name, mask in zip(names, words) if mask])
            for number, words in enumerate(masks)]
    return prints.select("node", *names, F.explode(F.array(*keys)).alias("key"))


def _chunk_pairs(sized: DataFrame, width: int) -> DataFrame:
    """``block, node, ...`` of rows with the ``size`` of their key: large ones meet in chunk pairs."""
    chunks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    # Chunks meet pairwise; the pair of a chunk with itself is part of its pair with any other.
    met = sized.withColumn("chunks", chunks).withColumn("own", own).withColumn(
        "other", F.explode(F.expr("CASE WHEN chunks = 1 THEN array(0L) "
                                  "ELSE filter(sequence(0L, chunks - 1), x -> x <> own) END")))
    return met.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node", *_word_names(width))


def _blocks(prints: DataFrame, masks: list[list[int]], width: int) -> DataFrame:
    """One row for each fingerprint and block; only blocks of two and more are kept, large ones in chunk pairs.

    Spark takes the keys to be as few as the fingerprints and would broadcast the sizes, so the join is a merge join.
    """
    keyed = _keyed(prints, masks, width)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return _chunk_pairs(keyed.join(sizes.hint("merge"), "key"), width)


def _crowded_blocks(prints: DataFrame, masks: list[list[int]], width: int) -> DataFrame:
    """``_blocks`` and blocks of one, for masks under which few are alone: wide rows need not meet the sizes of their blocks."""
    keyed = _keyed(prints, masks, width)
    large = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "large-blocks")
    return keyed.join(large, "key", "left_anti").select(F.col("key").alias("block"), "node", *_word_names(width)).unionAll(
        _chunk_pairs(keyed.join(large, "key"), width))


class Planes:
    """A block of fingerprints stored by bit."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.count, self.width = words.shape
        bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(self.count, -1), axis=1)
        lanes = -(-self.count // 64)
        filled = np.zeros((lanes * 64, bits.shape[1]), np.uint8)
        filled[:self.count] = bits
        self.bits = bits
        self.planes = np.ascontiguousarray(np.packbits(filled, axis=0, bitorder="little").T).view(np.uint64)
        #: Planes in which all members agree need no comparison.
        self.mixed = np.flatnonzero((bits != bits[0]).any(axis=0))

    def within(self, queries: np.ndarray, radius: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``queries``, member) within ``radius`` among the members of ``open_`` (packed)."""
        size = max(1, radius.bit_length())
        head = (1 << size) - 1 - radius
        lanes = np.flatnonzero(open_)
        row = np.repeat(np.arange(len(queries)), len(lanes))
        lane = np.tile(lanes, len(queries))
        alive = open_[lane].copy()
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        counters = [np.full(len(lane), full if head >> bit & 1 else np.uint64(0)) for bit in range(size)]
        asked = np.where(self.bits[queries] == 1, full, np.uint64(0))

        def add(value: np.ndarray, weight: int) -> np.ndarray:
            for bit in range(weight, size):
                counters[bit], value = counters[bit] ^ value, counters[bit] & value
            return value

        for start in range(0, len(self.mixed), PLANES_AT_ONCE):
            chosen = self.mixed[start:start + PLANES_AT_ONCE]
            over = np.zeros(len(lane), np.uint64)
            differ = [self.planes[plane][lane] ^ asked[row, plane] for plane in chosen]
            while len(differ) >= 3:
                one, two, three = differ.pop(), differ.pop(), differ.pop()
                half = one ^ two
                over |= add(half ^ three, 0)
                carry = (one & two) | (half & three)
                over |= add(carry, 1) if size > 1 else carry
            for value in differ:
                over |= add(value, 0)
            alive &= ~over
            kept = np.flatnonzero(alive)
            if len(kept) < len(alive):
                row, lane, alive = row[kept], lane[kept], alive[kept]
                counters = [counter[kept] for counter in counters]
            if not len(kept):
                break
        found = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(found)
        return row[at], lane[at] * 64 + bit

    def forest(self, radius: int) -> Iterator[tuple[int, int]]:
        """Links that connect all that pairs within ``radius`` connect, each member linked once at most."""
        unseen = np.zeros(len(self.planes[0]) * 64, np.uint8)
        unseen[:self.count] = 1

        def packed() -> np.ndarray:
            return np.packbits(unseen, bitorder="little").view(np.uint64)

        while True:
            seeds = np.flatnonzero(unseen)[:QUERIES_AT_ONCE]
            if not len(seeds):
                return
            row, member = self.within(seeds, radius, packed())
            linked = member != seeds[row]
            row, member = row[linked], member[linked]
            alone = np.ones(len(seeds), bool)
            alone[row] = False
            unseen[seeds[alone]] = 0
            for number in np.unique(row):
                seed = seeds[number]
                if not unseen[seed]:
                    continue
                unseen[seed] = 0
                reached = [other for other in member[row == number] if unseen[other]]
                unseen[reached] = 0
                yield from ((seed, other) for other in reached)
                queue = reached
                while queue and unseen.any():
                    asked, queue = np.array(queue[:QUERIES_AT_ONCE]), queue[QUERIES_AT_ONCE:]
                    origin, others = self.within(asked, radius, packed())
                    others, first = np.unique(others, return_index=True)
                    unseen[others] = 0
                    yield from zip(asked[origin[first]], others)
                    queue.extend(others)


def _small_links(node: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int,
                 ) -> Iterator[tuple[int, int]]:
    """Links of many blocks of up to ``SMALL`` members, as a forest in each."""
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.concatenate([np.arange(start, start + size) for start, size in zip(starts, sizes)]) if len(starts) else starts
    parent: dict[int, int] = {}

    def find(row: int) -> int:
        while parent.get(row, row) != row:
            row = parent[row]
        return row

    for step in range(1, int(sizes.max(initial=1))):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        left, right = rows[same], rows[same + step]
        close = np.bitwise_count(words[left] ^ words[right]).sum(axis=1) <= radius
        for one, two in zip(left[close].tolist(), right[close].tolist()):
            first, second = find(one), find(two)
            if first != second:
                parent[second] = first
                parent.setdefault(first, first)
                yield one, two


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from batches in the order of their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        last = int(np.flatnonzero(block == block[-1])[0]) if block[0] != block[-1] else 0
        if last or (held and held[-1].column(0)[-1].as_py() != block[0]):
            if last == 0:
                yield pa.Table.from_batches(held)
                held = [batch]
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch], radius: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links of blocks that come in order; a block never exceeds two chunks."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        block = table.column(0).to_numpy()
        node = table.column(1).to_numpy()
        words = np.stack([table.column(2 + word).to_numpy() for word in range(width)], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.append(starts, len(block)))
        small = (sizes > 1) & (sizes <= SMALL)
        pairs = list(_small_links(node, words, starts[small], sizes[small], radius))
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            pairs.extend((start + one, start + two) for one, two in Planes(words[start:start + size]).forest(radius))
        found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], schema=_EDGES)

    for table in _whole_blocks(batches):
        yield solve(table)


def link(prints: DataFrame, radius: int, masks: list[list[int]], width: int = 1) -> DataFrame:
    """Links ``a, b`` that connect what fingerprints (``node, _w0, ...``) within ``radius`` connect."""
    blocks = _blocks(prints, masks, width)
    dealt = blocks.repartition(partitions(prints.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(lambda batches: _links(batches, radius, width), "a long, b long")


# candidates and their verification

_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("done", pa.int64())])


def _led_pairs(words: np.ndarray, node: np.ndarray, label: np.ndarray, radius: int, done: int, budget: float,
               ) -> tuple[list[np.ndarray], int]:
    """Pairs of a block within ``radius`` and of two labels, led by ever more members from number ``done`` on.

    Stops after the leaders that bring more than ``budget`` pairs a member; the
    second value is the number of leaders done.
    """
    order = np.argsort(node * np.int64(_GOLDEN >> 1), kind="stable")
    node, label, planes = node[order], label[order], Planes(words[order])
    count, found, total, step = len(node), [], 0, 1
    while done < count and total <= budget * count:
        upto = min(count, done + step)
        open_ = np.zeros(len(planes.planes[0]) * 64, np.uint8)
        open_[done + 1:count] = 1
        leaders = np.arange(done, upto)
        row, member = planes.within(leaders, radius, np.packbits(open_, bitorder="little").view(np.uint64))
        leader = leaders[row]
        good = (member > leader) & (label[leader] != label[member])
        found.append(np.stack([node[leader[good]], node[member[good]]], axis=1))
        total += int(good.sum())
        done, step = upto, min(2 * step, QUERIES_AT_ONCE)
    return found, done


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, width: int, budget: float) -> Iterator[pa.RecordBatch]:
    """Pairs within ``radius`` (``done`` -1), and blocks left unfinished with the number of their leaders done."""
    for table in _whole_blocks(batches):
        block, node, label, done = (table.column(at).to_numpy() for at in range(4))
        words = np.stack([table.column(4 + word).to_numpy() for word in range(width)], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.append(starts, len(block)))
        number = np.repeat(np.arange(len(starts)), sizes)
        small = sizes <= PAIRWISE
        rows = np.flatnonzero(small[number])
        left, right = [], []
        for step in range(1, int(sizes[small].max(initial=1))):
            one = np.flatnonzero(number[rows[step:]] == number[rows[:-step]])
            one, two = rows[one], rows[one + step]
            close = (np.bitwise_count(words[one] ^ words[two]).sum(axis=1) <= radius) & (label[one] != label[two])
            left.append(one[close])
            right.append(two[close])
        left, right = (np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in (left, right))
        # A block of many links is led by few members first, so that a group is no square of its size.
        crowded = ~small | (np.bincount(number[left], minlength=len(sizes)) > SMALL * sizes / 2)
        kept = ~crowded[number[left]]
        found, open_ = [np.stack([node[left[kept]], node[right[kept]]], axis=1)], []
        for start, size in zip(starts[crowded], sizes[crowded]):
            whole = slice(start, start + size)
            pairs, upto = _led_pairs(words[whole], node[whole], label[whole], radius, int(done[start]), budget)
            found += pairs
            if upto < size:
                open_.append((block[start], upto))
        pairs, left_open = np.concatenate(found), np.array(open_, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([pairs[:, 0], left_open[:, 0]])),
            pa.array(np.concatenate([pairs[:, 1], np.zeros(len(left_open), np.int64)])),
            pa.array(np.concatenate([np.full(len(pairs), -1), left_open[:, 1]]))], schema=_CANDIDATES)


def _resemble(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose sorted shingle sets have this Jaccard similarity or more."""
    for batch in batches:
        kept = np.zeros(batch.num_rows, bool)
        for at, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
            one, two = one.values.to_numpy(), two.values.to_numpy()
            if min(len(one), len(two)) < least * max(len(one), len(two)):
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            kept[at] = both >= least * (len(one) + len(two) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_EDGES).filter(pa.array(kept))


def _verified(pairs: DataFrame, documents: DataFrame, keys: DataFrame, text: str, size: int, least: float) -> DataFrame:
    """The pairs whose texts resemble each other; ``keys`` names a document (``_key``) for each node."""
    def start():
        return lambda batch: [[np.unique(_shingle_hashes(value, size).view(np.int64)) for value in texts_of(batch, text)]]

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(keys, "node")
    texts = documents.join(asked, "_key").select("node", text).dropDuplicates(["node"])
    sets = stored(with_columns(texts, [T.StructField("_set", T.ArrayType(T.LongType()))], start, text).select(
        "node", "_set"), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("_set").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("_set").alias("two")), "b").select("a", "b", "one", "two")
    return stored(both.mapInArrow(lambda batches: _resemble(batches, least), "a long, b long"), "verified-links")


def _verified_groups(nodes: DataFrame, radius: int, masks: list[list[int]], width: int, verify) -> DataFrame:
    """``vertex, root`` by the pairs within ``radius`` that ``verify`` confirms.

    Every pair of a block is verified or already connected by confirmed ones: a
    block stops at its budget of pairs and goes on in the next round, with a
    larger budget and without the pairs of one component.
    """
    names = _word_names(width)
    spark = nodes.sparkSession
    blocks = _crowded_blocks(nodes, masks, width)
    members = blocks.select("block", "node", F.col("node").alias("label"), F.lit(0).cast("long").alias("done"), *names)
    found, budget = None, 0.5
    while True:
        dealt = members.repartition(partitions(spark), "block").sortWithinPartitions("block")
        made = stored(dealt.mapInArrow(lambda batches, limit=budget: _candidates(batches, radius, width, limit),
                                       "a long, b long, done long"), "candidates")
        links = verify(made.where("done < 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = links if found is None else found.unionAll(links)
        groups = components(found)
        open_ = made.where("done >= 0").select(F.col("a").alias("block"), "done")
        if open_.isEmpty():
            return groups
        members = blocks.join(open_, "block").join(groups, F.col("node") == F.col("vertex"), "left").select(
            "block", "node", F.coalesce("root", "node").alias("label"), "done", *names)
        budget *= 8


# whole operators

def _first_ids(prints: DataFrame, links: DataFrame, doc_id: str) -> DataFrame:
    """``node, component_id``: the smallest id of a document whose fingerprint the node reaches."""
    first = prints.groupBy("node").agg(F.min(doc_id).alias("first"))
    labelled = first.join(components(links), F.col("node") == F.col("vertex"), "left").select(
        "node", "first", F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(lowest, "root").select("node", "component_id")


def near_groups(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3,
                radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with fingerprints of 64 bits linked at ``radius`` bits or fewer.

    Exact: blocks miss no pair within the radius.  Texts without words have
    fingerprint zero and are linked like any other.  Rows keep their number;
    a null id takes part and is never a component's smallest.
    """
    prints = stored(with_fingerprints(documents.select(doc_id, text), text, size).select(
        doc_id, F.col("_w0").alias("node"), "_w0"), "fingerprints")
    links = link(prints.select("node", "_w0").distinct(), radius, exact_masks(radius))
    found = _first_ids(prints, links, doc_id)
    return prints.join(found, "node").select(doc_id, hexadecimal(F.col("node")).alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """Share of SimHash bits in which two sets of this Jaccard similarity and equal size differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5,
                similarity: float = 0.8, width: int = 4) -> DataFrame:
    """Documents without those that resemble one with a smaller id, directly or through others.

    Two resemble each other when the Jaccard similarity of their shingle sets is
    ``similarity`` or more.  Candidates are fingerprints of ``width`` words that
    differ in no more bits than such sets do on average plus three standard
    deviations.  Of rows with the same id, or none, one stays by its text.  All
    columns of the input are kept.
    """
    share = differing_share(similarity)
    bits = 64 * width
    radius = math.floor(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    names = _word_names(width)
    key = F.xxhash64(doc_id, text).alias("_key")
    # A node is one fingerprint of one set: unlike texts with the same fingerprint meet like any others.
    prints = stored(with_signatures(documents.select(doc_id, text), text, size, width).select(
        doc_id, key, F.xxhash64(*names, "_set").alias("node"), *names), "wide-fingerprints")
    nodes = stored(prints.select("node", *names).distinct(), "nodes")
    keys = prints.groupBy("node").agg(F.min("_key").alias("_key"))
    keyed = documents.select(key, text)
    groups = _verified_groups(
        nodes, radius, sampled_masks(width, radius / bits, nodes.count(), per_block=64), width,
        lambda pairs: _verified(pairs, keyed, keys, text, size, similarity))
    labelled = prints.select(doc_id, "_key", "node").join(
        groups, F.col("node") == F.col("vertex"), "left").select(
        doc_id, "_key", F.coalesce("root", "node").alias("root"))
    first = labelled.groupBy("root").agg(F.min(F.struct(
        F.col(doc_id).isNull().alias("unnamed"), F.col(doc_id).alias("id"), "_key")).alias("first"))
    return documents.withColumn("_key", key).join(
        first.select("first._key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
