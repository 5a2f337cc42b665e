"""MinHash near-dedup by a chosen-path set similarity join.

A document is a set of word shingles and a sketch of its minwise tokens.
In a tree, a node takes two of the positions, drawn by its name, and sends
each of its documents to one child for each, named by the minwise token found
there.  Documents of similarity s share a child with probability about s, so
that two children a node make the surviving paths of a similar pair a branching
process that does not die out (at 0.8 it lives with probability 0.94), while
unrelated documents part at once.  Small nodes are
compared exhaustively, larger ones branch again; independent trees bring the
share of missed pairs below what is asked for (``trees``).

Large nodes are thinned before they branch: a few of their documents, the
pivots, meet all others, so that a large group of copies is one component
at once.  Only pairs of documents that are not connected yet are left to
compare, so a node is small when it has up to ``SMALL`` documents, or up to ``SMALL`` outside its largest
component: these meet all others in chunks, at a cost that grows with the node and not with its square.

In a small node, sketches name the pairs that may be similar, and the full sets of their
documents come to the node and decide; the likeliest pairs go first, and pairs connected by then are left out.  A pair
that meets in several nodes is decided in the first of them.
Documents with the same set are one class from the start.

Hashes of sets have 128 bits.  A shingle is a hash of 64 bits within its set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.components import components
from arenaflow.llm.frames import partitions, stored, texts_of, with_columns

POSITIONS = 64
#: Positions compared, by one byte each.
COMPARED = 256
SMALL = 8192
PIVOTS = 4
#: Pairs whose nodes are looked up at once.
PAIRS_AT_ONCE = 1 << 14
SEED = 42
#: Buckets of documents asked for; the broadcast table of those hit has at most so many rows.
BUCKETS = 1 << 20
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_GOLDEN = 0x9E3779B97F4A7C15


# sets and sketches

def _mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of every text.

    A-Z are lower-cased, words are runs without ASCII white space; a text
    with fewer words is one shingle, one without words none.
    """
    from xxhash import xxh64_intdigest

    words = [text.encode().lower().split() for text in texts]
    names = pa.array([word for row in words for word in row], pa.binary()).dictionary_encode()
    table = np.fromiter((xxh64_intdigest(word, SEED) for word in names.dictionary.to_pylist()), np.uint64,
                        len(names.dictionary))
    hashes = table[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.uint64)
    found, start = [], 0
    for row in words:
        own = hashes[start:start + len(row)]
        start += len(row)
        width = min(size, len(own))
        if not width:
            found.append(np.empty(0, np.uint64))
            continue
        # The place of a word counts, and so does the number of words.
        code = np.full(len(own) - width + 1, width * _GOLDEN % (1 << 64), np.uint64)
        for at in range(width):
            code = _mix(code * np.uint64(3) + own[at:at + len(code)])
        found.append(np.unique(code))
    return found


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every set, ``POSITIONS`` minwise tokens for branching and a byte of each of ``COMPARED`` ones; ones if empty."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 31, COMPARED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = draw.integers(0, 1 << 32, COMPARED, dtype=np.uint32)
    found = np.full((COMPARED, len(sets)), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(own) for own in sets], np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        tokens = np.concatenate([sets[row] for row in filled])
        tokens = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
        for position in range(COMPARED):
            found[position, filled] = np.minimum.reduceat((tokens + offsets[position]) * factors[position], starts)
    found = np.ascontiguousarray(found.T)
    return found[:, :POSITIONS], found.astype(np.uint8)


def trees(similarity: float, missed: float = 1e-4) -> int:
    """Trees after which a pair at ``similarity`` is missed with probability ``missed`` at most.

    A pair keeps a path below a node with probability (2p - 1) / p^2 where p is
    the share of positions it agrees in, taken one standard deviation low.
    """
    share = similarity - math.sqrt(similarity * (1 - similarity) / POSITIONS)
    return max(1, math.ceil(math.log(missed) / math.log(1 - (2 * share - 1) / share ** 2)))


def least_agreeing(similarity: float) -> int:
    """Compared positions in which a pair agrees at least, but for about one in a hundred thousand."""
    return math.floor(COMPARED * similarity - 4.3 * math.sqrt(COMPARED * similarity * (1 - similarity)))


# trees

def _branch(node: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Names of the two children of every row: by node, position drawn and minwise token found there."""
    drawn = _mix(node ^ np.uint64(_GOLDEN))
    first = (drawn >> np.uint64(32)) % np.uint64(POSITIONS)
    second = (first + np.uint64(1) + (drawn & np.uint64(0xFFFFFFFF)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
    rows = np.arange(len(node))
    return np.stack([_mix(_mix(node + (taken + np.uint64(1)) * np.uint64(_GOLDEN)) + sketch[rows, taken.astype(np.int64)])
                     for taken in (first, second)], axis=1)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


_NAMED = pa.schema([("node", pa.int64()), ("cls", pa.int64()), ("label", pa.int64())])


def _children(batches: Iterator[pa.RecordBatch], roots: list[int] | None) -> Iterator[pa.RecordBatch]:
    """``node, cls, label`` for the children of every row (``cls, tokens`` and, below the roots, ``node, label``)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, sketch = batch.column(0), _matrix(batch.column(1), np.uint32, POSITIONS)
        nodes = ([np.full(len(cls), root, np.uint64) for root in roots] if roots is not None
                 else [batch.column(2).to_numpy().view(np.uint64)])
        label = cls if roots is not None else batch.column(3)
        for node in nodes:
            made = _branch(node, sketch)
            for child in range(made.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(made[:, child].view(np.int64)), cls, label], schema=_NAMED)


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.count_nonzero(one == two, axis=1)


def _pivot_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``a`` pivot, ``b`` document: pairs that agree among rows ``cls, label, bits, pivots``."""
    for batch in batches:
        cls, label, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint8, COMPARED)
        lists = batch.column(3)
        row = np.repeat(np.arange(len(cls)), lists.value_lengths().to_numpy())
        drawn = lists.flatten()
        pivot, pivot_label = drawn.field("pivot").to_numpy(), drawn.field("label").to_numpy()
        close = (label[row] != pivot_label) & (_agreeing(bits[row], _matrix(drawn.field("bits"), np.uint8, COMPARED)) >= least)
        yield pa.RecordBatch.from_arrays([pa.array(pivot[close]), pa.array(cls[row[close]])], schema=_EDGES)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes; rows come sorted by node, and a node has about two times ``SMALL`` rows at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        if cut or held and held[-1].column(0)[-1].as_py() != node[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _share_earlier(held: np.ndarray, ends: np.ndarray, node: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the rows ``one`` and ``two`` of pairs are together in a node before their own, of ``held[ends[row]:ends[row + 1]]``."""
    found = np.zeros(len(one), bool)
    sizes = np.diff(ends)
    for start in range(0, len(one), PAIRS_AT_ONCE):
        part = slice(start, start + PAIRS_AT_ONCE)
        a, b = one[part], two[part]
        for i in range(int(sizes[a].max())):
            at = held[np.minimum(ends[a] + i, len(held) - 1)]
            open_ = np.flatnonzero(~found[part] & (i < sizes[a]) & (at < node[a]))
            if not len(open_):
                continue
            for j in range(int(sizes[b[open_]].max())):
                other = b[open_]
                met = (j < sizes[other]) & (held[np.minimum(ends[other] + j, len(held) - 1)] == at[open_])
                found[start + open_[met]] = True
    return found


def _owned_pairs(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pairs to decide in these whole nodes, and their agreement.

    Rows are ``chunk, cls, label, lead, node, nodes, bits``: a pair is of unconnected documents of a
    chunk, one of them leads, they agree, and no earlier node holds both.
    """
    chunk, cls, label, lead, node = (table.column(at).to_numpy() for at in range(5))
    lists, bits = table.column(5).chunk(0) if len(chunk) else None, _matrix(table.column(6), np.uint8, COMPARED)
    ends, held = (lists.offsets.to_numpy(), lists.values.to_numpy()) if len(chunk) else (None, None)
    # A quarter of the positions rules out most pairs, with a wider margin.
    few = np.ascontiguousarray(bits[:, :COMPARED // 4])
    hint = max(0, least // 4 - 8)
    left, right, agreed = [], [], []
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        one, two, same = (np.concatenate(side) for side in zip(*waiting))
        waiting.clear()
        first = ~_share_earlier(held, ends, node, one, two)
        left.append(one[first])
        right.append(two[first])
        agreed.append(same[first])

    for step in range(1, len(chunk)):
        one = np.flatnonzero(chunk[step:] == chunk[:-step])
        if not len(one):
            break
        one = one[(label[one] != label[one + step]) & (lead[one] | lead[one + step])]
        one = one[_agreeing(few[one], few[one + step]) >= hint]
        same = _agreeing(bits[one], bits[one + step])
        kept = same >= least
        waiting.append((one[kept], one[kept] + step, same[kept]))
        if sum(len(pairs) for pairs, _, _ in waiting) >= PAIRS_AT_ONCE or len(waiting) >= 256:
            settle()
    if waiting:
        settle()
    return tuple(np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in (left, right, agreed))


def _involved(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``a`` chunk, ``b`` class of the documents with a pair to decide in the chunk."""
    for table in _whole_nodes(batches):
        table = table.combine_chunks()
        left, right, _ = _owned_pairs(table, least)
        rows = np.unique(np.concatenate([left, right]))
        yield pa.RecordBatch.from_arrays([pa.array(table.column(at).to_numpy()[rows]) for at in (0, 1)], schema=_EDGES)


def _decided(batches: Iterator[pa.RecordBatch], least: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Documents involved (with their set as the last column) that links connect, as stars around one of them."""
    for table in _whole_nodes(batches):
        table = table.combine_chunks()
        chunk, cls, label = (table.column(at).to_numpy() for at in range(3))
        left, right, agreed = _owned_pairs(table, least)
        sets = [np.frombuffer(value.as_buffer(), np.uint64) for value in table.column(7).chunk(0)] if len(left) else []
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def top(key):
            while parent.get(key, key) != key:
                parent[key] = parent.get(parent[key], parent[key])
                key = parent[key]
            return key

        joined = set()
        for at in np.argsort(-agreed, kind="stable").tolist():
            one, two = int(left[at]), int(right[at])
            low, high = top((int(chunk[one]), int(label[one]))), top((int(chunk[two]), int(label[two])))
            if low != high and _alike(sets[one], sets[two], similarity):
                parent[low] = high
                joined |= {(int(chunk[one]), int(label[one])), (int(chunk[two]), int(label[two]))}
        # What is connected is told as a star around its least class, which other nodes of the same documents share.
        groups: dict[tuple[int, int], list[int]] = {}
        for key, member in zip(zip(chunk.tolist(), label.tolist()), cls.tolist()):
            if key in joined:
                groups.setdefault(top(key), []).append(member)
        links = [(least_class, member) for members in groups.values() for least_class in [min(members)]
                 for member in set(members) if member != least_class]
        found = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_EDGES)


def _alike(one: np.ndarray, two: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more, as a fraction."""
    over, under = similarity
    if len(one) > len(two):
        one, two = two, one
    if not len(one) or under * len(one) < over * len(two):
        return False
    both = int(np.count_nonzero(two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one))
    return under * both >= over * (len(one) + len(two) - both)


def _resemble(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs (``a, b, one, two``) whose sets have this similarity or more."""
    for batch in batches:
        kept = [_alike(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64), similarity)
                for one, two in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_EDGES).filter(pa.array(kept, pa.bool_()))


class _Sets:
    """Full sets of classes, each made from its text once, when first asked for."""

    def __init__(self, documents: DataFrame, classes: DataFrame, size: int):
        self.documents, self.size = documents, size
        self.places = classes.select("cls", "_id", "_hash")
        self.known: DataFrame | None = None

    def of(self, asked: DataFrame) -> DataFrame:
        """``cls, _set`` of the classes asked for (``cls``, distinct), among others."""
        if self.known is not None:
            asked = asked.join(self.known, "cls", "left_anti")
        bucket = F.pmod(F.xxhash64("_id", "_hash"), F.lit(BUCKETS))
        places = stored(asked.join(self.places, "cls").withColumn("_bucket", bucket), "asked-places")
        near = self.documents.withColumn("_bucket", bucket).join(
            F.broadcast(places.select("_bucket").distinct()), "_bucket", "left_semi").drop("_bucket")
        texts = near.join(places.select("cls", F.col("_id").alias("_asked"), "_hash"), "_hash").where(
            F.col("_id").eqNullSafe(F.col("_asked"))).select("cls", "_text").dropDuplicates(["cls"])
        size = self.size

        def start():
            return lambda batch: [[own.tobytes() for own in shingle_sets(texts_of(batch, "_text"), size)]]

        made = stored(with_columns(texts, [T.StructField("_set", T.BinaryType())], start, "_text").select("cls", "_set"), "sets")
        self.known = made if self.known is None else self.known.unionAll(made)
        return self.known


def _star_labels(links: DataFrame) -> DataFrame:
    """``cls, label`` of the linked documents: every ``b`` is contracted into its least ``a`` before components are sought."""
    stars = stored(links.groupBy("b").agg(F.min("a").alias("star")), "stars")
    centres = links.join(stars, "b").select("a", "star").join(
        stars.select(F.col("b").alias("a"), F.col("star").alias("up")), "a", "left").select(
        "a", "star", F.coalesce("up", "a").alias("centre"))
    between = stored(centres.distinct(), "centres")
    roots = components(between, "star", "centre")
    placed = stars.select(F.col("b").alias("cls"), "star").unionAll(
        between.where("a = centre").select(F.col("a").alias("cls"), F.col("a").alias("star")).distinct())
    return stored(placed.join(roots, F.col("star") == F.col("vertex"), "left").select(
        "cls", F.coalesce("root", "star").alias("label")), "labels")


def _relabelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``node, cls, label`` of rows ``node, cls``: a class is looked up once, however many nodes it is in."""
    if labels is None:
        return rows.select("node", "cls", F.col("cls").alias("label"))
    places = rows.groupBy("cls").agg(F.collect_list("node").alias("nodes")).join(labels, "cls", "left")
    return places.select(F.explode("nodes").alias("node"), "cls", F.coalesce("label", "cls").alias("label"))


def _unsettled(named: DataFrame) -> DataFrame:
    """The rows ``node, cls, label`` of nodes that still hold several components.

    ``members`` is the size of the node, ``major`` its largest component and
    ``least`` the smaller of the size and the number of members outside that component.
    """
    parts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("part"))
    sizes = parts.groupBy("node").agg(F.sum("part").alias("members"), F.max(F.struct("part", "label")).alias("most"),
                                      F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return named.join(sizes.select(
        "node", "members", F.col("most.label").alias("major"),
        F.when(F.col("members") <= SMALL, F.col("members")).otherwise(F.col("members") - F.col("most.part")).alias("least")), "node")


def _in_chunks(rows: DataFrame) -> DataFrame:
    """``chunk, cls, label, lead, node`` of small nodes: above ``SMALL`` members, those outside the largest component visit all chunks."""
    chunks = F.ceil(F.col("members") / F.lit(SMALL)).cast("long")
    whole, home = F.col("members") <= SMALL, F.array(F.lit(-1).cast("long"))
    visits = F.when(~whole & (F.col("label") != F.col("major")), F.sequence(F.lit(-1).cast("long"), chunks - 1)).otherwise(home)
    spread = rows.select("node", "cls", "label", "members", F.pmod(F.xxhash64("cls"), chunks).alias("own"),
                         F.explode(visits).alias("visit"))
    return spread.select(
        F.when(whole, F.col("node")).otherwise(F.xxhash64("node", F.when(F.col("visit") < 0, F.col("own")).otherwise(
            F.col("visit")))).alias("chunk"), "cls", "label", (whole | (F.col("visit") >= 0)).alias("lead"), "node")


def _pivots(rows: DataFrame) -> DataFrame:
    """``node, cls, label`` for a few documents of every node, drawn by component so that small ones get their turn."""
    drawn = rows.groupBy("node").agg(*[
        F.min(F.struct(F.xxhash64("label", "node", F.lit(turn)), F.xxhash64("cls", F.lit(turn)), "cls", "label")).alias(f"p{turn}")
        for turn in range(PIVOTS)])
    return drawn.select("node", F.explode(F.array_distinct(F.array(*[
        F.struct(F.col(f"p{turn}.cls"), F.col(f"p{turn}.label")) for turn in range(PIVOTS)]))).alias("drawn")).select("node", "drawn.*")


def class_links(documents: DataFrame, classes: DataFrame, size: int, similarity: tuple[int, int],
                missed: float = 1e-4) -> DataFrame:
    """``cls, label``: components of the classes with a link."""
    spark = documents.sparkSession
    share = similarity[0] / similarity[1]
    least = least_agreeing(share)
    # Two sets of fewer shingles than this are equal or below the similarity.
    fewest = math.ceil(share / (1 - share) - 1e-9)
    taking_part = classes.where(F.col("n") >= fewest).select("cls", "tokens", "bits")
    roots = [int.from_bytes(hashlib.sha256(f"tree {tree}".encode()).digest()[:8], "big") for tree in range(trees(share, missed))]
    sets, labels, links = _Sets(documents, classes, size), None, None
    below = taking_part.select("cls", "tokens").mapInArrow(
        lambda batches: _children(batches, roots), "node long, cls long, label long")
    small: list[DataFrame] = []
    while True:
        members = stored(_unsettled(stored(below, "children")), "nodes")
        small.append(members.where(F.col("least") <= SMALL).select("node", "cls"))
        large = members.where(F.col("least") > SMALL)
        if large.isEmpty():
            break
        chosen = _pivots(large).join(taking_part.select("cls", "bits"), "cls").groupBy("node").agg(
            F.collect_list(F.struct(F.col("cls").alias("pivot"), "label", "bits")).alias("pivots"))
        met = large.select("node", "cls", "label").join(taking_part.select("cls", "bits"), "cls").join(chosen, "node").select(
            "cls", "label", "bits", "pivots")
        pairs = stored(met.mapInArrow(lambda batches: _pivot_pairs(batches, least), "a long, b long").distinct(), "pivot-pairs")
        known = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        both = pairs.join(known.select(F.col("cls").alias("b"), F.col("_set").alias("two")), "b").join(
            known.select(F.col("cls").alias("a"), F.col("_set").alias("one")), "a").select("a", "b", "one", "two")
        found = stored(both.mapInArrow(lambda batches: _resemble(batches, similarity), "a long, b long"), "links")
        links = found if links is None else links.unionAll(found)
        labels = _star_labels(links)
        # Nodes that the pivots have all but connected do not branch.
        members = stored(_unsettled(stored(_relabelled(large, labels), "relabelled")), "thinned-nodes")
        small.append(members.where(F.col("least") <= SMALL).select("node", "cls"))
        open_ = members.where(F.col("least") > SMALL)
        if open_.isEmpty():
            break
        below = open_.select("node", "cls", "label").join(taking_part, "cls").select("cls", "tokens", "node", "label").mapInArrow(
            lambda batches: _children(batches, None), "node long, cls long, label long")
    members = small[0]
    for more in small[1:]:
        members = members.unionAll(more)
    members = stored(_unsettled(stored(_relabelled(members, labels), "relabelled")).select(
        "node", "cls", "label", "members", "major"), "small-nodes")
    places = members.groupBy("cls").agg(F.collect_list("node").alias("nodes"))

    def dealt(rows: DataFrame, *besides: str) -> DataFrame:
        named = rows.join(places, "cls").join(taking_part.select("cls", "bits"), "cls").select(
            "chunk", "cls", "label", "lead", "node", "nodes", "bits", *besides)
        return named.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")

    rows = stored(_in_chunks(members), "chunks")
    involved = stored(dealt(rows).mapInArrow(lambda batches: _involved(batches, least), "a long, b long").select(
        F.col("a").alias("chunk"), F.col("b").alias("cls")).distinct(), "involved")
    known = sets.of(involved.select("cls").distinct())
    asked = rows.join(involved, ["chunk", "cls"]).join(known, "cls")
    found = stored(dealt(asked, "_set").mapInArrow(lambda batches: _decided(batches, least, similarity), "a long, b long"), "links")
    links = found if links is None else links.unionAll(found)
    return _star_labels(links)


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5,
                    similarity: tuple[int, int] = (4, 5), missed: float = 1e-4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two rows are linked when the Jaccard similarity of their sets of
    ``size``-word shingles is ``similarity`` (a fraction of whole numbers) or more; a
    link is missed with probability ``missed`` at most and none is made up.
    Rows with the same set are always one component.  A null or empty text and one without words has an
    empty set and is linked with nothing.  Repeated rows keep their number and share a component; a
    null id takes part and is never a component's smallest, so rows that reach
    no id have component null.  ``kept`` marks rows whose id is their component's, all of
    them where ids repeat.  Texts of any length are one row; other
    columns are not looked at; an empty table gives no rows.
    """
    source = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))

    def start():
        def make(batch):
            sets = shingle_sets(texts_of(batch, "_text"), size)
            digests = np.frombuffer(b"".join(hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in sets),
                                    np.int64).reshape(-1, 2)
            return [[len(own) for own in sets], pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    *([row.tobytes() for row in side] for side in sketches(sets))]

        return make

    long = T.LongType()
    signed = stored(with_columns(source, [
        T.StructField("n", long), T.StructField("_d0", long), T.StructField("_d1", long),
        T.StructField("tokens", T.BinaryType()), T.StructField("bits", T.BinaryType())], start, "_text").drop("_text").withColumn(
        "row", F.monotonically_increasing_id()), "sketches")
    firsts = stored(signed.where("n > 0").groupBy("_d0", "_d1").agg(
        F.min("row").alias("cls"), F.min("_id").alias("lowest")), "classes")
    classes = stored(signed.join(firsts.select(F.col("cls").alias("row")), "row", "left_semi").select(
        F.col("row").alias("cls"), "n", "_id", "_hash", "tokens", "bits"), "class-sketches")
    labels = class_links(source, classes, size, similarity, missed)
    named = firsts.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = named.groupBy("label").agg(F.min("lowest").alias("component_id"))
    found = named.join(lowest, "label").select("_d0", "_d1", "component_id")
    placed = signed.where("n > 0").join(found, ["_d0", "_d1"]).select("_id", "n", "component_id").unionAll(
        signed.where("n = 0").select("_id", "n", F.col("_id").alias("component_id")))
    return placed.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id",
                         F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
