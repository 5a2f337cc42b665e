"""Merkle manifest of a dataset, built and proved by time-forward processing.

Nodes are labelled so that every child comes before its parent: a leaf by its
place in its group, a node by its level and number.  The upward sweep handles
labels in ascending order; a node takes its children's digests from a priority
queue ordered by label and puts its own in for its parent.  The reversed sweep
hands every child its proof suffix, the siblings on the way to the root.

The queue is external: labels of one block (``ARITY ** DEPTH`` consecutive
nodes and what stands above them) pass through a heap in the task that holds
the block, messages to later blocks lie in a written table that is sorted by
label before the next sweep reads it.  A task holds one block at a time, and a
block is small whatever the size of its group, so a hot group is many blocks.
Groups are trees of their own; their roots are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.frames import numbered, partitions, stored

ARITY = 16
DEPTH = 3
SPAN = ARITY ** DEPTH
_ROWS = 4096


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for a null field, else its UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
             for value in (field.cast("string") for field in fields)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# in a block

def sweep_up(first: int, digests: Sequence[str], count: int) -> list[tuple[int, int, list[str], str]]:
    """Nodes above the leaves ``first``, ``first + 1``, ... of a tree of ``count``, up to ``DEPTH`` levels, by label."""
    height, left = 0, count
    while left > 1 and height < DEPTH:
        height, left = height + 1, -(-left // ARITY)
    queue = [(1, number // ARITY, number % ARITY, digest) for number, digest in enumerate(digests, first)] if height else []
    heapify(queue)
    nodes = []
    while queue:
        level, number = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, number):
            children.append(heappop(queue)[3])
        digest = digest_of("".join(children))
        nodes.append((level, number, children, digest))
        if level < height:
            heappush(queue, (level + 1, number // ARITY, number % ARITY, digest))
    return nodes


def sweep_down(first: int, size: int, nodes: list, suffix: tuple | None) -> list[tuple | None]:
    """Proof suffixes of the leaves of a block: nested pairs of (siblings before and after, suffix of the parent)."""
    if not nodes:
        return [suffix] * size
    waiting = {nodes[-1][:2]: suffix}
    for level, number, children, _ in reversed(nodes):
        above, joined, width = waiting.pop((level, number)), "".join(children), len(children[0])
        for place in range(len(children)):
            waiting[level - 1, number * ARITY + place] = (
                (joined[:width * place], joined[width * (place + 1):]), above)
    return [waiting[0, number] for number in range(first, first + size)]


def fold(digest: str, suffix: tuple | None) -> str:
    """The root that a digest and its proof suffix lead to."""
    while suffix is not None:
        (before, after), suffix = suffix
        digest = digest_of(before + digest + after)
    return digest


def _flat(suffix: tuple | None) -> list[str]:
    found = []
    while suffix is not None:
        found.extend(suffix[0])
        suffix = suffix[1]
    return found


def _nested(flat: Sequence[str]) -> tuple | None:
    suffix = None
    for at in range(len(flat) - 2, -1, -2):
        suffix = ((flat[at], flat[at + 1]), suffix)
    return suffix


# tables of nodes: tree, number (place in the tree), count (size of the tree), digest

def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after the other; batches are sorted by ``tree, block``."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)


def _by_label(frame: DataFrame) -> DataFrame:
    """Deliver rows by label: blocks in ranges of labels, sorted in every task."""
    return frame.repartitionByRange(partitions(frame.sparkSession), "tree", "block").sortWithinPartitions(
        "tree", "block", "number")


_TOPS = pa.schema([("tree", pa.string()), ("number", pa.int64()), ("count", pa.int64()), ("digest", pa.string())])


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tops():
        for rows in _grouped(batches):
            nodes = sweep_up(rows[0]["number"], [row["digest"] for row in rows], rows[0]["count"])
            yield (rows[0]["tree"], rows[0]["block"], max(1, -(-rows[0]["count"] // SPAN)),
                   nodes[-1][3] if nodes else rows[0]["digest"])

    return _batches(tops(), _TOPS)


def _with_block(frame: DataFrame) -> DataFrame:
    return frame.withColumn("block", F.expr(f"number div {SPAN}"))


def _forest(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Node tables of every pass, the leaves first, and ``tree, digest`` of the roots."""
    passes, roots = [leaves], None
    while True:
        lower = _with_block(passes[-1].select("tree", "number", "count", "digest"))
        tops = stored(_by_label(lower).mapInArrow(_up, "tree string, number long, count long, digest string"), "tops")
        done = tops.where("count = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionAll(done)
        later = tops.where("count > 1")
        if later.isEmpty():
            return passes, roots
        passes.append(later)


_MESSAGES = "tree string, block long, subroot string, root string, suffix array<string>"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages to the blocks below from the messages to blocks (first in their block) and the nodes of a pass."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("root", pa.string()),
                        ("suffix", pa.list_(pa.string()))])

    def messages():
        for head, *rows in _grouped(batches):
            first, nodes = rows[0]["number"], sweep_up(rows[0]["number"], [row["digest"] for row in rows], rows[0]["count"])
            for row, suffix in zip(rows, sweep_down(first, len(rows), nodes, _nested(head["suffix"]))):
                yield row["tree"], row["number"], head["subroot"], head["root"], _flat(suffix)

    return _batches(messages(), schema)


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes of a pass with the message to their block as its first row."""
    return _by_label(_with_block(nodes).unionByName(
        messages.withColumn("number", F.lit(-1).cast("long")), allowMissingColumns=True))


def manifest(
    documents: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source",
    order: str = "doc_id", doubted: Column | None = None, claims: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``order, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf is the digest of a row's ``fields``.  The rows of a group ascend by
    ``order`` (null first, equal ones by digest, so that repeated rows are
    leaves of their own and interchangeable); groups ascend bytewise, the null
    group first, apart from an empty name.  Where ``doubted`` holds, the leaf is computed anew from
    ``claims`` (columns in place of fields) before it is folded with its proof.
    Long texts are digested in place and never leave their row.  Columns
    besides ``fields``, ``group`` and ``order`` are not looked at; an empty
    table gives no rows.
    """
    claims = claims or {}
    kept = documents.select(
        F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("id"),
        leaf_digest([F.col(name) for name in fields]).alias("digest"),
        F.when(F.lit(False) if doubted is None else doubted,
               leaf_digest([claims.get(name, F.col(name)) for name in fields])).alias("claimed"))
    leaves = stored(numbered(stored(kept, "leaves"), ["id", "digest"]), "numbered-leaves")
    passes, subroots = _forest(leaves)

    # The roots of the groups are the leaves of one more tree.
    upper = stored(numbered(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "subroots")
    upper_passes, tops = _forest(upper)
    messages = tops.select("tree", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("subroot"),
                           F.col("digest").alias("root"), F.array().cast("array<string>").alias("suffix"))
    for nodes in reversed(upper_passes):
        messages = stored(_with_messages(nodes.select("tree", "number", "count", "digest"), messages).mapInArrow(
            _down, _MESSAGES), "upper-proofs")
    messages = messages.join(upper.select(F.col("number").alias("block"), "name", "digest"), "block").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "suffix")
    for nodes in reversed(passes[1:]):
        # A tree's message waits until the pass that holds its top.
        here = nodes.select("tree").distinct()
        made = stored(_with_messages(nodes, messages.join(here, "tree", "left_semi")).mapInArrow(_down, _MESSAGES), "proofs")
        messages = made.unionAll(messages.join(here, "tree", "left_anti"))

    kind = documents.select(F.col(order).alias("id")).schema["id"].dataType

    def prove(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("id", to_arrow_type(kind)), *[(name, pa.string()) for name in (
            "leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

        def rows_out():
            for head, *rows in _grouped(batches):
                first = rows[0]["number"]
                nodes = sweep_up(first, [row["digest"] for row in rows], rows[0]["count"])
                for row, suffix in zip(rows, sweep_down(first, len(rows), nodes, _nested(head["suffix"]))):
                    folded = fold(row["claimed"] or row["digest"], suffix)
                    yield (row["id"], row["digest"], head["subroot"], head["root"], digest_of("".join(_flat(suffix))),
                           folded, folded == head["root"])

        return _batches(rows_out(), schema)

    proved = documents.select(F.col(order).alias("id")).withColumns({
        name: F.lit("") for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root")} | {"verified": F.lit(True)})
    return _with_messages(leaves, messages).mapInArrow(prove, proved.schema).withColumnRenamed("id", order)
