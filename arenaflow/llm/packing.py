"""Best-fit packing of token pieces under several capacities at once.

An item asks for tokens, a document slot and attention cost (its length
squared).  Items are taken longest first.  Of the open sequences in which every
one of the three still fits, the best is the one with the least weighted norm of
what would be left over (``rule="norm"``), or with the largest weighted dot
product of the demand and what is left (``rule="dot"``).

Items are dealt at random into shards of bounded size, so every shard sees all
lengths and leaves at most about one sequence unfilled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.bpe import loaded
from arenaflow.llm.frames import slices, texts_of

SHARD_ITEMS = 8192
END_ID = 1


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weight of each dimension in the choice.

    With the default attention cost the limit equals what one full piece costs,
    so it can never bind before the tokens do; the same holds for documents.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0 * 4096.0
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=float)


def pack_lengths(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every item of one shard; equal lengths go in the order given."""
    limits, weights = capacity.limits(), np.array(capacity.weights)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if len(lengths) else 0
    left = np.empty((len(lengths), 3))
    number = np.empty(len(lengths), np.int64)
    opened = count = 0
    for item in order:
        need = np.array([lengths[item], 1.0, float(lengths[item]) ** 2])
        if (need > limits).any():
            raise ValueError("an item is larger than a sequence")
        rest = left[:opened]
        after = rest - need
        fits = np.flatnonzero((after >= 0).all(axis=1))
        if len(fits):
            if capacity.rule == "dot":
                best = fits[np.argmax(((rest[fits] / limits) * (need / limits)) @ weights)]
            else:
                best = fits[np.argmin(((after[fits] / limits) ** 2) @ weights)]
        else:
            best, opened = opened, opened + 1
            left[best], number[best] = limits, count
            count += 1
        sequence[item], offset[item] = number[best], capacity.tokens - left[best, 0]
        left[best] -= need
        if left[best, 0] < max(smallest, 1) or left[best, 1] < 1:
            opened -= 1
            left[best], number[best] = left[opened], number[opened]
    return sequence, offset


def pack(items: DataFrame, capacity: Capacity, shards: int, length: str = "length") -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to items with a token ``length``.

    An item may not be longer than a sequence.  An empty table gives an empty
    table; items of equal length may swap places, never sizes.  Columns named
    ``sequence_id`` or ``offset`` are replaced.
    """
    clash = [name for name in items.columns if name.lower() in ("sequence_id", "offset", "_shard")]
    dealt = items.drop(*clash).withColumn(
        "_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def pack_shard(part: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack_lengths(part[length].to_numpy(), capacity)
        return part.assign(sequence_id=part["_shard"] * (1 << 32) + sequence, offset=offset).drop(columns="_shard")

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in items.drop(*clash).schema)
    return dealt.groupBy("_shard").applyInPandas(pack_shard, f"{kept}, sequence_id long, offset long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def document_pieces(documents: DataFrame, path: str, limit: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Ids of every text (null: none) and an end id, cut only where they exceed ``limit``."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        coder = loaded(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for key, ids in zip(keys, coder.encode(texts_of(batch, "text")), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[start:start + 4 * limit]
                        rows.append((key, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(zip(*rows), _PIECES)], schema=_PIECES
                ) if rows else pa.RecordBatch.from_pylist([], schema=_PIECES)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, path: str, capacity: Capacity = Capacity(),
                   shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pack whole documents (an empty text is its end id) into as few sequences as best fit finds."""
    shards = max(1, -(-documents.count() // shard_items))
    return pack(document_pieces(documents, path, capacity.tokens), capacity, shards)
