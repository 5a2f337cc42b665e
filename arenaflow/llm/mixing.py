"""Language-model scores by online logistic context mixing.

A text is a row of words and one end.  A word is coded by its bytes and a final
space, a byte by eight bits.  Six predictors give each bit a probability from
the zeros and ones counted behind their contexts: the last one to five bytes of
the word, and all of it so far.  Contexts are hashed into tables of fixed size.
The predictor by the whole word counts the beginnings of all training words;
a filter tells it that a beginning is none of theirs.
The logistic of the predictions, weighted by a set of weights that a gate picks
(the longest context with counts, and how many), is the mixed probability; a
last table corrects it by what came true where it said the same before.

Counts cover all words of the training documents.  Weights are learned online,
a batch of words after the other, on every training word as often as it occurs
in the word table, with the word's own occurrence taken out of the counts;
tasks learn side by side and their weights are averaged.  As contexts end at
the word, a word has one such score, which is computed once for many places.
In its text the score of a word is refined by how often it stood there before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.frames import partitions, slices, stored

#: Bytes of context of the predictors; None is the whole word so far.  The tables hold 2 to these powers of slots.
ORDERS = (1, 2, 3, 4, 5, None)
TABLE_BITS = (16, 18, 20, 21, 22, 24)
OFFSETS = tuple(sum(1 << bits for bits in TABLE_BITS[:order]) for order in range(len(TABLE_BITS)))
SLOTS = sum(1 << bits for bits in TABLE_BITS)
#: Slots of the contexts of one to five bytes; those of the whole word so far follow.
SHORT_SLOTS = OFFSETS[-1]
FILTER_BITS = 26
CHUNK = 1 << 14
CONFIDENCES = 4
GATES = (len(ORDERS) + 1) * CONFIDENCES
STEPS = 33
#: Words by falling count whose scores every task holds; the others meet their counts in a join.
HEAD = 1 << 18
POSITIONS = 1 << 13
COUNTED_AT_ONCE = 400_000
WORDS_TO_A_TASK = 1_000_000
BASE = 0.1
#: Chance that a word is drawn from the words of its text so far, and the number of words at which it is half reached.
REPEATED, REPEATED_HALF = 0.3, 50.0
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWER = 0x100000001B3
_EXACT = 63


def keep_freed_memory() -> None:
    """Let a task's process keep what arrays of a batch give back.

    Else every batch of words asks the system for its pages again, which takes longer than its arithmetic.  The C library
    keeps blocks up to the size of the largest one freed, 32 MB at most; this one is never touched.
    """
    np.empty(30 << 20, np.uint8)


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.encode().lower().split()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``words_of`` many texts: the words of each, their codes one text after the other, and the words that codes stand for.

    A null text has no words.  Codes follow the first places of words.
    """
    # A slice is copied first: of one that was cast to long offsets, ascii_lower reads other bytes.
    own = pc.fill_null(pa.concat_arrays([texts]), "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    found = split.flatten()
    # White space at an end of a text leaves an empty word there.
    real = pc.greater(pc.binary_length(found), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    ends = before[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))]
    words = found.filter(real).cast(pa.large_binary()).dictionary_encode()
    return np.diff(ends), words.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.dictionary


# counts as bytes

def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts up to 63 as they are, above in eighths of a doubling."""
    large = _EXACT + np.rint(8 * np.log2(np.maximum(counts, _EXACT) / _EXACT))
    return np.where(counts <= _EXACT, np.rint(counts), np.minimum(large, 255)).astype(np.uint8)


_AMOUNT = np.concatenate([np.arange(_EXACT + 1), _EXACT * 2.0 ** (np.arange(1, 256 - _EXACT) / 8)])
_ZEROS, _ONES = np.repeat(_AMOUNT, 256), np.tile(_AMOUNT, 256)
_SLOT = np.arange(1 << 16)


def _without_own(bit: int) -> np.ndarray:
    """The count bytes that are left when one occurrence of ``bit`` is taken out of small counts."""
    count = _SLOT & 255 if bit else _SLOT >> 8
    return _SLOT - np.where((count > 0) & (count <= _EXACT), 1 if bit else 256, 0)


#: Three tables in a row, by the two count bytes of a slot: as they are, less a zero, and less a one of the word's own.
_LEFT = np.concatenate([_SLOT, _without_own(0), _without_own(1)])
#: Log odds of a one, and how sure the counts are (-1 where there are none).
_STRETCH = np.log((_ONES + 0.4) / (_ZEROS + 0.4)).astype(np.float32)[_LEFT]
_SURE = np.where(_LEFT > 0, np.digitize(_ZEROS + _ONES, [2, 8, 64])[_LEFT], -1).astype(np.int8)


class Coding:
    """The bits of a batch of words: the slot of the predictors (all, or those at ``only``) for every bit, and the bits themselves."""

    def __init__(self, words: list[bytes], only: range = range(len(ORDERS))):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(data)) - starts[self.word]
        key = np.zeros(len(data), np.uint64)
        keys = []
        for back in range(1, 6):
            earlier = np.zeros(len(data), np.uint64)
            earlier[back:] = data[:-back]
            earlier = np.where(place >= back, earlier + np.uint64(1), np.uint64(0))
            key = key * np.uint64(257) + earlier
            keys.append(key)
        powers = np.multiply.accumulate(np.full(len(data) + 1, _POWER, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data.astype(np.uint64) * powers[:-1], dtype=np.uint64)])
        inverse = np.uint64(pow(_POWER, -1, 1 << 64))
        backward = np.multiply.accumulate(np.full(len(data) + 1, inverse, np.uint64))
        first = starts[self.word]
        keys.append((sums[:-1] - sums[first]) * backward[first] + place.astype(np.uint64))
        self.beginning = [((keys[-1] * np.uint64(factor)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for factor in _MIX[:2]]
        self.bits = np.unpackbits(data[:, None], axis=1)
        prefix = np.ones(len(data), np.uint64)
        nodes = np.empty((len(data), 8), np.uint64)
        for bit in range(8):
            nodes[:, bit] = prefix
            prefix = prefix * np.uint64(2) + self.bits[:, bit]
        nodes *= np.uint64(_MIX[1])
        self.slots = []
        for order in only:
            wanted, bits = ORDERS[order], TABLE_BITS[order]
            context = keys[-1] if wanted is None else keys[wanted - 1]
            mixed = (context * np.uint64(_MIX[0]) + np.uint64(order))[:, None] ^ nodes
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(_MIX[2])
            self.slots.append((mixed >> np.uint64(64 - bits)).astype(np.int64) + OFFSETS[order])


def batches_of(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of words with about ``POSITIONS`` bytes."""
    start = held = 0
    for at, word in enumerate(words):
        held += len(word) + 1
        if held >= POSITIONS:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(words):
        yield start, len(words)


@dataclass
class Mixer:
    """Gated weights and the table of corrections; ``codes`` are the count bytes of all slots.

    ``starts`` marks, by two hashes, the beginnings of the training words, eight marks to a byte.
    """

    codes: np.ndarray
    starts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, len(ORDERS)), 0.3))
    hits: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS)))

    def inputs(self, coding: Coding, own: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of every predictor and the gate of every bit; ``own`` takes one occurrence of the word out."""
        odds, gate = [], np.zeros(coding.bits.shape, np.int64)
        table = ((coding.bits.astype(np.int64) + 1) << 16) if own else 0
        for order, slots in enumerate(coding.slots):
            code = self.codes.take(slots).astype(np.int64)
            if ORDERS[order] is None:
                one_mark, other = (self.starts[places >> 3] >> (places & 7).astype(np.uint8) for places in coding.beginning)
                code *= (one_mark & other & 1)[:, None]
            code += table
            odds.append(_STRETCH.take(code))
            sure = _SURE.take(code)
            gate = np.where(sure >= 0, (order + 1) * CONFIDENCES + sure, gate)
        return odds, gate

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        total = np.zeros(gate.shape, np.float32)
        weights = self.weights.astype(np.float32)
        for order, value in enumerate(odds):
            total += weights[:, order][gate] * value
        return np.clip(total, -12, 12)

    def learn(self, words: list[bytes], counts: np.ndarray, rate: float = 0.3) -> None:
        """One batch: move the weights against the error, and record what came true.  A word weighs what it occurs."""
        coding = Coding(words)
        odds, gate = self.inputs(coding, own=True)
        total = self.mixed(odds, gate)
        chance = 1 / (1 + np.exp(-total))
        times = np.repeat(counts[coding.word], 8).astype(np.float64)
        error = (coding.bits - chance).ravel() * times
        bend = np.maximum(chance * (1 - chance), 0.03).ravel() * times
        flat = gate.ravel()
        for order, value in enumerate(odds):
            value = value.ravel()
            push = np.bincount(flat, error * value, GATES)
            scale = np.bincount(flat, bend * value * value, GATES) + 50.0
            self.weights[:, order] += rate * push / scale
        step = np.rint((total.ravel() + 12) * ((STEPS - 1) / 24)).astype(np.int64) + flat * STEPS
        self.hits += np.bincount(step, coding.bits.ravel() * times, GATES * STEPS).reshape(GATES, STEPS)
        self.seen += np.bincount(step, times, GATES * STEPS).reshape(GATES, STEPS)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of the bits of every word."""
        if not words:
            return np.zeros(0)
        middle = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS)))
        table = ((self.hits + 100 * middle) / (self.seen + 100)).ravel().astype(np.float32)
        found = np.empty(len(words))
        for start, end in batches_of(words):
            coding = Coding(words[start:end])
            odds, gate = self.inputs(coding, own=False)
            total = self.mixed(odds, gate)
            place = (total + 12) * ((STEPS - 1) / 24)
            below = np.minimum(place.astype(np.int64), STEPS - 2)
            part = place - below
            at = gate * STEPS + below
            refined = table[at] * (1 - part) + table[at + 1] * part
            chance = 0.5 / (1 + np.exp(-total)) + 0.5 * refined
            right = np.where(coding.bits == 1, chance, 1 - chance).astype(np.float64)
            found[start:end] = np.bincount(coding.word, np.log10(np.maximum(right, 1e-9)).sum(axis=1), end - start)
        return found


# corpus statistics

def held_out(doc_id: str = "doc_id") -> Column:
    """Every tenth document by the checksum of its id; one without an id is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(documents: DataFrame) -> DataFrame:
    """``word, count`` over all training documents; tasks add up their own words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        counts: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "count"])
            counts.clear()
            return made

        for whole in batches:
            for batch in slices(whole, "text"):
                _, codes, names = coded_words(batch.column(0))
                for word, count in zip(names.to_pylist(), np.bincount(codes, minlength=len(names)).tolist()):
                    counts[word] += count
                if len(counts) > COUNTED_AT_ONCE:
                    yield emptied()
        yield emptied()

    texts = documents.where(~held_out() & F.col("text").isNotNull()).select("text")
    return texts.mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _add_beginnings(table: np.ndarray, starts: np.ndarray, names: list[bytes], counts: np.ndarray) -> None:
    """Count the beginnings of the given words and mark them in the filter."""
    for start, end in batches_of(names):
        coding = Coding(names[start:end], range(len(ORDERS) - 1, len(ORDERS)))
        weight = np.repeat(counts[start:end][coding.word], 8).astype(np.float32)
        np.add.at(table, 2 * (coding.slots[-1] - SHORT_SLOTS).ravel() + coding.bits.ravel(), weight)
        for places in coding.beginning:
            np.bitwise_or.at(starts, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))


def _no_beginnings() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(2 << TABLE_BITS[-1], np.float32), np.zeros(1 << (FILTER_BITS - 3), np.uint8)


def whole_word_contexts(names: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count bytes of the beginnings of the given words, and the filter of these beginnings."""
    table, starts = _no_beginnings()
    _add_beginnings(table, starts, names, counts)
    return count_bytes(table), starts


def count_bytes(table: np.ndarray) -> np.ndarray:
    """Zeros and ones of every slot as the two bytes of one number."""
    codes = np.empty(len(table) // 2, np.uint16)
    for start in range(0, len(codes), 1 << 18):
        small = quantised(table[2 * start:2 * (start + (1 << 18))])
        codes[start:start + (1 << 18)] = small[0::2].astype(np.uint16) << 8 | small[1::2]
    return codes


def _in_chunks(table: np.ndarray, size: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows ``chunk, counts`` of a table cut every ``size`` values, numbered from ``first``."""
    chunks = range(0, len(table), size)
    for at in range(0, len(chunks), 64):
        some = chunks[at:at + 64]
        yield pa.RecordBatch.from_arrays([
            pa.array([first + start // size for start in some], pa.int32()),
            pa.array([table[start:start + size].tobytes() for start in some], pa.binary())], ["chunk", "counts"])


def _added_chunk(part):
    """The count bytes of a chunk of all tasks' tables."""
    total = np.zeros(2 * CHUNK)
    for value in part["counts"]:
        piece = np.frombuffer(value, np.float32)
        total[:len(piece)] += piece
    return part.head(1)[["chunk"]].assign(codes=count_bytes(total).tobytes())


def count_contexts(words: DataFrame, tasks: int) -> np.ndarray:
    """The count bytes of the contexts of one to five bytes.  The tables have a fixed size, which bounds what reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        table = np.zeros(2 * SHORT_SLOTS, np.float32)
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for start, end in batches_of(names):
                coding = Coding(names[start:end], range(len(ORDERS) - 1))
                weight = np.repeat(counts[start:end][coding.word], 8).astype(np.float32)
                bits = coding.bits.ravel().astype(np.int64)
                for slots in coding.slots:
                    np.add.at(table, 2 * slots.ravel() + bits, weight)
        yield from _in_chunks(table, 2 * CHUNK)

    dealt = words.repartition(tasks).mapInArrow(run, "chunk int, counts binary")
    found = dealt.groupBy("chunk").applyInPandas(_added_chunk, "chunk int, codes binary").toArrow().sort_by("chunk")
    codes = np.frombuffer(b"".join(found["codes"].to_pylist()), np.uint16)
    return codes[:SHORT_SLOTS] if len(codes) else np.zeros(SHORT_SLOTS, np.uint16)


def count_beginnings(words: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """``whole_word_contexts`` of all words (``word, count``), of the same fixed sizes."""
    filters = (1 << TABLE_BITS[-1]) // CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        table, starts = _no_beginnings()
        for batch in batches:
            _add_beginnings(table, starts, batch.column(0).to_pylist(), batch.column(1).to_numpy())
        yield from _in_chunks(table, 2 * CHUNK)
        yield from _in_chunks(starts, 2 * CHUNK, filters)

    def added(part):
        if part["chunk"].iloc[0] < filters:
            return _added_chunk(part)
        marks = np.bitwise_or.reduce([np.frombuffer(value, np.uint8) for value in part["counts"]])
        return part.head(1)[["chunk"]].assign(codes=marks.tobytes())

    dealt = words.repartition(tasks).mapInArrow(run, "chunk int, counts binary")
    found = dealt.groupBy("chunk").applyInPandas(added, "chunk int, codes binary").toArrow().sort_by("chunk")["codes"].to_pylist()
    if not found:
        return whole_word_contexts([], np.zeros(0))
    return np.frombuffer(b"".join(found[:filters]), np.uint16), np.frombuffer(b"".join(found[filters:]), np.uint8)


def learn_weights(words: DataFrame, codes: np.ndarray, starts: np.ndarray, tasks: int) -> Mixer:
    """Weights averaged over the tasks by the words each has seen; one row for each task reaches the driver."""
    sent = words.sparkSession.sparkContext.broadcast((codes, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        mixer, seen = Mixer(*sent.value), 0
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for start, end in batches_of(names):
                mixer.learn(names[start:end], counts[start:end])
            seen += len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([seen], pa.int64()), *(pa.array([value.tobytes()], pa.binary()) for value in (
                mixer.weights, mixer.hits, mixer.seen))], ["words", "weights", "hits", "seen"])

    # Batches in the order of a hash: neighbours in the table need not be alike.
    dealt = words.repartition(tasks).mapInArrow(
        run, "words long, weights binary, hits binary, seen binary")
    rows = [row for row in dealt.collect() if row["words"]]
    sent.unpersist()
    mixer = Mixer(codes, starts)
    if rows:
        total = sum(row["words"] for row in rows)
        mixer.weights = sum(np.frombuffer(row["weights"]) * (row["words"] / total) for row in rows).reshape(GATES, -1)
        mixer.hits = sum(np.frombuffer(row["hits"]) for row in rows).reshape(GATES, STEPS)
        mixer.seen = sum(np.frombuffer(row["seen"]) for row in rows).reshape(GATES, STEPS)
    return mixer


def repeats(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word of texts of these lengths: the chance left to the model, and the chance that earlier words of its text give it."""
    ends = np.cumsum(lengths)
    starts = np.repeat(ends - lengths, lengths)
    place = np.arange(len(ids)) - starts
    order = np.empty(len(ids), np.int64)
    for start, end in zip((ends - lengths).tolist(), ends.tolist()):
        order[start:end] = ids[start:end].argsort(kind="stable")
    order += starts
    ranked = ids[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:len(ids)] | (place == 0)
    first = np.flatnonzero(new)
    earlier = np.empty(len(ids))
    earlier[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    drawn = REPEATED * place / (place + REPEATED_HALF)
    return 1 - drawn, drawn * earlier / np.maximum(place, 1)


def refined(score: np.ndarray, left: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Log10 chance of words with the model's ``score`` (however low) and what earlier words of the text give."""
    alone = np.log10(left) + score
    return np.where(again > 0, np.log10(left * 10.0 ** np.maximum(score, -300) + np.maximum(again, 1e-300)), alone)


_PART_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
             "rest array<struct<word: binary, left: double, again: double>>")


def score_documents(documents: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and score all of them.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``.  A null text is an empty one: its only token is the end.  Repeated
    rows count and are scored as often as they occur.
    """
    spark = documents.sparkSession
    keep_freed_memory()
    words = stored(count_words(documents), "word-counts")
    distinct, running = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    ends = documents.where(~held_out()).count()
    train_tokens, kinds = running + ends, distinct + (ends > 0)
    below = math.log10(train_tokens + BASE * (kinds + 1))
    tasks = max(1, -(-distinct // WORDS_TO_A_TASK), min(partitions(spark), -(-distinct // 100_000)))
    # The most frequent words, HEAD at most, are all that reaches the driver of the words; the model counts all of them.
    head = words.orderBy(F.desc("count"), "word").limit(HEAD).toArrow()
    names, counts = head["word"].to_pylist(), head["count"].to_numpy().astype(float)
    short = count_contexts(words, max(1, tasks // 8))
    whole, starts = count_beginnings(words, max(1, tasks // 8))
    mixer = learn_weights(words, np.concatenate([short, whole]), starts, tasks)
    share = (ends + 0.5) / (train_tokens + 1)
    end_score, word_score = math.log10(share), math.log10(1 - share)
    end_base = math.log10(ends + BASE) - below

    sent = spark.sparkContext.broadcast({
        "names": b" ".join(names), "base": np.log10(counts + BASE) - below,
        "score": mixer.scores(names)})
    model = spark.sparkContext.broadcast((mixer.codes, mixer.starts, mixer.weights, mixer.hits, mixer.seen))

    def known_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        places = {word: place for place, word in enumerate(sent.value["names"].split())}
        base, score = np.append(sent.value["base"], 0.0), np.append(sent.value["score"], 0.0)
        for whole in batches:
            for batch in slices(whole, "text"):
                lengths, codes, names = coded_words(batch.column(2))
                # Any word that is not of the head has place -1.
                at = np.fromiter((places.get(word, -1) for word in names.to_pylist()), np.int64, len(names))[codes]
                left, again = repeats(codes, lengths)
                # A word beyond the head counts nothing here: its score is added after the join.
                own = np.where(at < 0, 0.0, refined(score[at], left, again) + word_score)
                stops = np.cumsum(lengths)
                texts = list(zip((stops - lengths).tolist(), stops.tolist()))
                missing = np.flatnonzero(at < 0)
                beyond = np.searchsorted(missing, np.append(0, stops))
                rest = pa.ListArray.from_arrays(pa.array(beyond, pa.int32()), pa.StructArray.from_arrays([
                    names.take(pa.array(codes[missing])).cast(pa.binary()), pa.array(left[missing]), pa.array(again[missing])],
                    ["word", "left", "again"]))
                known = base[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(lengths + 1), pa.array(lengths - np.diff(beyond) + (ends > 0)),
                    pa.array([known[start:end].sum() + end_base for start, end in texts], pa.float64()),
                    pa.array([own[start:end].sum() + end_score for start, end in texts], pa.float64()), rest],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    parts = stored(documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        known_part, _PART_DDL).withColumn("row", F.monotonically_increasing_id()), "document-parts")
    rest = parts.select("row", F.explode("rest").alias("_rest")).select("row", "_rest.*")

    def rest_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        fitted = Mixer(*model.value)
        for batch in batches:
            encoded = batch.column(1).dictionary_encode()
            score = fitted.scores(encoded.dictionary.to_pylist())[encoded.indices.to_numpy()]
            left, again, count = (batch.column(place).to_numpy() for place in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array((count > 0).astype(np.int64)),
                pa.array(np.log10(count + BASE) - below), pa.array(refined(score, left, again) + word_score)],
                ["row", "n_known", "base_score", "score"])

    counted = rest.join(words, "word", "left").select(
        "row", "word", "left", "again", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    added = counted.mapInArrow(rest_part, "row long, n_known long, base_score double, score double").groupBy("row").agg(
        F.sum("n_known").alias("_known"), F.sum("base_score").alias("_base"), F.sum("score").alias("_score"))
    none = F.lit(0)
    return parts.drop("rest").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", none)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", none)).alias("score"))
