"""Phrase collocations against counting every phrase by itself."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arenaflow.llm import collocations

SCHEMA = "doc_id long, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = {}
    for _, lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, 5):
                own.update(tuple(words[at:at + size]) for at in range(len(words) - size + 1))
    return counts


def by_hand(rows, least=30, top=2000):
    found = []
    for lang, own in counted(rows).items():
        total = sum(count for phrase, count in own.items() if len(phrase) == 1)
        candidates = {phrase: count for phrase, count in own.items() if len(phrase) > 1 and count >= least}
        gone = {phrase[at:at + size] for phrase, count in candidates.items() for size in range(2, len(phrase))
                for at in range(len(phrase) - size + 1) if 100 * count >= 80 * own[phrase[at:at + size]]}
        scored = []
        for phrase, count in candidates.items():
            if phrase not in gone:
                score, cut = min((2_000_000 * count // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase)))
                scored.append((-score, -count, " ".join(phrase).encode(), own[phrase[:cut]], own[phrase[cut:]]))
        for rank, (score, count, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -count, left, right, total, -score))
    return sorted(found)


def found(frame, **options):
    return sorted(map(tuple, collocations.collocations(frame, **options).collect()))


def texts(seed, count):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a\x01", "a", "é", "san", "francisco", "ss\x0e"]
    for number in range(count):
        parts = [draw.choice(["New York City", "the of", "san\tfrancisco bay area"]) if draw.random() < 0.2
                 else draw.choice(words) + draw.choice(["", "", "", ".", ",", "\n", "\r\n", "!?"]) for _ in range(40)]
        yield number, draw.choice([None, "und", "en", "en", "en", ""]), " ".join(parts)


def test_every_phrase_is_counted_once(spark):
    rows = [*texts(1, 300), (900, "en", None), (901, None, ""), (902, "en", "the the the the the the the " * 2000)]
    frame = spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(7)
    want = by_hand(rows + rows[:40])
    assert found(frame) == want
    # Budgets of a few suffixes cut the hottest prefixes at every depth.
    for budget in (1, 5, 40):
        assert found(frame, budget=budget) == want


def test_limits_of_a_report(spark):
    rows = list(texts(2, 200))
    assert found(spark.createDataFrame(rows, SCHEMA), top=7) == by_hand(rows, top=7)
    assert found(spark.createDataFrame(rows, SCHEMA), least=2) == by_hand(rows, least=2)


def test_empty_table_and_clashing_columns(spark):
    rows = list(texts(3, 60))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame.limit(0)) == []
    clashing = frame.withColumns({name: F.lit(1) for name in ("a", "n", "word", "suffix", "part", "f", "rank")})
    assert found(clashing) == by_hand(rows)


def test_groups_are_about_the_budget(spark):
    rows = [(f"w{number % 7} x{number} ", "en", 1) for number in range(2000)] + [("hot cold snow ", "en", 1), ("hot cold ", "en", 1)]
    suffixes = spark.createDataFrame(rows, "suffix string, lang string, n long").select("lang", "suffix", "n")
    starts = collocations.partition_starts(suffixes, 100)
    assert starts == sorted(starts) and 15 <= len(starts) <= 40
    sizes = Counter()
    for suffix, lang, _ in rows:
        sizes[sum((lang, suffix) >= start for start in starts)] += 1
    assert max(sizes.values()) <= 100


def test_subtree_reads_counts_from_its_leaves():
    tree = collocations.Subtree(3)
    for suffix, count in [("a b ", 1), ("a b c ", 2), ("a b d ", 1), ("a c ", 1), ("b a ", 4), ("c a ", 1)]:
        tree.add(suffix, count)
    tree.finish()
    assert sorted(tree.found) == [("a b", 4), ("b a", 4), ("c a", 1)]


def test_small_steps_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 50)
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", 7)
    rows = [*texts(5, 60), (900, "en", "the the the of " * 90), (901, "en", "."), (902, None, "")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(2)) == by_hand(rows)


def test_a_slice_takes_little_besides_its_text():
    draw = random.Random(6)
    lines = [" ".join(draw.choices("abcdefghij", k=500)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(lines)), pa.array(lines)], ["lang", "text"])
    tracemalloc.start()
    for _ in collocations._count_words(iter([batch])):
        pass
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 12 * sum(map(len, lines))


def test_slices_of_a_task_add_up(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 200)
    bitmaps = [np.full((1 << collocations.BITS) >> 3, 255, np.uint8) for _ in collocations.MARKED]
    rows = [("en" if at % 3 else "de", f"one two three four. five six {at % 5}") for at in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(side) for side in zip(*rows)], ["lang", "text"])

    def made():
        return [(lang, suffix, n) for part in collocations._suffixes(iter([batch, batch]), bitmaps)
                for lang, suffix, n in zip(*(column.to_pylist() for column in part.columns))]

    whole = made()
    assert len({row[:2] for row in whole}) == len(whole)
    assert dict(Counter(n for _, suffix, n in whole if suffix == "one two three four ")) == {400: 1, 200: 1}
    # What does not fit is handed over in parts.
    monkeypatch.setattr(collocations, "HELD_BYTES", 300)
    monkeypatch.setattr(collocations, "ROWS_OUT", 2)
    parts = Counter()
    for lang, suffix, n in made():
        parts[lang, suffix] += n
    assert parts == {(lang, suffix): n for lang, suffix, n in whole}
