"""Near-duplicate, neighbour, language-model and pipeline operators against brute force."""

import glob
import itertools
import math
import random
import subprocess
import sys
import tempfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from arenaflow.llm import frames, line_dedup, mixing, neighbours, simhash
from arenaflow.llm.components import components


def _classes(names, links):
    parent = {name: name for name in names}

    def find(name):
        while parent[name] != name:
            name = parent[name]
        return name

    for one, two in links:
        first, second = sorted((find(one), find(two)))
        parent[second] = first
    return {name: find(name) for name in names}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(at, at + 1) for at in range(60)], [(0, at) for at in range(1, 80)],
    [(at, at * 2) for at in range(1, 50)] + [(1000, 1001), (1001, 1000)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {row["vertex"]: row["root"] for row in components(frame).collect()}
    real = [(one, two) for one, two in edges if one is not None and two is not None and one != two]
    classes = _classes({name for edge in real for name in edge}, real)
    assert found.keys() == classes.keys()
    for one, two in itertools.combinations(classes, 2):
        assert (classes[one] == classes[two]) == (found[one] == found[two])


def _prints(text):
    data = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in (text or "").encode())
    words = data.split()
    rows = [b" ".join(words[at:at + 3]) for at in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(row, 42) for row in rows]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def test_simhash_groups(spark):
    draw = random.Random(1)
    words = ["".join(draw.choices("aeiounst", k=4)) for _ in range(60)]
    texts = [None, "", "  \n", "One", "one", "a b"]
    for _ in range(25):
        base = draw.choices(words, k=150)
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            changed[draw.randrange(150)] = "other"
            texts.append(" ".join(changed))
    rows = [(at, text, "x") for at, text in enumerate(texts)] + [(6, texts[6], "x"), (None, texts[7], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = simhash.near_groups(frame).collect()
    values = [_prints(text) for text in texts]
    links = [(one, two) for one, two in itertools.combinations(range(len(texts)), 2)
             if (values[one] ^ values[two]).bit_count() <= 3]
    classes = _classes(range(len(texts)), links)
    assert len(found) == len(rows) and len(set(classes.values())) < len(texts) - 20
    for row in found:
        at = row["doc_id"] if row["doc_id"] is not None else 7
        assert row["fingerprint"] == f"{values[at]:016x}" and row["component_id"] == classes[at]
    assert simhash.near_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("radius,width", [(3, 1), (0, 1), (10, 1), (44, 4)])
def test_bit_sliced_blocks(radius, width):
    draw = np.random.default_rng(radius)
    centres = draw.integers(0, 1 << 63, (6, width)).astype(np.uint64)
    words = centres[draw.integers(0, 6, 300)]
    for row in range(0, 300, 2):
        for bit in draw.integers(0, 64 * width, 1 + radius // 2):
            words[row, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    distance = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2)
    planes = simhash.Planes(words)
    everything = np.packbits(np.pad(np.ones(300, np.uint8), (0, -300 % 64)), bitorder="little").view(np.uint64)
    asked = np.arange(0, 300, 7)
    row, member = planes.within(asked, radius, everything)
    assert set(zip(asked[row], member)) == set(zip(*(axis.tolist() for axis in np.nonzero(
        (distance <= radius) & np.isin(np.arange(300), asked)[:, None]))))
    wanted = _classes(range(300), zip(*np.nonzero(distance <= radius)))
    found = _classes(range(300), planes.forest(radius))
    assert len(set(wanted.values())) == len(set(found.values()))
    assert len(list(planes.forest(radius))) == 300 - len(set(wanted.values()))


def test_large_blocks_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    draw = random.Random(4)
    values = [draw.getrandbits(64) & ~0xFFF | draw.getrandbits(4) for _ in range(10)]
    values = sorted({value ^ 1 << draw.randrange(64) for value in values for _ in range(20)})
    prints = spark.createDataFrame([(simhash._signed(value),) * 2 for value in values], "node long, _w0 long")
    links = [tuple(row) for row in simhash.link(prints, 3, simhash.exact_masks(3)).collect()]
    wanted = _classes(values, [pair for pair in itertools.combinations(values, 2) if (pair[0] ^ pair[1]).bit_count() <= 3])
    found = _classes(values, [(one % (1 << 64), two % (1 << 64)) for one, two in links])
    assert len(set(found.values())) == len(set(wanted.values()))


def test_sizes_of_blocks_are_not_broadcast(spark):
    """A key for each mask makes more rows than Spark expects: the sizes of blocks have no bound."""
    prints = spark.range(50).select(F.col("id").alias("node"), F.col("id").alias("_w0"))
    blocks = simhash._blocks(prints, simhash.exact_masks(3), 1)
    assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert blocks.groupBy("block").count().where("count < 2").count() == 0 < blocks.count()


def _jaccard(one, two):
    first, second = ({tuple(words[at:at + 5]) for at in range(len(words) - 4)} for words in (one.split(), two.split()))
    return len(first & second) / len(first | second)


def _changed(draw, text, similarity):
    """A copy with words exchanged from the front until its similarity is at most this, and the similarity before the last."""
    words, at, last = text.split(), 2, text
    while True:
        words[at] = "".join(draw.choices("xyz", k=8))
        if _jaccard(text, " ".join(words)) < similarity:
            return last, " ".join(words)
        last, at = " ".join(words), at + 1


def test_near_copies_are_verified(spark):
    draw = random.Random(12)
    texts, near, apart = [], [], []
    for _ in range(40):
        base = " ".join("".join(draw.choices("aeiounst", k=6)) for _ in range(200))
        at = len(texts)
        if len(near) < 20:
            texts += [base, _changed(draw, base, 0.8)[0]]
            near.append(at)
        else:
            texts += [base, _changed(draw, base, 0.75)[1]]
            apart.append(at)
    assert all(_jaccard(texts[at], texts[at + 1]) >= 0.8 for at in near)
    assert all(_jaccard(texts[at], texts[at + 1]) < 0.75 for at in apart)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {row["doc_id"] for row in simhash.deduplicate(frame).collect()}
    assert left == set(near) | {at + step for at in apart for step in (0, 1)}


def test_near_copies_go_on_past_failed_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    draw = random.Random(13)
    base = ["".join(draw.choices("aeiounst", k=6)) for _ in range(200)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in draw.sample(range(5, 195, 10), 3):
            words[at] = "".join(draw.choices("xyz", k=8))
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [_jaccard(one, two) for one, two in itertools.combinations(texts[:-1], 2)]
    assert sum(value < 0.8 for value in pairs) > len(pairs) / 2 and min(_jaccard(texts[-1], one) for one in texts) >= 0.8
    assert [row["doc_id"] for row in simhash.deduplicate(frame).collect()] == [0]


def test_projected_neighbours(spark):
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((30, 16))
    vectors = (centres[draw.integers(0, 30, 900)] + 0.3 * draw.standard_normal((900, 16))).astype(np.float32)
    vectors[5:300:5] = vectors[5]
    rows = [(at, vector.tolist(), 0.5) for at, vector in enumerate(vectors)]
    rows += [(2000, None, 0.5), (2020, [0.0] * 16, 0.5), (2040, [float("nan")] * 16, 0.5), (2060, [None] * 16, 0.5),
             (None, vectors[0].tolist(), 0.5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    settings = neighbours.Settings(shard_rows=300, query_rows=20)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 20, settings=settings).toPandas()
    exact = vectors.astype(np.float64)
    hits = 0
    for query, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = (exact * exact[query]).sum(axis=1)
        order = [at for at in np.lexsort((np.arange(900), -scores)) if at != query][:20]
        hits += len(set(order) & set(own.vec_id))
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, scores[own.vec_id], atol=1e-12)
        assert query not in set(own.vec_id)
    assert found.query_id.nunique() == 45 and hits / (45 * 20) >= 0.9
    few = neighbours.nearest(frame.where("vec_id < 3"), frame.where("vec_id = 0"), 20).collect()
    assert [row["vec_id"] for row in few] and len(few) == 2
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_chi_square_law():
    draws = (np.random.default_rng(0).standard_normal((100_000, 8)) ** 2).sum(axis=1)
    for value in (2.0, 7.3, 15.0):
        assert abs(neighbours.chi_square_below(value, 8) - (draws < value).mean()) < 0.01


def _lines(texts):
    return [(at, place, line.strip(" ").lower()) for at, text in enumerate(texts)
            for place, line in enumerate((text or "").split("\n")) if line.strip(" ")]


def test_fuzzy_lines(spark):
    draw = random.Random(6)

    def line(count=25):
        return " ".join("".join(draw.choices("aeiounst", k=draw.randint(2, 8))) for _ in range(count))

    shared = [line() for _ in range(15)] + ["ab", "x"]
    texts = [None, "", "\n \n", "long " * 20000]
    for _ in range(60):
        chosen = draw.choice(shared)
        near = chosen.replace(" ", " q", 1) if draw.random() < 0.5 else chosen.upper()
        texts.append("\n".join([line(), near, line(8)]))
    frame = spark.createDataFrame([(at, text, 3) for at, text in enumerate(texts)], "doc_id long, text string, line_no int")
    rows = _lines(texts)
    sets = {text: {text[at:at + 8] for at in range(max(1, len(text) - 7))} for _, _, text in rows}
    links = [(one, two) for one, two in itertools.combinations(sets, 2)
             if len(sets[one] & sets[two]) >= 0.8 * len(sets[one] | sets[two])]
    classes = _classes(sets, links)
    first = {}
    for at, place, text in rows:
        first.setdefault(classes[text], (at, place))
    found = line_dedup.mark_lines(frame).collect()
    assert len(found) == len(rows) and links
    kept = {(row["doc_id"], row["line_no"]): (row["kept_doc_id"], row["kept_line_no"]) for row in found}
    assert kept == {(at, place): first[classes[text]] for at, place, text in rows}
    left = {row["doc_id"]: row["text"] for row in line_dedup.deduplicate(frame).collect()}
    assert left[0] is None and left[1] == "" and left[2] == "\n \n"
    for at, text in enumerate(texts[4:], 4):
        lines = text.split("\n")
        assert left[at] == "\n".join(one for place, one in enumerate(lines) if kept[(at, place)] == (at, place))
    assert line_dedup.mark_lines(frame.limit(0)).count() == 0
    assert "Python" not in line_dedup.mark_lines(frame)._jdf.queryExecution().toString()


def _same_line(spark, pairs):
    """Which pairs of lines end in one component."""
    lines = sorted({line for pair in pairs for line in pair})
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {lines[row["doc_id"]]: row["kept_doc_id"] for row in line_dedup.mark_lines(frame).collect()}
    return [kept[one] == kept[two] for one, two in pairs]


def test_fuzzy_lines_of_mixed_band_values(spark, monkeypatch):
    from pyspark.sql import functions as F

    # All lines share one band value, whatever they resemble.
    monkeypatch.setattr(line_dedup, "band_keys", lambda *given: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    draw = random.Random(3)
    pairs = []
    for _ in range(40):
        line = " ".join("".join(draw.choices("aeiounst", k=6)) for _ in range(20))
        pairs.append((line, line + " x"))
    assert all(_same_line(spark, pairs))
    assert not any(_same_line(spark, [(one[0], two[0]) for one, two in zip(pairs, pairs[1:])]))


def test_fuzzy_lines_of_seven_and_eight_words(spark):
    draw = random.Random(5)
    pairs = [("ab " * 30 + "ab", "ab " * 43 + "ab")]
    for _ in range(10):
        words = ["".join(draw.choices("aeiounst", k=18)) for _ in range(7)]
        pairs += [(" ".join(words), "a " + " ".join(words)), (" ".join(words[:6]), " ".join(words[:5]) + "  " + words[5]),
                  ("x" + " ".join(words), " ".join([*words, "y"]))]
    assert all(_same_line(spark, pairs))


def test_mixing_scores(spark):
    draw = random.Random(9)
    syllables = ["the", "an", "on", "ing", "ed", "st", "re"]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randint(5, 60))) for _ in range(120)] + [
        None, "", "The AN zqxj", "y" * 70000, "É \x00"]
    frame = spark.createDataFrame([(at, text, 1.0) for at, text in enumerate(texts)], "doc_id long, text string, score double")
    frame = frame.unionAll(frame.where("doc_id = 3"))
    found = {row["doc_id"]: row for row in mixing.score_documents(frame).collect()}
    split = {at: mixing.words_of(text or "") for at, text in enumerate(texts)}
    train = [at for at in split if zlib.crc32(str(at).encode()) % 10] + [3]
    counts = Counter(word for at in train for word in split[at])
    tokens, kinds = sum(counts.values()) + len(train), len(counts) + 1
    for at, own in split.items():
        row = found[at]
        base = sum(math.log10((counts[word] + 0.1) / (tokens + 0.1 * (kinds + 1))) for word in own)
        base += math.log10((len(train) + 0.1) / (tokens + 0.1 * (kinds + 1)))
        assert abs(row["base_score"] - base) < 1e-6 * max(1, abs(base)) and row["train_tokens"] == tokens
        assert row["n_tokens"] == len(own) + 1 and row["n_known"] == 1 + sum(counts[word] > 0 for word in own)
        assert row["held_out"] == (zlib.crc32(str(at).encode()) % 10 == 0) and np.isfinite(row["score"]) and row["score"] < 0
    known, odd = found[10], found[122]
    assert known["score"] / known["n_tokens"] > odd["score"] / odd["n_tokens"]
    assert mixing.score_documents(frame.limit(0)).count() == 0


def test_mixed_chances_of_bits_add_up():
    words = [b"the", b"then", b"an"]
    whole, starts = mixing.whole_word_contexts(words, np.array([5.0, 2.0, 9.0]))
    mixer = mixing.Mixer(np.concatenate([np.zeros(mixing.SHORT_SLOTS, np.uint16), whole]), starts)
    mixer.learn(words, np.array([5.0, 2.0, 9.0]))
    first = [bytes([byte]) for byte in range(256) if byte != 32]
    alone = 10 ** mixer.scores([word for word in first])
    assert 0 < alone.sum() < 1  # words of one byte are only some of all words


def test_mixing_counts_the_beginnings_of_all_words(spark, monkeypatch):
    """Words beyond the head count in the predictor by the whole word like those of it."""
    words = ["abcdefgh" + chr(97 + at % 26) * (1 + at // 26) for at in range(60)]
    texts = [" ".join(words[at % 60:] + words[:at % 60]) for at in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {row["doc_id"]: row["score"] for row in mixing.score_documents(frame).collect()}
    monkeypatch.setattr(mixing, "HEAD", 3)
    few = {row["doc_id"]: row["score"] for row in mixing.score_documents(frame).collect()}
    assert all(abs(whole[at] - few[at]) < 1e-4 * abs(whole[at]) for at in whole)


def test_mixing_counts_do_not_depend_on_tasks(spark):
    words = [b"the", b"then", b"an", b"and", "\u00e9t\u00e9".encode()]
    counts = np.array([5, 2, 9, 1, 70])
    frame = spark.createDataFrame(list(zip(words, counts.tolist())), "word binary, count long")
    codes, starts = mixing.count_beginnings(frame, 3)
    expected_codes, expected_starts = mixing.whole_word_contexts(words, counts.astype(float))
    assert np.array_equal(codes, expected_codes) and np.array_equal(starts, expected_starts)


def test_words_of_many_texts_at_once():
    """Codes of a whole slice name the words of each text, and repeats are counted within a text."""
    texts = ["b a\tB  a", None, "", " \n", "a", " a b a ", "\x00 \x1c\x1f\x85x \u00c9\u0130K\u212a"] + [
        f"A{chr(at)}b{chr(at)}" for at in range(260)]
    lengths, codes, names = mixing.coded_words(pa.array(texts, pa.string()))
    split = [mixing.words_of(text or "") for text in texts]
    assert lengths.tolist() == [len(own) for own in split]
    assert [names[code].as_py() for code in codes.tolist()] == [word for own in split for word in own]
    left, again = mixing.repeats(codes, lengths)
    at = 0
    for own in split:
        for place, word in enumerate(own):
            drawn = mixing.REPEATED * place / (place + mixing.REPEATED_HALF)
            assert left[at] == 1 - drawn and again[at] == drawn * own[:place].count(word) / max(place, 1)
            at += 1
    for none in ([], [None], [""]):
        lengths, codes, names = mixing.coded_words(pa.array(none, pa.string()))
        assert lengths.tolist() == [0] * len(none) and not len(codes) and not len(mixing.repeats(codes, lengths)[0])


def test_words_of_a_slice_of_texts(spark):
    """A batch above the size of a slice is cut, and a cut array does not start at its buffers' first byte."""
    texts = pa.array([f"Text {at} OF {'many ' * (at % 7)}words" for at in range(60)])
    for start in (0, 1, 20, 59):
        cut = texts.slice(start, 9)
        lengths, codes, names = mixing.coded_words(cut)
        split = [mixing.words_of(text) for text in cut.to_pylist()]
        assert lengths.tolist() == [len(own) for own in split]
        assert [names[code].as_py() for code in codes.tolist()] == [word for own in split for word in own]
    draw = random.Random(5)
    long = [" ".join(f"Word{draw.randrange(400)}" for _ in range(60_000)) for _ in range(24)]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").coalesce(1)
    assert sum(map(len, long)) > 2 * frames.SLICE_BYTES
    counted = {bytes(row["word"]): row["count"] for row in mixing.count_words(frame).collect()}
    assert counted == Counter(word for at, text in enumerate(long) if zlib.crc32(str(at).encode()) % 10 for word in mixing.words_of(text))


def test_batches_of_words_do_not_ask_for_their_pages_again():
    """In a process of its own, as the threshold of the C library only grows."""
    code = """if 1:
        import resource
        from arenaflow.llm import mixing
        mixing.keep_freed_memory()
        words = [b"word%d" % at for at in range(1000)]
        for _ in range(2):
            mixing.Coding(words)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(10):
            mixing.Coding(words)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(mixing.__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    assert int(run.stdout) < 2000


def test_links_are_added_to_groups_of_lines(spark):
    """Contracting only the new links between roots gives the components of all links, with one root of their own each."""
    draw = random.Random(5)
    links = [(draw.randrange(150), draw.randrange(150)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    groups = components(spark.createDataFrame(links[:40], "a long, b long"))
    for start, end in ((40, 60), (60, len(links)), (len(links), len(links))):
        groups = line_dedup._merged(groups, spark.createDataFrame(links[start:end], "a long, b long"))
    rows = groups.collect()
    found = {row["vertex"]: row["root"] for row in rows}
    names = {end for link in links for end in link}
    expected = _classes(names, links)
    assert len(rows) == len(found) and found.keys() == names and all(found[root] == root for root in found.values())
    assert all((found[one] == found[two]) == (expected[one] == expected[two]) for one, two in itertools.combinations(names, 2))


def test_few_edges_are_contracted_without_broadcasts(spark):
    edges = spark.createDataFrame([(at, at + 1) for at in range(0, 60)], "a long, b long")
    found = components(edges)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("root").distinct().count() == 1 and found.count() == 61


def test_stored_frames_leave_no_shuffle_files(spark, tmp_path):
    folder = spark.sparkContext.getConf().get("spark.local.dir", None) or tempfile.gettempdir()

    def shuffled():
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    before, setting = shuffled(), spark.conf.get(frames.CLEANED, None)
    counted = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = frames.stored(counted.repartition(3, "n").groupBy("n").agg(F.max("k").alias("k")), "counts")
    assert sorted(map(tuple, kept.collect())) == [(714, 6), (715, 1)]
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(frames.CLEANED, None) == setting


def test_crowded_blocks_hold_the_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    draw = random.Random(3)
    prints = spark.createDataFrame([(at, draw.choice([0, 3, 7, 1 << 40]) ^ (1 << draw.randrange(63) if at % 3 else 0))
                                    for at in range(60)], "node long, _w0 long")
    masks = simhash.exact_masks(3)

    def met(blocks):
        held = {}
        for row in blocks.collect():
            held.setdefault(row["block"], []).append(row["node"])
        return {pair for nodes in held.values() for pair in itertools.combinations(sorted(nodes), 2)}

    assert met(simhash._crowded_blocks(prints, masks, 1)) == met(simhash._blocks(prints, masks, 1)) != set()


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(8)

    def text(count=6):
        return "\n".join(" ".join("".join(draw.choices("aeiounst", k=5)) for _ in range(30)) for _ in range(count))

    clean = [text() for _ in range(80)]
    toxic = [text() + " you absolute nincompoop blockhead" for _ in range(40)]
    copies = [clean[at] for at in range(5)] + [clean[at].replace(" a", " b", 2) for at in range(5, 10)]
    texts = clean + toxic + copies + [None, ""]
    documents = spark.createDataFrame([(at, value, "en", "s", len(value or "")) for at, value in enumerate(texts)],
                                      "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(at, 1, int(at >= 80)) for at in range(120)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = set(packed.doc_id)
    assert len(left & set(range(80))) == 80  # clean documents stay
    assert not left & set(range(80, 120))  # toxic ones go
    assert not left & set(range(120, 130))  # copies go
    near = corpus_pipeline.drop_near_copies(spark, documents, str(tmp_path))
    ids = {row["doc_id"] for row in near.collect()}
    assert set(range(80)) <= ids and not ids & set(range(120, 130)) and near.columns == documents.columns
    assert len(ids & {130, 131}) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), str(tmp_path)).count() == 0


def test_unlike_lines_of_a_band_value_are_not_fetched(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "band_keys", lambda *given: F.array(F.lit(1).cast("long")))
    led, asked = line_dedup._led_pairs, []

    def counted(*given):
        found = led(*given)
        asked.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "_led_pairs", counted)
    draw = random.Random(4)
    pairs = []
    for _ in range(40):
        line = " ".join("".join(draw.choices("aeiounst", k=6)) for _ in range(20))
        pairs.append((line, line + " x"))
    assert all(_same_line(spark, pairs))
    assert 0 < sum(asked) <= 60


def test_lowest_hashes_of_bins_without_lambdas(spark):
    draw = random.Random(12)
    texts = ["ab", "of eight", "a" * 50, "\u00e9\U0001f600 " * 9, *("".join(draw.choices("abc ", k=size)) for size in (9, 30, 400, 5000))]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    found = line_dedup._low_hashes(lines, 8)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    low = {row["id"]: list(row)[1:] for row in found.collect()}
    bins = line_dedup.BANDS * line_dedup.VALUES
    for row in line_dedup._with_shingles(lines, 8).collect():
        held = [[] for _ in range(bins)]
        for value in row["hashes"]:
            held[((value % (1 << 64)) >> 32) * bins >> 32].append(value)
        assert low.pop(row["id"]) == [min(values, default=None) for values in held]
    assert not low
    keys = {row["id"]: row["keys"] for row in found.select("id", line_dedup.band_keys().alias("keys")).collect()}
    assert all(len(own) == line_dedup.BANDS and None not in own for own in keys.values()) and len(set(keys[0])) == line_dedup.BANDS


def test_odd_sketches_lose_no_pair(spark):
    from pyspark.sql import functions as F

    draw = random.Random(8)
    rows = []
    for _ in range(400):
        words = ["".join(draw.choices("abcd", k=draw.randint(1, 6))) for _ in range(draw.randint(1, 400))]
        share = draw.choice([0.03, 0.5])
        other = [draw.choice(["", word, word + "a"]) if draw.random() < share else word for word in words]
        rows.append((len(rows), " ".join(words), " ".join(other)))
    rows.append((len(rows), "", "x" * 20000))
    frame = spark.createDataFrame(rows, "at long, line string, other string")
    sketch = [f"odd[{word}] AS odd{word}" for word in range(line_dedup.WORDS)]
    first = line_dedup._with_shingles(frame.select("at", "line"), 8).select(
        "at", "hashes", F.size("hashes").alias("count"), line_dedup.odd_sketch().alias("odd")).selectExpr("at", "hashes", "count", *sketch)
    second = line_dedup._with_shingles(frame.selectExpr("at", "other AS line"), 8).select(
        "at", "hashes", F.size("hashes").alias("count"), line_dedup.odd_sketch().alias("odd")).selectExpr(
        "at", "hashes AS two_hashes", "count AS two_count", *[f"odd[{word}] AS two_odd{word}" for word in range(line_dedup.WORDS)])
    found = first.join(second, "at").select(
        "at", (line_dedup.similarity("hashes", "two_hashes") >= 0.8).alias("alike"),
        line_dedup._may_resemble("", "two_", 0.8).alias("may")).collect()
    assert len(found) == len(rows)
    assert all(row["may"] for row in found if row["alike"])
    assert sum(row["alike"] for row in found) > 100 and sum(not row["may"] for row in found) > 20


@pytest.mark.parametrize("few", [0, 3, 40])
def test_components_in_one_task_and_in_many(spark, monkeypatch, few):
    from arenaflow.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    draw = random.Random(few)
    edges = [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + [(at, at + 1) for at in range(200, 260)] + [(5, None)]
    found = module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    whole = [(a, b) for a, b in edges if b is not None and a != b]
    classes = _classes({end for edge in whole for end in edge}, whole)
    assert sorted(row["vertex"] for row in found) == sorted(classes)
    roots = {row["vertex"]: row["root"] for row in found}
    assert all(roots[root] == root for root in roots.values())
    for one, two in itertools.combinations(classes, 2):
        assert (roots[one] == roots[two]) == (classes[one] == classes[two])
