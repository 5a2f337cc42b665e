"""Tokenizing, fingerprint, html and toxicity operators against the libraries and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arenaflow.llm import bpe, ctph, html_text, packing, token_counts, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "A  b\n\nc ", "<|endoftext|>x <|startoftext|>", "it's 'LL é́ ΣΑΣ İ 12 ½ 中文字 　 x\x1cy",
       "aaaa" * 3000, "thin" * 700 + "!", "word " * 5000]


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(WORDS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text(alphabet="aethin'sS <|>endofx\n0é", max_size=400)))
def test_encoding_equals_the_library(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    found = coder.encode([text])[0]
    assert bpe.unpack(found) == ids
    assert coder.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_halves_join_to_the_whole(coder):
    draw = random.Random(3)
    for _ in range(300):
        symbols = coder.word_symbols("".join(draw.choices("aethinor", k=draw.randint(2, 400))).encode())
        cut = draw.randrange(1, len(symbols))
        whole = coder.merge(list(symbols))
        assert coder.join(coder.encode_symbols(symbols[:cut]), coder.encode_symbols(symbols[cut:])) == whole
        assert coder.encode_symbols(symbols) == whole


def test_round_trip_of_odd_rows_spread_over_tasks(spark, library):
    rows = [(number, text, "kept", 7) for number, text in enumerate(ODD)] + [(3, "a", "kept", 7), (None, "b c", "kept", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens int")
    for spread in (1 << 20, 64):
        found = bpe.round_trip(frame, WORDS, spread_bytes=spread).collect()
        assert len(found) == len(rows)
        for row in found:
            ids = library.encode(row["text"] or "", add_special_tokens=False).ids
            assert bpe.unpack(bytes(row["ids"])) == ids and row["n_tokens"] == len(ids)
            assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_pieces_cut_anywhere_join(coder):
    text = "thin" * 100 + " a <|endoftext|> it's " + "e" * 90
    symbols = coder.text_symbols(text)
    for size in (1, 3, 7, 50):
        tokens = []
        for at in range(0, len(symbols), size):
            tokens = coder.join_stretches(tokens, coder.encode_stretch(symbols[at:at + size]))
        assert bpe.pack(tokens) == coder.encode([text])[0]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    frame = spark.createDataFrame([(at, text, 1) for at, text in enumerate(ODD)], "doc_id long, text string, N_TOKENS int")
    for row in token_counts.count_tokens(frame, BYTES).collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["n_bytes"]) == (len(ids), len((row["text"] or "").encode()))
        assert row["over_limit"] == (len(ids) > 1024)
    assert token_counts.count_tokens(frame.limit(0), BYTES).count() == 0
    assert frame.columns == ["doc_id", "text", "N_TOKENS"]


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a b", None, "Some longer words here."]
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = [row["n_tokens"] for row in token_counts.count_tokens(frame, path).collect()]
    assert found == [len(processor.encode(text or "", num_threads=1)) for text in texts]


def test_batches_balance_bytes():
    batches = list(token_counts.balanced(["a" * 10] * 10 + ["b" * 1000], limit=100))
    assert [len(batch) for batch in batches] == [5, 5, 1]


def test_packing_fills_sequences(spark, library):
    rows = [(at, text) for at, text in enumerate(ODD * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    capacity = packing.Capacity(tokens=512, attention=512.0 ** 2)
    found = packing.pack_documents(frame, WORDS, capacity).toPandas()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        own = found[found.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for piece in own.itertuples():
            part = ids[piece.start:piece.start + piece.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == piece.ids_crc32
        assert (own.length.to_numpy()[:-1] == 512).all()
    for _, sequence in found.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.length.sum() <= 512
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 512) + 1
    assert packing.pack_documents(frame.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 60, 400)
    capacity = packing.Capacity(tokens=100, documents=4, attention=3000.0, rule=rule, weights=(1.0, 1.0, 1.0))
    lengths = lengths[lengths ** 2 <= 3000]
    sequence, offset = packing.pack_lengths(lengths, capacity)
    for number in np.unique(sequence):
        own = sequence == number
        assert lengths[own].sum() <= 100 and own.sum() <= 4 and (lengths[own] ** 2).sum() <= 3000
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([101]), capacity)


def _edits(left, right):
    row = list(range(len(right) + 1))
    for at, letter in enumerate(left, 1):
        before, row = row, [at]
        for place, other in enumerate(right, 1):
            row.append(min(before[place] + 1, row[-1] + 1, before[place - 1] + (letter != other)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(left=st.text(alphabet="abc", max_size=90), right=st.text(alphabet="abc", max_size=90))
def test_edit_distance(left, right):
    assert ctph.edit_distance(left, right) == _edits(left, right)


def test_piecewise_fingerprints_of_a_ring(spark):
    texts = [text or "" for text in ODD]
    rows = [(at * 3, text) for at, text in enumerate(ODD)]
    frame = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    found = {row["doc_id"]: row for row in ctph.compare_edited(frame).collect()}
    assert len(found) == len(rows)
    for at, text in enumerate(texts):
        row, following = found[at * 3], texts[(at + 1) % len(texts)]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(text)
        assert row["fingerprint"] == ctph.fingerprint(text) and row["edited_fingerprint"] == ctph.fingerprint(changed)
        assert row["near_next"] == ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(following))
        assert 0 <= row["near_edited"] <= 1
    assert found[0]["near_next"] == 1.0  # null, then empty
    single = spark.createDataFrame([(None, "only one")], "doc_id long, text string")
    assert ctph.compare_edited(single).collect()[0]["near_next"] == 1.0
    assert ctph.compare_edited(single.limit(0)).count() == 0


def test_an_edit_leaves_far_chunks():
    draw = random.Random(5)
    text = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(400))
    other = " ".join("".join(draw.choices("klmnopqrst", k=6)) for _ in range(400))
    changed = text[:900] + "something else" + text[900:]
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(changed)) > 0.9
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(other)) < 0.2


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- ad --><div class="ad">Buy these things now today</div>
<%s><h1>The &amp; title</h1><p><b>First   line\nhere<br><p>Second &lt;one&gt; with <a href="x>y">a link</a>, and more.
<div class="comments"><p>I do not like this text at all</p></div></%s><aside>More to read</aside>
<form><label>Name</label></form><footer>&copy; all rights</footer></body></html>"""
TEXT = "The & title\nFirst line here\nSecond <one> with a link, and more."


@pytest.mark.parametrize("element", ["article", "main", "section", 'div id="content"'])
def test_main_text(spark, element):
    page = PAGE % (element, element.split()[0])
    pages = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "v", "", 3), (4, "w", "<p", 3)],
                                  "page_id long, url string, html string, N_CHARS int")
    weights = html_text.fit(pages)
    found = {row["page_id"]: row for row in html_text.extract(pages, weights).collect()}
    assert found[1]["text"] == TEXT and found[1]["n_chars"] == len(TEXT)
    assert [found[at]["text"] for at in (2, 3, 4)] == ["", "", ""]
    assert html_text.extract(pages.limit(0), weights).count() == 0


def test_toxicity_of_unseen_misspellings(spark):
    draw = random.Random(7)

    def text(count, *more):
        words = ["".join(draw.choices("etaoinsr", k=draw.randint(2, 7))) for _ in range(count)]
        for word in more:
            words.insert(draw.randrange(len(words)), word)
        return " ".join(words)

    insults = ["blockheads", "nincompoop", "dunderhead"]
    toxic = [text(80, draw.choice(insults), draw.choice(insults)) for _ in range(150)]
    clean = [text(80) for _ in range(150)]
    rows = [(at, value, int(at < 150)) for at, value in enumerate(toxic + clean)]
    documents = spark.createDataFrame(
        [(at, value) for at, value, _ in rows] + [(900, text(80, "nincompooop", "blokheads")), (901, text(80)), (902, ""),
                                                  (903, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(at, label) for at, _, label in rows], "doc_id long, toxic int")
    found = {row["doc_id"]: row for row in toxicity.score_documents(documents, labels).collect()}
    assert len(found) == 304
    held = [(row["predicted"], int(at < 150)) for at, row in found.items() if row["held_out"] and at < 300]
    assert np.mean([got == want for got, want in held]) > 0.9
    assert found[900]["score"] > found[901]["score"]
    assert found[902]["score"] == found[903]["score"] == 0.0
    nothing = toxicity.score_documents(documents, labels.limit(0)).collect()
    assert all(0 <= row["score"] <= 1 for row in nothing)
    assert toxicity.score_documents(documents.limit(0), labels).count() == 0
