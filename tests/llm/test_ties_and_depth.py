"""Ties of neighbours, unlike texts with one fingerprint, and the best stretch of a page against all stretches."""

import random

import numpy as np

from arenaflow.llm import html_text, neighbours, simhash


def test_many_equal_products_go_to_the_smallest_ids(spark):
    rows = [(100, [1.0] + [0.0] * 63)]
    for number in range(1, 60):
        vector = [0.0] * 64
        vector[number] = 1.0
        rows.append((100 + number, vector))
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    found = neighbours.nearest(frame, frame.where("vec_id = 100")).orderBy("rank").collect()
    assert [(row["rank"], row.vec_id, row.score) for row in found] == [(at + 1, 101 + at, 0.0) for at in range(20)]


def test_search_keeps_the_earlier_of_equal_rows():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-1, 2, (3000, 6)).astype(float)
    queries = draw.integers(-1, 2, (20, 6)).astype(float)
    settings = neighbours.Settings(confidence=1.0)
    rows, _, _ = neighbours.search(vectors, queries, 15, float((vectors ** 2).sum(axis=1).max()), settings)
    for query, found in zip(queries, rows):
        want = np.lexsort((np.arange(len(vectors)), -(vectors @ query)))[:15]
        assert found.tolist() == want.tolist()


def test_unlike_texts_with_one_fingerprint_both_stay(spark):
    def text(seed):
        draw = random.Random(seed)
        return "one line that comes again and again\n" * 300 + " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(60))

    one, two = text(1), text(2)
    assert simhash.fingerprint(one, 5, 4) == simhash.fingerprint(two, 5, 4)
    frame = spark.createDataFrame([(1, one), (2, two), (3, one + " more"), (4, two)], "doc_id LONG, text STRING")
    assert sorted(row.doc_id for row in simhash.deduplicate(frame).collect()) == [1, 2]


def weights():
    return html_text.count_weights([])


def test_an_advert_does_not_cut_an_article():
    for size in (10, 80, 2000):
        page = (f"<body><nav>home news</nav><article><h1>A title here</h1><p>{'first words of it ' * 6}</p>"
                f"<div class='ad'>{'buy this now ' * size}</div><p>{'last words of it ' * 6}</p></article></body>")
        lines = html_text.main_text(page, weights()).split("\n")
        assert lines == ["A title here", ("first words of it " * 6).strip(), ("last words of it " * 6).strip()]


def test_deep_and_long_pages_are_read_once():
    page = "<body><article><p>" + "deep words here " * 20 + "<div>" * 100_000 + "inner words " * 30 + "</div>" * 100_000
    assert "deep words here" in html_text.main_text(page, weights())
    long = "<article>" + "".join(f"<p>paragraph number {number} with some words</p>" for number in range(20_000))
    assert html_text.main_text(long, weights()).count("\n") == 19_999


def test_the_scan_finds_the_best_of_all_stretches():
    draw = random.Random(6)
    tags = ["p", "div", "li", "h2", "article", "nav", "aside", "span", "a", "footer"]
    for _ in range(60):
        page = ""
        for _ in range(draw.randrange(1, 14)):
            name = draw.choice(tags)
            page += f"<{name}>{'word ' * draw.randrange(0, 12)}" + (f"</{name}>" if draw.random() < 0.8 else "")
        found = list(html_text.parts(page))
        used = weights()

        def value(part):
            if part.left_out:
                return 0.0
            if part.text is None:
                return used.tags.get(part.kind, used.other_tags)
            return part.words * used.words.get(part.kind, used.other_words)

        scores = [value(part) for part in found]
        best = max((sum(scores[start:end]) for start in range(len(found)) for end in range(start + 1, len(found) + 1)), default=0.0)
        # The stretch the scan takes, told by what each word of it is worth.
        kept = html_text.main_text(page, used)
        if best <= 0:
            assert kept == ""
        else:
            candidates = [(start, end) for start in range(len(found)) for end in range(start + 1, len(found) + 1)
                          if abs(sum(scores[start:end]) - best) < 1e-9]
            texts = set()
            for start, end in candidates:
                blocks, open_ = [], []
                for part in found[start:end]:
                    if part.breaks:
                        blocks.append("".join(open_))
                        open_ = []
                    elif part.text is not None and not part.left_out:
                        open_.append(part.text)
                texts.add("\n".join(filter(None, (" ".join(block.split()) for block in [*blocks, "".join(open_)]))))
            assert kept in texts
