"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a row of tokens.  Words score by the element they stand in,
tags score below zero, both with weights counted on labelled pages; one linear
scan finds the stretch with the largest total.  What the stretch still holds of
adverts, forms or comments is left out by the names of their elements.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.frames import texts_of, with_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z|([^<]+|<)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in (
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html option optgroup legend caption summary".split())
_NEVER = frozenset(
    "script style noscript template svg math head title iframe object nav aside form button select textarea footer "
    "label input menu dialog canvas audio video noembed noframes xmp".split())
#: Words in class, id and role names that mark parts which are not the article.
_ODD_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|captcha|comments?|comment-?list|complementary|"
    r"cookies?|consent|contentinfo|copyright|disclaimer|disqus|discussion|footer|gdpr|login|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|pagination|pager|popup|promos?|promotion|recommended|related|replies|reply|respond|"
    r"search|share|sharing|sidebar|signup|site-?header|skip|social|sponsor(?:ed)?|subscribe|subscription|tags|toolbar|widget)"
    r"(?:$|[-_\s])", re.I)

#: Small pages with the article in an ``article`` or ``main`` element, for templates that a table may lack.
_EXAMPLES = (
    '<html><body><header><a href="/">Home</a> Daily paper</header><nav><ul><li><a>News</a></li><li><a>Sport</a></li></ul>'
    "</nav><main><h1>A long day</h1><p>It was a long day and nothing went well for anyone here.</p><h2>After</h2><p>Then "
    "it was over, and all of them went home.</p><ul><li>One thing to keep in mind</li></ul></main><aside><h3>More</h3>"
    "<p><a>Other news</a></p></aside><footer><p>All rights reserved</p></footer></body></html>",
    '<html><body><div class="menu"><a>Start</a> <a>About</a></div><div class="cookie-notice"><p>We use cookies</p>'
    '<button>Accept</button></div><article><h1>Plain words</h1><p>Plain words are words that <a>most people</a> know.'
    "</p><blockquote><p>They are short.</p></blockquote><pre>some code</pre><table><tr><td>a cell</td></tr></table>"
    '</article><section class="comments"><h2>Comments</h2><div><p>I do not agree with you at all.</p></div></section>'
    "<form><label>Your name</label><input></form><div id=\"footer\">Contact us</div></body></html>",
)


@dataclass(frozen=True)
class Weights:
    """Scores of a word by the block it stands in and of a tag by its name, with the ones for names never met."""

    words: dict[str, float]
    tags: dict[str, float]
    other_words: float
    other_tags: float


@dataclass
class Part:
    """A stretch of text in one element, or a tag: ``kind`` names what its weight goes by."""

    kind: str
    text: str | None
    words: int
    left_out: bool
    labelled: bool
    breaks: bool


def parts(page: str) -> Iterator[Part]:
    """Texts and tags of a page in order; elements that are left open end with the one around them."""
    stack: list[tuple[str, bool, bool, str]] = []
    # Open elements by name: the stack is searched only for names that are in it, so deep pages stay linear.
    open_ = Counter()

    def end(depth: int) -> None:
        open_.subtract(element[0] for element in stack[depth:])
        del stack[depth:]

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        if match is None:  # a tag that never ends
            break
        at = match.end()
        closing, name, attributes, text = match.groups()
        left_out = bool(stack) and stack[-1][1]
        labelled = bool(stack) and stack[-1][2]
        if text is not None:
            kind = stack[-1][3] if stack else "body"
            yield Part(kind, text, len(text.split()), left_out, labelled, False)
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in _VOID:
                continue
            if open_[name] > 0:
                end(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == name))
            yield Part(name, None, 0, left_out, labelled, name in _BLOCK)
            continue
        if name in _CLOSES_P and open_["p"] > 0:
            # Nearest first: an element that keeps paragraphs to itself ends the search as well.
            depth = next(depth for depth in range(len(stack) - 1, -1, -1)
                         if stack[depth][0] in ("p", "article", "section", "div", "td", "li"))
            if stack[depth][0] == "p":
                end(depth)
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and open_[name] > 0:
            depth = next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] in (name, "ul", "ol", "table"))
            if stack[depth][0] == name:
                end(depth)
        left_out = bool(stack) and stack[-1][1]
        labelled = bool(stack) and stack[-1][2]
        yield Part(name, None, 0, left_out, labelled, name in _BLOCK)
        if name in _RAW:
            found = _RAW[name].search(page, at)
            at = found.end() if found else len(page)
            continue
        if name in _VOID or attributes.rstrip().endswith("/") and name in ("path", "circle", "rect"):
            if name == "br":
                yield Part("br", " ", 0, left_out, labelled, False)
            continue
        names = " ".join("".join(found) for found in _NAMES.findall(attributes)) if "=" in attributes else ""
        odd = name in _NEVER or name == "header" and not labelled or name not in ("body", "html", "main", "article") and bool(
            names and _ODD_NAMES.search(names)) or name == "article" and bool(names and re.search("comment|reply", names, re.I))
        above = stack[-1][3] if stack else "body"
        kind = ("odd" if odd else name) if name in _BLOCK or odd else ("a" if name == "a" else above)
        kind = "odd" if left_out else kind
        open_[name] += 1
        stack.append((name, left_out or odd, not odd and (labelled or name in ("article", "main")), kind))


def count_weights(pages: list[str]) -> Weights:
    """Log-odds of standing in an article, for words by their element and for tags, on pages that mark one."""
    words, tags = (Counter(), Counter()), (Counter(), Counter())
    for page in [*_EXAMPLES, *pages]:
        found = list(parts(page))
        if not any(part.labelled for part in found):
            continue
        for part in found:
            (tags if part.text is None else words)[part.labelled and not part.left_out][part.kind] += (
                1 if part.text is None else part.words)

    def odds(counts: tuple[Counter, Counter], kind: str) -> float:
        return math.log((counts[1][kind] + 0.5) / (counts[0][kind] + 0.5))

    word_weights = {kind: max(-3.0, min(3.0, odds(words, kind))) for kind in set(words[0]) | set(words[1])}
    tag_weights = {kind: -0.25 - max(0.0, min(3.0, -odds(tags, kind))) for kind in set(tags[0]) | set(tags[1])}
    return Weights(word_weights, tag_weights, 0.5, -0.5)


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best stretch, one to a line; empty where no stretch scores above zero."""
    found = list(parts(page))
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    for at, part in enumerate(found):
        # What is left out of the text neither helps nor cuts a stretch.
        if part.left_out:
            value = 0.0
        elif part.text is None:
            value = weights.tags.get(part.kind, weights.other_tags)
        else:
            value = part.words * weights.words.get(part.kind, weights.other_words)
        if total <= 0:
            total, start = 0.0, at
        total += value
        if total > best:
            best, best_from, best_to = total, start, at + 1
    blocks, open_ = [], []
    for part in found[best_from:best_to]:
        if part.breaks:
            blocks.append("".join(open_))
            open_ = []
        elif part.text is not None and not part.left_out:
            open_.append(part.text)
    blocks.append("".join(open_))
    lines = (" ".join(html.unescape(block).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, text: str = "html", sample: int = 500, longest: int = 1 << 17) -> Weights:
    """Weights from ``sample`` labelled pages of up to ``longest`` bytes, chosen by a hash: a bound at every size."""
    labelled = pages.where(F.col(text).rlike("(?i)<(article|main)[ >]") & (F.octet_length(text) <= longest))
    chosen = labelled.select(text).orderBy(F.xxhash64(text), text).limit(sample)
    return count_weights([row[0] for row in chosen.collect()])


def extract(pages: DataFrame, weights: Weights, html_column: str = "html") -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points).  Null pages are empty ones and have no text.

    Columns of these names are replaced; all rows, repeated ones too, stay.
    """
    def start():
        return lambda batch: [[main_text(value, weights) for value in texts_of(batch, html_column)]]

    return with_columns(pages, [T.StructField("text", T.StringType())], start, html_column).withColumn(
        "n_chars", F.char_length("text").cast("long"))
