"""Token counts: batch encoding in Arrow functions that hand back lengths only.

Texts are cut where no token can cross (in front of a single space between two
words for byte-level vocabularies, at any space for word vocabularies), so that
a piece that was met before needs no second encoding.  New pieces go to the
library in batches balanced by bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.frames import texts_of, with_columns

BATCH_BYTES = 1 << 20
REMEMBERED = 400_000
_SEEN_MASK = (1 << 22) - 1
_DOUBLE_SPACE = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def balanced(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Batches of about ``limit`` bytes each; a longer piece is a batch of its own."""
    batch: list[str] = []
    held = 0
    for piece in pieces:
        size = len(piece) * 2
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


class Memory(dict):
    """Results of pieces met at least twice.  It is emptied at ``limit`` entries: a bound on memory, never on results."""

    def __init__(self, limit: int = REMEMBERED):
        super().__init__()
        self.limit = limit
        self.once = bytearray(_SEEN_MASK + 1)

    def room(self, fresh: int) -> None:
        if len(self) + fresh > self.limit:
            self.clear()

    def settle(self, fresh: list) -> None:
        """Forget those of the new keys that were met for the first time: most never come back."""
        once = self.once
        for key in fresh:
            slot = hash(key) & _SEEN_MASK
            if not once[slot]:
                once[slot] = 1
                del self[key]


def byte_level_pieces(text: str) -> list[str]:
    """Pieces of a text for a byte-level vocabulary: all but the first follow a single space."""
    if _DOUBLE_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return _SINGLE_SPACE.split(text)
    return text.split(" ")


class ByteLevelCounter:
    """Counts for a byte-level vocabulary whose own pattern keeps a space with the word behind it."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.memory = Memory()

    def counts(self, texts: list[str]) -> list[int]:
        split = [byte_level_pieces(text) for text in texts]
        memory = self.memory
        memory.room(0)
        later: set[str] = set()
        for pieces in split:
            later.update(pieces[1:])
        fresh = [piece for piece in later if piece not in memory]
        for batch in balanced(fresh):
            encoded = self.tokenizer.encode_batch_fast([" " + piece for piece in batch], add_special_tokens=False)
            memory.update(zip(batch, map(len, encoded), strict=True))
        first = [len(encoded) for batch in balanced(pieces[0] for pieces in split)
                 for encoded in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        counted = [head + sum(map(memory.__getitem__, pieces[1:])) for head, pieces in zip(first, split, strict=True)]
        memory.settle(fresh)
        return counted


class WholeTextCounter:
    """Counts by encoding whole texts, for vocabularies that promise no safe boundary."""

    def __init__(self, encode):
        self.encode = encode

    def counts(self, texts: list[str]) -> list[int]:
        return [size for batch in balanced(texts) for size in self.encode(batch)]


def counter(path: str):
    """The counter for a vocabulary file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeTextCounter(lambda batch: [len(ids) for ids in processor.encode(batch, num_threads=1)])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    step = settings.get("pre_tokenizer") or {}
    plain = all(not (token["lstrip"] or token["rstrip"] or token["single_word"] or " " in token["content"])
                for token in settings.get("added_tokens", []))
    if (settings.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex")
            and not step.get("add_prefix_space") and plain):
        return ByteLevelCounter(tokenizer)
    return WholeTextCounter(
        lambda batch: map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)))


def count_tokens(frame: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Append ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text is an empty one: no bytes and no tokens.  An empty table gives
    an empty table; repeated rows stay; columns of these names are replaced.
    """
    def start():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)

        def make(batch):
            return [count.counts(texts_of(batch, text))]

        return make

    counted = with_columns(frame, [T.StructField("n_tokens", T.LongType())], start, text)
    return counted.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "over_limit": F.col("n_tokens") > F.lit(limit),
    })
