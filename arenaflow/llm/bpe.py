"""BPE encoding and decoding for a word vocabulary, by tree concatenation.

A word of up to ``LEAF`` symbols is merged directly.  A longer one is halved,
its halves are encoded on their own, and the two results are joined: the tokens
next to the join are encoded again, one from each side, then two, then four,
until the outermost token of either side comes back unchanged.  Merges act on
neighbours only, so a row of tokens in which every pair of neighbours is its own
encoding is the encoding of the whole; that makes the join exact, not close.

Words of more than ``SEGMENT`` symbols are spread over tasks: every task encodes
one piece, and pieces of a word are joined in order by the same rule.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.frames import partitions, stored, texts_of, with_columns
from arenaflow.llm.token_counts import Memory

LEAF = 24
#: Letters and numerals of the first 256 code points, which normalisation only lower-cases; white space is apart.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMERALS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMERALS}]+")
_PLAIN = re.compile("[\0-\xff]*")
SEGMENT = 1 << 16


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file: normalised words, byte symbols, a mark at word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model = settings["model"]
        step = settings.get("pre_tokenizer") or {}
        parts = step.get("pretokenizers", [])
        if not (model["type"] == "BPE" and model.get("end_of_word_suffix") and settings.get("decoder") is None
                and len(parts) == 2 and parts[0].get("behavior") == "Removed" and parts[1].get("type") == "ByteLevel"
                and not parts[1].get("add_prefix_space")):
            raise ValueError(f"{path} is not a word vocabulary with end marks")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.words = library.pre_tokenizer.pre_tokenize_str
        vocabulary: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {token["content"]: token["id"] for token in settings["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inner = {name: number for name, number in vocabulary.items() if len(name) == 1}
        self.final = {name[0]: number for name, number in vocabulary.items()
                      if len(name) == 1 + len(end) and name.endswith(end)}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        for name, number in [*vocabulary.items(), *self.special.items()]:
            self.names[number] = name
        shift = self.size.bit_length()
        self.low = (1 << shift) - 1
        self.shift = shift
        #: Of a pair of tokens, in one integer: the rank of its merge above, the merged token below.
        self.merges: dict[int, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {
            number: (number,) for number in [*self.inner.values(), *self.final.values()]}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            first, second = vocabulary[left], vocabulary[right]
            whole = vocabulary[left + right]
            self.merges[first << shift | second] = rank << shift | whole
            self.symbols[whole] = self.symbols[first] + self.symbols[second]
        self.letters = {self._letter(byte): byte for byte in range(256)}
        self.inner_of = [self.inner.get(self._letter(byte)) for byte in range(256)]
        self.final_of = [self.final.get(self._letter(byte)) for byte in range(256)]
        self.finals = set(self.final.values())
        self.whole_alphabet = None not in self.inner_of and None not in self.final_of
        self.pieces = Memory(100_000)
        self.known_words = Memory(500_000)

    @staticmethod
    def _letter(byte: int) -> str:
        """The letter that stands for a byte: printable ones for themselves, the others from code point 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [value for value in range(256) if value not in plain]
        return chr(byte) if byte in plain else chr(256 + others.index(byte))

    def merge(self, row: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until no pair is listed."""
        if len(row) > 2 * LEAF:
            return self._merge_long(row)
        shift, get, none = self.shift, self.merges.get, 1 << 62
        pairs = [get(left << shift | right, none) for left, right in zip(row, row[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            whole = best & self.low
            row[at:at + 2] = [whole]
            del pairs[at]
            if at:
                pairs[at - 1] = get(row[at - 1] << shift | whole, none)
            if at < len(pairs):
                pairs[at] = get(whole << shift | row[at + 1], none)
        return row

    def _merge_long(self, row: list[int]) -> list[int]:
        """The same order of merges with a queue, for windows that have grown long."""
        shift, low, get = self.shift, self.low, self.merges.get
        after = list(range(1, len(row))) + [-1]
        before = list(range(-1, len(row) - 1))
        queue = [(found >> shift, position, row[position], row[position + 1], found & low)
                 for position in range(len(row) - 1)
                 if (found := get(row[position] << shift | row[position + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, at, left, right, whole = heapq.heappop(queue)
            behind = after[at]
            if row[at] != left or behind < 0 or row[behind] != right:
                continue
            row[at], row[behind] = whole, -1
            after[at] = after[behind]
            if after[at] >= 0:
                before[after[at]] = at
            for start in (before[at], at):
                if start >= 0 and after[start] >= 0:
                    found = get(row[start] << shift | row[after[start]])
                    if found is not None:
                        heapq.heappush(queue, (found >> shift, start, row[start], row[after[start]], found & low))
        return [token for token in row if token >= 0]

    def spell(self, tokens: list[int]) -> list[int]:
        return [symbol for token in tokens for symbol in self.symbols[token]]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one word from their own encodings."""
        reach = 1
        while left and right:
            head, tail = left[-reach:], right[:reach]
            window = self.encode_symbols(self.spell(head) + self.spell(tail), direct=True)
            if ((reach >= len(left) or window[0] == head[0]) and (reach >= len(right) or window[-1] == tail[-1])):
                return left[:-reach] + window + right[reach:]
            reach *= 2
        return left + right

    def encode_symbols(self, symbols: list[int], direct: bool = False) -> list[int]:
        if direct or len(symbols) <= LEAF:
            return self.merge(symbols)
        row = [self.merge(symbols[start:start + LEAF]) for start in range(0, len(symbols), LEAF)]
        while len(row) > 1:
            row = [self.join(*row[at:at + 2]) if at + 1 < len(row) else row[at] for at in range(0, len(row), 2)]
        return row[0]

    def word_symbols(self, word: bytes) -> list[int]:
        """The symbols of a word's bytes; bytes that the vocabulary lacks are left out, as the library does."""
        inner, final = self.inner_of, self.final_of
        row = [inner[byte] for byte in word[:-1]]
        row.append(final[word[-1]])
        return row if self.whole_alphabet else [symbol for symbol in row if symbol is not None]

    def parts(self, piece: str) -> Iterator[int | bytes]:
        """Words and the ids of special strings of a stretch of text, in order."""
        cut = self.cut_special.split(piece) if self.cut_special and "<|" in piece else (piece,)
        for part in cut:
            if part in self.special:
                yield self.special[part]
            elif _PLAIN.fullmatch(part):
                for word in _WORDS.findall(part.lower()):
                    yield word.encode()
            else:
                for word, _ in self.words(self.normalize(part)):
                    yield bytes(map(self.letters.__getitem__, word))

    def encode_word(self, word: str) -> bytes:
        return pack(self.encode_symbols(self.word_symbols(word.encode())))

    def encode_piece(self, piece: str) -> bytes:
        return b"".join(
            pack([part]) if isinstance(part, int) else pack(self.encode_symbols(self.word_symbols(part)))
            for part in self.parts(piece))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.

        A text of plain letters falls into words at once; any other is cut at
        white space, which never lies within a word.
        """
        plain = [bool(_PLAIN.fullmatch(text)) and "<|" not in text for text in texts]
        split = [_WORDS.findall(text.lower()) if easy else text.replace("\n", " ").split(" ")
                 for text, easy in zip(texts, plain, strict=True)]
        ids: list[bytes] = [b""] * len(texts)
        for easy, memory, encode in ((True, self.known_words, self.encode_word), (False, self.pieces, self.encode_piece)):
            rows = [row for row, kind in enumerate(plain) if kind == easy]
            memory.room(0)
            fresh = [piece for piece in set().union(*(split[row] for row in rows)) if piece not in memory]
            for piece in fresh:
                memory[piece] = encode(piece)
            for row in rows:
                ids[row] = b"".join(map(memory.__getitem__, split[row]))
            memory.settle(fresh)
        return ids

    def text_symbols(self, text: str) -> list[int]:
        """The symbols of a whole text; the last of every word is one of the final ones."""
        row: list[int] = []
        for part in self.parts(text):
            row.extend([part] if isinstance(part, int) else self.word_symbols(part))
        return row

    def ends_word(self, token: int) -> bool:
        spelled = self.symbols.get(token)
        return spelled is None or spelled[-1] in self.finals

    def encode_stretch(self, symbols: list[int]) -> list[int]:
        """Tokens of a run of symbols; its first and last word may be cut off."""
        tokens, word = [], []
        for symbol in symbols:
            word.append(symbol)
            if self.ends_word(symbol):
                tokens += self.encode_symbols(word)
                word = []
        return tokens + self.encode_symbols(word) if word else tokens

    def join_stretches(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring runs; a word that lies in both is put together."""
        if not left or not right or self.ends_word(left[-1]):
            return left + right
        tail = len(left)
        while tail and not self.ends_word(left[tail - 1]):
            tail -= 1
        head = next((at + 1 for at, token in enumerate(right) if self.ends_word(token)), len(right))
        return left[:tail] + self.join(left[tail:], right[:head]) + right[head:]

    def decode(self, ids: bytes) -> str:
        return " ".join(filter(None, map(self.names.__getitem__, unpack(ids))))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder for each worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(frame: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (little-endian unsigned 32-bit integers in a binary) and ``n_tokens``.

    A null or empty text has no tokens.  An empty table gives an empty table,
    repeated rows stay, and columns named ``ids`` or ``n_tokens`` are replaced.
    """
    def start():
        coder = loaded(path)

        def make(batch):
            return [coder.encode(texts_of(batch, text))]

        return make

    return with_columns(frame, [T.StructField("ids", T.BinaryType())], start, text).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long"))


def encode_spread(frame: DataFrame, path: str, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``encode`` for rows of very long text: every ``segment`` symbols are encoded in a task of their own.

    A cut may fall within a word; the two sides are then joined by re-encoding
    the tokens around it.  Only the ids of one text meet in one task.
    """
    rows = stored(frame.withColumn("_row", F.monotonically_increasing_id()), "long-texts")

    def cut(batches):
        coder = loaded(path)
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), texts_of(batch, text), strict=True):
                symbols = coder.text_symbols(value)
                for place, at in enumerate(range(0, max(1, len(symbols)), segment)):
                    yield pa.RecordBatch.from_pydict(
                        {"_row": [row], "place": [place], "ids": [pack(symbols[at:at + segment])]},
                        schema=_STRETCH)

    def encode_stretches(batches):
        coder = loaded(path)
        for batch in batches:
            ids = [pack(coder.encode_stretch(unpack(value))) for value in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())],
                                             schema=_STRETCH)

    def joined(stretches):
        coder, tokens = loaded(path), []
        for value in stretches.sort_values("place")["ids"]:
            tokens = coder.join_stretches(tokens, unpack(value))
        return stretches.head(1)[["_row"]].assign(ids=pack(tokens))

    stretches = rows.select("_row", text).mapInArrow(cut, _STRETCH_DDL)
    encoded = stretches.repartition(partitions(frame.sparkSession), "_row", "place").mapInArrow(
        encode_stretches, _STRETCH_DDL)
    found = encoded.groupBy("_row").applyInPandas(joined, "_row long, ids binary")
    clash = [name for name in rows.columns if name.lower() in ("ids", "n_tokens")]
    return rows.drop(*clash).join(found, "_row").drop("_row").withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long"))


_STRETCH_DDL = "_row long, place long, ids binary"
_STRETCH = pa.schema([("_row", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])


def decode(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``: the names of the tokens with a space between, special ones included.

    Null ids decode to an empty text; a column named ``decoded`` is replaced.
    """
    def start():
        coder = loaded(path)

        def make(batch):
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [[coder.decode(value or b"") for value in values]]

        return make

    return with_columns(frame, [T.StructField("decoded", T.StringType())], start, ids)


def encode_and_decode(frame: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode``, then ``decode`` of its ids in the same task: one worker and one vocabulary instead of two."""
    def start():
        coder = loaded(path)

        def make(batch):
            ids = coder.encode(texts_of(batch, text))
            return [ids, [coder.decode(value) for value in ids]]

        return make

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return with_columns(frame, fields, start, text).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def round_trip(documents: DataFrame, path: str, text: str = "text", spread_bytes: int = SEGMENT) -> DataFrame:
    """Encode every text, the very long ones spread over tasks, and decode the ids again."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    short = encode_and_decode(documents.where(size <= spread_bytes), path, text)
    long = decode(encode_spread(documents.where(size > spread_bytes), path, text), path)
    return short.unionByName(long)
