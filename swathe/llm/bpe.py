"""BPE encoding and decoding as streams (operator 6).

A merge can only join two neighbouring symbols if their touching characters stand side by side
inside some vocabulary entry. Where no entry holds such a pair, no merge ever crosses, so everything
to the left is stable as soon as one further character is seen: that is the lookahead taken from the
merge list. Tokens of a finished stretch are emitted at once; only the open stretch is held.

Nulls are empty texts, an empty text has no tokens, and repeated rows are encoded again.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from swathe.llm.common import mapped, texts

END = "</w>"
CACHED_WORDS = 1 << 18
CACHED_LENGTH = 48
BLOCK = 4096              # ids or characters taken at a time
SCANNED = 32              # symbols up to which a scan for the lowest rank beats a heap
# The pieces that the vocabulary file's splitter cuts. No two alternatives but the second
# and the last start with the same character, so words, the most frequent, may come first.
PIECES = r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
# The same below U+0250 for the faster standard module, whose \w holds six numbers and \s four controls.
BEYOND_LATIN = re.compile("[\u0250-\U0010FFFF]")
LATIN_PIECES = re.compile(
    r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\w\s]|[_\x1C-\x1F])+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = set(printable)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def blocks(ids: Iterable[int], size: int = BLOCK) -> Iterator[list[int]]:
    ids = iter(ids)
    while part := list(islice(ids, size)):
        yield part


class Pieces(dict):
    """The ids of short pieces that were seen, emptied when full."""

    def __init__(self, coder: Transducer):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[piece] = self.coder._short_piece(piece)
        return ids


class Transducer:
    """Encodes text piece by piece with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.alphabet = byte_alphabet()
        self.shown_byte = dict(enumerate(self.alphabet))
        self.piece = regex.compile(PIECES)
        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.touching = {
            body[i:i + 2] for token in self.vocab for body in [token.removesuffix(END)]
            for i in range(len(body) - 1)}
        self.short = Pieces(self)

    def encode(self, text: str) -> Iterator[int]:
        """Ids in order, each as soon as no later character can change it."""
        start = 0
        for mark in self.mark.finditer(text) if self.special else ():
            yield from self._plain(text[start:mark.start()])
            yield self.special[mark.group()]
            start = mark.end()
        yield from self._plain(text[start:])

    def _plain(self, text: str) -> Iterator[int]:
        text = unicodedata.normalize("NFC", text)
        # Lower-case letter by letter: the final form of sigma depends on context otherwise.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        short = self.short
        pattern = self.piece if BEYOND_LATIN.search(text) else LATIN_PIECES
        for match in pattern.finditer(text):
            piece = match.group()
            if len(piece) > CACHED_LENGTH:
                yield from self._piece(piece)
            else:
                yield from short[piece]

    def _symbols(self, piece: str) -> Iterator[str]:
        for i in range(0, len(piece), BLOCK):
            data = piece[i:i + BLOCK].encode("utf-8", "replace")
            yield from data.decode("latin-1").translate(self.shown_byte)

    def _short_piece(self, piece: str) -> tuple[int, ...]:
        symbols = list(self._symbols(piece))
        symbols[-1] += END
        return tuple(self._merge(symbols))

    def _piece(self, piece: str) -> Iterator[int]:
        held: list[str] = []
        for symbol in self._symbols(piece):
            if held and held[-1] + symbol not in self.touching:
                yield from self._merge(held)
                held = []
            held.append(symbol)
        if held:
            held[-1] += END
            yield from self._merge(held)

    def _merge(self, symbols: list[str]) -> Iterator[int]:
        """Lowest rank first, leftmost among equals; a long stretch over a linked list."""
        if len(symbols) > SCANNED:
            return self._merge_long(symbols)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
        return map(self.vocab.__getitem__, symbols)

    def _merge_long(self, symbols: list[str]) -> Iterator[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 1) for i in range(n - 1)
                 if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        parts: list[str | None] = list(symbols)
        while queue:
            rank, i, j = heapq.heappop(queue)
            if parts[i] is None or j >= n or parts[j] is None or after[i] != j:
                continue
            if self.rank.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, b))
        return (self.vocab[p] for p in parts if p is not None)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        return self.decode_blocks(blocks(ids))

    def decode_blocks(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Text in steps. A byte-level file goes through an incremental UTF-8 state machine; a file
        without decoder shows its tokens, one space between them."""
        if self.decoder is None:
            lead = ""
            for part in parts:
                yield lead + " ".join(map(self.text_of.__getitem__, part))
                lead = " "
            return
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        marks = set(self.special.values())
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in (i for part in parts for i in part):
            token = self.text_of[i].removesuffix(END)
            if i in marks:
                yield state.decode(b"", True) + token
                state.reset()
            else:
                yield state.decode(bytes(byte_of[c] for c in token))
        yield state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker and file."""
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int): the tokens of every text."""
    def start():
        coder = transducer(path)
        return lambda values: [[np.fromiter(coder.encode(t), "int32") for t in values]]
    return mapped(texts(docs), ["doc_id"], start, "ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text``: what the ids of ``encode_documents`` spell."""
    def start():
        coder = transducer(path)
        return lambda values: [["".join(coder.decode(ids)) for ids in values]]
    return mapped(encoded, ["doc_id"], start, "text string", column="ids")


def encoding_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of ids and decoded text, in one pass over each text, and the
    ``ids`` themselves if asked for."""
    def digest(coder: Transducer, text: str) -> tuple:
        packed, shown, count, ids = hashlib.sha256(), hashlib.sha256(), 0, array("i")

        def stream():
            nonlocal count
            for part in blocks(coder.encode(text)):
                count += len(part)
                if with_ids:
                    ids.extend(part)
                packed.update(np.array(part, "<u4").tobytes())
                yield part
        for step in coder.decode_blocks(stream()):
            shown.update(step.encode())
        found = count, packed.hexdigest(), shown.hexdigest()
        return (*found, np.frombuffer(ids, "int32")) if with_ids else found

    def start():
        coder = transducer(path)
        return lambda values: list(zip(*(digest(coder, t) for t in values), strict=True))
    return mapped(texts(docs), ["doc_id"], start,
                  "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
