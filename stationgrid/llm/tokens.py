"""Token counts by a compiled finite-state tokenizer.

A byte-pair encoding with merges in rank order has two properties: a sequence of
tokens is an encoding exactly if each neighbouring pair is, and every prefix of a
word has one encoding. So the encoding of a growing prefix is found from left to
right: the new last token is the longest token ending here that is compatible with
the last token of the prefix before it. What later steps need of the past is
finite: the longest end of the prefix that begins some token, and the last token
and count at each position of it. These are the states of a deterministic
transducer; a transition on a byte carries the change of the number of emitted
tokens. States and transitions are compiled when text first reaches them.

White space resets the transducer, whatever state a chunk is entered in. The state
map of a chunk is therefore (piece before the first white space, tokens after it,
piece behind the last white space), or the bare piece where there is none. Maps
compose associatively, and a document's count is the scan of its chunks' maps.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationgrid.llm.common import map_batches, texts

CHUNK_CHARS = 1 << 16
#: The word cache of a worker starts anew at this size; it holds no result that cannot be recomputed.
CACHED_WORDS = 400_000
CACHED_STATES = 300_000
#: Python counts these as white space, Unicode's White_Space property does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Transducer:
    """Deterministic transducer of one byte-level BPE vocabulary whose words end in a mark."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end = end
        self.vocab = frozenset(vocab)
        self.ranks = {(m if isinstance(m, str) else " ".join(m)): i for i, m in enumerate(merges)}
        self.prefixes = {t[:k] for t in vocab for k in range(1, len(t) + 1)}
        self.letters = byte_letters()
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict] = []
        self.start = self._state("", ((None, 0),))

    def _state(self, live: str, past: tuple) -> int:
        key = (live, past)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.ids[key]

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges in rank order: the definition, used for tokens and pairs of tokens only."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(f"{a} {b}", 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]
        return symbols

    def _fits(self, before: str | None, token: str) -> bool:
        if token not in self.whole:
            self.whole[token] = token in self.vocab and self.merged(self._symbols(token)) == [token]
        if before is None or not self.whole[token]:
            return self.whole[token]
        if (before, token) not in self.pairs:
            if len(self.pairs) > 4 * CACHED_STATES:
                self.pairs.clear()
            self.pairs[before, token] = self.merged(self._symbols(before) + self._symbols(token)) == [before, token]
        return self.pairs[before, token]

    def _last(self, letters: str, past: tuple, end: str) -> tuple[str, int]:
        for k in range(len(letters)):
            token = letters[k:] + end
            if (token in self.prefixes or k == len(letters) - 1) and self._fits(past[k][0], token):
                return token, past[k][1] + 1
        return letters[-1] + end, past[len(letters) - 1][1] + 1  # a letter that the vocabulary lacks

    def _compile(self, state: int, letter: str) -> tuple[int, int]:
        live, past = self.states[state]
        letters = live + letter
        token, count = self._last(letters, past, "")
        keep = next((k for k in range(len(letters)) if letters[k:] in self.prefixes), len(letters))
        entries = (*past, (token, count))[keep:]
        step = self._state(letters[keep:], tuple((t, n - count) for t, n in entries)), count
        self.steps[state][letter] = step
        return step

    def _compile_end(self, state: int, letter: str) -> int:
        live, past = self.states[state]
        count = self._last(live + letter, past, self.end)[1]
        self.steps[state][letter + self.end] = count
        return count

    def count(self, piece: str) -> int:
        """Tokens of one piece (letters for bytes, not empty)."""
        if len(self.states) > CACHED_STATES:
            self.reset()
        state, total, steps = self.start, 0, self.steps
        for letter in piece[:-1]:
            state, emitted = steps[state].get(letter) or self._compile(state, letter)
            total += emitted
        last = steps[state].get(piece[-1] + self.end)
        return total + (self._compile_end(state, piece[-1]) if last is None else last)


class WordCounts(dict):
    """Tokens of each word (no white space inside), compiled on first sight."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letters = {i: c for i, c in enumerate(self.machine.letters)}

    def __missing__(self, word: str) -> int:
        total = 0
        for k, part in enumerate(self.special.split(word)):
            if k % 2:
                total += 1
                continue
            # letter by letter, so that a closing sigma is lowered like any other
            lowered = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.pieces.findall(lowered):
                total += self.machine.count(piece.encode().decode("latin-1").translate(self.letters))
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = total
        return total


@lru_cache(maxsize=4)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


class ChunkMap(NamedTuple):
    """What a chunk does to the count, from whichever state it is entered."""

    head: str
    tokens: int
    tail: str | None  # None: no white space in the chunk, so all of it is head


def chunk_map(text: str, counts: WordCounts) -> ChunkMap:
    words = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
    if not text:
        return ChunkMap("", 0, None)
    opens, closes = bool(_SPACE.match(text[0])), bool(_SPACE.match(text[-1]))
    words = [w for w in words if w]
    if len(words) <= 1 and not opens and not closes:
        return ChunkMap(text, 0, None)
    head = "" if opens else words.pop(0)
    tail = "" if closes else words.pop()
    return ChunkMap(head, sum(map(counts.__getitem__, words)), tail)


def compose(a: ChunkMap, b: ChunkMap, counts: WordCounts) -> ChunkMap:
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.tokens, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.tokens, a.tail + b.head)
    joined = a.tail + b.head
    return ChunkMap(a.head, a.tokens + b.tokens + (counts[joined] if joined else 0), b.tail)


def scan(maps: list[ChunkMap], counts: WordCounts) -> ChunkMap:
    """Pairs first, then pairs of pairs: the up-sweep of a prefix scan."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], counts) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ChunkMap("", 0, None)


def total(m: ChunkMap, counts: WordCounts) -> int:
    return m.tokens + sum(counts[w] for w in (m.head, m.tail or "") if w)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs``.

    ``vocabulary`` is the file of a byte-level BPE with word ends. A null or empty text has
    no tokens; repeated rows each give a row; a null doc_id is kept; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    size = F.char_length("text")
    pieces = F.when(size <= chunk_chars, F.array("text")).otherwise(F.transform(
        F.sequence(F.lit(0), ((size - 1) / F.lit(chunk_chars)).cast("int")),
        lambda i: F.substring(F.col("text"), (i * chunk_chars + 1).cast("int"), F.lit(chunk_chars)),
    ))
    chunks = (
        texts(docs).withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long")})
        .select("row", "doc_id", "n_bytes", F.posexplode(pieces).alias("chunk", "text"))
    )
    key = chunks.schema["doc_id"].dataType.simpleString()

    def to_maps(batch):
        counts = word_counts(path)
        maps = [chunk_map(t, counts) for t in batch.column("text").to_pylist()]
        return {
            "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "chunk": batch.column("chunk"),
            "head": [m.head for m in maps], "tokens": [m.tokens for m in maps], "tail": [m.tail for m in maps],
        }

    maps = map_batches(chunks, to_maps, f"row long, doc_id {key}, n_bytes long, chunk int, head string, tokens long, tail string")
    grouped = maps.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.array_sort(F.collect_list(F.struct("chunk", "head", "tokens", "tail"))).alias("maps"),
    )

    def to_counts(batch):
        counts = word_counts(path)
        n = [total(scan([ChunkMap(m["head"], m["tokens"], m["tail"]) for m in ms], counts), counts) for ms in batch.column("maps").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(grouped, to_counts, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")
