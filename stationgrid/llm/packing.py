"""Best-fit packing of token sequences by bin completion.

Lengths are integers up to the sequence size, so all that a packing must know of any
number of documents is how many pieces each length has: at most ``capacity`` counts.
The search runs on these. It takes the largest length left and looks for the filling
that completes its bin: larger items first (a filling is dominated if one item of it
could be replaced by a larger one that fits), a branch is cut when even all the room
left could not beat the incumbent's waste, and the incumbent starts as the best fit.
The filling is then used as often as its counts last, which uses up a length, so the
search has at most about two steps per length whatever the size of the corpus.

Every piece finds its place by its rank among the pieces of its length. Ranks come
from windows over (length, hash bucket) and sums of the buckets before, so that a
length shared by very many pieces is spread.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stationgrid.llm.common import map_batches, materialised, texts

#: Branch-and-bound nodes for one bin; beyond them its incumbent, at worst the best fit, is used.
NODES = 20_000
#: Pieces of one length that one window group ranks.
RANKED_TOGETHER = 20_000
MIN_BUCKETS = 16
#: Letters beyond this range are left to the tokenizer file's own library: Unicode versions differ between the two.
_BEYOND = re.compile("[^\u0000-ɏ]")
#: The fast library fails on white space of about a million characters in a row.
WHITE_RUN = 100_000
_LONG_WHITE = re.compile(r"\s{%d}" % WHITE_RUN)


class Encoder:
    """Token ids as the ``tokenizers`` library gives them, special strings included.

    The same vocabulary as ranks encodes several times faster; both agree on Latin text, other
    text goes to the tokenizer file itself. So do texts with ``WHITE_RUN`` or more characters of white space in a row.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            lines = (line.split() for line in open(ranks_path, "rb"))
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _BEYOND.search(text) or _LONG_WHITE.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all", disallowed_special=())


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    return Encoder(json_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    first = n % capacity
    pieces = [(0, first)] if first else []
    return pieces + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, ranks: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document."""
    json_path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks or (None if vocabulary else public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = texts(docs)
    key = docs.schema["doc_id"].dataType.simpleString()

    def encode(batch):
        encode_one, out = encoder(json_path, ranks_path).ids, []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.array([*encode_one(text), end_id], dtype="<u4").tobytes()
            out += [(doc, p, s, n, zlib.crc32(ids[4 * s: 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out), strict=True)) if out else None

    return map_batches(docs, encode, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


def complete(room: int, counts: dict[int, int], sizes: list[int], nodes: int = NODES) -> list[int]:
    """The filling of ``room`` with least waste, undominated ones first.

    ``sizes``: the lengths that are left, largest first. Ties go to larger items, so that small
    ones stay for later bins.
    """
    best: list[int] = []
    free = room
    used: dict[int, int] = {}
    for s in sizes:  # best fit: the incumbent
        n = min(free // s, counts[s] - used.get(s, 0))
        if n > 0:
            best += [s] * n
            used[s] = n
            free -= s * n
        if not free:
            return best
    waste, visited = free, 0
    #: What all items from position i on could fill at most.
    reach = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        reach[i] = reach[i + 1] + sizes[i] * counts[sizes[i]]
    stack = [(0, room, [])]
    while stack and waste and visited < nodes:
        i, free, taken = stack.pop()
        visited += 1
        if free < waste:
            best, waste = taken, free
        while i < len(sizes) and sizes[i] > free:
            i += 1
        if i == len(sizes) or free - min(free, reach[i]) >= waste:  # waste bound
            continue
        most = min(free // sizes[i], counts[sizes[i]])
        # pushed in this order, the fullest use of the largest item is tried first
        stack += [(i + 1, free - n * sizes[i], taken + [sizes[i]] * n) for n in range(most + 1)]
    return best


def plan_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), for all pieces that are counted."""
    left = {s: n for s, n in counts.items() if n}
    plan: list[tuple[list[int], int]] = []
    sizes = sorted(left, reverse=True)
    while sizes:
        largest = sizes[0]
        left[largest] -= 1
        inside = [s for s in sizes if s <= capacity - largest and left[s]]
        filling = [largest, *complete(capacity - largest, left, inside, nodes)]
        left[largest] += 1
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // n for s, n in need.items())
        plan.append((filling, times))
        for s, n in need.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s]]
    return plan


def _places(plan: list[tuple[list[int], int]]) -> list[tuple]:
    """(length, first rank, last rank + 1, first sequence, offsets in it): at most a few per length and filling."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for s in filling:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, where in offsets.items():
            low = ranks.get(s, 0)
            ranks[s] = low + len(where) * times
            rows.append((s, low, ranks[s], sequence, where))
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = materialised(pieces)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(plan_bins(counts, capacity, nodes))
    buckets = max(MIN_BUCKETS, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
        .select("length", "_bucket", "_before")
    )
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    schema = T.StructType.fromDDL("length long, low long, high long, sequence long, offsets array<long>")
    table = (
        spark.createDataFrame(places, schema).groupBy("length")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high", "sequence", "offsets"))).alias("_places"))
    )
    # one row per length at most: bounded by ``capacity``, not by the data
    found = ranked.join(F.broadcast(table), "length").withColumn(
        "_place", F.filter("_places", lambda p: (p["low"] <= F.col("_rank")) & (F.col("_rank") < p["high"]))[0]
    )
    slot = F.col("_rank") - F.col("_place.low")
    per_bin = F.size("_place.offsets").cast("long")
    return found.select(
        *columns,
        (F.col("_place.sequence") + F.floor(slot / per_bin)).cast("long").alias("sequence_id"),
        F.element_at("_place.offsets", (slot % per_bin + 1).cast("int")).alias("offset"),
    )


def best_fit_packing(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, ranks: str | None = None, nodes: int = NODES) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    Every document has at least its closing id, so null and empty texts are pieces of length 1.
    Repeated rows are packed each on its own; a null doc_id is kept; an empty table gives no rows.
    """
    return pack(pieces_of(docs, capacity, vocabulary, ranks), capacity, nodes)
