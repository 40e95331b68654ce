"""Document fingerprints after I-Match: hashes of the terms a document shares with randomised parts of a lexicon.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents: common words say nothing, and
rare ones are often typing errors. Parts of it are drawn by hash, in levels: a part of level L holds each term with a chance of
2^-L. A document uses the two levels at which a part holds between a quarter of a term and one of its own, so a
change of some words leaves many parts alone whatever the length of the text. The distinct terms of a document in one part are sorted and
hashed to one signature, and the likeness of two fingerprints is the share of equal signatures among the parts that are not
empty in both.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import _arrow_types, _batch, map_batches, texts, written

#: The band: a term stands in at most this share of the documents, and in at least that one.
MOST, LEAST = 0.05, 2e-4
#: No more terms than this can be in the band: below the share that guarantees it, terms are too rare.
LEXICON = 1 << 20
#: Parts of the lexicon at each level.
PARTS = 48
#: Terms that a task counts before it hands their counts on.
COUNTED = 300_000

_TERM = re.compile(r"\w+")
#: An odd number per part; the first bits of a term's product with it say at which levels the part holds the term.
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(b"part %d" % k, digest_size=8).digest(), "little") | 1 for k in range(PARTS)], dtype=np.uint64)


class TermHashes(dict):
    """64-bit hashes of terms; those of short terms are kept, a bounded number of them."""

    def __missing__(self, term: str) -> int:
        found = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))
        if len(term) < 64:
            if len(self) >= 200_000:
                self.clear()
            self[term] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Sorted hashes of the distinct terms, which are the lower-cased runs of letters, digits and underscores."""
        distinct = set(_TERM.findall(text.lower()))
        return np.sort(np.fromiter(map(self.__getitem__, distinct), dtype=np.uint64, count=len(distinct)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, in parts of about COUNTED terms."""
    counts = Counter()

    def part() -> pa.RecordBatch:
        terms = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in counts], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["term", "n"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(set(_TERM.findall(text.as_py().lower())))
            if len(counts) >= COUNTED:
                yield part()
                counts.clear()
    if counts:
        yield part()


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band, at most LEXICON of them."""
    source = texts(docs)
    counts = written(source.select("text").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    pairs, documents = counts.agg(F.sum("n")).first()[0] or 0, source.count()
    # of all pairs of a term and a document, at most LEXICON terms can have as many as this each
    least = max(LEAST * documents, pairs / LEXICON)
    band = counts.where((F.col("n") >= least) & (F.col("n") <= max(1.0, MOST * documents))).select("term").toArrow()
    return np.sort(np.asarray(band.column("term"), dtype=np.int64).view(np.uint64))


class Fingerprint:
    """Level, signatures at it and at the next one (0: the part holds no term of the document), and whether terms of the band were found."""

    def __init__(self, terms: np.ndarray, known: np.ndarray):
        at = np.searchsorted(known, terms)
        inside = terms[known[np.minimum(at, len(known) - 1)] == terms] if len(known) else terms[:0]
        self.banded = len(inside) > 0
        # a document all of whose terms lie outside the band is known by all of them
        own = inside if self.banded else terms
        # 2^level is more than the number of terms: a part holds between half a term and one
        self.level = int(len(own)).bit_length()
        drawn = [_drawn(own[k:k + 4096], self.level) for k in range(0, len(own), 4096)]
        if len(drawn) != 1:
            part, term, more = (np.concatenate(x) for x in zip(*drawn, strict=True)) if drawn else (np.zeros(0, np.int64), own, np.zeros(0, bool))
            order = np.argsort(part, kind="stable")
            drawn = [(part[order], term[order], more[order])]
        part, term, more = drawn[0]
        self.signs = [_signatures(part, term), _signatures(part[more], term[more])]

    def __str__(self) -> str:
        return f"{'b' if self.banded else 'o'}{self.level:02d}:" + ":".join(signs.astype(">u2").tobytes().hex() for signs in self.signs)

    def likeness(self, other: Fingerprint) -> float:
        """Share of equal signatures at the levels both have, of those that are not empty in both."""
        if self.banded != other.banded:
            return 0.0
        a = np.concatenate([self.signs[d] for d in (0, 1) if 0 <= self.level + d - other.level <= 1] or [np.zeros(0, np.int64)])
        b = np.concatenate([other.signs[d] for d in (0, 1) if 0 <= other.level + d - self.level <= 1] or [np.zeros(0, np.int64)])
        some = int(np.count_nonzero((a != 0) | (b != 0)))
        if some:
            return float(np.count_nonzero((a == b) & (a != 0)) / some)
        return float(self.level == other.level and len(a) > 0)


def _drawn(terms: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts and sorted terms of each part at ``level``, and whether they also stand in the part at the next level."""
    mixed = _FACTORS[:, None] * terms[None, :]
    part, at = np.nonzero(mixed < np.uint64(1 << (64 - level)))
    return part, terms[at], mixed[part, at] < np.uint64(1 << (63 - level))


def _signatures(part: np.ndarray, term: np.ndarray) -> np.ndarray:
    out = np.zeros(PARTS, dtype=np.int64)
    if len(part):
        terms = term.tobytes()
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        at = [*(8 * first).tolist(), len(terms)]
        out[part[first]] = [1 + xxhash.xxh64_intdigest(terms[a:b]) % 65535 for a, b in zip(at, at[1:], strict=False)]
    return out


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


class _Documents:
    """Documents with their fingerprints, made once each."""

    def __init__(self, known: np.ndarray):
        self.known, self.hashes = known, TermHashes()

    def fingerprint(self, text: str) -> Fingerprint:
        return Fingerprint(self.hashes.of(text), self.known)

    def row(self, doc_id: int | None, text: str, own: Fingerprint, following: str, next_print: Fingerprint) -> tuple:
        tail = len(text) // 4
        changed = text[:len(text) - tail] + following[:tail]
        edited = self.fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, str(own), str(edited), own.likeness(edited), own.likeness(next_print)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; equal texts have equal fingerprints. A null text is empty, and an empty text has a fingerprint, too."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batch: pa.RecordBatch) -> dict:
        maker = _Documents(known.value)
        return {"doc_id": batch.column("doc_id"), "fingerprint": [str(maker.fingerprint(t)) for t in batch.column("text").to_pylist()]}

    return map_batches(texts(docs), run, "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every document beside an edited form of it and beside the next document.

    doc_id, n_chars, edited_sha256 (of the edited text), fingerprint, edited_fingerprint, near_edited and near_next (likeness to
    either). The edited text has its last quarter replaced by as many code points from the start of the next document, or by all that has. Documents
    follow each other by doc_id, null first, rows of equal ids by text; after the last comes the first, which in a
    table of one row is itself. A null text is empty; texts without any term are like each other only. An empty table gives no rows.

    Documents are dealt by ranges of ids and pass in order. Only the first and the last one of a range leave it with
    their texts, to meet those of the ranges beside it.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(lexicon(docs))
    schema = _RESULT + ", edge int, part int, text string"
    types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, last, part = _Documents(known.value), None, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                here = (doc_id, body := text.as_py(), maker.fingerprint(body))
                rows.append((*maker.row(*last, body, here[2]), 0, part, None) if last else (doc_id, *[None] * 6, 1, part, body))
                last = here
            if rows:
                yield _batch(dict(zip(types.names, zip(*rows, strict=True), strict=True)), types)
        if last:
            yield _batch(dict(zip(types.names, zip((last[0], *[None] * 6, 2, part, last[1])), strict=True)), types)

    def across(batch: pa.RecordBatch) -> dict:
        maker = _Documents(known.value)
        rows = [maker.row(i, t, maker.fingerprint(t), u, maker.fingerprint(u)) for i, t, u in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        return dict(zip(types.names, zip(*rows, strict=True), strict=False))

    dealt = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = written(dealt.mapInArrow(run, schema), "likeness")
    # one number per range
    ranges = sorted(r["part"] for r in done.where("edge = 1").select("part").collect())
    after = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "part int, following_part int")
    firsts = done.where("edge = 1").select(F.col("part").alias("following_part"), F.col("text").alias("following"))
    pairs = done.where("edge = 2").select("doc_id", "part", "text").join(after, "part").join(firsts, "following_part").select("doc_id", "text", "following")
    return done.where("edge = 0").select(*types.names[:7]).unionByName(map_batches(pairs, across, _RESULT))
