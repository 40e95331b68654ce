"""Repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. No machine can hold the suffixes of all
documents, so equal strings are first brought together. In every window of ``length`` bytes the smallest hash of its runs of
GRAM bytes picks an anchor; equal windows have the same anchor at the same place in them, and each window belongs to one anchor.
Anchors whose run stands in one place only end there with all their windows: nearly all of a clean corpus. If
all occurrences of an anchor have the same bytes around them, all their windows are repeated. Of the
others, each distinct text around an anchor is read once, with its number of occurrences, and the texts of an anchor
come together. There a suffix array is built by two-stage sorting: suffixes smaller than their successor are sorted directly, the
rest is induced from them by scanning the buckets of first bytes; windows whose common prefix with
their neighbour in the array is long enough are repeated.

Anchors with more than CROWD distinct texts around them (a phrase that very many documents share) would make one large group. Their windows
are dealt by two 64-bit hashes of their bytes and counted instead, which gives the same answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationgrid.llm.common import join_keys, map_batches, materialised, texts, written

LENGTH = 400
GRAM = 128
CROWD = 1500
#: Bytes that are hashed at a time, and bytes of one suffix array (more only for a single anchor's texts).
CHUNK = 1 << 20
#: Ids that may be broadcast so that only the texts of these documents are shuffled: 8 MB of numbers.
BROADCAST_IDS = 500_000

_MIX = np.random.default_rng(20_011).integers(1, 1 << 63, 320, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from every place on, by doubling; shorter ends are left out."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    power, span = (_MIX[:256] + np.uint64(2 * seed))[data], 1
    whole, done, level = None, 0, 256 + 16 * seed
    while True:
        if length & span:
            if whole is None:
                whole = power
            else:
                n = len(data) - done - span + 1
                whole = whole[:n] * _MIX[level + 8] + power[done: done + n]
                whole ^= whole >> np.uint64(31)
            done += span
        if done == length:
            return whole
        power = power[:-span] * _MIX[level] + power[span:]
        power ^= power >> np.uint64(29)
        span *= 2
        level += 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span: len(values) - span + 1]) if width > span else out


def chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of consecutive items of about ``limit`` together, at least one item each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def anchors(documents: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, hash of the anchor, hash of the bytes of all its windows)."""
    data = b"".join(documents)
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return none
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    begin = sizes.cumsum() - sizes
    hashes = run_hashes(np.frombuffer(data, np.uint8), gram)
    hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    low = np.uint64(0xFFFFFFFF)
    picked = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low
    many = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), many)
    if not len(doc):
        return none
    start = np.arange(len(doc)) - np.repeat(many.cumsum() - many, many) + begin[doc]
    owner = picked[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    doc, lo, hi, owner = doc[first], start[first], start[last], owner[first]
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    around = np.fromiter((digest(view[a: b + length], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (owner - lo).tolist())), dtype=np.uint64, count=len(lo))
    return doc, lo - begin[doc], hi - begin[doc], hashes[owner].view(np.int64), around.view(np.int64)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last is not."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    # equal bytes have the kind of the next byte that differs
    where = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(where[::-1])[::-1]
    return step[following] > 0


def words_at(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number in text order, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k: k + len(data)]
    return out


def sorted_directly(data: bytes, words: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """``which`` in the order of their first ``depth`` bytes: by number for 8 bytes, ties by the rest of the text."""
    order = which[np.argsort(words[which], kind="stable")]
    key = words[order]
    tied = np.flatnonzero(np.concatenate([[False], key[1:] == key[:-1]]))
    if not len(tied):
        return order
    member = np.zeros(len(order), bool)
    member[tied] = member[tied - 1] = True
    places = np.flatnonzero(member)
    new = np.concatenate([[True], key[places][1:] != key[places][:-1]])
    cuts = [*np.flatnonzero(new).tolist(), len(places)]
    for a, b in zip(cuts, cuts[1:]):
        group = order[places[a:b]].tolist()
        group.sort(key=lambda i: data[i + 8: i + depth])
        order[places[a:b]] = group
    return order


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of at least their first ``depth`` bytes, by two-stage sorting."""
    t = np.frombuffer(data, np.uint8)
    if not len(t):
        return np.zeros(0, np.int64)
    small = smaller_than_next(t)
    direct = sorted_directly(data, words_at(t), np.flatnonzero(small), depth)
    cuts = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(batch: np.ndarray) -> None:
        """The suffixes one byte longer that are larger than these come next in the buckets of their first byte."""
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            ends = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, ends):
                induced[t[part[0]]].append(part)

    # the empty suffix is the smallest: the last byte's suffix follows from it
    induced[t[-1]].append(np.array([len(t) - 1]))
    for c in range(256):
        k = 0
        while k < len(induced[c]):  # scanning a bucket may add to its own end
            induce(induced[c][k])
            out.append(induced[c][k])
            k += 1
        own = direct[cuts[c]: cuts[c + 1]]
        if len(own):
            induce(own)
            out.append(own)
        induced[c] = []
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``depth`` bytes; 0 for the first."""
    words = words_at(data)
    n = len(data)
    out = np.zeros(len(array), np.int64)
    alive = np.arange(1, len(array))
    for at in range(0, depth, 8):
        a, b = array[alive - 1] + at, array[alive] + at
        inside = np.maximum(a, b) < n
        x = np.zeros(len(alive), np.uint64)
        x[inside] = words[a[inside]] ^ words[b[inside]]
        room = n - np.maximum(a, b)
        on = (x == 0) & (room >= 8)
        out[alive[on]] += 8
        # where they part: leading equal bytes of the eight, as far as both texts go
        end = ~on
        y, same = x[end], np.zeros(end.sum(), np.int64)
        for k in range(8):
            same += y < np.uint64(1 << (56 - 8 * k)) if k < 7 else y == 0
        out[alive[end]] += np.minimum(same, room[end].clip(0))
        alive = alive[on]
        if not len(alive):
            break
    return np.minimum(out, depth)


def repeated_windows(parts: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each (text, occurrences) the windows, by their start, that the texts hold twice or more in all."""
    data = b"".join(p for p, _ in parts)
    sizes = np.array([len(p) for p, _ in parts], dtype=np.int64)
    begin = sizes.cumsum() - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    weight = np.array([n for _, n in parts], dtype=np.int64)[part]
    whole = np.arange(len(data)) + length <= (begin + sizes)[part]
    array = suffix_array(data, length)
    run = (common_prefixes(np.frombuffer(data, np.uint8), array, length) < length).cumsum() - 1
    total = np.bincount(run, weight[array] * whole[array])
    hit = array[(total[run] >= 2) & whole[array]]
    hit.sort()
    return [hit[a:b] - s for a, b, s in zip(np.searchsorted(hit, begin), np.searchsorted(hit, begin + sizes), begin)]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that windows at ``starts`` (ascending) cover, joined where they touch."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    low, high = starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])] + length
    return list(zip(low.tolist(), high.tolist()))


_PLACE = "doc_id {key}, mark long, low int, high int, anchor long, around long"


def _anchor_rows(docs: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    def find(batch):
        text = [t.encode() for t in batch.column("text").to_pylist()]
        found = []
        for part in chunks([len(t) for t in text], CHUNK):
            doc, *rest = anchors(text[part], length, gram)
            found.append((doc + part.start, *rest))
        doc, low, high, anchor, around = (np.concatenate(x) for x in zip(*found))
        return {"doc_id": batch.column("doc_id").take(pa.array(doc)), "mark": batch.column("mark").take(pa.array(doc)), "low": low.astype(np.int32), "high": high.astype(np.int32), "anchor": anchor, "around": around}

    return map_batches(docs.select("doc_id", "mark", "text").where(F.octet_length("text") >= length), find, _PLACE.format(key=key))


def _with_docs(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``rows`` (one per document). Up to BROADCAST_IDS documents only their texts are shuffled, beyond that all.

    ``how`` is inner, or left: then ``rows`` has the column ``spans``, null for the other documents.
    """
    rows = rows.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    same = docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["mark"] == F.col("_mark"))
    ids = rows.select("_doc", "_mark")
    if ids.count() > BROADCAST_IDS:
        return docs.join(rows, same, how).drop("_doc", "_mark")
    found = docs.join(F.broadcast(ids), same, "left_semi").join(rows, same, "inner").drop("_doc", "_mark")
    if how == "inner":
        return found
    others = docs.join(F.broadcast(ids), same, "left_anti")
    return found.unionByName(others.withColumn("spans", F.lit(None).cast(rows.schema["spans"].dataType)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, mark, spans (array of low, high in bytes; maximal runs) of ``docs`` (doc_id, mark, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    found = written(_anchor_rows(docs, key, length, gram), "anchors")
    groups = found.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("around").alias("_a"), F.max("around").alias("_b")).where("_n > 1")
    groups = materialised(groups.select("anchor", "_n", (F.col("_a") != F.col("_b")).alias("mixed")))
    several = materialised(join_keys(found, groups, ["anchor"], found.count()))
    spans = several.where("NOT mixed").select("doc_id", "mark", "low", (F.col("high") + length).alias("high"))

    mixed = several.where("mixed")
    place = F.struct("doc_id", "mark", "low", "high")
    distinct = materialised(mixed.groupBy("anchor", "around").agg(F.count("*").cast("int").alias("n"), F.min(place).alias("at")))
    crowded = materialised(distinct.groupBy("anchor").agg(F.count("*").alias("_n"), (F.count("*") > crowd).alias("crowded")))
    asked = (
        join_keys(distinct, crowded, ["anchor"], distinct.count())
        .select("at.doc_id", "at.mark", F.struct("anchor", "around", "n", "at.low", "at.high", "crowded").alias("ask"))
        .groupBy("doc_id", "mark").agg(F.collect_list("ask").alias("asks"))
    )
    read = materialised(_with_docs(docs, materialised(asked), "inner").select("text", "asks").transform(lambda d: _around(d, length)))
    texts_ = read.where("window IS NULL").select("anchor", "around", "n", "body")
    windows = read.where("window IS NOT NULL").select("anchor", "around", "n", "window", "k1", "k2")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1]))
        own: list[list] = []
        for r in rows:
            if own and own[-1][0][0] == r[0]:
                own[-1].append(r)
            else:
                own.append([r])
        for part in chunks([sum(len(r[3]) for r in g) for g in own], CHUNK):
            together = [r for g in own[part] for r in g]
            hits = repeated_windows([(r[3], r[2]) for r in together], length)
            kept = [(r[0], r[1], [{"low": a, "high": b} for a, b in spans_of(h, length)]) for r, h in zip(together, hits) if len(h)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*kept), _FOUND)], names=["anchor", "around", "inside"])

    by_array = texts_.repartition("anchor").mapInArrow(sort, "anchor long, around long, inside array<struct<low:int,high:int>>")
    twice = windows.groupBy("k1", "k2").agg(F.sum("n").alias("_n")).where("_n > 1").select("k1", "k2")
    # windows in a row are one span
    turn = F.row_number().over(Window.partitionBy("anchor", "around").orderBy("window"))
    by_hash = (
        windows.join(twice, ["k1", "k2"]).withColumn("_row", F.col("window") - turn).groupBy("anchor", "around", "_row")
        .agg(F.min("window").alias("low"), (F.max("window") + length).alias("high")).groupBy("anchor", "around")
        .agg(F.collect_list(F.struct("low", "high")).alias("inside"))
    )
    inside = by_array.unionByName(by_hash)
    found_in = mixed.join(inside, ["anchor", "around"]).select("doc_id", "mark", "low", F.explode("inside").alias("w"))
    spans = spans.unionByName(found_in.select("doc_id", "mark", (F.col("low") + F.col("w.low")).alias("low"), (F.col("low") + F.col("w.high")).alias("high")))
    doc = Window.partitionBy("doc_id", "mark").orderBy("low", "high")
    reach = F.max("high").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("low")).cast("int")).withColumn("_run", F.sum("_new").over(doc))
    whole = runs.groupBy("doc_id", "mark", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


_FOUND = (pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))


def _around(rows: DataFrame, length: int) -> DataFrame:
    """The texts that are asked for, or the hashes of all their windows where the anchor is crowded."""

    def cut(batch):
        out: dict[str, list] = {k: [] for k in ("anchor", "around", "n", "body", "window", "k1", "k2")}
        for text, asks in zip(batch.column("text").to_pylist(), batch.column("asks").to_pylist()):
            data = text.encode()
            for a in asks:
                body = data[a["low"]: a["high"] + a["span"]]
                own = (a["anchor"], a["around"], a["n"])
                if not a["crowded"]:
                    for k, v in zip(out, (*own, body, None, None, None)):
                        out[k].append(v)
                    continue
                t = np.frombuffer(body, np.uint8)
                one, two = (run_hashes(t, a["span"], s).view(np.int64).tolist() for s in (1, 2))
                for i, (x, y) in enumerate(zip(one, two)):
                    for k, v in zip(out, (*own, None, i, x, y)):
                        out[k].append(v)
        return out

    asks = F.transform("asks", lambda a: a.withField("span", F.lit(length)))
    return map_batches(rows.withColumn("asks", asks), cut, "anchor long, around long, n int, body binary, window int, k1 long, k2 long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``keep_text`` also the bytes that stay.

    A null text is empty. Repeated rows are documents of their own and repeat each other. Equality of anchors' surroundings
    and of crowded windows is that of 128 bits of hashes, all else is compared byte by byte.
    """
    docs = texts(docs).withColumn("mark", F.xxhash64("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    spans = materialised(repeated_spans(docs, length))

    def cut(batch):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, merged = text.encode(), sorted((s["low"], s["high"]) for s in own or ())
            kept, at = [], 0
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            for k, v in zip(out, (len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left)):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    columns = f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return map_batches(_with_docs(docs, spans, "left").select("doc_id", "text", "spans"), cut, columns)
