"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most ``2 h`` bits have a variant in common that differs from each in at most
``h`` bits. So every fingerprint emits all its variants within ``h`` bits, and equal variants
meet in a shuffle. All that meet in one variant are within ``2 h`` bits of each other, so a star of
links per variant loses no connection and no pairs are listed.

The variants are dealt by their first bits. Those of one fingerprint that go to the same place
differ in the rest only, so the fingerprint itself is sent there once instead of all of them (79 rows of 16 bytes
instead of 2,081 at 64 bits and a radius of 4), and the variants are made where they meet. They are
sorted as numbers whose low bits hold the fingerprint's index. A place that gets crowded is split by further bits.

``near_duplicates`` links texts by the Jaccard similarity of whole shingle sets. The fingerprints that ball hashing links propose the first
pairs, and their shingle sets decide. SimHash alone would miss similar texts whose fingerprints are farther apart, so an exact join follows
that judges what is not linked yet: similar sets share one of their first
shingles in any common order, so pairs meet there, rarest first; every pair that could pass is judged unless its
two texts are linked already.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import _arrow_types, _batch, map_batches, materialised, texts
from stationgrid.llm.components import connected_components

SEED = 42
#: Variants that a task holds at a time; a crowded place is split until it needs no more.
VARIANTS = 1 << 22
#: Ids that may be broadcast instead of shuffling the texts: 16 MB of numbers.
BROADCAST_IDS = 2_000_000
#: Entries that a meeting place, and a partition of them, gets on average.
PLACE_ENTRIES = 4_000_000
#: Counters of shingles by hash; they only order shingles by how common they are.
COUNTERS, COUNTER_BLOCKS = 1 << 20, 16
#: First shingles that a partition gets on average.
FIRST_SHINGLES = 1_000_000
#: Rows of groups that a task looks at in one go; more if one group has more.
GROUPED_ROWS = 50_000
#: Factor by which the members that are compared with their whole group grow from round to round.
HUB_GROWTH = 8
#: Pairs of unlinked groups, counted in each group, that are looked at in one round.
LAST_ROUND = 1_000_000
#: Contracted links, 16 bytes each, that one task may label; more are contracted by joins until so many are left.
FINISH_LINKS = 1 << 20


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.fromiter(map(len, found), dtype=np.int64, count=len(found)).cumsum() + np.arange(len(found))
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    last = ends[words - 1:].tolist() or [len(joined)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; added up in bytes, 255 hashes at a time."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 255 * 256):
        part = hashes[k: k + 255 * 256]
        blocks = -(-len(part) // 255)
        padded = np.zeros(blocks * 255, dtype="<u8")
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(blocks, 255, 64)
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; no hashes: 0."""
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=64)
def masks(bits: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of ``bits`` bits."""
    out = [0]
    for n in range(1, min(most, bits) + 1):
        out += [sum(1 << b for b in chosen) for chosen in combinations(range(bits), n)]
    return np.array(out, dtype=np.uint64)


def ball(bits: int, most: int) -> int:
    return sum(comb(bits, n) for n in range(most + 1)) if bits > 0 else 1


def copies(fps: np.ndarray, bits: int, half: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, positions of the fingerprints that have variants there)."""
    m = masks(prefix, half)
    own = (fps >> np.uint64(bits - prefix)).astype(np.uint64)
    return (own[:, None] ^ m[None, :]).ravel().astype(np.int64), np.repeat(np.arange(len(fps)), len(m))


def links(fps: np.ndarray, place: int, bits: int, half: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints (each within ``half`` bits of ``place`` in the first ``prefix`` bits)."""
    away = np.bitwise_count((fps >> np.uint64(bits - prefix)) ^ np.uint64(place)).astype(np.int64) if prefix else np.zeros(len(fps), np.int64)
    rest = bits - prefix
    none = np.zeros(0, np.int64)
    if len(fps) < 2:
        return none, none
    many = sum(int((away == d).sum()) * ball(rest, half - d) for d in range(half + 1))
    if rest > 0 and (many > VARIANTS or len(fps) > (1 << min(prefix + 64 - bits, 40))):
        step, found = min(4, rest), []
        for more in range(1 << step):
            deeper, at = prefix + step, (place << step) | more
            near = np.flatnonzero(np.bitwise_count((fps >> np.uint64(bits - deeper)) ^ np.uint64(at)) <= half)
            a, b = links(fps[near], at, bits, half, deeper)
            found.append((near[a], near[b]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    width = np.uint64(max(64 - rest, 0))
    low = np.uint64((1 << rest) - 1)
    parts = []
    for d in range(half + 1):
        which = np.flatnonzero(away == d)
        if len(which):
            variants = (fps[which] & low)[:, None] ^ masks(rest, half - d)[None, :]
            parts.append(((variants << width) | which.astype(np.uint64)[:, None]).ravel() if rest else which.astype(np.uint64))
    keys = np.concatenate(parts)
    keys.sort()
    variant = keys >> width if rest else np.zeros(len(keys), np.uint64)
    index = (keys & np.uint64((1 << int(width)) - 1)).astype(np.int64) if rest else keys.astype(np.int64)
    same = variant[1:] == variant[:-1]
    if not same.any():
        return none, none
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    star = index[first][np.repeat(np.arange(len(first)), np.diff([*first, len(keys)]))]
    met = np.concatenate([[False], same])
    # next to each other, and the first of the variant with each
    a, b = np.concatenate([index[:-1][same], star[met]]), np.concatenate([index[1:][same], index[met]])
    pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
    a, b = pair // len(fps), pair % len(fps)
    return a[a != b], b[a != b]


def forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Verified links without cycles, nearest first: they connect what all of the links connect."""
    apart = np.bitwise_count(fps[a] ^ fps[b])
    order = np.argsort(apart, kind="stable")
    order = order[apart[order] <= radius]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def ball_links(points: DataFrame, bits: int, radius: int, prefix: int) -> DataFrame:
    """Distinct links (a, b), a < b, of ``points`` (id long, fps array<long>: one or more independent fingerprints).

    ``points`` are distinct; at least ``prefix`` bits name a meeting place, more where places would hold too much.
    """
    half = radius // 2
    views = int(points.select(F.max(F.size("fps"))).first()[0] or 1)
    count = points.count()
    while prefix < bits and count * ball(prefix, half) > PLACE_ENTRIES << prefix:
        prefix += 1
    places = 1 << prefix
    partitions = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * views * ball(prefix, half) // PLACE_ENTRIES))

    def send(batch):
        ids = np.asarray(batch.column("id"))
        fps = np.array(batch.column("fps").to_pylist(), dtype=np.int64).reshape(len(ids), -1).view(np.uint64)
        out = []
        for v in range(fps.shape[1]):
            where, which = copies(fps[:, v], bits, half, prefix)
            order = np.argsort(where, kind="stable")
            where, which = where[order], which[order]
            cuts = np.flatnonzero(np.diff(where)) + 1
            at = where[np.concatenate([[0], cuts])].tolist() if len(where) else []
            out += [(v * places + p, own) for p, own in zip(at, np.split(which, cuts))]
        return {
            "place": [p for p, _ in out],
            "fps": [fps[own, p // places].tobytes() for p, own in out], "ids": [ids[own].tobytes() for _, own in out],
        }

    sent = map_batches(points.select("id", "fps"), send, "place long, fps binary, ids binary").repartition(partitions, "place")

    def meet(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for p, f, i in zip(batch.column("place").to_pylist(), batch.column("fps").to_pylist(), batch.column("ids").to_pylist()):
                held.setdefault(p, []).append((f, i))
        for p in sorted(held):
            parts = held.pop(p)
            fps = np.frombuffer(b"".join(f for f, _ in parts), dtype=np.uint64)
            ids = np.frombuffer(b"".join(i for _, i in parts), dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            fps, ids = fps[order], ids[order]
            a, b = links(fps, p % places, bits, half, prefix)
            kept = forest(fps, a, b, radius)
            if kept:
                x, y = ids[np.array(kept)].T
                yield pa.record_batch({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return sent.mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed number)."""
    docs = texts(docs)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        fps = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return map_batches(docs, run, f"doc_id {key}, fp long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, prefix: int = 12) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id that links reach) of every row.

    Null and empty texts have the fingerprint zero and link like any other; repeated rows each give a
    row; a null doc_id gets its component's smallest id, null if it has no other; an empty table gives no rows.
    """
    fps = materialised(fingerprints(docs, words))
    groups = materialised(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = ball_links(groups.select(F.col("fp").alias("id"), F.array("fp").alias("fps")), 64, radius, prefix)
    roots = connected_components(edges)
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- similar texts: first shingles propose, the shingle sets decide --------------------------------------


def class_of(shingles: np.ndarray) -> int:
    """One number for each shingle set (sorted)."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))))


def first_shingles(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, as many as a similar set must share one of."""
    order = np.lexsort((shingles, counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return shingles[order[: len(shingles) - ceil(similarity * len(shingles) - 1e-9) + 1]]


def hub_pairs(key: np.ndarray, ids: np.ndarray, size: np.ndarray, pos: np.ndarray, share: np.ndarray, root: np.ndarray, similarity: float, low: int, high: int):
    """Pairs of the members ``low`` to ``high`` of each key's group with all members after them.

    Left out are pairs with one root and those whose shared shingles, at best all from this one on, are too few.
    """
    order = np.lexsort((ids, -share, key))
    key, ids, size, pos, root = (x[order] for x in (key, ids, size, pos, root))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.repeat(starts, np.diff([*starts, len(key)]))
    rank = np.arange(len(key)) - first
    for r in range(low, high):
        x = np.flatnonzero(rank > r)
        if not len(x):
            return
        y = first[x] + r
        need = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6)
        fits = (root[x] != root[y]) & (np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need)
        a, b = ids[x[fits]], ids[y[fits]]
        if len(a):
            yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def simhash_pairs(docs: DataFrame, words: int, radius: int = 4, prefix: int = 12) -> DataFrame:
    """Pairs (a, b), a < b, of shingle sets whose fingerprints link: what connects all sets that links of at most ``radius`` bits connect."""

    def run(batch):
        found = [h for h in (shingle_hashes(t, words) for t in batch.column("text").to_pylist()) if len(h)]
        return {"id": [class_of(np.unique(h)) for h in found], "fp": np.array([fingerprint(h) for h in found], dtype=np.uint64).view(np.int64)}

    fps = materialised(map_batches(docs, run, "id long, fp long").groupBy("id").agg(F.min("fp").alias("fp")))
    groups = materialised(fps.groupBy("fp").agg(F.min("id").alias("least")))
    edges = ball_links(groups.select(F.col("fp").alias("id"), F.array("fp").alias("fps")), 64, radius, prefix)
    apart = edges.join(groups.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(groups.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    equal = fps.join(groups, "fp").where("id <> least").select(F.col("least").alias("x"), F.col("id").alias("y"))
    return apart.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, component_id: documents linked by a Jaccard similarity of at least ``similarity`` of their shingle sets.

    Texts without words are no near-duplicates of anything. Equal shingle sets are one class with the smallest id. SimHash proposes the first
    links, which the shingle sets confirm; the rest is exact: all
    pairs that share one of their first shingles are judged, but for pairs that other links connect. In a large group a growing number of
    members, those with most shared shingles first, is compared with all others, and links contract the groups in between.
    """
    docs = texts(docs)
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, id long, n int, block int, counts binary"
    types = _arrow_types(schema)

    def sketch(batches):
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            none = [None] * len(sets)
            yield _batch({"doc_id": batch.column("doc_id"), "id": [class_of(s) if len(s) else None for s in sets], "n": [len(s) for s in sets], "block": none, "counts": none}, types)
        if counts.any():
            none = [None] * COUNTER_BLOCKS
            parts = [c.astype("<u4").tobytes() for c in np.split(np.minimum(counts, (1 << 32) - 1), COUNTER_BLOCKS)]
            yield _batch({"doc_id": none, "id": none, "n": none, "block": list(range(COUNTER_BLOCKS)), "counts": parts}, types)

    def added(t):
        import pyarrow as pa

        total = sum((np.frombuffer(c, "<u4").astype(np.int64) for c in t.column("counts").to_pylist()), np.zeros(COUNTERS // COUNTER_BLOCKS, np.int64))
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "counts": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})

    both = materialised(docs.mapInArrow(sketch, schema))
    sketched = both.where("block IS NULL").select("doc_id", "id", "n")
    members = sketched.where("id IS NOT NULL")
    classes = materialised(members.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("n").alias("n")))
    counts = np.zeros(COUNTERS, dtype=np.uint32)
    for r in both.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(added, "block int, counts binary").collect():  # one row for each block
        counts.reshape(COUNTER_BLOCKS, -1)[r["block"]] = np.frombuffer(r["counts"], "<u4")
    common = spark.sparkContext.broadcast(counts)
    total = int(classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * similarity) + 1)).first()[0] or 0)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FIRST_SHINGLES))
    places = 2 * partitions

    def send(batch):
        sets = [s for s in (np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()) if len(s)]
        if not sets:
            return None
        firsts = [first_shingles(s, common.value, similarity) for s in sets]
        many = [len(f) for f in firsts]
        token = np.concatenate(firsts)
        ids, size = np.repeat([class_of(s) for s in sets], many).astype("<i8"), np.repeat([len(s) for s in sets], many).astype("<i4")
        # a later place in the order only tightens a bound, so it may be cut off
        pos = np.minimum(np.concatenate([np.arange(m) for m in many]), 65535).astype("<u2")
        place = (token % np.uint64(places)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        own = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
        token = (token >> np.uint64(32)).astype("<u4")
        return {"place": [int(place[o[0]]) for o in own]} | {name: [x[o].tobytes() for o in own] for name, x in (("token", token), ("ids", ids), ("size", size), ("pos", pos))}

    def meet(batches):
        import pyarrow as pa

        held = [r for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        token, ids, size, pos = (np.frombuffer(b"".join(r[name] for r in held), kind) for name, kind in (("token", "<u4"), ("ids", "<i8"), ("size", "<i4"), ("pos", "<u2")))
        at = (np.repeat([r["place"] for r in held], [len(r["token"]) // 4 for r in held]).astype(np.int64) << 32) | token.astype(np.int64)
        order = np.lexsort((pos, ids, at))
        order = order[np.concatenate([[True], (at[order][1:] != at[order][:-1]) | (ids[order][1:] != ids[order][:-1])])]
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        many = np.diff([*starts, len(at)])
        many = np.repeat(many, many)
        kept = many > 1
        for o, a, m in zip(*(np.array_split(x[kept], max(1, int(kept.sum()) // 50_000)) for x in (order, at, many))):
            yield pa.record_batch({"token": a, "id": ids[o], "n": size[o], "pos": pos[o].astype(np.int32), "m": m.astype(np.int64)})

    # texts of one document of each class
    extra = materialised(members.select("doc_id").where("doc_id IS NOT NULL").distinct().join(classes.select(F.col("least").alias("doc_id")), "doc_id", "left_anti"))
    one = docs.join(F.broadcast(extra) if extra.count() <= BROADCAST_IDS else extra, "doc_id", "left_anti")
    sent = map_batches(one, send, "place long, token binary, ids binary, size binary, pos binary").repartition(partitions, "place")
    shared = materialised(sent.mapInArrow(meet, "token long, id long, n int, pos int, m long"))
    often = shared.groupBy("id").agg(F.count("*").alias("_often"))
    groups = materialised(shared.join(often, "id").withColumn("share", F.col("_often") / (F.col("n") - F.ceil(F.col("n") * similarity) + 1)).drop("_often"))
    common.destroy()  # the groups are written; nothing reads the counts again
    largest = int(groups.agg(F.max("m")).first()[0] or 0)

    def shingles(batch):
        sets = [s for s in (np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()) if len(s)]
        return {"id": [class_of(s) for s in sets], "set": [s.view(np.int64) for s in sets]}

    def judged_alike(pairs: DataFrame) -> DataFrame:
        asked = materialised(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes.select("id", F.col("least").alias("doc_id")), "id"))
        ids = asked.select("doc_id").distinct()
        # texts of the proposed classes only; a few ids spare the shuffle of the texts
        found = docs.join(F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
        sets = materialised(map_batches(found, shingles, "id long, set array<long>").join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.max("set").alias("set")))
        both = F.size(F.array_intersect("_a", "_b"))
        return materialised(
            pairs.join(sets.withColumnsRenamed({"id": "a", "set": "_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "_b"}), "b")
            .where(both >= similarity * (F.size("_a") + F.size("_b") - both) - 1e-9).select("a", "b")
        )

    def proposed(rows: DataFrame, low: int, high: int) -> DataFrame:
        names = ("token", "id", "n", "pos", "share", "root")

        def run(batches):
            import pyarrow as pa

            def pairs_in(parts):
                columns = [np.concatenate([p[k] for p in parts]) for k in range(len(names))]
                for pair in hub_pairs(*columns, similarity, low, high):
                    yield pa.record_batch({"a": pair[0], "b": pair[1]})

            held, rows_held, enough = [], 0, GROUPED_ROWS
            for batch in batches:
                held.append([np.asarray(batch.column(name)) for name in names])
                rows_held += batch.num_rows
                if rows_held >= enough:
                    held = [[np.concatenate(x) for x in zip(*held)]]
                    cut = int(np.searchsorted(held[0][0], held[0][0][-1]))  # the last group may go on
                    if cut:
                        yield from pairs_in([[x[:cut] for x in held[0]]])
                        held = [[x[cut:] for x in held[0]]]
                    rows_held -= cut
                    enough = max(GROUPED_ROWS, 2 * rows_held)
            if rows_held:
                yield from pairs_in(held)

        return rows.select("token", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "share", "root").repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").distinct()

    alike = judged = None
    roots = spark.createDataFrame([], "id long, root long")
    pairs = materialised(simhash_pairs(one, words))
    if not pairs.isEmpty():
        judged, found = pairs, judged_alike(pairs)
        if not found.isEmpty():
            alike, roots = found, materialised(connected_components(found, FINISH_LINKS).withColumnRenamed("node", "id"))
    low, high = 0, 1
    while low < largest - 1:
        rows = groups.where(F.col("m") > low + 1).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        if low:
            # groups that links connect already are done; what little is left needs no further rounds
            left = rows.groupBy("token").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.max("m").alias("_m")).where("_r <> _s")
            pairs_left = left.agg(F.sum(F.col("_m") * F.col("_m") / 2)).first()[0]
            if not pairs_left:
                break
            if pairs_left <= LAST_ROUND:
                high = largest
        pairs = proposed(rows, low, high)
        pairs = materialised(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            judged = pairs if judged is None else judged.unionByName(pairs)
            found = judged_alike(pairs)
            if not found.isEmpty():
                alike = found if alike is None else alike.unionByName(found)
                roots = materialised(connected_components(alike, FINISH_LINKS).withColumnRenamed("node", "id"))
        low, high = high, high * HUB_GROWTH
    rooted = classes.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    return sketched.join(named, "id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """All columns of the rows that are the first of their group; a repeated row of the same id goes too, a null id stays."""
    found = near_duplicates(docs, similarity, words).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti")
    return kept.select(*docs.columns)
