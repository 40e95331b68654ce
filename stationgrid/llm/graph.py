"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Vectors live in parts, by a hash of their id. Every step sends messages to the part that holds what they
ask about and joins them there: neighbours of neighbours are compared where a node's list comes together, and what is
better than a node's last neighbour is sent to that node. The graph starts from leaves of random
hyperplanes, in which all pairs of a bounded number of vectors are compared. Largest inner products become smallest distances by one
more component that gives all vectors the same length.

A query walks the graph from its own node: each round its best nodes that are not yet expanded give their neighbours, which are
scored where they live. The best of the walk are scored exactly at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import materialised
from stationgrid.llm.vectors import distinct_vectors, inner, ranked_results, valid_vectors

PART_NODES = 4096
MIN_PARTS = 12
#: Vectors that are compared with each other, and rows of one product of them.
LEAF_NODES = 8192
LEAF_ROWS = 1024


class Settings(NamedTuple):
    neighbours: int = 30
    trees: int = 8
    leaf: int = 3000
    iterations: int = 2
    sample: int = 16
    rounds: int = 3
    expand: int = 120
    keep: int = 60
    seed: int = 11


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def sent(target: np.ndarray, **arrays: np.ndarray) -> Iterator[dict]:
    """One message for each part in ``target``: the rows of the arrays that go there, as bytes."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield {"part": int(target[own[0]])} | {k: np.ascontiguousarray(a[own]).tobytes() for k, a in arrays.items()}


def table(rows: list[dict], names: tuple[str, ...]) -> pa.Table:
    schema = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in names)])
    return pa.Table.from_pylist(rows, schema=schema)


def ddl(names: tuple[str, ...]) -> str:
    return ", ".join(["part long", *(f"{n} binary" for n in names)])


def joined(t: pa.Table, name: str, dtype: str, width: int = 0) -> np.ndarray:
    flat = np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=dtype)
    return flat.reshape(-1, width) if width else flat


NODE = ("uid", "vec", "nbr", "sim")
PAIR = ("uid", "nbr", "sim")


def best_of(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` most similar distinct neighbours of each node, grouped by node, best first."""
    order = np.lexsort((-sim, nbr, node))
    n, b = node[order], nbr[order]
    order = order[np.concatenate([[True], (n[1:] != n[:-1]) | (b[1:] != b[:-1])])] if len(order) else order
    order = order[np.lexsort((nbr[order], -sim[order], node[order]))]
    n = node[order]
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, int)
    rank = np.arange(len(n)) - np.repeat(first, np.diff([*first, len(n)]))
    return order[rank < k]


def leaf_pairs(uid: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, similarity) of the ``k`` nearest of each vector within a leaf, in blocks of bounded size."""
    out = []
    for s in range(0, len(uid), LEAF_NODES):
        u, v = uid[s: s + LEAF_NODES], vec[s: s + LEAF_NODES]
        if len(u) < 2:
            continue
        m = min(k, len(u) - 1)
        for a in range(0, len(u), LEAF_ROWS):
            sims = v[a: a + LEAF_ROWS] @ v.T
            here = np.arange(len(sims))
            sims[here, here + a] = -np.inf
            at = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            out.append((np.repeat(u[a: a + LEAF_ROWS], m), u[at].ravel(), np.take_along_axis(sims, at, 1).ravel().astype(np.float32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


def local_join(owner: np.ndarray, member: np.ndarray, fresh: np.ndarray, vec: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of one owner's list, at least one of them fresh, that beat the last neighbour of the first."""
    order = np.argsort(owner, kind="stable")
    owner, member, fresh, vec, kth = owner[order], member[order], fresh[order], vec[order].astype(np.float32), kth[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
    out = []
    for a, b in zip(first, [*first[1:], len(owner)]):
        if b - a < 2:
            continue
        sims = vec[a:b] @ vec[a:b].T
        good = (sims > kth[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (member[a:b, None] != member[None, a:b])
        x, y = np.nonzero(good)
        if len(x):
            out.append((member[a + x], member[a + y], sims[x, y].astype(np.float32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


class NeighbourGraph:
    """The graph of ``base`` (uid, v of one dimension), built when made; ``nodes`` has one row for each part."""

    def __init__(self, base: DataFrame, dim: int, settings: Settings = Settings()):
        self.base, self.dim, self.s = base, dim, settings
        row = base.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
        self.count, self.longest = int(row["n"]), float(row["longest"] or 0.0)
        self.parts = max(MIN_PARTS, -(-self.count // PART_NODES))
        self.width = dim + 1
        self.nodes = materialised(self._placed())
        self.nodes = self._merged(self._leaves())
        for i in range(settings.iterations):
            self.nodes = self._merged(self._compared(i))

    def _join(self, nodes: DataFrame, messages: DataFrame, fn: Callable[[pa.Table, pa.Table], list[dict]], names: tuple[str, ...]) -> DataFrame:
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return table(fn(a, b), names)

        return nodes.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(run, ddl(names))

    def _placed(self) -> DataFrame:
        parts, longest, dim, k = self.parts, self.longest, self.dim, self.s.neighbours

        def place(batches):
            for batch in batches:
                uid = np.asarray(batch.column("uid"))
                v = np.asarray(batch.column("v").flatten()).reshape(-1, dim)
                more = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
                vec = np.concatenate([v, more[:, None]], axis=1) / max(longest, 1e-300) ** 0.5
                rows = [*sent(part_of(uid, parts), uid=uid, vec=vec.astype(np.float32))]
                yield from table(rows, ("uid", "vec")).to_batches()

        def gather(t: pa.Table) -> pa.Table:
            uid = joined(t, "uid", "<i8")
            none = np.full((len(uid), k), -1, np.int64)
            return table([{
                "part": t.column("part")[0].as_py(), "uid": uid.tobytes(), "vec": joined(t, "vec", "<f4").tobytes(),
                "nbr": none.tobytes(), "sim": np.full(none.shape, -np.inf, np.float32).tobytes(),
            }], NODE)

        return self.base.select("uid", "v").mapInArrow(place, ddl(("uid", "vec"))).groupBy("part").applyInArrow(gather, ddl(NODE))

    def _leaves(self) -> DataFrame:
        """Proposals from the leaves of ``trees`` sets of random hyperplanes through a centre."""
        s, width, parts = self.s, self.width, self.parts
        depth = max(0, round(np.log2(max(self.count, 1) / s.leaf)))
        planes = np.random.default_rng(s.seed).standard_normal((s.trees, depth, width)).astype(np.float32)

        def centre(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                v = joined(t, "vec", "<f4", width)
                yield pa.record_batch({"total": [v.sum(axis=0, dtype=np.float64).tolist()]})

        # one sum for each part
        sums = [r["total"] for r in self.nodes.mapInArrow(centre, "total array<double>").toLocalIterator()]
        middle = (np.sum(sums, axis=0) / max(self.count, 1)).astype(np.float32) if sums else np.zeros(width, np.float32)

        def spread(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                uid, v = joined(t, "uid", "<i8"), joined(t, "vec", "<f4", width)
                rows = []
                for tree in range(s.trees):
                    bits = (v - middle) @ planes[tree].T > 0
                    leaf = (tree << 40) + (bits * (1 << np.arange(depth, dtype=np.int64))).sum(axis=1, dtype=np.int64)
                    rows += sent(leaf, uid=uid, vec=v.astype(np.float16))
                yield from table(rows, ("uid", "vec")).to_batches()

        def compare(t: pa.Table) -> pa.Table:
            uid, v = joined(t, "uid", "<i8"), joined(t, "vec", "<f2", width).astype(np.float32)
            if len(uid) > LEAF_NODES:  # crowded: neighbours along one more direction stay together
                order = np.argsort(v @ np.random.default_rng(len(uid)).standard_normal(width), kind="stable")
                uid, v = uid[order], v[order]
            node, nbr, sim = leaf_pairs(uid, v, s.neighbours)
            return table([*sent(part_of(node, parts), uid=node, nbr=nbr, sim=sim)], PAIR)

        return self.nodes.mapInArrow(spread, ddl(("uid", "vec"))).groupBy("part").applyInArrow(compare, ddl(PAIR))

    def _merged(self, found: DataFrame) -> DataFrame:
        """The graph with the better of its own and the found neighbours."""
        k = self.s.neighbours

        def merge(a: pa.Table, b: pa.Table) -> list[dict]:
            if not a.num_rows:
                return []
            uid, nbr, sim = joined(a, "uid", "<i8"), joined(a, "nbr", "<i8", k), joined(a, "sim", "<f4", k)
            own = nbr.ravel() >= 0
            node = np.concatenate([np.repeat(uid, k)[own], joined(b, "uid", "<i8")])
            other = np.concatenate([nbr.ravel()[own], joined(b, "nbr", "<i8")])
            near = np.concatenate([sim.ravel()[own], joined(b, "sim", "<f4")])
            keep = best_of(node, other, near, k)
            order = np.argsort(uid, kind="stable")
            at = order[np.searchsorted(uid[order], node[keep])]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
            rank = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
            nbr, sim = np.full((len(uid), k), -1, np.int64), np.full((len(uid), k), -np.inf, np.float32)
            nbr[at, rank], sim[at, rank] = other[keep], near[keep]
            return [{"part": a.column("part")[0].as_py(), "uid": uid.tobytes(), "vec": a.column("vec")[0].as_py(), "nbr": nbr.tobytes(), "sim": sim.tobytes()}]

        return materialised(self._join(self.nodes, found, merge, NODE))

    def _reversed(self) -> DataFrame:
        k, parts = self.s.neighbours, self.parts

        def turn(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                uid, nbr = joined(t, "uid", "<i8"), joined(t, "nbr", "<i8", k)
                own = nbr.ravel() >= 0
                to, back = nbr.ravel()[own], np.repeat(uid, k)[own]
                yield from table([*sent(part_of(to, parts), uid=to, nbr=back)], ("uid", "nbr")).to_batches()

        return self.nodes.mapInArrow(turn, ddl(("uid", "nbr")))

    def _compared(self, iteration: int) -> DataFrame:
        """Neighbours of neighbours: members of the sampled lists of every node, compared with each other."""
        s, k, width, parts = self.s, self.s.neighbours, self.width, self.parts

        def lists(a: pa.Table, b: pa.Table) -> list[dict]:
            if not a.num_rows:
                return []
            uid, nbr = joined(a, "uid", "<i8"), joined(a, "nbr", "<i8", k)
            own = nbr.ravel() >= 0
            rows = []
            for owner, member in ((np.repeat(uid, k)[own], nbr.ravel()[own]), (joined(b, "uid", "<i8"), joined(b, "nbr", "<i8"))):
                # a sample of each list, by a hash that changes from iteration to iteration
                mark = ((owner * 31 + member + iteration * 7919).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.float32)
                keep = best_of(owner, member, mark, s.sample)
                rows.append((owner[keep], member[keep]))
            owner, member = (np.concatenate(x) for x in zip(*rows))
            pair = np.unique(np.stack([owner, member]), axis=1)
            return [*sent(part_of(pair[1], parts), owner=pair[0], uid=pair[1])]

        def answer(a: pa.Table, b: pa.Table) -> list[dict]:
            if not a.num_rows or not b.num_rows:
                return []
            uid, vec, sim = joined(a, "uid", "<i8"), joined(a, "vec", "<f4", width), joined(a, "sim", "<f4", k)
            order = np.argsort(uid, kind="stable")
            owner, member = joined(b, "owner", "<i8"), joined(b, "uid", "<i8")
            at = order[np.searchsorted(uid[order], member)]
            return [*sent(part_of(owner, parts), owner=owner, uid=member, vec=vec[at].astype(np.float16), kth=sim[at, -1])]

        def compare(t: pa.Table) -> pa.Table:
            owner, member, vec, kth = joined(t, "owner", "<i8"), joined(t, "uid", "<i8"), joined(t, "vec", "<f2", width), joined(t, "kth", "<f4")
            node, nbr, sim = local_join(owner, member, np.ones(len(owner), bool), vec, kth)
            keep = best_of(node, nbr, sim, k)
            node, nbr, sim = node[keep], nbr[keep], sim[keep]
            return table([*sent(part_of(node, parts), uid=node, nbr=nbr, sim=sim)], PAIR)

        asked = self._join(self.nodes, self._reversed(), lists, ("owner", "uid"))
        told = self._join(self.nodes, asked, answer, ("owner", "uid", "vec", "kth"))
        return told.groupBy("part").applyInArrow(compare, ddl(PAIR))

    def search(self, queries: DataFrame) -> DataFrame:
        """query (uid of a base vector), uid: the best found for each of ``queries`` (uid), its own node included."""
        s, dim, width, parts = self.s, self.dim, self.width, self.parts
        back = materialised(self._join(self.nodes, self._reversed(), self._adjacent(), ("uid", "vec", "adj", "many")))

        def starts(batches):
            for batch in batches:
                q = np.asarray(batch.column("uid"))
                yield from table([*sent(part_of(q, parts), query=q)], ("query",)).to_batches()

        def begin(a: pa.Table, b: pa.Table) -> list[dict]:
            if not a.num_rows or not b.num_rows:
                return []
            uid, vec, query = joined(a, "uid", "<i8"), joined(a, "vec", "<f4", width), np.unique(joined(b, "query", "<i8"))
            order = np.argsort(uid, kind="stable")
            at = order[np.searchsorted(uid[order], query)]
            v = vec[at].copy()
            v[:, dim] = 0  # the query has no share in the added component: what counts is the inner product
            return [{"part": a.column("part")[0].as_py(), "query": query.tobytes(), "vec": v.tobytes(), "seen": b"", "of": b"", "score": b"", "done": b""}]

        # the state of a query lives with its own node
        names = ("query", "vec", "seen", "of", "score", "done")
        state = materialised(self._join(self.nodes, queries.select("uid").mapInArrow(starts, ddl(("query",))), begin, names))
        for r in range(s.rounds):
            def ask(batches, r=r):
                for batch in batches:
                    t = pa.Table.from_batches([batch])
                    query = joined(t, "query", "<i8")
                    of, node, score, done = joined(t, "of", "<i8"), joined(t, "seen", "<i8"), joined(t, "score", "<f4"), joined(t, "done", "?")
                    if r == 0:
                        of = node = query
                    else:
                        open_ = np.flatnonzero(~done)
                        keep = open_[best_of(of[open_], node[open_], score[open_], s.expand)]
                        of, node = of[keep], node[keep]
                    yield from table([*sent(part_of(node, parts), query=of, uid=node)], ("query", "uid")).to_batches()

            def expand(a: pa.Table, b: pa.Table) -> list[dict]:
                if not a.num_rows or not b.num_rows:
                    return []
                uid, adj, many = joined(a, "uid", "<i8"), joined(a, "adj", "<i8"), joined(a, "many", "<i8")
                begins = many.cumsum() - many
                order = np.argsort(uid, kind="stable")
                query, node = joined(b, "query", "<i8"), joined(b, "uid", "<i8")
                at = order[np.searchsorted(uid[order], node)]
                times = many[at]
                where = np.repeat(begins[at], times) + np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                pair = np.unique(np.stack([np.repeat(query, times), adj[where]]), axis=1)
                return [*sent(part_of(pair[0], parts), query=pair[0], uid=pair[1])]

            def fresh(a: pa.Table, b: pa.Table) -> list[dict]:
                """At the query's home: nodes that it has not seen yet, with its vector, to where they live."""
                if not a.num_rows or not b.num_rows:
                    return []
                query, vec = joined(a, "query", "<i8"), joined(a, "vec", "<f4", width)
                old = np.stack([joined(a, "of", "<i8"), joined(a, "seen", "<i8")])
                new = np.unique(np.stack([joined(b, "query", "<i8"), joined(b, "uid", "<i8")]), axis=1)
                both, first, times = np.unique(np.concatenate([old, new], axis=1), axis=1, return_index=True, return_counts=True)
                new = both[:, (times == 1) & (first >= old.shape[1])]
                rows = []
                for message in sent(part_of(new[1], parts), query=new[0], uid=new[1]):
                    asked = np.unique(np.frombuffer(message["query"], "<i8"))
                    rows.append(message | {"who": asked.tobytes(), "vec": vec[np.searchsorted(query, asked)].tobytes()})
                return rows

            def score(a: pa.Table, b: pa.Table) -> list[dict]:
                if not a.num_rows or not b.num_rows:
                    return []
                uid, vec = joined(a, "uid", "<i8"), joined(a, "vec", "<f4", width)
                order = np.argsort(uid, kind="stable")
                rows = []
                for m in b.to_pylist():
                    query, node = np.frombuffer(m["query"], "<i8"), np.frombuffer(m["uid"], "<i8")
                    who, qv = np.frombuffer(m["who"], "<i8"), np.frombuffer(m["vec"], "<f4").reshape(-1, width)
                    at = order[np.searchsorted(uid[order], node)]
                    sims = np.einsum("ij,ij->i", qv[np.searchsorted(who, query)], vec[at])
                    rows += sent(part_of(query, parts), query=query, uid=node, score=sims.astype(np.float32))
                return rows

            def absorb(a: pa.Table, b: pa.Table) -> list[dict]:
                if not a.num_rows:
                    return []
                of, node, points, done = joined(a, "of", "<i8"), joined(a, "seen", "<i8"), joined(a, "score", "<f4"), joined(a, "done", "?").copy()
                open_ = np.flatnonzero(~done)
                done[open_[best_of(of[open_], node[open_], points[open_], s.expand)]] = True  # those that were asked
                of = np.concatenate([of, joined(b, "query", "<i8")])
                node = np.concatenate([node, joined(b, "uid", "<i8")])
                points = np.concatenate([points, joined(b, "score", "<f4")])
                done = np.concatenate([done, np.zeros(len(of) - len(done), bool)])
                return [{
                    "part": a.column("part")[0].as_py(), "query": a.column("query")[0].as_py(), "vec": a.column("vec")[0].as_py(),
                    "of": of.tobytes(), "seen": node.tobytes(), "score": points.tobytes(), "done": done.tobytes(),
                }]

            near = self._join(back, state.mapInArrow(ask, ddl(("query", "uid"))), expand, ("query", "uid"))
            wanted = self._join(state, near, fresh, ("query", "uid", "who", "vec"))
            scored = self._join(back, wanted, score, ("query", "uid", "score"))
            state = materialised(self._join(state, scored, absorb, names))

        def best(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                of, node, points = joined(t, "of", "<i8"), joined(t, "seen", "<i8"), joined(t, "score", "<f4")
                keep = best_of(of, node, points, s.keep)
                query = joined(t, "query", "<i8")
                yield pa.record_batch({"query": np.concatenate([of[keep], query]), "uid": np.concatenate([node[keep], query])})

        return state.mapInArrow(best, "query long, uid long").distinct()

    def _adjacent(self) -> Callable[[pa.Table, pa.Table], list[dict]]:
        """Both ends of every edge know each other when the graph is walked."""
        k = self.s.neighbours

        def gather(a: pa.Table, b: pa.Table) -> list[dict]:
            if not a.num_rows:
                return []
            uid, nbr = joined(a, "uid", "<i8"), joined(a, "nbr", "<i8", k)
            own = nbr.ravel() >= 0
            node = np.concatenate([np.repeat(uid, k)[own], joined(b, "uid", "<i8")])
            other = np.concatenate([nbr.ravel()[own], joined(b, "nbr", "<i8")])
            node, other = np.unique(np.stack([node, other]), axis=1)
            order = np.argsort(uid, kind="stable")
            many = np.zeros(len(uid), np.int64)
            at = order[np.searchsorted(uid[order], node)]
            np.add.at(many, at, 1)
            walk = np.argsort(at, kind="stable")
            return [{"part": a.column("part")[0].as_py(), "uid": uid.tobytes(), "vec": a.column("vec")[0].as_py(), "adj": other[walk].tobytes(), "many": many.tobytes()}]

        return gather


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found, ties to smaller ids.

    Queries are the rows whose vec_id is divisible by ``every``; they search the rows of their own dimension. Null and zero vectors and those
    with null or non-finite components take no part; an empty table gives no rows. Equal vectors are one node.
    """
    rows = materialised(valid_vectors(vectors, vector, zero=False))
    out = None
    for (dim,) in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # dimensions, not rows
        own = rows.where(F.size("v") == dim)
        base = materialised(distinct_vectors(own, k + 1))
        asked = own.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(base.select("v", "uid"), "v").select("query_id", "uid", F.col("v").alias("q"))
        asked = materialised(asked)
        if asked.isEmpty():
            continue
        found = NeighbourGraph(base, dim, settings).search(asked.select("uid").distinct())
        pairs = found.join(base, "uid").select("query", "ids", "v").join(asked.withColumnRenamed("uid", "query"), "query")
        part = ranked_results(pairs.select("query_id", "ids", inner("q", "v", "double").alias("score")), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out
