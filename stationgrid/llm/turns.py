"""Repair of the order of turns in conversations by the cheapest edits.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles. Rows are kept, get another role, go, or empty ones are put in
between, each at a price; what is cheapest is a shortest path through four states. All of the search works on
one byte per row:

* Rows are dealt by ranges of (conversation, turn), so that a long conversation lies in many chunks, one per partition it reaches into.
* Going backwards through a chunk turns the costs of the four states behind it into those before it. A conversation within
  one partition starts from the known costs of its end. Chunks of longer ones all start at once from that guess, and fix-up
  passes start them again from what the chunk behind has found, until these costs differ only by a constant from some that
  the chunk started from before: then its decisions are the same, and its costs differ by the constant.
* The stitched costs say at each row which edits are still cheapest; the least of them by ASCII are followed from
  the start. What leads from each of the states in front of a chunk to one behind it is found along with the costs, so chunks are traced at once, too.

Only vectors of four costs and four states per chunk come to the driver, and there are at most two chunks per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import _arrow_types, _batch, join_keys, map_batches, materialised, small_batches, written

#: Prices of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after s, after u, after a. ``_NEXT`` is where a user or assistant row leads, which its state prescribes.
_NEXT = (2, 2, 3, 2)
_PUT = ("user", "user", "assistant", "user")
_OTHER = 3  # initials: s, u, a, any other
#: Codes of rows: 0 must go; 1 + initial + 4 if truncated.
_GONE = 0


@lru_cache(maxsize=None)
def _before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs of the states before a row, less their least, and that least."""
    costs = [DELETE + c for c in after]
    if code != _GONE:
        initial, extra = (code - 1) % 4, TRUNCATED * ((code - 1) // 4)
        for state, next_state in enumerate(_NEXT):
            kept = 1 if (initial, state) == (0, 0) else next_state if initial == next_state - 1 else None
            costs[state] = min(costs[state], REROLE + extra + after[next_state], *([] if kept is None else [extra + after[kept]]))
    costs = _with_inserts(costs)
    least = min(costs)
    return tuple(c - least for c in costs), least


def _with_inserts(costs: list[int]) -> list[int]:
    return [min(costs[s], INSERT + costs[_NEXT[s]], 2 * INSERT + costs[_NEXT[_NEXT[s]]]) for s in range(4)]


#: Costs behind the last row: what is missing is put in.
END = tuple(_with_inserts([0, 10 * INSERT, 10 * INSERT, 0]))


@lru_cache(maxsize=None)
def _step(code: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """The least of the cheapest edits by ASCII from ``state`` through a row: letters, state behind it, price."""
    costs, least = _before(code, after)
    edits, price = "", 0
    initial, extra = (code - 1) % 4, TRUNCATED * ((code - 1) // 4)
    while True:
        left = costs[state] + least
        if DELETE + after[state] == left:
            return edits + "D", state, price + DELETE
        if INSERT + costs[_NEXT[state]] + least == left:
            edits, state, price = edits + "I", _NEXT[state], price + INSERT
            continue
        kept = 1 if (initial, state) == (0, 0) else _NEXT[state] if initial == _NEXT[state] - 1 else None
        if kept is not None and extra + after[kept] == left:
            return edits + "K", kept, price + extra
        return edits + "R", _NEXT[state], price + REROLE + extra


def _backward(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs behind each row, less their least, and those before the first row at the end of the list reversed."""
    out = [after]
    for code in reversed(codes):
        out.append(_before(code, out[-1])[0])
    return out[::-1]


def _trace(codes: bytes, costs: list[tuple[int, ...]], state: int) -> tuple[str, int, int]:
    edits, price = [], 0
    for code, after in zip(codes, costs[1:], strict=True):
        letters, state, more = _step(code, after, state)
        edits.append(letters)
        price += more
    return "".join(edits), state, price


def _finish(state: int) -> str:
    """What is put in behind the last row."""
    return {1: "II", 2: "I"}.get(state, "")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by a hash of conversation and turn; rows that are dropped are not present."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("_kind"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), times.alias("_time")).drop("_time")


def _same(rows: DataFrame) -> Column:
    """128 bits of conversation, role and text: equal for rows that repeat each other; also orders the rows of one turn."""
    parts = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text")
    return F.substring(F.unhex(F.sha2(parts, 256)), 1, 16)


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, same, present, initial, blank, cut, first (turn of the first row that says the same, where several do)."""
    end = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    narrow = materialised(rows.select(
        "conv_id", "turn", _same(rows).alias("same"), "present",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(_OTHER).cast("byte").alias("initial"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    ))
    # a struct, as nulls count as the least turn
    repeats = narrow.where("present").groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    found = join_keys(narrow, repeats, ["same"], narrow.count(), "left")
    return found.withColumn("later", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).drop("first")


_STATS = "n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
_FOUND = "conv_id long, part int, place int, " + _STATS + ", first_turn long, last_turn long, first_initial int, last_initial int, cost long, audit string, codes binary"


class _Chunk:
    """The present rows of a conversation in one partition."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.n = conv_id, bytearray(), 0
        self.low = self.high = self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None

    def add(self, turn: list, same: list, initial: list, blank: list, cut: list, later: list) -> None:
        for t, s, i, b, c, seen in zip(turn, same, initial, blank, cut, later, strict=True):
            if t is not None and (self.high is None or t != self.last_turn):
                self.turns += 1
                self.low, self.high = t if self.low is None else self.low, t
                self.first_turn = t if self.n == 0 else self.first_turn
            seen = seen or (t, s) == self.last
            code = _GONE
            if b:
                self.blank += 1
            elif seen:
                self.duplicate += 1
            else:
                self.truncated += c
                code = 1 + i + 4 * c
            if self.n:
                self.illegal += illegal_pair(self.last_initial, i)
            else:
                self.first_initial = i
            self.codes.append(code)
            self.last, self.last_turn, self.last_initial, self.n = (t, s), t, i, self.n + 1

    def row(self, part: int, place: int, cost: int | None, audit: str | None, codes: bytes | None) -> tuple:
        return (
            self.conv_id, part, place, self.n, self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal,
            self.first_turn, self.last_turn, self.first_initial, self.last_initial, cost, audit, codes,
        )


def illegal_pair(first: int, second: int) -> int:
    return int((first, second) not in ((0, 1), (1, 2), (2, 1)))


def _whole(codes: bytes) -> tuple[int, str]:
    edits, state, price = _trace(codes, _backward(codes, END), 0)
    last = _finish(state)
    return price + INSERT * len(last), edits + last


def _search(coded: DataFrame) -> DataFrame:
    """One row per conversation that lies within one partition; of the first and the last conversation of each partition their chunks, with codes."""
    types = _arrow_types(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = []
            ids = batch.column("conv_id").to_pylist()
            there = np.asarray(batch.column("present").to_numpy(zero_copy_only=False))
            columns = {c: batch.column(c).to_pylist() for c in ("turn", "same", "initial", "blank", "cut", "later")}
            starts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if chunk is None or ids[a] != chunk.conv_id:
                    if chunk is not None:
                        rows.append(chunk.row(part, 0, None, None, bytes(chunk.codes)) if place == 0 else chunk.row(part, place, *_whole(bytes(chunk.codes)), None))
                        place += 1
                    chunk = _Chunk(ids[a])
                chunk.add(*([v for v, ok in zip(columns[c][a:b], there[a:b], strict=True) if ok] for c in columns))
            if rows:
                yield _batch(dict(zip(types.names, zip(*rows, strict=True), strict=True)), types)
        if chunk is not None:
            yield _batch(dict(zip(types.names, zip(chunk.row(part, place, None, None, bytes(chunk.codes)), strict=True), strict=True)), types)

    return written(coded.mapInArrow(run, _FOUND), "turn_chunks")


def _lead(chunks: DataFrame, wanted: dict[tuple[int, int], tuple[int, ...]]) -> dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]]:
    """For chunks and costs behind them: the costs before, less their least, and the state each of the four states leads to."""
    rows = [(p, k, ",".join(map(str, v))) for (p, k), v in wanted.items()]
    starts = chunks.sparkSession.createDataFrame(rows, "part int, place int, start string")

    def run(batch: pa.RecordBatch) -> dict:
        out = {"part": batch.column("part"), "place": batch.column("place"), "before": [], "ends": []}
        for codes, start in zip(batch.column("codes").to_pylist(), batch.column("start").to_pylist(), strict=True):
            costs = _backward(codes, tuple(map(int, start.split(","))))
            out["before"].append(list(costs[0]))
            out["ends"].append([_trace(codes, costs, s)[1] for s in range(4)])
        return out

    found = map_batches(chunks.select("part", "place", "codes").join(starts, ["part", "place"]), run, "part int, place int, before array<int>, ends array<int>")
    return {(r["part"], r["place"]): (tuple(r["before"]), tuple(r["ends"])) for r in found.collect()}


def _stitch(chunks: DataFrame, chains: list[list[tuple[int, int]]]) -> dict[tuple[int, int], tuple[tuple[int, ...], int]]:
    """Costs behind each chunk, less their least, and the state in front of it, for chunks in the order of their conversation."""
    known: dict[tuple[int, int], dict] = {c: {} for chain in chains for c in chain}
    latest = {c: END for c in known}
    while True:
        wanted = {}
        for chain in chains:
            after = END
            for c in reversed(chain):
                if after not in known[c]:  # a fix-up pass, or the first one; those in front go on from what they were given last
                    wanted[c] = after
                    after = known[c][latest[c]][0] if known[c] else END
                else:
                    latest[c] = after
                    after = known[c][after][0]
        if not wanted:
            break
        for c, found in _lead(chunks, wanted).items():
            known[c][wanted[c]] = found
            latest[c] = wanted[c]
    stitched = {}
    for chain in chains:
        after = END
        behind = {}
        for c in reversed(chain):
            behind[c] = after
            after = known[c][after][0]
        state = 0
        for c in chain:
            stitched[c] = (behind[c], state)
            state = known[c][behind[c]][1][state]
    return stitched


_AUDIT = "conv_id long, part int, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, present): gaps, blank, duplicate, truncated, illegal, cost, audit.

    Only present rows count; a conversation without any has zeros and an empty audit. Rows follow each other by turn, null first, rows of one turn by
    a hash of role and text; null conversations are one conversation. An empty role, like any that does not start with s, u or a, cannot
    be kept. A null role or text must have been replaced. An empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("same"))
    coded = materialised(_coded(rows).repartitionByRange(*order).sortWithinPartitions(*order))
    found = _search(coded)
    chunks = found.where("codes IS NOT NULL")
    # at most two rows per partition
    met = sorted(chunks.select("part", "place", "conv_id", "n", "first_turn", "last_turn", "first_initial", "last_initial").collect(), key=lambda r: (r["part"], r["place"]))
    chains, joints = [], {}
    for r in met:
        c = (r["part"], r["place"])
        if chains and r["conv_id"] == chains[-1][0]["conv_id"] and chains[-1][-1]["part"] < r["part"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    for chain in chains:
        before = None
        for r in chain:
            turns = illegal = 0
            if r["n"]:
                if before is not None:
                    illegal = illegal_pair(before["last_initial"], r["first_initial"])
                    turns = -int(r["first_turn"] is not None and r["first_turn"] == before["last_turn"])
                before = r
            joints[r["part"], r["place"]] = (turns, illegal, r is chain[-1])
    stitched = _stitch(chunks, [[(r["part"], r["place"]) for r in chain] for chain in chains])
    plan = [(p, k, *joints[p, k], ",".join(map(str, after)), state) for (p, k), (after, state) in stitched.items()]
    joined = chunks.join(rows.sparkSession.createDataFrame(plan, "part int, place int, more_turns int, more_illegal int, ends boolean, start string, state int"), ["part", "place"])

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in ("conv_id", "part", "n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")} | {"cost": [], "audit": []}
        for codes, start, state, ends in zip(*(batch.column(c).to_pylist() for c in ("codes", "start", "state", "ends")), strict=True):
            edits, state, price = _trace(codes, _backward(codes, tuple(map(int, start.split(",")))), state)
            last = _finish(state) if ends else ""
            out["cost"].append(price + INSERT * len(last))
            out["audit"].append(edits + last)
        return out

    fixed = joined.withColumns({"turns": F.col("turns") + F.col("more_turns"), "illegal": F.col("illegal") + F.col("more_illegal")})
    names = [c.split()[0] for c in _AUDIT.split(", ")]
    traced = map_batches(fixed, run, _AUDIT).groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    both = found.where("codes IS NULL").select(*(c for c in names if c not in ("part", "n"))).unionByName(traced)
    return both.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation behind its audit, in order, whole conversations to a partition."""
    order = [F.col("conv_id").asc_nulls_first(), "_kind", F.col("turn").asc_nulls_first(), "_same"]
    texts = rows.where("present").select("conv_id", F.lit(1).alias("_kind"), "turn", _same(rows).alias("_same"), "role", "text")
    first = found.withColumn("_kind", F.lit(0))
    both = texts.unionByName(first, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*order)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int | None, str | None, str | None]]:
    """(batch, row, turn, role, text) of every repaired row; a row of an audit opens its conversation and has no role."""
    audit, at, state, batch = "", 0, 0, None

    def put_in() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield batch, k, None, _PUT[state], ""
            at, state = at + 1, _NEXT[state]

    k = 0
    for batch in batches:
        kinds, turns, roles, texts = (batch.column(c).to_pylist() for c in ("_kind", "turn", "role", "text"))
        edits = batch.column("audit")
        for k, kind in enumerate(kinds):
            if kind == 0:
                audit, at, state = edits[k].as_py(), 0, 0
                yield batch, k, None, None, None
            else:
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = 1 if state == 0 and roles[k].startswith("s") else _NEXT[state]
                    yield batch, k, turns[k], roles[k], texts[k]
                elif edit == "R":
                    role, state = _PUT[state], _NEXT[state]
                    yield batch, k, turns[k], role, texts[k]
            yield from put_in()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn (null: put in), role, text of the repaired conversations; ``found`` are their audits."""
    schema = "conv_id long, place long, turn long, role string, text string"
    types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for batch, k, turn, role, text in _replay(batches):
            if role is None:
                place = 0
            else:
                out.append((batch.column("conv_id")[k].as_py(), place, turn, role, text))
                place += 1
            if len(out) >= 1000:
                yield _batch(dict(zip(types.names, zip(*out, strict=True), strict=True)), types)
                out = []
        if out:
            yield _batch(dict(zip(types.names, zip(*out, strict=True), strict=True)), types)

    return _replayed(rows, found.select("conv_id", "audit")).mapInArrow(run, schema)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the SHA-256 of the repaired rows, ``role:text`` joined by line feeds.

    The hash of a conversation is one chain over its text, so a conversation passes through one task, row by row; nothing of it is held but its audit.
    """
    types = _arrow_types(_DIGEST)
    names = types.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, digest, empty = [], None, None, True
        for batch, k, _, role, text in _replay(batches):
            if role is None:
                if here is not None:
                    out.append((*here, digest.hexdigest()))
                here, digest, empty = tuple(batch.column(c)[k].as_py() for c in names), hashlib.sha256(), True
            else:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
            if len(out) >= 1000:
                yield _batch(dict(zip(types.names, zip(*out, strict=True), strict=True)), types)
                out = []
        if here is not None:
            out.append((*here, digest.hexdigest()))
            yield _batch(dict(zip(types.names, zip(*out, strict=True), strict=True)), types)

    return _replayed(rows, found).mapInArrow(run, _DIGEST)
