import hashlib
import random
import re
import zlib

from stationgrid.llm import queries, turns

WORD = re.compile("[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit) by a forward search that keeps the least pair per state and tries every edit."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put_in(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for c in "ua":
                    if (state, c) in follow:
                        best[c] = min(best.get(c, (99999, "")), (cost + 2, audit + "I"))
        return best

    best = {"": (0, "")}
    for (_, _, role, _), fault in zip(rows, faults, strict=True):
        best = put_in(best)
        moved = {}
        for state, (cost, audit) in best.items():
            options = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options += [(c, cost + extra + 2, "R") for c in "ua" if (state, c) in follow] + ([(role[0], cost + extra, "K")] if role and (state, role[0]) in follow else [])
            for end, price, letter in options:
                moved[end] = min(moved.get(end, (99999, "")), (price, audit + letter))
        best = moved
    best = put_in(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    """conv_id: everything the query returns, from damaged rows in order."""
    rows = sorted(damage(rows), key=lambda r: (r[1] is not None, r[1] or 0))
    seen, faults = set(), []
    for _, _, role, text in rows:
        letters = WORD.findall(text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for _, t, _, _ in rows if t is not None]
    cost, audit = cheapest(rows, faults)
    state, left, out = "", list(rows), []
    for c in audit:
        row = left.pop(0) if c != "I" else None
        if c in "RI":
            out.append(f"{'assistant' if state == 'u' else 'user'}:{row[3] if row else ''}")
            state = "a" if state == "u" else "u"
        elif c == "K":
            out.append(f"{row[2]}:{row[3]}")
            state = row[2][0]
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def result(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n long, state string").repartition(5)


def repair(spark, rows):
    damaged = turns.damaged(made(spark, rows))
    return turns.repair_digests(damaged, turns.audits(damaged))


def conversation(rng, conv, length):
    roles = ["user", "assistant", "system", "tool", "", None]
    return [
        (conv, t, rng.choices(roles, [8, 8, 2, 1, 0.3, 0.3])[0], rng.choice([f"Say {rng.randrange(60)}.", f"cut {rng.randrange(60)}", "Yes!", "", " \n", None, "Why? \t"]))
        for t in sorted(rng.sample(range(3 * length), length))
    ]


def want(rows):
    return {c: plain([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, sf)
    assert result(got) == want(rows) and got.count() == len({r[0] for r in rows})


def test_equals_search_over_all_edits(spark):
    rng = random.Random(11)
    rows = [r for c in range(300) for r in conversation(rng, c, rng.randrange(1, 14))]
    rows += [(None, t, "user", f"null {t}.") for t in range(4)] + [(900, None, "assistant", "no turn."), (900, 3, "user", "a turn.")]
    assert result(repair(spark, rows)) == want(rows)


def test_conversations_across_many_chunks(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(turns, "small_batches", lambda s: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    passes = []
    lead = turns._lead
    monkeypatch.setattr(turns, "_lead", lambda chunks, wanted: (passes.append(len(wanted)), lead(chunks, wanted))[1])
    try:
        # users only, then alternating parts, and rows that all go: costs that depend on what lies far behind
        rows = [(1, t, "user", f"line {t}.") for t in range(901)] + [(2, t, "system", f"line {t}") for t in range(400)] + [(3, t, "user", " ") for t in range(300)] + conversation(rng, 4, 500)
        assert result(repair(spark, rows)) == want(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(passes) > 1


def test_repaired_rows(spark):
    rng = random.Random(13)
    rows = [r for c in range(40) for r in conversation(rng, c, rng.randrange(1, 9))]
    damaged = turns.damaged(made(spark, rows))
    found = turns.audits(damaged).persist()
    by_conv = {}
    for r in sorted(turns.repaired(damaged, found).collect(), key=lambda r: (r.conv_id, r.place)):
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    got = result(turns.repair_digests(damaged, found))
    assert {c: hashlib.sha256("\n".join(by_conv.get(c, [])).encode()).hexdigest() for c in got} == {c: v[-1] for c, v in got.items()}


def test_nothing_left_and_nothing_given(spark):
    dropped = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, t, "user", "gone.") for c, t in dropped]
    assert set(result(repair(spark, rows)).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair(spark, []).collect() == []


def test_rows_of_one_turn(spark):
    rows = [(7, 1, r, t) for r in ("user", "assistant") for t in ("One.", "Two.", "Two.")] + [(7, 1, "user", "long " * 50_000 + ".")] * 2
    got = result(repair(spark, rows))[7]
    n = len(damage(rows))
    assert got[0] == 0 and got[2] == n - len(set(damage(rows))) and len(got[6].replace("I", "")) == n
