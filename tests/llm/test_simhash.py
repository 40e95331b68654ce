import numpy as np
import pytest
import xxhash

from stationgrid.llm import simhash
from stationgrid.llm.components import connected_components


def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i: i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in items}


def test_components_equal_brute_force(documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    fps = {i: plain_fingerprint(t, 4) for i, t in rows.items()}
    ids = sorted(rows)
    want = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.simhash_components(documents).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("bits,prefix,room", [(64, 12, 1 << 22), (64, 4, 1 << 9), (40, 5, 1 << 12), (16, 3, 1 << 8)])
def test_links_of_crowded_places(monkeypatch, bits, prefix, room):
    monkeypatch.setattr(simhash, "VARIANTS", room)
    rng = np.random.default_rng(bits + prefix)
    fps = np.repeat(rng.integers(0, 1 << 62, 12, dtype=np.uint64) & np.uint64((1 << bits) - 1), 30)
    for i in range(len(fps)):
        for b in rng.choice(bits, rng.integers(0, 6), replace=False):
            fps[i] ^= np.uint64(1 << int(b))
    fps = np.unique(fps)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)]
    where, which = simhash.copies(fps, bits, 2, prefix)
    found = []
    for place in np.unique(where):
        own = which[where == place]
        found += [(int(own[x]), int(own[y])) for x, y in simhash.forest(fps[own], *simhash.links(fps[own], int(place), bits, 2, prefix), 4)]
    assert components(range(len(fps)), found) == components(range(len(fps)), near)


def test_places_follow_the_number_of_fingerprints(documents, monkeypatch):
    want = {tuple(r) for r in simhash.simhash_components(documents, prefix=2).collect()}
    monkeypatch.setattr(simhash, "PLACE_ENTRIES", 20)
    assert {tuple(r) for r in simhash.simhash_components(documents, prefix=2).collect()} == want


@pytest.mark.parametrize("finish", [0, 5, 1000])
def test_connected_components(spark, finish):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (7, 7), (200, 200)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), finish).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long"), finish).collect() == []


def test_odd_rows(odd, table):
    got = sorted(simhash.simhash_components(odd).collect(), key=str)
    assert len(got) == 8
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.simhash_components(table([])).collect() == []


def test_near_duplicates_by_jaccard(documents, table):
    rows = {r.doc_id: r.text for r in documents.collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows.items()}
    ids = sorted(rows)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(ids, alike)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()} == want
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_keep_one_of_odd_rows(odd):
    kept = simhash.keep_one(odd)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 4, 6, None]


def test_planted_near_copies_are_found(table):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(30):
        base = list(rng.choice(words, 200))
        for c in range(3):
            copy = list(base)
            for at in rng.choice(200, c, replace=False):
                copy[at] = "changed"
            rows.append((g * 3 + c, " ".join(copy)))
    assert {r.component_id for r in simhash.near_duplicates(table(rows)).collect()} == {3 * g for g in range(30)}


def jaccard_components(rows, words=5, similarity=0.8):
    sets = {i: set(simhash.shingle_hashes(t, words).tolist()) for i, t in rows}
    ids = sorted(sets)
    return components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9])


def test_star_shaped_copies_are_all_found(table):
    """Copies that are like their original only, not like each other."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in rng.permutation(250)]
        rows.append((1000 * g + 500, " ".join(base)))
        for c in range(300):
            copy = list(base)
            for at in rng.choice(240, 3, replace=False):
                copy[at + 5] = f"changed{c}"
            rows.append((1000 * g + c, " ".join(copy)))
    want = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table(rows)).collect()} == want
    assert len(set(want.values())) < 10


def test_short_near_copies_are_found(table):
    """Texts of few shingles, whose fingerprints would be coarse."""
    rows = []
    for k in range(400):
        base = [f"d{k}w{i}" for i in range(8 + k % 12)]
        more = [*base, "more"] if k % 2 else ["more", *base]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(more))]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table(rows)).collect()} == jaccard_components(rows) == {i: i - i % 2 for i, _ in rows}


def test_keep_one_takes_its_first_links_from_fingerprints(table, monkeypatch):
    """The pairs that ball hashing links are proposed, judged and kept apart from the pairs of the exact join."""
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in rng.permutation(400)]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join([*base, "more"])), (3 * g + 2, " ".join([*base, base[0]]))]
    proposed = []
    pairs = simhash.simhash_pairs
    monkeypatch.setattr(simhash, "simhash_pairs", lambda docs, words: (proposed.append(pairs(docs, words)), proposed[-1])[1])
    assert sorted(r.doc_id for r in simhash.keep_one(table(rows)).collect()) == [3 * g for g in range(6)]
    class_ids = [{simhash.class_of(np.unique(simhash.shingle_hashes(t, 5))) for i, t in rows if i // 3 == g} for g in range(6)]
    found = {(r.a, r.b) for r in proposed[0].collect()}
    assert found and all(any({a, b} <= ids for ids in class_ids) for a, b in found)
