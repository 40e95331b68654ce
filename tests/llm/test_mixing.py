import re

import pytest

from stationgrid.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def check(rows, slack):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = plain_targets(sizes)
    assert target == pytest.approx(want)
    assert all(r.source_size == sizes[r.source] for r in rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack, s


def test_targets_and_takings(documents):
    rows = mixing.mix_copies(documents).collect()
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0D]+", r.text)) for r in documents.collect()}
    assert {r.doc_id: r.size for r in rows} == words
    check(rows, 60)
    again = mixing.mix_copies(documents.repartition(5)).collect()
    assert {r.doc_id: r.copies for r in rows} == {r.doc_id: r.copies for r in again}


def test_small_and_hot_sources(table):
    rows = [(i, "w " * (1 + i % 50), "hot") for i in range(600)] + [(1000 + i, "v " * 5, "tiny") for i in range(2)] + [(2000 + i, "u " * 30, None) for i in range(20)] + [(3000, "", "empty"), (3001, None, "")]
    found = mixing.mix_copies(table(rows)).collect()
    assert len(found) == len(rows)
    check(found, 5)
    assert {r.copies for r in found if r.source == "tiny"} == {3}


def test_rates_are_exponential_tilts(spark):
    cells = spark.createDataFrame([(0, s, 10) for s in (1, 5, 20, 100)], "sid long, size long, n long")
    sources = spark.createDataFrame([(0, 1260, 40, 500.0)], "sid long, source_size long, n long, target double")
    import math

    tilt = mixing.tilts(cells, sources).first().tilt
    assert sum(10 * s * min(3, math.exp(tilt * s / 31.5)) for s in (1, 5, 20, 100)) == pytest.approx(500, rel=1e-6)


def test_odd_rows(odd, table):
    assert len(mixing.mix(odd).collect()) == 8
    assert mixing.mix(table([])).collect() == []
    assert {r.target for r in mixing.mix(table([(1, None), (2, "")])).collect()} == {0.0}
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(r.copies for r in mixing.mix_copies(odd).collect()) == mixed.count()
