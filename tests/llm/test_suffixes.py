import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stationgrid.llm import suffixes


def plain(texts, length):
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for n in [0, 1, 2, *range(3, 160, 9)]:
        d = bytes(rng.choice(alphabet) for _ in range(n))
        d = d[: n // 2] * 2 if n % 2 else d
        want = sorted(range(len(d)), key=lambda i: d[i:])
        got = suffixes.suffix_array(d, 1000)
        assert got.tolist() == want
        lcp = suffixes.common_prefixes(np.frombuffer(d, np.uint8), got, 1000)
        for j in range(1, len(d)):
            a, b = d[want[j - 1]:], d[want[j]:]
            assert lcp[j] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_every_window_has_one_anchor():
    rng = random.Random(1)
    docs = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randrange(0, 300))) for _ in range(30)] + [b"a" * 500]
    doc, low, high, *_ = suffixes.anchors(docs, 40, 16)
    windows = [(d, s) for d, a, b in zip(doc, low, high) for s in range(a, b + 1)]
    assert len(windows) == len(set(windows)) == sum(max(0, len(d) - 39) for d in docs)


@pytest.mark.parametrize("crowd", [1500, 1])
def test_equals_brute_force(table, monkeypatch, crowd):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (suffixes.LENGTH, 16, crowd))
    rng = random.Random(crowd)
    blocks = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))) for _ in range(10)]
    rows = [(i, "".join(rng.choice([*blocks, str(rng.random())]) for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    rows += [(100, "x" * 700), (101, None), (102, ""), (103, "ab" * 90)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(table(rows), 64).collect()}
    want = plain([(t or "").encode() for _, t in rows], 64)
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_documents(documents):
    rows = documents.orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in suffixes.remove_repeats(documents).orderBy("doc_id").collect()]
    assert got == plain([r.text.encode() for r in rows], 400)


def test_odd_rows(odd, table):
    long = "z" + "".join(chr(97 + i * i % 23) for i in range(900))
    got = suffixes.remove_repeats(odd.unionByName(table([(8, long), (8, long)])))
    rows = got.collect()
    assert len(rows) == 10 and [r.n_removed for r in rows if r.doc_id == 8] == [901, 901]
    assert {r.doc_id: r.n_removed for r in rows}[6] == 150_000 - 0
    assert suffixes.remove_repeats(table([])).collect() == []
