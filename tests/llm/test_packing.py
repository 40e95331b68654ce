import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stationgrid.llm import packing


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in documents.collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048
        cuts = sorted({0, *range(first, len(ids), 2048)})
        want |= {(r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))}
    rows = packing.best_fit_packing(documents).collect()
    assert len(rows) == len(want) and {tuple(r)[:5] for r in rows} == want
    assert check(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_fillings_are_best():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        counts = {s: items.count(s) for s in items}
        found = packing.complete(40, counts, sorted(counts, reverse=True))
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= 40)
        assert sum(found) == best and all(found.count(s) <= counts[s] for s in found)


def least_bins(counts, capacity):
    """No packing has fewer bins: large items stand alone or take only what fits beside them."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - a)
        large = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - a}
        small = sum(s * n for s, n in counts.items() if a <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def test_plan_uses_every_piece():
    rng = random.Random(4)
    counts = {s: rng.randrange(0, 5000) for s in range(1, 200)}
    plan = packing.plan_bins(counts, 200)
    used = {}
    for filling, times in plan:
        assert sum(filling) <= 200
        for s in filling:
            used[s] = used.get(s, 0) + times
    assert used == {s: n for s, n in counts.items() if n}
    assert sum(t for _, t in plan) <= 1.01 * least_bins(counts, 200) + 1


def test_faster_encoder_agrees():
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    pieces = [chr(i) for i in range(0x250)] + ["'s", "<|endoftext|>", "日本", "🙂"] + list(" \n\t\x1c\x85") * 9 + list("abcdethinger") * 20
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))
        assert encoder.ids(text) == encoder.exact.encode(text, add_special_tokens=False).ids


def test_odd_rows_and_small_sequences(odd, table):
    rows = packing.best_fit_packing(odd, capacity=64).collect()
    check(rows, 64)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.best_fit_packing(table([])).collect() == []


def test_long_white_space():
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a" + " " * 1_200_000 + "b", "\n" * 1_200_000):
        assert encoder.ids(text) == encoder.exact.encode(text, add_special_tokens=False).ids
