import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from stationgrid.llm import imatch, queries


def neighbours(rows):
    """(row, next row) by doc_id, null first, then text; after the last the first."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return list(zip(rows, rows[1:] + rows[:1], strict=True))


def edited(text, following):
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def check_edits(got, rows):
    want = Counter((i, len(t), hashlib.sha256(edited(t, u).encode()).hexdigest()) for (i, t), (_, u) in neighbours(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_whole_table(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = queries.op12_imatch_fingerprints(spark, sf).collect()
    check_edits(got, rows)
    text = dict(rows)
    assert len({(text[r.doc_id], r.fingerprint) for r in got}) == len(set(text.values()))
    long = [r for r in got if len(set(text[r.doc_id].split())) > 40]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.05
    # the general interface gives the same fingerprints
    assert {(r.doc_id, r.fingerprint) for r in imatch.fingerprints(documents).collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_lexicon_is_the_band_counted_over_all_documents(table):
    rng = random.Random(3)
    rows = [(i, " ".join(["the", *(f"Mid{rng.randrange(60)}" for _ in range(5)), f"only{i}", "the"])) for i in range(300)]
    counts = Counter(t for _, text in rows for t in set(re.findall(r"\w+", text.lower())))
    want = sorted(xxhash.xxh64_intdigest(t) for t, n in counts.items() if 2e-4 * 300 <= n <= 0.05 * 300)
    assert imatch.lexicon(table(rows)).tolist() == want and 0 < len(want) < len(counts)


def test_terms_too_rare_for_a_bounded_lexicon_go(table, monkeypatch):
    monkeypatch.setattr(imatch, "LEXICON", 200)
    rows = [(i, " ".join(f"w{j}" for j in (i % 40, 100 + i % 200, 1000 + i))) for i in range(400)]
    assert len(imatch.lexicon(table(rows))) == 40


def test_signatures_are_those_of_sorted_terms_in_each_part():
    terms = np.array([random.Random(k).getrandbits(63) for k in range(300)], dtype=np.uint64)
    found = imatch.Fingerprint(np.sort(terms), np.sort(terms[:200]))
    assert found.level == 8 and found.banded
    for d in (0, 1):
        for k in range(imatch.PARTS):
            inside = [int(t) for t in np.sort(terms[:200]) if int(t) * int(imatch._FACTORS[k]) % (1 << 64) < 1 << (64 - 8 - d)]
            want = 1 + xxhash.xxh64_intdigest(np.array(inside, np.uint64).tobytes()) % 65535 if inside else 0
            assert found.signs[d][k] == want
    assert found.likeness(found) == 1.0 and found.likeness(imatch.Fingerprint(np.sort(terms[200:]), np.sort(terms[:200]))) == 0.0


def test_likeness_falls_with_the_share_of_new_terms():
    rng = random.Random(5)
    terms = np.sort(np.array([rng.getrandbits(63) for _ in range(4000)], dtype=np.uint64))
    own = imatch.Fingerprint(terms[:1000], terms)
    near = [own.likeness(imatch.Fingerprint(np.sort(np.concatenate([terms[:1000 - k], terms[1000:1000 + k]])), terms)) for k in (0, 50, 200, 600, 1000)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[1] > 0.8 and near[-1] < 0.05


def test_odd_rows(odd, table):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = imatch.edited_likeness(odd).collect()
    check_edits(got, rows)
    same = {r.fingerprint for r in got if r.doc_id in (4, 5)}
    assert len(same) == 1 and len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert imatch.edited_likeness(table([])).collect() == []
    one = imatch.edited_likeness(table([(7, "alone in the table here")])).collect()
    check_edits(one, [(7, "alone in the table here")])
    assert one[0].near_next == 1.0


def test_many_rows_of_one_id_and_long_texts(table):
    rows = [(5, f"text number {i % 9} of many") for i in range(400)] + [(i, "ab " * 50_000 + str(i)) for i in (1, 9)] + [(20 + i, "é€😀" * i) for i in range(30)]
    check_edits(imatch.edited_likeness(table(rows)).collect(), rows)
