import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stationgrid.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def scanned(text, size):
    counts = tokens.word_counts(PATH)
    return tokens.total(tokens.scan([tokens.chunk_map(text[i: i + size], counts) for i in range(0, len(text), size)], counts), counts)


def test_documents(documents, library):
    want = {r.doc_id: (len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids)) for r in documents.collect()}
    for size in (tokens.CHUNK_CHARS, 100):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(documents, chunk_chars=size).collect()}
        assert got == want


def test_chunks_compose_for_any_text(library):
    rng = random.Random(1)
    pieces = [chr(i) for i in range(0x250)] + ["'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|endof", "é", "Σ", "İ", "　", "日本", "🙂"] + list(" \n\t\x1c\x1f\x85") * 9 + list("abcdethinger") * 20
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert scanned(text, 1 << 16) == want and scanned(text, 3) == want, text


def test_long_words_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_STATES", 50)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    tokens.word_counts.cache_clear()
    rng = random.Random(2)
    for n in (1, 100, 5000):
        text = "".join(rng.choice("abcdefghij") for _ in range(n)) + " some more words " + "aaaa" * n
        assert scanned(text, 64) == len(library.encode(text, add_special_tokens=False).ids)
    tokens.word_counts.cache_clear()


def test_odd_rows(odd, table, library):
    got = tokens.token_counts(odd).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].n_bytes, by_id[1].n_tokens) == (0, 0) and by_id[3].n_tokens == 0
    assert by_id[6].n_tokens == 30_000 and by_id[6].over_limit and not by_id[4].over_limit
    assert tokens.token_counts(table([])).collect() == []
