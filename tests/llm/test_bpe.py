import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from paragraf.llm import bpe, common

ALPHABET = ["a", "b", "ab", "th", "he", " ", "  ", "\n", "\t", "e", "in", "er", "'s", "'", "1", "23", "é", "ß", "<|endoftext|>", "<|", "日本", "😀", "́", "İ", " ", "\x85", "\x1c", "ing", "aaaa", "    ", "===", "՘"]


@pytest.fixture(scope="module")
def coder():
    return bpe.byte_pairs(common.vocabulary(bpe.BYTE_VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(common.vocabulary(bpe.BYTE_VOCABULARY))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_random_texts(coder, library):
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(coder.encode(text)) == expected
        assert coder.decode(coder.encode(text)).decode("utf-8", "replace") == library.decode(expected, skip_special_tokens=False)


def test_random_ids_decode_alike(coder, library):
    rnd = random.Random(2)
    for _ in range(500):
        some = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        raw = np.array([*some, 4_000_000_000], "<u4").tobytes()
        assert coder.decode(raw).decode("utf-8", "replace") == library.decode(some, skip_special_tokens=False)


def test_every_character_of_the_plain_range(coder, library):
    for c in map(chr, range(bpe.PLAIN_BELOW)):
        text = f"a{c}{c} {c}1 \n{c}"
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_long_words_are_linear(coder, library):
    for text in ("ab" * 20_000, "the" * 5_000, "x" * 30_000):
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bounded_tables(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    text = "some words that are many more than three, and then some"
    before = coder.encode(text)
    coder.words.clear()
    assert coder.encode(text) == before and len(coder.words) <= 3


def test_query(spark, sf_dir, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op2_bpe(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, docs):
    rows = [(1, None), (1, None), (None, "a"), (2, ""), (3, "word " * 50_000), (4, "x" * 200_000)]
    got = sorted((r.id is not None, r.id or 0, r.n_tokens) for r in bpe.round_trip(docs(rows)).collect())
    assert [g[:2] for g in got] == [(False, 0), (True, 1), (True, 1), (True, 2), (True, 3), (True, 4)] and got[1][2] == 0
    assert bpe.round_trip(docs(rows).limit(0)).count() == 0
    back = {r.id: r.text for r in bpe.decode_ids(bpe.encode_texts(docs(rows))).collect()}
    assert back[1] == "" and back[3] == "word " * 50_000 and back[4] == "x" * 200_000
