import random

import pytest

from paragraf.llm import common, token_counts

from .test_bpe import ALPHABET


@pytest.fixture(scope="module")
def library():
    return token_counts.library(common.vocabulary(token_counts.WORD_VOCABULARY))


def test_spliced_counts(library):
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice([*ALPHABET, "<|startoftext|>"]) for _ in range(rnd.randint(0, 90)))
        expected = len(library.encode(text, add_special_tokens=False))
        for chunk, overlap in ((8, 2), (16, 6), (40, 12)):
            assert token_counts.count_long(text, library, chunk, overlap) == expected


def test_texts_without_white_space_widen_to_the_whole(library):
    for text in ("x" * 3000, "\x1c!" * 900, "\x1c" * 2000, "a\x1f " * 700, "ab1" * 1000, "日本語" * 700, "lead " + "y" * 2500 + " tail"):
        assert token_counts.count_long(text, library, 64, 16) == len(library.encode(text, add_special_tokens=False))


def test_no_common_boundary():
    assert token_counts.stable_boundary("abc def", 0, 7, [(0, 7, 1)], [(0, 7, 1)]) is None
    assert token_counts.stable_boundary("a b c d e", 0, 9, [(k, k + 1, 5) for k in range(0, 9, 2)], [(k, k + 1, 5) for k in range(0, 9, 2)]) in (3, 5)


def test_query(spark, sf_dir, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = token_counts.op4_token_counts(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(k, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for k, t in rows.items()}


def test_edges(spark, docs, library):
    rows = [(1, None), (None, ""), (2, "é " * 40_000), (2, "é " * 40_000), (3, "z" * 70_000)]
    got = token_counts.count_tokens(docs(rows), chunk=1000, overlap=100).collect()
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 120_000, 40_000), (2, 120_000, 40_000), (3, 70_000, len(library.encode("z" * 70_000, add_special_tokens=False)))]
    assert token_counts.count_tokens(docs(rows).limit(0)).count() == 0
