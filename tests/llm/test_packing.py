import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paragraf.llm import common, packing

from .test_bpe import ALPHABET


def test_best_fit_rules():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 8, 7)] == [(0, 0), (1, 0), (2, 0)]  # the bin of 8 closes
    assert p.place(2) == (2, 7) and p.place(4) == (0, 6)
    with pytest.raises(ValueError):
        p.place(11)


def test_bins_hold_what_they_can():
    rnd = random.Random(1)
    for open_bins in (1, 7, 500):
        p, filled = packing.BestFit(64, open_bins), {}
        for _ in range(3000):
            n = rnd.randint(1, 64)
            b, at = p.place(n)
            assert at == filled.get(b, 0)
            filled[b] = at + n
            assert filled[b] <= 64 and p.standing <= open_bins


def test_pieces():
    assert list(packing.pieces_of(1, 4)) == [(0, 0, 1)] and list(packing.pieces_of(4, 4)) == [(0, 0, 4)]
    assert list(packing.pieces_of(9, 4)) == [(0, 0, 1), (1, 1, 4), (2, 5, 4)] and list(packing.pieces_of(8, 4)) == [(0, 0, 4), (1, 4, 4)]


def test_encoders_agree():
    path = common.vocabulary(packing.BYTE_VOCABULARY)
    encode, library, rnd = packing.fast_encoder(path), Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(2000)] + [f"a{c}{c} {c}1 \n{c}" for c in map(chr, range(packing.PLAIN_BELOW))]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def check(rows, texts, length):
    library = Tokenizer.from_file(common.vocabulary(packing.BYTE_VOCABULARY))
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == length or k == 0
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), -(-total // length)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = check(packing.op5_packing(spark, sf_dir).collect(), texts, 1024)
    assert used <= 1.03 * least + 1


def test_edges(spark, docs):
    texts = {1: None, 2: "", 3: "word " * 20_000, 4: "x" * 50_000, 5: "<|endoftext|> a"}
    check(packing.pack(docs(list(texts.items())), length=16, open_bins=2).collect(), texts, 16)
    long = {k: c * 2_000_000 for k, c in enumerate(" \na")} | {3: "a " + " \t" * 1_000_000}
    check(packing.pack(docs(list(long.items()))).collect(), long, 1024)
    assert len(packing.pack(docs([(1, "a"), (1, "a"), (None, "b")])).collect()) == 3
    assert packing.pack(docs([(1, "a")]).limit(0)).count() == 0


def test_floods_are_dealt_evenly(spark, docs, monkeypatch):
    """Half of all rows are equal, a third have null ids."""
    monkeypatch.setattr(packing, "DOCUMENTS_PER_TASK", 500)
    rows = [(None, "same text")] * 1000 + [(1, "one id")] * 1000 + [(k, f"text {k}") for k in range(2000)]
    found = packing.pack(docs(rows).repartition(3)).collect()
    assert len(found) == len(rows)
    tasks = {}
    for r in found:
        tasks[r.sequence_id >> 40] = tasks.get(r.sequence_id >> 40, 0) + 1
    assert len(tasks) == 8 and max(tasks.values()) <= 3 * sorted(tasks.values())[4]
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
