import random
import re

import numpy as np
import pytest
import xxhash

from paragraf.llm import simhash
from paragraf.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(f"[{SPACE}]", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(x for x in groups[find(i)] if x is not None) for i in range(len(ids))}


def test_fingerprint_by_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "B", "é", "Ñ", " ", "\t", "\x0b", "\x1c", " ", "İ", "the "]) for _ in range(rnd.randint(0, 60)))
        assert int.from_bytes(simhash.fingerprint(text), "big") == brute_fingerprint(text)


def test_query_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    expected = brute_components([r.doc_id for r in rows], prints)
    got = simhash.op1_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}


def test_links_reach_every_pair(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for b in base:
        for _ in range(20):
            b ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            prints.add(b)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    expected = brute_components(signed, [p & (2**64 - 1) for p in signed])
    groups = {}
    for p in signed:
        groups.setdefault(roots.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x for x in signed if expected[x] == k) for k in set(expected.values())}


def test_edges(spark, docs):
    rows = [(5, None), (2, ""), (7, " \n"), (9, "one two"), (9, "one two"), (None, "one two"), (11, "ONE\ttwo"), (12, "x" * 200_000), (13, "w " * 50_000)]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.component_id) for r in got}
    assert {(5, 2), (2, 2), (7, 2), (9, 9), (11, 9), (None, 9), (12, 12), (13, 13)} == by
    assert simhash.near_duplicates(docs(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs(rows), 3)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[k] for k in range(61)}) == 1 and len({roots[k] for k in range(1000, 1100)}) == 1
    assert roots[0] != roots[1000] and len(roots) == 161
