import hashlib
from collections import Counter, defaultdict

import pytest

from paragraf.llm import alignment, common
from paragraf.llm.bpe import byte_alphabet


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=common.vocabulary("piece_bpe_32k.model"))


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by plain loops."""
    a, b = libraries()
    alphabet, made, counts = byte_alphabet(), [], Counter()
    for text in texts:
        links, groups = [], []
        if text:
            want = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(k)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for k in ids_b]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                ends = [set(), set()]
                for k, each in enumerate((bytes_a, bytes_b)):
                    at = 0
                    for x in each:
                        ends[k].add(at := at + len(x))
                cuts, groups = sorted(ends[0] & ends[1]), []
                for low, high in zip([0, *cuts], cuts, strict=False):
                    group = []
                    for ids, each in ((ids_a, bytes_a), (ids_b, bytes_b)):
                        at, held = 0, []
                        for k, x in zip(ids, each, strict=True):
                            at += len(x)
                            if low < at <= high:
                                held.append(k)
                        group.append(held)
                    groups.append(group)
                    links.append((group[0][-1], group[1][-1]))
        made.append((groups, links))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for groups, links in made:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text))
    return out, counts, best


TEXTS = [
    "The quick brown fox jumps over the lazy dog, twice.", "", None, " ", "\n\ttabs and\r\nlines  ", "naïve Straße œuvre 東京 🙂 été", "<|endoftext|> <s> </s> <unk> <0x41> plain",
    "a" * 300, "1234567890 12,345.67", "unbelievably internationalization", "▁ is a piece's space", "x\u0000y", "Ünïcödé ́ combining", "The the THE tHe", "don't won't it's", "؟ مرحبا بالعالم",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, id string")


def held(spark, rows, **settings):
    want, counts, best = brute([t for _, t in rows])
    found = alignment.align(frame(spark, rows), with_groups=True, **settings).collect()
    got = sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.groups_sha256) for r in found), key=repr)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert got == sorted(((i, *w, digest(w[6])) for (i, _), w in zip(rows, want, strict=True)), key=repr)
    return counts, best


def test_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0])] * 30 + [(5, TEXTS[5])] * 2 + [(100 + k, f"word{k % 7} and some the more {k}") for k in range(60)]
    counts, best = held(spark, rows, stripes=7, chunk_links=50)
    found = {(r.b, r.a): (r["count"], r.best) for r in alignment.id_pairs(frame(spark, rows), stripes=7).collect()}
    assert found == {(b, a): (n, n == best[b]) for (a, b), n in counts.items()}


def test_spelling():
    """Texts that a vocabulary doesn't spell have no tokens."""
    both = alignment.aligner(common.vocabulary("byte_bpe_50k.json"), common.vocabulary("piece_bpe_32k.model"))
    assert both.tokens("▁ is a piece's space") is None and both.tokens("") is None
    assert both.tokens("plain") is not None
    assert min(both.long_a) > 0 and min(both.long_b) > 0


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t) < 3000]
    held(spark, short[:60])
    found = alignment.op11_alignment(spark, sf_dir)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.count() == len(rows)


def test_long_text(spark):
    text = "".join(f"Clause {k}: nothing in section {k * k} applies. " for k in range(6_000)) + "z" * 30_000
    found = alignment.align(frame(spark, [(1, text), (2, "short")])).collect()
    a, b = libraries()
    r = next(r for r in found if r.id == 1)
    assert (r.n_a, r.n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, None)]])
def test_empty(spark, rows):
    found = alignment.align(frame(spark, rows)).collect()
    assert sorted((r.id is None, r.n_a, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == sorted((i is None, 0, 0, 0, 0, "") for i, _ in rows)
    assert alignment.id_pairs(frame(spark, rows)).collect() == []
