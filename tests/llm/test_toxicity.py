import random
import zlib

import pytest
from pyspark.sql import functions as F

from paragraf.llm import toxicity as T
from paragraf.llm import transducers


@pytest.fixture(scope="module")
def grammar():
    return T.Grammar(T.seeds() | {"blorg*": 4.0})


CLAUSES = [
    ("you are an idiot", (0, 0, 0, 4, 0)), ("an idiot", (4, 0, 0, 0, 0)), ("not an idiot", (0, 4, 0, 0, 0)), ("he said idiot", (0, 0, 4, 0, 0)), ('she wrote "what an idiot", well', (0, 0, 4, 0, 0)),
    ("the idiot wrote to you", (0, 0, 0, 4, 0)), ("i will kill you", (0, 0, 0, 0, 1)), ("i will never kill you", (0, 0, 0, 0, 0)), ("kill the lights", (0, 0, 0, 0, 0)), ("he said. idiot", (4, 0, 0, 0, 0)),
    ("no. idiot moron", (8, 0, 0, 0, 0)), ("blorgen and blorg", (4, 0, 0, 0, 0)), ("nothing here", (0, 0, 0, 0, 0)), ("", (0, 0, 0, 0, 0)), ("idiot " * 10, (12, 0, 0, 0, 0)),
]


@pytest.mark.parametrize(("text", "expected"), CLAUSES)
def test_transducers(grammar, text, expected):
    assert grammar.outputs(text) == expected


def test_composition_does_what_the_five_do_one_after_another():
    rnd, cascade, one = random.Random(2), T.cascade(), T.grammar_machine()
    for _ in range(3000):
        line = [rnd.choice(range(8)) for _ in range(rnd.randint(0, 40))]
        made = line
        for each in cascade:
            made, _ = each.run(made)
        assert one.run(line)[0] == made


def test_minimal_machines():
    twice = transducers.machine(0, "ab", lambda n, s: ((n + 1) % 6, s if n % 2 else None))
    least = transducers.minimal(twice)
    assert len(twice.moves) == 6 and len(least.moves) == 2 and least.run("aabbab")[0] == twice.run("aabbab")[0]
    whole = transducers.compose(T.cascade()[0], T.cascade()[1])
    small = transducers.minimal(whole)
    assert len(small.moves) <= len(whole.moves) and len(transducers.minimal(small).moves) == len(small.moves)


def rules(clause, quoted):
    """The grammar's rules, word by word, without tables: what a clause puts out, and whether a quotation stays open."""
    out, words, report = [0.0] * 5, [], False
    for s, w in clause:  # (symbol, weight, reported), without quotation marks
        if s == T.QUOTE:
            quoted = not quoted
            continue
        words.append((s, w, quoted or report))
        report |= s == T.REPORT
    near = lambda k, kind, n: [j for j in range(max(0, k - n), k) if words[j][0] == kind]
    negated = [bool(near(k, T.NEGATION, T.NEGATION_REACH)) for k in range(len(words))]
    threats, fired = [], []
    for k, (s, _, spoken) in enumerate(words):
        if s == T.THREAT and not near(k, T.NEGATION, T.NEGATION_REACH - 1):
            threats.append(k)
        if s == T.TARGET and not spoken and not negated[k] and any(k - j <= T.TARGET_REACH for j in threats):
            fired.append(k)
            threats.clear()
    out[4] = float(len(fired))
    for k, (s, w, spoken) in enumerate(words):
        if s != T.INSULT:
            continue
        later = [j for j in range(k + 1, min(len(words), k + T.TARGET_REACH + 1)) if words[j][0] == T.TARGET or words[j][0] == T.INSULT and not (words[j][2] or negated[j] or near(j, T.TARGET, T.TARGET_REACH))]
        aimed = near(k, T.TARGET, T.TARGET_REACH) or later and words[later[0]][0] == T.TARGET
        out[2 if spoken else 1 if negated[k] else 3 if aimed else 0] += w
    return [min(x, T.CLAUSE_CAP) for x in out], quoted


def test_outputs_by_brute_force(grammar):
    rnd = random.Random(4)
    words = ["idiot", "moron", "kill", "you", "them", "not", "never", "said", '"', ".", "the", "house", "tree", "is"]
    for _ in range(3000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))
        expected, quoted, clause = [0.0] * 5, False, []
        for token in [*T.text_tokens(text), "."]:
            symbol = grammar.symbol(token)
            if symbol[0] != T.END:
                clause.append(symbol)
                continue
            made, quoted = rules(clause, quoted)
            expected, clause = [a + b for a, b in zip(expected, made, strict=True)], []
        assert grammar.outputs(text) == tuple(expected), text


def test_weights_stand_for_repeats():
    import numpy as np

    rnd = np.random.default_rng(1)
    x, y, n = rnd.random((30, 5)), rnd.integers(0, 2, 30).astype(float), rnd.integers(1, 9, 30)
    flat = lambda f: [f[0], *f[1]]
    once = T._factors(np.repeat(x, n, axis=0), np.repeat(y, n), np.ones(n.sum()))
    assert flat(T._factors(x, y, n.astype(float))) == pytest.approx(flat(once), abs=1e-5)


def test_scores_are_ordered(grammar):
    plain, negated, aimed = (grammar.score(t) for t in ("an idiot and a moron", "not an idiot", "you idiot, you moron"))
    assert negated < plain < aimed and 0 < grammar.score("") < 0.5 < aimed < 1


def test_held_out_as_crc(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(50), -3, None]], "doc_id long").select("doc_id", T.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == T.is_held_out(r.doc_id) for r in rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = T.op10_toxicity(spark, folder)
    assert scored.count() == 10_000
    both = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    r = both.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrongly"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right >= 0.97 and r.wrongly <= 0.02 and 0 <= r.low <= r.high <= 1


def test_lexicon_learns_inflected_words_and_not_copies(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("klmnr") for _ in range(rnd.randint(2, 4)))
    text = lambda: " ".join(word() for _ in range(60))
    docs = [(k, text()) for k in range(400)]
    docs += [(1000 + k, text() + f" zzqx{word()} " + text() + f" zzqx{word()} " + text()) for k in range(80)]
    docs += [(2000 + k, "copied uniqueword text that is toxic for no reason") for k in range(40)]
    labels = [(k, int(k >= 1000)) for k, _ in docs]
    learned = T.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zzqx*" in learned.terms and "uniqueword" not in learned.terms
    assert learned.score(text() + " zzqxaka") > 0.5 > learned.score(text())


def test_the_grammar_of_the_table_scores_the_right_way_round(spark):
    grammar = T.grammar_for(spark, "/root/testdata/sf0.1")
    plain, negated, reported, directed, threat = grammar.factors
    assert 0 < reported <= negated < plain <= directed and grammar.bias + threat > 0
    toxic = ["You are an idiot.", "you idiot", "The idiot left.", "I will kill you.", "We will hurt them, they know.", "Those are worthless scum."]
    clean = ["You are not an idiot.", "He said you are an idiot.", 'She wrote "you idiot" on it.', "I will never hurt you.", "kill the lights", "He is no moron.", "They never called him stupid.", "It was reported that clown is worthless."]
    assert [t for t in toxic if grammar.score(t) < 0.5] == [] == [t for t in clean if grammar.score(t) >= 0.5]
    assert grammar.score("You are not an idiot.") < grammar.score("The idiot left.") < grammar.score("You are an idiot.")
    # what words alone say of the same sentences
    alone = lambda text: grammar.bias + plain * sum(w for _, w in map(grammar.symbol, T.text_tokens(text)))
    wrong = [t for t in toxic if alone(t) < 0] + [t for t in clean if alone(t) >= 0]
    assert len(wrong) >= 6


def test_lists_are_widened_by_counts(spark):
    """Labelled sentences that the insult lexicon alone can't tell apart, with words that the seeds don't have."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("klmnr") for _ in range(rnd.randint(2, 4)))
    text = lambda n=20: " ".join(word() for _ in range(n)) + "."
    docs, insults = [], ["idiot", "scum", "moron"]
    for k in range(900):
        bad = rnd.choice(insults)
        kind = k % 6
        said = {0: f"zu {bad} {word()}", 1: f"nonn {bad}", 2: f"dixit {word()} {word()} {word()} {bad}", 3: f"zerleg {word()} du", 4: f"zerleg {word()}. {word()} du {word()}", 5: f"du {word()} zu {word()} nonn {word()}. dixit {word()} du"}[kind]
        docs.append((k, text() + " " + said + ". " + text() + (f" {bad} {word()}. {word()} {bad}." if kind == 0 else ""), int(kind in (0, 3))))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    learned = T.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    for each, kind in (("nonn", T.NEGATION), ("dixit", T.REPORT), ("zerleg", T.THREAT)):
        assert learned.words.get(each) == kind, learned.words
    assert set(learned.words) <= {"nonn", "dixit", "zerleg", "zu"}
    assert learned.score("Zerleg ola du.") > 0.5 > max(learned.score("zerleg ola"), learned.score("ola du"))


def test_edges(spark, docs):
    rows = [(1, None), (1, None), (None, "you idiot"), (2, ""), (3, "idiot " * 50_000), (4, "x" * 200_000)]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    grammar = T.learn(docs(rows), empty)
    frame = docs(rows).withColumn("_score", F.lit("clash")).withColumn("_text", F.lit("clash")).withColumn("Text_To_Score", F.lit(1))
    got = T.score(frame, grammar).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "text", "fp", "id", "_score", "_text", "Text_To_Score"} and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if not r.text}) == 1
    assert T.score(frame.limit(0), grammar).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 7), (2, 1)], "doc_id long, toxic int")
    assert 0 < T.learn(docs(rows), odd).score("") < 0.5
