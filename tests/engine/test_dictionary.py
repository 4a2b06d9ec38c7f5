import random
import re

from pyspark.sql import functions as F

from paragraf.functions import citations
from paragraf.operators import dictionary


def made(spark, forms):
    return dictionary.longest_first(spark.createDataFrame([(k, f) for k, f in enumerate(forms)], "ord long, de string"))


def test_every_form_of_every_text(spark):
    rnd = random.Random(3)
    forms = ["".join(rnd.choice("aAbBü") for _ in range(rnd.randint(1, 6))) for _ in range(120)] + [None, "", "1x", "ab", "ab"]
    texts = ["".join(rnd.choice("aAbBü x") for _ in range(rnd.randint(0, 14))) for _ in range(200)] + [None, "", "a"] + ["abba"] * 50
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    order = sorted({f for f in forms if f and not f[0].isdigit()}, key=lambda f: (-len(f), forms.index(f)))
    for any_case in (False, True):
        plain = (lambda x: x.lower()) if any_case else (lambda x: x)
        got = {r.id: r.found for r in dictionary.contained(rows, "text", made(spark, forms), "found", any_case).collect()}
        assert got == {k: [f for f in order if plain(f) in plain(t or "")] for k, t in enumerate(texts)}
    assert all(r.found == [] for r in dictionary.contained(rows, "text", made(spark, [None, "7"]), "found").collect())
    assert dictionary.contained(rows.limit(0), "text", made(spark, forms), "found").count() == 0


def test_case_as_patterns_see_it(spark):
    forms, text = ["Straße", "İX", "ſo", "KG"], "STRASSE straße ix iX SO So kg KG kg"
    row = dictionary.contained(spark.createDataFrame([(1, text)], "id long, text string"), "text", made(spark, forms), "found", True).first()
    assert {"Straße", "KG", "İX"} <= set(row.found)


def test_gold_sets_of_a_dictionary_are_those_of_its_list(spark):
    rnd = random.Random(4)
    forms = ["OR", "ZGB", "StGB", "B", "al", "ORG", "a.b", "Abs"] + [f"X{k}Y" for k in range(40)]
    order = sorted(forms, key=lambda f: (-len(f), forms.index(f)))
    parts = ["Art. 5 OR", "art 6a abs. 2 zgb", "Art. 7 lit. b StGB", "Art.8 al. 3 X7Y", "Art. 9 Abs. 1 lit. a", "BGE 116 Ia 56 E. 2b", "Art. 3 ORG", "Art. 1 a.b", "Art. 2 axb", "Art. 4 X99Y", "B"]
    rows = spark.createDataFrame([(k, " ".join(rnd.choice(parts) for _ in range(4))) for k in range(80)], "id long, text string")
    found = dictionary.contained(rows, "text", made(spark, forms), "any", True)
    for r in found.select("text", citations.gold_citations("text", F.col("any")).alias("a"), citations.gold_citations("text", order).alias("b"), citations.normalize("text", F.col("any"))["canonical_id"].alias("c"), citations.normalize("text", order)["canonical_id"].alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.text


def test_plans_hold_no_forms(spark):
    rows = spark.createDataFrame([(1, "Art. 5 X17Y")], "id long, text string")
    plans = []
    for n in (100, 4000):
        found = dictionary.contained(rows, "text", made(spark, [f"X{k}Y" for k in range(n)]).checkpoint(), "books")
        assert found.first().books == ["X17Y"]
        plans.append(found.select(citations.normalize("text", F.col("books")))._jdf.queryExecution().optimizedPlan().toString())
    assert re.sub(r"\d+", "", plans[0]) == re.sub(r"\d+", "", plans[1])


def test_forms_of_one_start_are_not_tried_one_by_one(spark, monkeypatch):
    """A dictionary that isn't broadcast, whose forms all begin alike: a text meets those it holds, and nothing is broadcast by estimate."""
    forms = [f"PX{k}G" for k in range(3000)]
    rows = spark.range(400).selectExpr("id", "concat('so PX', id, 'G und PX', id + 7, 'g') as text")
    monkeypatch.setattr(dictionary, "BROADCAST_FORMS", 100)
    found = dictionary.contained(rows, "text", made(spark, forms), "found", any_case=True)
    assert {r.id: r.found for r in found.collect()} == {k: sorted([f"PX{k}G", f"PX{k + 7}G"], key=lambda f: (-len(f), int(f[2:-1]))) for k in range(400)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("BroadcastHashJoin") == 1  # with the ten starts alone


def test_long_texts_are_searched_in_pieces(spark):
    size = dictionary.PIECE
    texts = ["x" * (size - at) + "ABCDE" + "y" * size * 2 + "Q" for at in range(7)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert all(r.found == ["ABCDE", "Q"] for r in dictionary.contained(rows, "text", made(spark, ["ABCDE", "Q", "ABCDF"]), "found").collect())
