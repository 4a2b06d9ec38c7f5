import math

import pytest

from paragraf.operators import metrics as M

BOOKS = ["StGB", "ZGB", "OR"]


@pytest.fixture
def sides(spark):
    def make(preds, golds):
        p = [(q, r, c) for q, cs in enumerate(preds) for r, c in enumerate(cs, 1)]
        g = [(q, c) for q, cs in enumerate(golds) for c in cs]
        queries = spark.createDataFrame([(q,) for q in range(len(preds))], "query_id int")
        return spark.createDataFrame(p, "query_id int, rank int, citation string"), spark.createDataFrame(g, "query_id int, citation string"), queries

    return make


@pytest.mark.parametrize(("pred", "gold", "expected"), [("AB", "AB", (1, 1, 1)), ("AX", "AB", (0.5, 0.5, 0.5)), ("XY", "AB", (0, 0, 0)), ("", "A", (0, 0, 0)), ("A", "", (0, 1, 0)), ("", "", (1, 1, 1)), ("ABC", "A", (1 / 3, 1, 0.5)), ("A", "ABC", (1, 1 / 3, 0.5)), ("AA", "A", (1, 1, 1))])
def test_f1(sides, pred, gold, expected):
    r = M.per_query(*sides([pred], [gold])).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx(expected)


def test_macro_micro_map(sides):
    args = sides(["A", "X", "BC"], ["A", "Y", "BC"])
    assert M.macro(*args).first().macro_f1 == pytest.approx(2 / 3)
    args = sides(["A", "AB"], ["AC", "A"])
    micro = M.micro(*args).first()
    assert (micro.micro_precision, micro.micro_recall) == pytest.approx((2 / 3, 2 / 3))
    assert M.mean_average_precision(*sides(["ABC", "XAYB"], ["ABC", "AB"])).first().map == pytest.approx(0.75)
    none = sides([], [])
    assert tuple(M.macro(*none).first()) == (0, 0, 0) and M.mean_average_precision(*none).first().map == 0


@pytest.mark.parametrize(("pred", "gold", "expected"), [("ABC", "ABC", 1), ("XAYB", "AB", 0.5), ("AB", "", 0), ("AA", "A", 2.0)])
def test_average_precision(sides, pred, gold, expected):
    assert M.average_precision(*sides([pred], [gold])).first().ap == pytest.approx(expected)


@pytest.mark.parametrize(("pred", "gold", "expected"), [("ABC", "ABC", 1), ("XAB", "AB", (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3))), ("AB", "", 0), ("", "A", 0)])
def test_ndcg(sides, pred, gold, expected):
    assert M.mean_ndcg(*sides([pred], [gold]), 3).first().mean_ndcg == pytest.approx(expected)


@pytest.fixture
def tables(spark):
    submission = [("q1", "Art. 1 ZGB;Art.  1 ZGB;Art. 2 OR"), ("q2", " "), ("q3", None)]
    gold = [("q1", "Art. 1 ZGB;Art. 2 OR;BGE 1 I 2"), ("q2", ""), ("q3", "Art. 9 OR")]
    return spark.createDataFrame(submission, "query_id string, predicted_citations string"), spark.createDataFrame(gold, "query_id string, gold_citations string")


def test_score(tables):
    submission, gold = tables
    row = M.score(submission, gold, BOOKS).first()
    assert row.num_queries == 3 and row.macro_f1 == pytest.approx((0.8 + 1 + 0) / 3) and row.micro_precision == 1 and row.micro_recall == 0.5
    assert M.score(submission, gold, BOOKS, metrics=["f1", "map"]).columns == ["macro_f1", "map"]
    with pytest.raises(M.EvaluationError, match="q3"):
        M.score(submission.where("query_id <> 'q3'"), gold, BOOKS)
    assert M.score(submission.where("query_id <> 'q3'"), gold, BOOKS, strict=False).first().num_queries == 2


def test_competition(spark, tables):
    submission, gold = tables
    assert M.competition(submission, gold).first().score == pytest.approx((0.8 + 1 + 0) / 3)
    for bad, message in ((submission.limit(1), "not in the submission"), (submission.drop("query_id"), "no column"), (submission.selectExpr("*", "1 as x"), "one column"), (submission.selectExpr("query_id", "repeat('a;', 300) as predicted_citations"), "citations, more than"), (submission.selectExpr("query_id", "repeat('a', 10001) as predicted_citations"), "characters, more than")):
        with pytest.raises(M.EvaluationError, match=message):
            M.competition(bad, gold)
    with pytest.raises(M.EvaluationError, match="empty"):
        M.competition(submission, gold.limit(0))


def test_validate(spark, tables):
    assert M.validate(tables[0], BOOKS, "a.CSV") == []
    bad = spark.createDataFrame([("a", "Art. 1 OR"), ("a", "nonsense"), (None, "x;y;z")], "query_id string, predicted_citations string")
    errors = M.validate(bad, BOOKS, "a.txt")
    assert len(errors) == 4 and "a" in errors[2]
    assert "missing" in M.validate(bad.drop("query_id"), BOOKS)[0]


def test_report(sides):
    r = M.report(*sides(["AX"], ["AB"])).first()
    assert (r.tp, r.fp, r.fn) == (["A"], ["X"], ["B"])
