import pytest
from pyspark.sql import functions as F

from paragraf import sources
from paragraf.operators import agent, corpus, fusion


def test_merge_equal_texts(spark):
    rows = spark.createDataFrame([(0, "Art. 1", " t "), (1, "Art. 10", "t"), (2, "Art. 1", "t"), (3, None, "u"), (4, "B", "u"), (5, "C", None), (6, "D", "")], "ord int, citation string, text string")
    got = {r.ord: (r.citation, r.text) for r in corpus.merge_equal_texts(rows).collect()}
    assert got == {0: ("Art. 1; Art. 10", " t "), 3: ("; B", "u"), 5: ("C; D", None)}


def test_enriched(spark):
    rows = spark.createDataFrame([(0, "Art. 1", "Art. 1: body"), (1, "Art. 1", "Art. 10 body"), (2, None, "body"), (3, "Art. 1", "Art. 1")], "i int, c string, t string")
    got = [r.x for r in rows.orderBy("i").select(corpus.enriched("c", "t", F.when(F.col("i") == 1, F.lit("s"))).alias("x")).collect()]
    block = "\n\n<metadata>\nZitat: Art. 1\n</metadata>"
    assert got == ["body" + block, "Art. 10 body\n\n<metadata>\nZitat: Art. 1\nZusammenfassung: s\n</metadata>", "body", "Art. 1" + block]


def test_summaries(spark):
    docs = spark.createDataFrame([("a", "x" * 10), ("b", "y" * 10)], "citation string, text string")
    cache = spark.createDataFrame([("a", "known")], "citation string, summary string")
    got = {r.citation: r.summary for r in corpus.summaries(docs, cache, str.upper, limit=4).collect()}
    assert got == {"a": "known", "b": "YYYY"}


def test_summaries_are_upper_cased_as_in_sql(spark, tmp_path):
    import duckdb

    from paragraf import plans

    texts = ["straße und mehr", "ŉǰﬁ éàü", None, "x" * 4000, "İıſ", "", "más"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert "upper(" in plans.oracle_sql()["q_summaries"]
    got = sorted((r.citation, r.summary) for r in plans.queries()["q_summaries"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(plans.oracle_sql()["q_summaries"]).fetchall())
    assert any(s.startswith("XXXXXXXXXX") for _, s in got)


def test_blocks(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, list("cdefg"))], "doc_id int, tokens array<string>")
    got = {r.block: r.tokens for r in corpus.token_blocks(rows, 4, "$").collect()}
    assert got == {0: ["a", "b", "$", "$"], 1: ["c", "d", "e", "f"]}
    assert corpus.token_blocks(rows.limit(0), 4).count() == 0


def test_pairs(spark):
    gold = spark.createDataFrame([("q", "a"), ("q", "zz"), ("r", "zz"), ("s", "a"), ("s", "b"), ("s", "c")], "query_id string, citation string")
    queries = spark.createDataFrame([(q, "case " + q) for q in "qrs"], "query_id string, query string")
    texts = spark.createDataFrame([(c, "t" + c) for c in "abc"], "citation string, text string")
    got = corpus.preference_pairs(gold, queries, texts, "S").collect()
    assert sorted((r.query_id, r.citation) for r in got if r.positive) == [("q", "a"), ("s", "a"), ("s", "b"), ("s", "c")]
    negative = [r for r in got if not r.positive]
    assert [r.query_id for r in negative] == ["q"] and negative[0].citation in "bc" and negative[0].chosen == corpus.NOT_RELEVANT
    assert got[0].prompt.startswith("S\n\nRechtsfall:\ncase ")


def test_gold_sets(spark):
    rows = spark.createDataFrame([("Frage Art. 5 Abs. 1 OR", "BGE 1 I 2 E. 3"), ("leer", None), ("x", "BGE 7 I 7")], "question string, answer string")
    courts = spark.createDataFrame([("BGE 1 I 2 E. 3",)], "citation string")
    got = sorted((r.query_id, r.gold_citations) for r in corpus.gold_sets(rows, ["OR"]).collect())
    assert [q for q, _ in got] == ["train_0001", "train_0002"] and {g for _, g in got} == {"Art. 5 Abs. 1 OR;BGE 1 I 2 E. 3", "BGE 7 I 7"}
    assert [r.gold_citations for r in corpus.gold_sets(rows, ["OR"], courts).collect()] == ["Art. 5 Abs. 1 OR;BGE 1 I 2 E. 3"]


def test_split_is_stable(spark):
    rows = spark.range(5000)
    train, held = corpus.split(rows, "id")
    assert train.count() + held.count() == 5000 and 50 < held.count() < 160
    assert {r.id for r in held.collect()} == {r.id for r in corpus.split(rows.repartition(7), "id")[1].collect()}


def test_agent_parsing(spark):
    text = "Thought: a\nAction: Search\nAction Input: x y \nAction: other\nAction Input: z\nFinal Answer: one\ntwo "
    r = spark.createDataFrame([(text,)], "c string").select(agent.action("c").alias("a"), agent.all_actions("c").alias("all"), agent.final_answer("c").alias("f")).first()
    assert tuple(r.a) == ("Search", "x y") and [tuple(x) for x in r.all] == [("Search", "x y"), ("other", "z\nFinal Answer: one\ntwo")] and r.f == "one\ntwo"
    r = spark.createDataFrame([("Action: only",), (None,)], "c string").select(agent.action("c").alias("a"), agent.final_answer("c").alias("f"), agent.tool_arguments("c").alias("j")).collect()
    assert all(x.a is None and x.f is None and x.j == {} for x in r)


def test_agent_loop(spark):
    docs = spark.createDataFrame([(0, "Art. 1 OR", "t")], "doc_id int, citation string, text string")

    def tool(calls):
        hits = calls.select("query_id", F.lit(1).alias("rank"), F.lit(0).alias("doc_id"), F.lit(1.0).alias("score"))
        return fusion.formatted(calls, hits, docs)

    def model(prompts):
        return ["no action at all" if "stop" in p else "Final Answer: BGE 1 I 2" if "Observation" in p else "Action: search\nAction Input: x\n" if "go" in p else "Action: fly\nAction Input: y\n" for p in prompts]

    queries = spark.createDataFrame([(1, "go"), (2, "stop"), (3, "lost")], "query_id int, query string")
    answers, log = agent.run(queries, model, {"search": tool}, "{query}", 3)
    got = {r.query_id: (r.answer, r.iterations, r.citations) for r in answers.collect()}
    assert got == {1: ("BGE 1 I 2", 2, ["Art. 1 OR", "BGE 1 I 2"]), 2: (None, 1, []), 3: ("BGE 1 I 2", 2, ["BGE 1 I 2"])}
    assert "Unknown tool" in log.where("query_id = 3 and iteration = 1").first().observation


def test_relevance_fails_open(spark):
    rows = spark.createDataFrame([(1, "a", 1, "p"), (1, "a", 2, "q"), (1, "b", 3, "r")], "query_id int, citation string, rank int, prompt string")

    def broken(prompts):
        raise RuntimeError

    assert agent.relevant(rows, broken).count() == 2 and agent.relevant(rows, broken, on_error="drop").count() == 0
    assert [r.citation for r in agent.relevant(rows, lambda p: ["JA" if x == "r" else "nein" for x in p]).collect()] == ["b"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text('citation,text\n"BGE 1 I 2","eine\nZeile ""x"""\nArt. 1,\n', encoding="utf-8")
    rows = sources.read_corpus_csv(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()
    assert [(r.citation, r.text, r.title) for r in rows] == [("BGE 1 I 2", 'eine\nZeile "x"', ""), ("Art. 1", "", "")]
    assert sources.read_corpus_csv(spark, str(tmp_path / "c.csv"), 1).count() == 1
    (tmp_path / "c.jsonl").write_text('{"citation":"ä","text":"b"}\n\n{"citation":"c"}\n', encoding="utf-8")
    assert sources.read_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 2
    sources.write_jsonl(spark.createDataFrame([("ä",)], "c string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().c == "ä"
    predictions = spark.createDataFrame([("q1", ["a", "b"]), ("q2", [])], "query_id string, citations array<string>")
    sources.write_submission(predictions, str(tmp_path / "s"))
    back = {r.query_id: r.predicted_citations for r in sources.read_submission(spark, str(tmp_path / "s")).collect()}
    assert back["q1"] == "a;b" and back["q2"].strip() == ""
    with pytest.raises(sources.MissingColumns):
        sources.read_gold(spark, str(tmp_path / "s"))
    (tmp_path / "a.json").write_text('[{"id":"x","abbrev":{"de":"OR","fr":"CO"}},{"id":"y","abbrev":{"de":null}}]')
    assert [(r.id, r.de, r.it) for r in sources.read_abbreviations(spark, str(tmp_path / "a.json")).orderBy("ord").collect()] == [("x", "OR", None), ("y", None, None)]
    assert sources.first_path(spark, str(tmp_path / "none"), str(tmp_path / "a.json")).endswith("a.json")


def test_tool_calling_agent(spark):
    import json

    from paragraf.operators import toolcalls

    docs = spark.createDataFrame([(0, "BGE 1 I 2 E. 1", "Dazu Art. 5 OR und Art. 6 ZGB."), (1, "Art. 9 OR", "nichts")], "doc_id int, citation string, text string")

    def find(queries, k):
        return queries.where("query <> 'leer'").select("query_id", F.lit(1).alias("rank"), F.when(F.col("query") == "gericht", 0).otherwise(1).alias("doc_id"), F.lit(1.0).alias("score"))

    kind = "src string, dst string, src_label string, dst_label string, rel_type string, weight double, tf int"
    edges = spark.createDataFrame([("BGE 1 I 2", "BGE 7 I 7", "Case", "Case", "CITES", 1.5, 1)], kind)
    nodes = spark.createDataFrame([("BGE 1 I 2", "Case", "a"), ("BGE 7 I 7", "Case", "b")], "id string, label string, text string")
    tools = {"search_courts": toolcalls.search_tool(find, docs, "courts", in_texts=True), "search_laws": toolcalls.search_tool(find, docs), "explore": toolcalls.explore_tool(edges, nodes)}

    def model(prompts):
        def one(p):
            if "Observation" in p:
                return {"text": "Am Ende BGE 3 II 4 und Art. 1 OR", "calls": []}
            if p.startswith("a"):
                return {"calls": [{"name": "search_courts", "arguments": {"query": "gericht"}}, {"name": "explore", "arguments": {"citation_id": "BGE 1 I 2"}}, {"name": "fly", "arguments": {}}]}
            return {"calls": [{"name": "search_laws", "arguments": {"query": "recht" if p == "b" else "leer"}}]}

        if any(p == "broken" for p in prompts):
            raise RuntimeError
        return [json.dumps(one(p)) for p in prompts]

    def judge(prompts):
        return ["NEIN" if "Art. 6 ZGB\n" in p or "\nArt. 1 OR" in p else "JA" for p in prompts]

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, query string")
    found, log = toolcalls.run(queries, model, tools, judge)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.citation)
    assert got == {1: {"BGE 1 I 2 E. 1", "Art. 5 OR", "BGE 7 I 7", "BGE 3 II 4"}, 2: {"Art. 9 OR", "BGE 3 II 4"}, 3: {"BGE 3 II 4"}}
    acts = sorted((r.query_id, r.iteration, r.action) for r in log.collect())
    assert acts == [(1, 1, "explore"), (1, 1, "fly"), (1, 1, "search_courts"), (1, 2, "final"), (2, 1, "search_laws"), (2, 2, "final"), (3, 1, "search_laws"), (3, 2, "final")]
    assert "No relevant" in log.where("query_id = 3 and iteration = 1").first().observation and "BGE 7 I 7" in log.where("action = 'explore'").first().observation
    broken, _ = toolcalls.run(spark.createDataFrame([(1, "broken")], "query_id int, query string"), model, tools, judge)
    assert broken.isEmpty()


def test_log_files(spark, tmp_path):
    log = spark.createDataFrame([(1, 2.0, ["a"], 3), (2, None, None, 1)], "query_id int, seconds double, citations array<string>, iterations int")
    assert corpus.log_summary(log).first().asDict() == {"queries": 2, "seconds_mean": 1.0, "seconds_total": 2.0, "citations_mean": 0.5, "iterations_mean": 2.0}
    sources.write_log(log, str(tmp_path / "l"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "l"))
    assert {r.citations for r in back.collect()} == {'["a"]', None}
    (tmp_path / "c.csv").write_text("citation,text,title\nA,b,c\n")
    assert sources.convert(spark, str(tmp_path / "c.csv"), str(tmp_path / "p")).first().text == "b"
