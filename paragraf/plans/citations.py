"""Queries of the citation language over texts made from orders, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import abbreviations as A
from ..functions import citations as C
from ..functions import text as T
from ..operators import dictionary
from ..sources import spread
from .retrieval import ints, table

BOOKS = list(A.SEED)
_ROMAN = ("I", "II", "III", "IV", "V", "Ia")


def _n(c: str) -> Column:
    return F.expr(c).cast("string")


def _texts(spark, sf_dir):
    roman = F.element_at(F.array(*[F.lit(x) for x in _ROMAN]), F.expr("cast(o_orderkey % 6 + 1 as int)"))
    v, p, a = _n("o_custkey % 150 + 1"), _n("o_orderkey % 900 + 1"), _n("o_custkey % 50 + 1")
    case = F.concat(F.lit(" "), v, F.lit(" "), roman, F.lit(" "), p)
    text = F.concat(
        F.lit("Nach BGE"), case, F.lit(" E. 2.1 und Art. "), a, F.lit(" Abs. "), _n("o_orderkey % 4 + 1"), F.lit(" OR, bestätigt in bge  "), v, F.lit(" "), roman, F.lit(" "), p,
        F.lit(" S. 7 f., gilt Art. 95 lit. a, b und c BGG. Siehe Urteil 1C_"), _n("o_orderkey % 500 + 1"), F.lit("/2011 sowie Art. "), a, F.lit("a ZGB; SR 210 Art. 3). So auch Art. 4 Abs. 2 StGB.\nEnde"),
    )
    form = F.element_at(
        F.array(
            F.concat(F.lit("  Art.  "), a, F.lit(" Abs. 2  OR ")), F.concat(F.lit("Artikel "), a, F.lit("a lit. b ZGB")), F.concat(F.lit("BGE"), case, F.lit(" E. 5.3.1")), F.lit("no such thing"),
            F.concat(F.lit("bge"), case, F.lit(" cons. 2b")), F.concat(F.lit("art "), a, F.lit("bis BV al. 2a")), F.concat(F.lit("BGE"), case, F.lit(" E. 1b/gg")), F.lit("StGB"),
        ),
        F.expr("cast(o_orderkey % 8 + 1 as int)"),
    )
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", text.alias("text"), form.alias("form"))


def _list(c: Column, name: str) -> Column:
    return F.array_join(F.array_sort(c), "|").alias(name)


def q_extract_bge(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", _list(C.bge_citations("text"), "cases"))


def q_count_citations(spark, sf_dir):
    return C.count_mentions(_texts(spark, sf_dir), "o_orderkey", "text", C.CASE_KINDS + ("Art.",))


def q_case_id(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", C.case_id("form").alias("case_id"))


def _dictionary(spark, sf_dir):
    """The seed's books and some thousands more, made of parts and customers: (form, ord)."""
    seed = spark.createDataFrame([(k, b) for k, b in enumerate(BOOKS)], "ord long, de string")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("G")).alias("de"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10**12).alias("ord"), F.concat(F.lit("K"), F.col("c_custkey").cast("string"), F.lit("Vo")).alias("de"))
    return dictionary.longest_first(seed.unionByName(parts).unionByName(customers))


def q_dictionary(spark, sf_dir):
    """Citations of books of a dictionary, some unknown, some within longer ones, as gold sets and as one normalised citation."""
    book = F.concat(F.lit("P"), F.expr("o_orderkey % 3000 + 1").cast("string"), F.when(F.col("o_custkey") % 3 == 0, F.lit("g")).otherwise(F.lit("G")))
    other = F.concat(F.lit("xK"), F.expr("o_custkey % 2500 + 1").cast("string"), F.lit("Vox"))
    text = F.concat(F.lit("Art. "), _n("o_custkey % 50 + 1"), F.lit(" Abs. 2 "), book, F.lit(", "), other, F.lit(" und ART 7a al. 3 "), F.substring(other, F.lit(2), F.lit(20)))
    forms = _dictionary(spark, sf_dir)
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", text.alias("text"))
    rows = dictionary.contained(dictionary.contained(rows, "text", forms, "any", any_case=True), "text", forms, "exact")
    c = C.normalize("text", F.col("exact"))
    return rows.select("o_orderkey", F.array_join("exact", "|").alias("exact"), F.array_join(C.gold_citations("text", F.col("any")), "|").alias("gold"), c["canonical_id"].alias("canonical_id"), c["book"].alias("book"))


def q_normalize(spark, sf_dir):
    c = C.normalize("form", F.col("books"))
    return dictionary.contained(_texts(spark, sf_dir), "form", _dictionary(spark, sf_dir), "books").select("o_orderkey", *[c[x].alias(x) for x in ("citation_type", "canonical_id", "volume", "section", "page", "consideration", "book", "article", "paragraph")])


def q_equivalent(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", C.equivalent("form", F.concat(F.lit("siehe "), "form"), BOOKS).alias("same"))


def q_parse_list(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", F.array_join(C.parse_list(F.concat_ws(" ; ", "form", F.lit("Art. 1 OR"), F.lit(""), F.lit("Art. 1  OR"), "form"), BOOKS), "|").alias("items"))


def q_court_text_articles(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", _list(C.court_text_articles("text"), "articles"))


def q_free_text_citations(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", _list(C.free_text_citations("text"), "citations"))


def q_output_citations(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", _list(C.output_citations("text"), "citations"))


def q_gold_citations(spark, sf_dir):
    rows = dictionary.contained(_texts(spark, sf_dir), "text", _dictionary(spark, sf_dir), "books", any_case=True)
    return rows.select("o_orderkey", F.array_join(C.gold_citations("text", F.col("books")), "|").alias("citations"))


def q_citation_field(spark, sf_dir):
    return C.citation_columns(_texts(spark, sf_dir)).select("o_orderkey", "citation_field")


def q_expand_letters(spark, sf_dir):
    cites = F.concat(F.lit("Art.  "), _n("o_orderkey % 90 + 1"), F.lit(" Abs. 1 lit. a, b  und d BGG"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(C.expand_letters(F.when(F.col("o_orderkey") % 2 == 0, cites).otherwise(F.lit("Art. 3  OR")))).alias("citation"))


def q_context_window(spark, sf_dir):
    """The context of each document's middle word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("at"))
    made = docs.select("doc_id", C.context_around("text", "at", F.substring("text", F.col("at") + 1, F.lit(6))).alias("summary"))
    return made.select("doc_id", F.md5("summary").alias("digest"), F.length("summary").alias("n"))


def q_line_citations(spark, sf_dir):
    text = F.concat(F.lit("Thought: BGE 1 I 1\n - Art. 5 OR\n* "), "form", F.lit("\nkeine\n3. SR 210\nfinal answer: Art. 1 ZGB\n12) 4A_2/2020"))
    return _texts(spark, sf_dir).select("o_orderkey", F.array_join(C.line_citations(text), "|").alias("lines"))


def q_abbreviations(spark, sf_dir):
    """Nations as a dictionary: names in upper, lower and mixed case as three languages."""
    words = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("de"), F.lower("n_name").alias("fr"), F.initcap("n_name").alias("it"))
    wanted = words.select(F.explode(F.array("id", "fr", F.concat("it", F.lit("x")))).alias("abbreviation"))
    return A.translations(wanted, words)


def q_extract_all(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", F.explode(C.extract("text")).alias("c")).select("o_orderkey", "c.raw", "c.type", "c.canonical", "c.position")


def q_case_citations(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", _list(C.case_citations("text"), "cases"))


def q_cited_with_context(spark, sf_dir):
    rows = _texts(spark, sf_dir).select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("citation"), F.when(F.col("o_orderkey") % 10 == 0, F.col("form")).otherwise(F.col("text")).alias("text"))
    return C.cited_with_context(rows)


def q_tokens_strip(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", T.collapse("form").alias("flat"), T.truncate("text", 40).alias("short"))


QUERIES = {f.__name__: f for f in (q_extract_bge, q_count_citations, q_case_id, q_dictionary, q_normalize, q_equivalent, q_parse_list, q_court_text_articles, q_free_text_citations, q_output_citations, q_gold_citations, q_citation_field, q_expand_letters, q_context_window, q_line_citations, q_abbreviations, q_extract_all, q_case_citations, q_cited_with_context, q_tokens_strip)}

_TEXTS = r"""
parts AS (SELECT o_orderkey, ' ' || (o_custkey % 150 + 1) || ' ' || ['I', 'II', 'III', 'IV', 'V', 'Ia'][CAST(o_orderkey % 6 + 1 AS INTEGER)] || ' ' || (o_orderkey % 900 + 1) AS c, (o_custkey % 50 + 1) AS a FROM orders),
texts AS (SELECT o_orderkey, 'Nach BGE' || c || ' E. 2.1 und Art. ' || a || ' Abs. ' || (o_orderkey % 4 + 1) || ' OR, bestätigt in bge ' || c || ' S. 7 f., gilt Art. 95 lit. a, b und c BGG. Siehe Urteil 1C_' || (o_orderkey % 500 + 1)
    || '/2011 sowie Art. ' || a || 'a ZGB; SR 210 Art. 3). So auch Art. 4 Abs. 2 StGB.' || chr(10) || 'Ende' AS text,
  ['  Art.  ' || a || ' Abs. 2  OR ', 'Artikel ' || a || 'a lit. b ZGB', 'BGE' || c || ' E. 5.3.1', 'no such thing', 'bge' || c || ' cons. 2b', 'art ' || a || 'bis BV al. 2a', 'BGE' || c || ' E. 1b/gg', 'StGB'][CAST(o_orderkey % 8 + 1 AS INTEGER)] AS form
  FROM parts)"""
_FLAT = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_CASE = lambda c: rf"regexp_replace(regexp_extract({c}, '(?i)BGE\s+(\d+)\s+([IVX]+[a-z]?)\s+(\d+)'), '(?i)^BGE\s+(\d+)\s+([IVX]+[a-z]?)\s+(\d+)$', 'BGE \1 \2 \3')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _normal(c: str) -> str:
    """SQL of (type, id, ...) columns of a column of raw citations; books longest first."""
    first = "list_filter([" + ", ".join(f"'{b}'" for b in BOOKS) + f"], lambda b: contains({c}, b))[1]"
    g = lambda n: f"regexp_extract({c}, '(?i){C.FULL_BGE}', {n})"
    return rf"""{g(1)} AS v, {g(2)} AS s, {g(3)} AS p, nullif({g(4)}, '') AS k, CASE WHEN {g(1)} = '' THEN {first} END AS b,
  'Art. ' || nullif(regexp_extract({c}, '(?i)(?:Art\.?|Artikel)\s*(\d+[a-z]?)(?:[^a-zA-Z]|$)', 1), '') AS a, 'Abs. ' || nullif(regexp_extract({c}, '(?i)(?:Abs\.?|Absatz|al\.?|cpv\.?)\s*(\d+[a-z]?)', 1), '') AS g"""


_ID = "CASE WHEN v <> '' THEN 'BGE ' || v || ' ' || s || ' ' || p || coalesce(' E. ' || k, '') WHEN b IS NOT NULL THEN concat_ws(' ', a, g, b) END"


def _all(pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_extract_all(text, '{flags}{_q(pattern)}')"


def _sorted(expr: str, name: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({expr})), '|'), '') AS {name}"


_DISTINCT = "list_filter({x}, lambda y, i: NOT list_contains({x}[1:i - 1], y))"

SQL = {
    "q_extract_bge": f"WITH {_TEXTS} SELECT o_orderkey, {_sorted(f'list_transform({_all(C.BGE)}, lambda x: {_CASE(_FLAT(chr(120)))})', 'cases')} FROM texts",
    "q_count_citations": f"""WITH {_TEXTS},
found AS (SELECT o_orderkey, {_CASE(_FLAT('x'))} AS citation FROM (SELECT o_orderkey, unnest({_all(C.BGE)}) AS x FROM texts)
  UNION ALL SELECT o_orderkey, {_FLAT('x')} FROM (SELECT o_orderkey, unnest({_all(C.DOCKET)}) AS x FROM texts)
  UNION ALL SELECT o_orderkey, {_FLAT('x')} FROM (SELECT o_orderkey, unnest({_all(C.ARTICLE)}) AS x FROM texts))
SELECT o_orderkey, citation, count(*) AS tf FROM found GROUP BY ALL""",
    "q_case_id": f"WITH {_TEXTS} SELECT o_orderkey, nullif({_CASE('form')}, '') AS case_id FROM texts",
    "q_dictionary": r"""
WITH forms AS (SELECT form, row_number() OVER (ORDER BY length(form) DESC, ord) AS n FROM (SELECT * FROM (VALUES ('SchKG', 0), ('StGB', 1), ('StPO', 2), ('ZGB', 3), ('BGG', 4), ('ZPO', 5), ('OR', 6), ('BV', 7)) v(form, ord)
  UNION ALL SELECT 'P' || p_partkey || 'G', 1000 + p_partkey FROM part UNION ALL SELECT 'K' || c_custkey || 'Vo', 1000000000000 + c_custkey FROM customer)),
t AS (SELECT o_orderkey, 'Art. ' || (o_custkey % 50 + 1) || ' Abs. 2 P' || (o_orderkey % 3000 + 1) || CASE WHEN o_custkey % 3 = 0 THEN 'g' ELSE 'G' END AS first, 'xK' || (o_custkey % 2500 + 1) || 'Vox' AS other, 'P' || (o_orderkey % 3000 + 1) || 'G' AS p, 'K' || (o_custkey % 2500 + 1) || 'Vo' AS k, o_custkey % 3 <> 0 AS large, o_custkey % 50 + 1 AS a FROM orders),
m AS (SELECT t.*, x.form IS NOT NULL AS has_p, y.form IS NOT NULL AS has_k, x.n AS np, y.n AS nk FROM t LEFT JOIN forms x ON x.form = p LEFT JOIN forms y ON y.form = k),
b AS (SELECT *, list_filter(CASE WHEN coalesce(np, 0) < coalesce(nk, 0) THEN [CASE WHEN has_p AND large THEN p END, CASE WHEN has_k THEN k END] ELSE [CASE WHEN has_k THEN k END, CASE WHEN has_p AND large THEN p END] END, lambda x: x IS NOT NULL) AS exact FROM m)
SELECT o_orderkey, array_to_string(exact, '|') AS exact,
  array_to_string(list_filter([CASE WHEN has_p AND large THEN 'Art. ' || a || ' Abs. 2 ' || p END, CASE WHEN has_k THEN 'Art. 7a Abs. 3 ' || k END], lambda x: x IS NOT NULL), '|') AS gold,
  CASE WHEN len(exact) > 0 THEN 'Art. ' || a || ' Abs. 2 ' || exact[1] END AS canonical_id, exact[1] AS book FROM b
""",
    "q_normalize": f"""WITH {_TEXTS}, n AS (SELECT o_orderkey, {_normal('form')} FROM texts)
SELECT o_orderkey, CASE WHEN v <> '' THEN 'court_decision' WHEN b IS NOT NULL THEN 'federal_law' END AS citation_type, {_ID} AS canonical_id, CAST(nullif(v, '') AS INTEGER) AS volume,
  CASE WHEN v <> '' THEN s END AS section, CAST(nullif(p, '') AS INTEGER) AS page, k AS consideration, b AS book, CASE WHEN b IS NOT NULL THEN a END AS article, CASE WHEN b IS NOT NULL THEN g END AS paragraph FROM n""",
    "q_equivalent": f"WITH {_TEXTS}, n AS (SELECT o_orderkey, {_normal('form')} FROM texts) SELECT o_orderkey, {_ID} IS NOT NULL AS same FROM n",
    "q_parse_list": f"""WITH {_TEXTS}, n AS (SELECT o_orderkey, {_normal('form')} FROM texts), i AS (SELECT o_orderkey, {_ID} AS id FROM n)
SELECT o_orderkey, CASE WHEN id IS NULL OR id = 'Art. 1 OR' THEN 'Art. 1 OR' ELSE id || '|Art. 1 OR' END AS items FROM i""",
    "q_court_text_articles": f"WITH {_TEXTS} SELECT o_orderkey, {_sorted(_all(C.COURT_TEXT_ARTICLE, '').replace('(text,', '(substr(text, 1, 2000),'), 'articles')} FROM texts",
    "q_free_text_citations": f"WITH {_TEXTS} SELECT o_orderkey, {_sorted(' || '.join(_all(p) for p in C.FREE_TEXT), 'citations')} FROM texts",
    "q_gold_citations": f"""WITH {_TEXTS},
found AS (SELECT o_orderkey, {_all('Art' + chr(92) + '.?' + chr(92) + 's*(' + chr(92) + 'd+[a-z]?)(?:' + chr(92) + 's+(?:Abs' + chr(92) + '.?|al' + chr(92) + '.?|cpv' + chr(92) + '.?)' + chr(92) + 's*(' + chr(92) + 'd+[a-z]?))?(?:' + chr(92) + 's+(?:Ziff' + chr(92) + '.?|lit' + chr(92) + '.?|Bst' + chr(92) + '.?)' + chr(92) + 's*(' + chr(92) + 'd*[a-z]?))?' + chr(92) + 's+(?:' + '|'.join(BOOKS) + ')')} || {_all(C.FULL_BGE)} AS l FROM texts),
each AS (SELECT o_orderkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM found), n AS (SELECT o_orderkey, i, {_normal('x')} FROM each),
ids AS (SELECT o_orderkey, min(i) AS i, {_ID} AS id FROM n GROUP BY o_orderkey, id HAVING id IS NOT NULL)
SELECT o_orderkey, string_agg(id, '|' ORDER BY i) AS citations FROM ids GROUP BY o_orderkey""",
    "q_citation_field": f"""WITH {_TEXTS},
found AS (SELECT o_orderkey, {_all('|'.join(f'(?:{p})' for p in C.FIELD), '')} AS l FROM texts),
each AS (SELECT o_orderkey, {_FLAT('x')} AS x, i FROM (SELECT o_orderkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM found)),
firsts AS (SELECT o_orderkey, x, min(i) AS i FROM each GROUP BY ALL)
SELECT o_orderkey, string_agg(x, '; ' ORDER BY i) AS citation_field FROM firsts GROUP BY o_orderkey""",
    "q_expand_letters": "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN list_transform(['a', 'b', 'd'], lambda x: 'Art. ' || (o_orderkey % 90 + 1) || ' lit. ' || x || ' BGG') ELSE ['Art. 3 OR'] END) AS citation FROM orders",
    "q_context_window": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) // 2 AS BIGINT) AS pos FROM documents),
w AS (SELECT doc_id, pos - greatest(0, pos - 80) AS back, substr(t, greatest(0, pos - 80) + 1, least(length(t), pos + length(substr(t, pos + 1, 6)) + 200) - greatest(0, pos - 80)) AS c FROM d),
x AS (SELECT doc_id, c, instr(substr(c, 1, least(length(c), back + 50)), '. ') AS dot, instr(substr(c, 1, least(length(c), back + 50)), '). ') AS br FROM w),
y AS (SELECT doc_id, CASE WHEN dot > 0 THEN regexp_replace(substr(c, dot + 2), '^\s+', '') WHEN br > 0 THEN regexp_replace(substr(c, br + 3), '^\s+', '') ELSE c END AS c FROM x),
z AS (SELECT doc_id, regexp_replace(replace(c, chr(10), ' '), '^\s+|\s+$', '', 'g') AS s FROM y)
SELECT doc_id, md5(s) AS digest, CAST(length(s) AS INTEGER) AS n FROM z
""",
    "q_line_citations": rf"""WITH {_TEXTS} SELECT o_orderkey, 'Art. 5 OR' || CASE WHEN contains(form, 'BGE') OR contains(form, 'Art.') THEN '|' || trim(form) ELSE '' END || '|SR 210' AS lines FROM texts""",
    "q_abbreviations": """
WITH w AS (SELECT 'N' || n_nationkey AS id, n_name AS de, lower(n_name) AS fr, upper(n_name[1]) || lower(n_name[2:]) AS it FROM nation)
SELECT id AS abbreviation, id, de, fr, it, true AS known FROM w UNION ALL SELECT fr, id, de, fr, it, true FROM w
UNION ALL SELECT array_to_string(list_transform(string_split(lower(de), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || 'x', NULL, NULL, NULL, NULL, false FROM w
""",
}

_TIDY = lambda c, word: rf"nullif(trim(regexp_replace({c}, '{word}\.?\s*', '{word}. ')), '')"
_OUT = C.OUTPUT_ARTICLE.format(books=C.OUTPUT_BOOKS)
_PART = lambda n: rf"regexp_extract(x, '(?i){_OUT}', {n})"
SQL |= {
    "q_output_citations": f"""WITH {_TEXTS},
found AS (SELECT o_orderkey, x FROM (SELECT o_orderkey, unnest({_all(_OUT)}) AS x FROM texts)),
named AS (SELECT o_orderkey, concat_ws(' ', 'Art. ' || {_PART(1)}, {_TIDY(_PART(2), 'Abs')}, {_TIDY(_PART(3), 'lit')}, {_TIDY(_PART(4), 'Ziff')}, upper({_PART(5)})) AS c FROM found
  UNION SELECT o_orderkey, regexp_replace(x, '^BGE\\s+(\\d+)\\s+([IVX]+[a-z]?)\\s+(\\d+)(?:\\s+E\\.\\s*([\\d.a-z/]+))?$', 'BGE \\1 \\2 \\3 E. \\4') FROM (SELECT o_orderkey, unnest({_all(C.OUTPUT_BGE, '')}) AS x FROM texts))
SELECT o_orderkey, string_agg(DISTINCT c, '|' ORDER BY c) AS citations FROM named GROUP BY o_orderkey""",
    "q_tokens_strip": f"WITH {_TEXTS} SELECT o_orderkey, {_FLAT('form')} AS flat, substr(text, 1, 40) || '…' AS short FROM texts",
}
_KINDS = (("BGE", C.BGE), ("Art.", C.ARTICLE), ("Docket", C.DOCKET))
_EXTRACTED = f"""WITH {_TEXTS},
found AS ({" UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS type, text, unnest({_all(p)}) AS x FROM texts" for k, p in _KINDS)}),
named AS (SELECT o_orderkey, type, {_FLAT('x')} AS raw, CASE WHEN type = 'BGE' THEN {_CASE(_FLAT('x'))} ELSE {_FLAT('x')} END AS canonical, CAST(instr(text, x) - 1 AS INTEGER) AS position FROM found),
firsts AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, canonical ORDER BY position) AS k FROM named)"""
SQL |= {
    # the decision's "und A" reaches into the first article, which the overlap rule then leaves out
    "q_extract_all": f"{_EXTRACTED} SELECT o_orderkey, raw, type, canonical, position FROM firsts WHERE k = 1 AND NOT regexp_full_match(raw, 'Art. .* Abs. . OR')",
    "q_case_citations": f"{_EXTRACTED} SELECT o_orderkey, string_agg(canonical, '|' ORDER BY canonical) AS cases FROM firsts WHERE k = 1 AND type <> 'Art.' GROUP BY o_orderkey",
}
_PIECES = " UNION ALL ".join(f"SELECT s, text, unnest({_all(p)}) AS x FROM src" for p in C.CONTEXT_KINDS)
SQL["q_cited_with_context"] = rf"""WITH {_TEXTS},
src AS (SELECT 'O' || o_orderkey AS s, regexp_replace(CASE WHEN o_orderkey % 10 = 0 THEN form ELSE text END, '^\s+|\s+$', '', 'g') AS text FROM texts),
hits AS (SELECT DISTINCT s, text, {_FLAT('x')} AS cite, instr(text, x) - 1 AS pos FROM ({_PIECES})),
w AS (SELECT s, cite, pos, pos - greatest(0, pos - 80) AS back, substr(text, greatest(0, pos - 80) + 1, least(length(text), pos + length(cite) + 200) - greatest(0, pos - 80)) AS c FROM hits),
x AS (SELECT *, instr(substr(c, 1, least(length(c), back + 50)), '. ') AS dot, instr(substr(c, 1, least(length(c), back + 50)), '). ') AS br FROM w),
y AS (SELECT s, cite, pos, CASE WHEN dot > 0 THEN regexp_replace(substr(c, dot + 2), '^\s+', '') WHEN br > 0 THEN regexp_replace(substr(c, br + 3), '^\s+', '') ELSE c END AS c FROM x)
SELECT s AS source_citation, cite AS cited_citation, regexp_replace(replace(c, chr(10), ' '), '^\s+|\s+$', '', 'g') AS summary, CAST(pos AS INTEGER) AS position FROM y
UNION ALL SELECT s, s, text, NULL FROM src WHERE s NOT IN (SELECT s FROM hits)"""
