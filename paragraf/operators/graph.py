"""The citation graph as two tables: building, storing and traversing it.

nodes: id, label (Case or Law) and properties. edges: src, dst, src_label, dst_label, rel_type (CITES,
CITES_LAW, LAW_CITES_CASE, LAW_CITES_LAW), weight, tf. Traversals start from a table of seeds, so that
only their neighbourhoods are joined, and answer all seeds in one plan. They read the edges several
times: edges that are computed are best written first (`Graph.save`, or `session.stable`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import collapse, filled, strip, truncate
from ..session import stable, stored

TEXT_LIMIT = 100_000
#: Edges of a partition where ways of two edges are counted: there are some tens of times as many ways.
PARTITION_EDGES = 500_000
#: Words of 64 bits that mark the nodes next to a seed.
MARKS = 16
CITES, CITES_LAW, LAW_CITES_CASE, LAW_CITES_LAW = "CITES", "CITES_LAW", "LAW_CITES_CASE", "LAW_CITES_LAW"


# --- building ---------------------------------------------------------------------------------


def ordered_concat(df: DataFrame, key: str, ord_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """(key, text): texts of a key joined in order. The result is one value a key, so a key's texts must fit a row (2 GB)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), filled(text_col).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def first_rows(df: DataFrame, ord_col: str, max_rows: int | None) -> DataFrame:
    """The first rows in file order, whatever numbers that order has; None or 0 is all."""
    return df.orderBy(ord_col).limit(max_rows) if max_rows else df


def cases(considerations: DataFrame, ord_col: str = "ord", citation_col: str = "citation", text_col: str = "text", max_rows: int | None = None) -> DataFrame:
    """Case nodes (id, text, volume, section, page): considerations of a decision joined in order; other rows are left out."""
    keyed = first_rows(considerations, ord_col, max_rows).select(C.case_id(citation_col).alias("id"), F.col(ord_col).alias("ord"), strip(filled(text_col)).alias("text")).where("id is not null")
    part = F.split("id", " ")
    return ordered_concat(keyed, "id", "ord", "text").select("id", "text", F.get(part, F.lit(1)).cast("int").alias("volume"), F.get(part, F.lit(2)).alias("section"), F.get(part, F.lit(3)).cast("int").alias("page"))


def laws(provisions: DataFrame, ord_col: str = "ord", max_rows: int | None = None) -> DataFrame:
    """Law nodes (id, text, title, sr_number, book): texts of equal citations joined, the first title; book is unknown here."""
    keyed = first_rows(provisions, ord_col, max_rows).select(collapse(filled("citation")).alias("id"), F.col(ord_col).alias("ord"), strip(filled("text")).alias("text"), strip(filled("title")).alias("title")).where("id <> ''")
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    grouped = keyed.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.min_by("title", "ord").alias("title"))
    return grouped.select("id", "text", "title", C.sr_number("id").alias("sr_number"), F.lit(None).cast("string").alias("book"))


def weighted(counts: DataFrame, total: int) -> DataFrame:
    """(src, dst, weight, tf) of counts (src, dst, tf): (1 + ln tf) * ln(total / df), df the sources of a target."""
    sources = counts.groupBy("dst").agg(F.count("*").alias("df"))
    weight = (F.lit(1.0) + F.ln(F.col("tf").cast("double"))) * F.ln(F.lit(float(total)) / F.col("df"))
    return counts.join(sources, "dst").select("src", "dst", F.round(weight, 6).alias("weight"), F.col("tf").cast("long").alias("tf"))


def citing_once(nodes: DataFrame) -> DataFrame:
    """(id, citation, law, tf) of all citations in the nodes' texts, read once; `law` tells provisions from decisions. Written, as every kind of edge starts from it."""
    tagged = lambda kinds, law: F.transform(C.mentions("text", kinds), lambda x: F.struct(x.alias("citation"), F.lit(law).alias("law")))
    found = nodes.where("text <> ''").select("id", F.explode(F.concat(tagged(C.CASE_KINDS, False), tagged(C.LAW_KINDS, True))).alias("m"))
    return stable(found.groupBy("id", "m.citation", "m.law").agg(F.count("*").alias("tf")))


def citing(nodes: DataFrame, kinds: tuple[str, ...], targets: DataFrame | None = None, loops: bool = True, found: DataFrame | None = None) -> DataFrame:
    """(src, dst, tf) of citations in the nodes' texts, before weights are made: only to known targets, without loops. found: what `citing_once` gave."""
    counts = found.where(F.col("law") == (kinds == C.LAW_KINDS)) if found is not None else C.count_mentions(nodes.where("text <> ''"), "id", "text", kinds)
    counts = counts.select(F.col("id").alias("src"), F.col("citation").alias("dst"), "tf")
    if not loops:
        counts = counts.where("src <> dst")
    if targets is not None:
        counts = counts.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return counts


def case_edges(nodes: DataFrame, total: int | None = None, found: DataFrame | None = None) -> DataFrame:
    return weighted(citing(nodes, C.CASE_KINDS, nodes, loops=False, found=found), nodes.count() if total is None else total)


def law_edges(nodes: DataFrame, total: int | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(law nodes (id, book), edges) of laws that decisions cite, known or not."""
    counts = citing(nodes, C.LAW_KINDS, found=found)
    cited = counts.select(F.col("dst").alias("id")).distinct().withColumn("book", C.book_of("id"))
    return cited, weighted(counts, nodes.count() if total is None else total)


def edges_of_laws(provisions: DataFrame, case_ids: DataFrame, law_ids: DataFrame, total: int | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(law to case, law to law) edges; blank provisions cite nothing, but count in the total."""
    total = provisions.count() if total is None else total
    return weighted(citing(provisions, C.CASE_KINDS, case_ids, found=found), total), weighted(citing(provisions, C.LAW_KINDS, law_ids, loops=False, found=found), total)


def typed(edges: DataFrame, rel_type: str) -> DataFrame:
    source, target = {CITES: ("Case", "Case"), CITES_LAW: ("Case", "Law"), LAW_CITES_CASE: ("Law", "Case"), LAW_CITES_LAW: ("Law", "Law")}[rel_type]
    return edges.select("src", "dst", F.lit(source).alias("src_label"), F.lit(target).alias("dst_label"), F.lit(rel_type).alias("rel_type"), "weight", "tf")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def save(self, path: str) -> None:
        """Edges twice, sorted by either end, so that row groups can be skipped from both."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.repartitionByRange("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges_by_src")
        self.edges.repartitionByRange("dst").sortWithinPartitions("dst").write.mode("overwrite").parquet(f"{path}/edges_by_dst")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges_by_src"))


def build(considerations: DataFrame, provisions: DataFrame | None = None, text_limit: int = TEXT_LIMIT, max_rows: int | None = None) -> Graph:
    """Nodes and all edges; only stored texts are cut to `text_limit`. Without provisions there are decisions only.

    Nodes, and the citations in their texts, are worked out once and written; every kind of edge reads those.
    """
    case_nodes = stable(cases(considerations, max_rows=max_rows))
    total, found = case_nodes.count(), citing_once(case_nodes)
    edges = typed(case_edges(case_nodes.select("id"), total, found), CITES)
    none = lambda kind: F.lit(None).cast(kind)
    nodes = case_nodes.select("id", F.lit("Case").alias("label"), "volume", "section", "page", truncate("text", text_limit).alias("text"), none("string").alias("title"), none("string").alias("book"), none("string").alias("sr_number"))
    if provisions is not None:
        known = stable(laws(provisions, max_rows=max_rows))
        cited, more = law_edges(case_nodes, total, found)
        every = known.select("id").union(cited.select("id")).distinct()
        to_case, to_law = edges_of_laws(known, case_nodes.select("id"), every, known.count(), citing_once(known))
        edges = edges.unionByName(typed(more, CITES_LAW)).unionByName(typed(to_case, LAW_CITES_CASE)).unionByName(typed(to_law, LAW_CITES_LAW))
        law_nodes = upsert_coalesce(known.withColumn("text", truncate("text", text_limit)), cited.select("id", none("string").alias("text"), none("string").alias("title"), none("string").alias("sr_number"), "book"))
        nodes = nodes.unionByName(law_nodes.select("id", F.lit("Law").alias("label"), none("int").alias("volume"), none("string").alias("section"), none("int").alias("page"), "text", "title", "book", "sr_number"))
    return Graph(nodes, edges)


def clear(graph: Graph, label: str | None = None) -> Graph:
    """The graph without its nodes of a label and what hangs on them; without all, if none is given."""
    if label is None:
        return Graph(graph.nodes.limit(0), graph.edges.limit(0))
    return Graph(graph.nodes.where(F.col("label") != label), graph.edges.where((F.col("src_label") != label) & (F.col("dst_label") != label)))


def schema_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, type): the columns of both tables, as a catalogue."""
    rows = [(kind, f.name, f.dataType.simpleString()) for kind, df in (("node", nodes), ("edge", edges)) for f in df.schema.fields]
    return nodes.sparkSession.createDataFrame(rows, "kind string, name string, type string")


def assert_keys(nodes: DataFrame) -> None:
    """Ids are unique within a label."""
    again = nodes.groupBy("label", "id").count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"repeated nodes: {[tuple(r) for r in again]}")


def export_edges(graph: Graph, path: str) -> list[str]:
    """CSV files (source, target, weight, tf): decisions always, other kinds if there are any."""
    written = []
    for kind, name in ((CITES, "case_edges"), (CITES_LAW, "case_to_law_edges"), (LAW_CITES_CASE, "law_to_case_edges"), (LAW_CITES_LAW, "law_to_law_edges")):
        rows = graph.edges.where(F.col("rel_type") == kind).select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "tf")
        if kind == CITES or not rows.isEmpty():
            rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)
            written.append(name)
    return written


# --- storing ----------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; where both have a key, all properties of the new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; where both have a key, each property is the new one unless that is null."""
    names = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, key, "full").select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in names])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, ord_col: str | None = None) -> tuple[DataFrame, int]:
    """(edges, matched): new edges whose two ends exist, over old ones of the same ends and type; matched counts rows of input."""
    ends = nodes.select("id", "label").distinct()
    source = ends.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    target = ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    met = new.join(source, ["src", "src_label"], "left_semi").join(target, ["dst", "dst_label"], "left_semi")
    order = F.col(ord_col) if ord_col else F.struct("weight", "tf")
    last = met.groupBy("src", "rel_type", "dst", "src_label", "dst_label").agg(F.max_by(F.struct("weight", "tf"), order).alias("x")).select("src", "dst", "src_label", "dst_label", "rel_type", "x.weight", "x.tf")
    return old.join(last.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti").select(last.columns).unionByName(last), met.count()


# --- traversing -------------------------------------------------------------------------------


def _bit(id_: Column | str) -> tuple[Column, Column]:
    """Word and bit of an id in the marks."""
    h = F.pmod(F.xxhash64(id_), F.lit(64 * MARKS)).cast("int")
    return F.floor(h / 64).cast("int"), h % 64


def _marks(one: DataFrame, k: int) -> DataFrame:
    """(seed, marks): bits of the nodes next to a seed, all bits if there are fewer than k.

    A seed with k nodes next to it shows no others, so of its ways of two edges only those to such nodes
    count, and the bits tell most of the rest before any way is shuffled; they rule out none that counts.
    """
    each = one.where("case_id <> seed").select("seed", "case_id").distinct()
    word, bit = _bit("case_id")
    one_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = [F.bit_or(F.when(word == n, one_bit).otherwise(F.lit(0).cast("long"))).alias(f"m{n}") for n in range(MARKS)]
    found = one.select("seed").distinct().join(each.groupBy("seed").agg(F.count("*").alias("m"), *words), "seed", "left")
    full = F.col("m") >= k
    return found.select("seed", F.array(*(F.when(full, F.col(f"m{n}")).otherwise(F.lit(-1).cast("long")) for n in range(MARKS))).alias("marks"))


def _marked(marks: str, id_: str) -> Column:
    word, bit = _bit(id_)
    return F.call_function("shiftrightunsigned", F.get(marks, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1


def neighbours(seeds: DataFrame, edges: DataFrame, k: int = 10, max_hops: int = 2) -> DataFrame:
    """(seed, rank, case_id, distance, best, score) within one or two hops, along citations either way.

    Two hops go out twice or in twice, and multiply weights. Distance is the least and best the largest
    weight over all ways, each for itself; the k first by distance, then by best, then by id are kept.
    """
    if max_hops not in (1, 2):
        raise ValueError("max_hops is 1 or 2")
    each = edges.where(F.col("rel_type") == CITES) if "rel_type" in edges.columns else edges
    each = each.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w"))
    seeds = seeds.select("seed").distinct()
    out = seeds.join(each, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("case_id"), "w", F.lit(True).alias("along"))
    back = seeds.join(each, F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("case_id"), "w", F.lit(False).alias("along"))
    one = out.unionByName(back)
    if max_hops == 2:
        one = stored(one)
    ways = [one.select("seed", "case_id", "w", F.lit(1).alias("d"))]
    if max_hops == 2:
        marked = one.join(_marks(one, k), "seed")
        for along, here, there in ((True, "src", "dst"), (False, "dst", "src")):
            near = marked.where(F.col("along") == along).select("seed", F.col("case_id").alias("mid"), F.col("w").alias("w1"), "marks")
            far = near.join(each, F.col("mid") == F.col(here)).where(_marked("marks", there))
            ways.append(far.select("seed", F.col(there).alias("case_id"), (F.col("w1") * F.col("w")).alias("w"), F.lit(2).alias("d")))
    every = ways[0]
    for way in ways[1:]:
        every = every.unionByName(way)
    best = every.where("case_id <> seed").groupBy("seed", "case_id").agg(F.min("d").alias("distance"), F.max("w").alias("best"))
    order = Window.partitionBy("seed").orderBy("distance", F.desc("best"), "case_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("seed", "rank", "case_id", "distance", "best", (F.col("best") / F.col("distance")).alias("score"))


def linked(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str, label: str = "Case", limit: int = 100) -> DataFrame:
    """(seed, rank, id) of nodes with a label that cite (`in`) or are cited by (`out`) a seed: decisions from the latest volume (unknown first), laws by id."""
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    rows = seeds.select("seed").distinct().join(edges, F.col("seed") == F.col(here)).select("seed", F.col(there).alias("id")).distinct()
    rows = rows.join(nodes.where(F.col("label") == label), "id")
    order = Window.partitionBy("seed").orderBy(*([F.col("volume").desc_nulls_first(), "id"] if label == "Case" else ["id"]))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("seed", "rank", "id")


def top_citing_law(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 10, with_text: bool = True) -> DataFrame:
    """(seed, rank, id, weight[, text]) of decisions that cite a law most."""
    rows = seeds.select("seed").distinct().join(edges.where(F.col("rel_type") == CITES_LAW), F.col("seed") == F.col("dst"))
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "src")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("seed", "rank", F.col("src").alias("id"), "weight")
    return top.join(nodes.where("label = 'Case'").select("id", "text"), "id", "left").select("seed", "rank", "id", "weight", "text") if with_text else top


def top_linked(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str, k: int = 5) -> DataFrame:
    """(seed, rank, id, type, weight, tf, text): the heaviest edges of any type into (`in`) or out of (`out`) a seed; an id that is a decision and a law is taken as a decision."""
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    known = nodes.groupBy("id").agg(F.min("label").alias("label"))
    near = seeds.select("seed").distinct().join(known, F.col("seed") == F.col("id")).select("seed", F.col("label").alias(f"{here}_label"))
    rows = near.join(edges, (F.col("seed") == F.col(here)) & (near[f"{here}_label"] == edges[f"{here}_label"]))
    rows = rows.select("seed", F.col(there).alias("id"), F.col(f"{there}_label").alias("label"), F.col("rel_type").alias("type"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("tf", F.lit(0)).alias("tf"))
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "id", "type")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(nodes.select("id", "label", "text"), ["id", "label"], "left").select("seed", "rank", "id", "type", "weight", "tf", F.coalesce("text", F.lit("")).alias("text"))


def explore(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """Both directions of top_linked with a column direction."""
    both = [top_linked(seeds, edges, nodes, d, k).withColumn("direction", F.lit(d)) for d in ("in", "out")]
    return both[0].unionByName(both[1])


def explored_text(seeds: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """(seed, output): what cites a seed and what it cites, as text."""
    line = F.format_string("[%.2f] %s [%s]\n%s", "weight", "id", "type", "text")
    rows = found.groupBy("seed", "direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("lines"))
    wide = rows.groupBy("seed").pivot("direction", ["in", "out"]).agg(F.first("lines"))
    none = lambda word: F.lit(f"  (no {word} citations found)")
    text = F.concat_ws("\n\n", F.format_string("=== Citation Explorer: %s ===", "seed"), F.lit(f"\n--- Cited BY (top {k}) ---"), F.coalesce("in", none("inbound")), F.lit(f"\n--- CITES (top {k}) ---"), F.coalesce("out", none("outbound")))
    return seeds.select("seed").distinct().join(wide, "seed", "left").select("seed", F.when(strip(filled("seed")) == "", F.lit("Error: Empty citation ID. Please provide a law or case citation.")).otherwise(text).alias("output"))


def cocited(seeds: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(seed, rank, id, citing): decisions cited together with a seed, by how many cite both."""
    each = edges.where(F.col("rel_type") == CITES) if "rel_type" in edges.columns else edges
    each = each.select("src", "dst").distinct()
    by = seeds.select("seed").distinct().join(each, F.col("seed") == F.col("dst")).select("seed", "src")
    parts = -(-edges.count() // PARTITION_EDGES)
    fine = parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if fine:
        by, each = by.repartition(parts, "src"), each.repartition(parts, "src")
    pairs = by.join(each, "src").where("dst <> seed").select("seed", F.col("dst").alias("id"))
    if fine:
        pairs = pairs.repartition(parts, "seed", "id")
    # a seed, a source and a target are one row each, so rows are distinct sources
    pairs = pairs.groupBy("seed", "id").agg(F.count("*").alias("citing"))
    order = Window.partitionBy("seed").orderBy(F.desc("citing"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("seed", "rank", "id", "citing")


def exists(nodes: DataFrame, id_: str, label: str = "Case") -> bool:
    return not nodes.where((F.col("id") == id_) & (F.col("label") == label)).limit(1).isEmpty()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label and edges by type."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))


def most_cited(edges: DataFrame, k: int = 10) -> DataFrame:
    """(id, in_degree): the k decisions with the most citations by decisions."""
    each = edges.where(F.col("rel_type") == CITES) if "rel_type" in edges.columns else edges
    return each.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(k)


# --- search over the graph --------------------------------------------------------------------


def case_documents(docs: DataFrame, ord_col: str = "ord", citation_col: str = "citation") -> DataFrame:
    """(case_id, doc): the last document of each decision."""
    rows = docs.withColumn("case_id", C.case_id(citation_col)).where("case_id is not null")
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*docs.columns), ord_col).alias("doc"))


def seeds_of(queries: DataFrame, fallback: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """(query_id, pos, seed): the first decision a query names (all, with `multi`), else those of its first fallback hits (query_id, rank, citation)."""
    named = C.bge_citations("query") if multi else F.array_compact(F.array(C.case_id("query")))
    own = queries.select("query_id", F.posexplode(named).alias("pos", "seed"))
    if fallback is None:
        return own
    rest = fallback.join(own.select("query_id").distinct(), "query_id", "left_anti").where("rank <= 3").withColumn("seed", C.case_id("citation")).where("seed is not null")
    return own.unionByName(rest.groupBy("query_id", "seed").agg(F.min("rank").alias("pos")).select("query_id", F.col("pos").cast("int").alias("pos"), "seed"))


def search(queries: DataFrame, edges: DataFrame, docs: DataFrame, k: int = 10, max_hops: int = 2, fallback: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """(query_id, rank, case_id, distance, score, doc): neighbours of a query's seeds, but no seeds; what several reach counts for the first seed."""
    seeds = seeds_of(queries, fallback, multi)
    near = seeds.join(neighbours(seeds, edges, k, max_hops).withColumnRenamed("rank", "near_rank"), "seed")
    near = near.join(seeds.select("query_id", F.col("seed").alias("case_id")).distinct(), ["query_id", "case_id"], "left_anti")
    first = near.groupBy("query_id", "case_id").agg(F.min_by(F.struct("distance", "score", "pos", "near_rank"), F.struct("pos", "near_rank")).alias("x")).select("query_id", "case_id", "x.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", "near_rank")
    top = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(case_documents(docs), "case_id", "left").select("query_id", "rank", "case_id", "distance", "score", F.lit("citation_graph").alias("method"), "doc")
