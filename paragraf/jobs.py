"""Batch jobs: `python -m paragraf.jobs index|graph ...`.

index: build, extend or shrink a segmented index from a CSV, JSONL or Parquet corpus, and try a search.
graph: build the citation graph of decisions and laws, save it, or export its edges only.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as S
from .operators import graph as G
from .operators.segments import Segments
from .session import session


def corpus(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(ord, citation, text, title) of a corpus, by the ending of its path; Parquet where there is none."""
    if path.endswith(".csv"):
        return S.read_corpus_csv(spark, path, max_rows)
    rows = S.read_jsonl(spark, path) if path.endswith((".jsonl", ".json")) else S.ordinal(spark.read.parquet(path))
    rows = rows if "title" in rows.columns else rows.withColumn("title", F.lit(""))
    rows = rows.select("ord", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("citation", "text", "title")])
    return rows.orderBy("ord").limit(max_rows) if max_rows else rows


def index(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Ids are hashes of citations: a corpus that is added again replaces what it cites."""
    made = Segments(spark, args.out)
    ident = F.xxhash64("citation").alias("doc_id")
    if args.docs:
        rows = corpus(spark, args.docs, args.max_rows).groupBy(ident).agg(F.concat_ws("\n\n", F.max_by("title", "ord"), F.max_by("text", "ord")).alias("text"))
        if made.version:
            made.delete(rows)
        made.add(S.spread(rows))
    if args.remove:
        made.delete(corpus(spark, args.remove).select(ident))
    if args.merge:
        made.merge()
        made.vacuum()
    count, length = made.numbers()
    report = {"documents": count, "average_length": round(length, 3), "segments": len(made.manifest()), "version": made.version}
    if args.smoke:
        asked = spark.createDataFrame([(0, args.smoke)], "query_id long, query string")
        report["hits"] = [{"rank": r.rank, "doc_id": r.doc_id, "score": round(r.score, 6)} for r in made.search(asked, 5).orderBy("rank").collect()]
        if not report["hits"] and count:
            raise RuntimeError(f"the index finds nothing for {args.smoke!r}")
    return report


def graph(spark: SparkSession, args: argparse.Namespace) -> dict:
    provisions = None if args.no_laws or not args.laws else corpus(spark, args.laws)
    made = G.build(corpus(spark, args.cases), provisions, args.text_limit, args.max_rows)
    if not args.export_only:
        made.save(f"{args.out}/graph")
        made = G.Graph.load(spark, f"{args.out}/graph")
    return {"files": G.export_edges(made, f"{args.out}/edges"), "nodes": made.nodes.count(), "edges": made.edges.count()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paragraf.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("index")
    one.add_argument("--docs", help="corpus to add (.csv, .jsonl or a Parquet folder)")
    one.add_argument("--remove", help="corpus whose citations go")
    one.add_argument("--out", required=True)
    one.add_argument("--max-rows", type=int)
    one.add_argument("--merge", action="store_true", help="join segments, remove old versions")
    one.add_argument("--smoke", help="a search that must find something")
    two = jobs.add_parser("graph")
    two.add_argument("--cases", required=True)
    two.add_argument("--laws")
    two.add_argument("--out", required=True)
    two.add_argument("--max-rows", type=int)
    two.add_argument("--no-laws", action="store_true")
    two.add_argument("--export-only", action="store_true")
    two.add_argument("--text-limit", type=int, default=G.TEXT_LIMIT)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    report = {"index": index, "graph": graph}[args.job](spark or session(f"paragraf {args.job}"), args)
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
