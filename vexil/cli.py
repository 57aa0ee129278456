"""Command line: `python -m vexil.cli build|search|bench ...`, over .npy, .fvecs or Parquet files."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.index import STRATEGIES, VectorIndex
from vexil.operators import evaluate
from vexil.plans import predicate
from vexil.sources import formats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vexil")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="train an index, fill it and keep it")
    build.add_argument("--train_vecs", required=True)
    build.add_argument("--train_access", help="vec_id and tid, as .npy or Parquet")
    build.add_argument("--index", required=True)
    build.add_argument("--strategy", choices=STRATEGIES, default="exact")
    for name, value in (("clusters", 16), ("probes", 8), ("parts", 16), ("codes", 256), ("factor", 8)):
        build.add_argument(f"--{name}", type=int, default=value)
    for name in ("search", "bench"):
        s = sub.add_parser(name, help="search and write results" if name == "search" else "search, time it, and compare with exact search")
        s.add_argument("--index", required=True)
        s.add_argument("--queries", required=True)
        s.add_argument("--query_labels", help="a label for each query, in order; negative: none")
        s.add_argument("--filter", help="one predicate for all queries")
        s.add_argument("--filters_file", help="a predicate a line; all queries under each of them")
        s.add_argument("--notation", choices=("prefix", "postfix"), default="prefix")
        s.add_argument("--k", type=int, default=10)
        s.add_argument("--output", help="folder of JSON results")
    return p


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding."""
    if path.endswith(".npy"):
        return formats.read_npy(spark, path)
    if path.endswith(("fvecs", "bvecs")):
        return formats.read_xvecs(spark, path, "float32" if path.endswith("fvecs") else "uint8")
    return spark.read.parquet(path).select("vec_id", "embedding")


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".npy"):
        return formats.read_npy(spark, path).select(F.col("embedding")[0].cast("long").alias("vec_id"), F.col("embedding")[1].cast("int").alias("tid"))
    return spark.read.parquet(path).select("vec_id", "tid")


def _queries(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = read_vectors(spark, args.queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    if not args.query_labels:
        return rows.withColumn("tid", F.lit(None).cast("int"))
    labels = read_vectors(spark, args.query_labels).select(F.col("vec_id").alias("query_id"), F.col("embedding")[0].cast("int").alias("tid"))
    return rows.join(labels, "query_id", "left")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs a command; gives what it prints as JSON."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "build":
        index = VectorIndex(spark, args.clusters, args.probes, args.parts, args.codes, args.factor, args.strategy)
        vectors = read_vectors(spark, args.train_vecs)
        index.batch_create(vectors, _pairs(spark, args.train_access) if args.train_access else None)
        index.save(args.index)
        out = {"vectors": index.vectors.count(), "grants": index.access.count()}
    else:
        index, queries = VectorIndex.load(spark, args.index), _queries(spark, args)
        # A file of filters counts before one filter, and that before the queries' labels.
        formulas = [r["formula"] for r in formats.read_formulas(spark, args.filters_file).collect()] if args.filters_file else [args.filter] if args.filter else []
        out = {"runs": [_run(index, queries, f, args) for f in formulas or [None]]}
    print(json.dumps(out))
    return out


def _run(index: VectorIndex, queries: DataFrame, formula: str | None, args: argparse.Namespace) -> dict:
    began = time.perf_counter()
    if formula is None:
        found = index.batch_query(queries, args.k)
    else:
        found = index.predicate_query(queries.select("query_id", "q"), args.k, formula, args.notation)
    found = found.cache()
    n, asked = found.count(), queries.count()
    seconds = time.perf_counter() - began
    out = {"filter": formula, "queries": asked, "rows": n, "seconds": round(seconds, 3), "qps": round(asked / seconds, 3) if seconds else None}
    if args.output:
        name = "labels" if formula is None else predicate.show(predicate.parse(formula, args.notation), "prefix").replace(" ", "_")
        formats.write_results(found, f"{args.output}/{name}")
    if args.command == "bench":
        exact = VectorIndex(index.spark, strategy="exact")
        exact._vectors, exact._access = index.vectors, index.access
        truth = exact.batch_query(queries, args.k) if formula is None else exact.predicate_query(queries.select("query_id", "q"), args.k, formula, args.notation)
        out["recall"] = evaluate.recall(queries, found, truth).agg(F.avg("recall")).first()[0]
    found.unpersist()
    return out


if __name__ == "__main__":
    main()
