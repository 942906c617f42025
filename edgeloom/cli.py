"""Command line: simulate, run, evaluate, enrich."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import enrichment, estimators, metrics, preprocess, simulate
from edgeloom.session import ship_package
from edgeloom.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="edgeloom")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("simulate", help="generate synthetic samples")
    s.add_argument("--n", type=int, default=200)
    s.add_argument("--p", type=int, default=100)
    s.add_argument("--topology", default="hub", choices=["hub", "scale-free", "cluster", "random"])
    s.add_argument("--reps", type=int, default=10)
    s.add_argument("--prob", type=float, default=0.05)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--out", default="results/simulated")
    r = sub.add_parser("run", help="infer a network from an expression CSV")
    r.add_argument("--data", required=True)
    r.add_argument("--method", default="desparsified", choices=["desparsified", "glasso", "gglasso"])
    r.add_argument("--alpha", type=float, default=0.05)
    r.add_argument("--fdr", default="BH", choices=["BH", "BY"])
    r.add_argument("--npn", action="store_true")
    r.add_argument("--out", default="results")
    e = sub.add_parser("evaluate", help="score a network against the truth")
    e.add_argument("--predicted", required=True)
    e.add_argument("--ground-truth", required=True)
    e.add_argument("--scores", help="square CSV; a higher value means more likely an edge")
    e.add_argument("--out", default="results/metrics.csv")
    h = sub.add_parser("enrich", help="test gene sets of a network")
    h.add_argument("--adj", required=True, help=".npy square adjacency")
    h.add_argument("--genes", required=True, help="one gene name per line")
    h.add_argument("--terms", required=True, help="parquet with db, term_id, term_name, gene")
    h.add_argument("--pvalues", help=".npy square p-values")
    h.add_argument("--level", default="all", choices=enrichment.LEVELS)
    h.add_argument("--method", default="ora", choices=["ora", "prerank"])
    h.add_argument("--backend", default="gprofiler", choices=["gprofiler", "gseapy"])
    h.add_argument("--extraction", default="hub", choices=enrichment.EXTRACTIONS)
    h.add_argument("--out", default="enrichment_results.csv")
    return top


def _simulate(spark: SparkSession, a) -> None:
    for rep in range(a.reps):
        sinks.write_replicate(simulate.generate(spark, a.n, a.p, a.topology, a.prob, a.seed + rep), a.out)
    print(f"wrote {a.reps} replicates to {a.out}")


def _run(spark: SparkSession, a) -> None:
    samples, variables = readers.read_expression_csv(spark, a.data)
    if a.npn:
        samples = preprocess.npn_shrinkage(samples)
    p = variables.count()
    stem = os.path.splitext(os.path.basename(a.data))[0]
    if a.method == "desparsified":
        edges = estimators.DesparifiedGGM().fit(samples).get_adjacency(a.alpha, a.fdr).persist()
    elif a.method == "glasso":
        edges = estimators.SklearnGLasso().fit(samples).get_adjacency()
    else:
        edges = estimators.GGLassoEstimator().fit(samples).get_adjacency()
    for path in sinks.write_run(edges, p, a.out, stem, a.method == "desparsified"):
        print(path)


def _evaluate(spark: SparkSession, a) -> None:
    pred, p = readers.read_square_csv(spark, a.predicted, "is_edge")
    true, _ = readers.read_square_csv(spark, a.ground_truth, "label")
    scores = readers.read_square_csv(spark, a.scores, "score")[0] if a.scores else None
    out = metrics.evaluate_predictions(pred, true, p, scores).persist()
    sinks.write_metrics(out, a.out)
    for k, v in out.first().asDict().items():
        print(f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}")


def _enrich(spark: SparkSession, a) -> None:
    adj, p = readers.read_npy(spark, a.adj, "is_edge")
    edges = adj.filter("is_edge <> 0").select("i", "j")
    if a.pvalues:
        edges = edges.join(readers.read_npy(spark, a.pvalues, "p_value")[0], ["i", "j"])
    variables = readers.read_gene_order(spark, a.genes)
    hits = enrichment.from_adjacency(
        edges, variables, spark.read.parquet(a.terms), p, a.level, a.method, a.backend, a.extraction)
    table = enrichment.enrichment_table(hits)
    if table is None:
        print("no enrichment found")
        return
    if "intersections" in table.columns:
        table = table.withColumn("intersections", F.concat_ws(";", "intersections"))
    sinks.write_metrics(table, a.out)
    print(f"wrote {a.out}")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    ship_package(spark)
    {"simulate": _simulate, "run": _run, "evaluate": _evaluate, "enrich": _enrich}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
