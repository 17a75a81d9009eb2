"""Command line of the jobs: ``spark-submit`` or ``python -m pairspark screen|score|evaluate|split``.

``--model`` names a module with ``protein_features``, ``ligand_features`` and ``make_scorer`` and, if
it has them, ``feature_type``, ``heads`` (:class:`Heads`), ``canonical`` and ``explain``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from .plans import jobs
from .session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairspark", description="Pair screening on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, model: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        sub.add_argument("--output", required=True, help="folder to write")
        if model:
            sub.add_argument("--model", required=True, help="module with the featurizers and the scorer")
            sub.add_argument("--cache", required=True, help="folder of the feature caches")
            sub.add_argument("--batch-size", type=int, default=128)
        return sub

    screen = command("screen", "every protein with every ligand")
    screen.add_argument("--fasta", required=True)
    screen.add_argument("--ligands", required=True)
    screen.add_argument("--top-k", type=int)
    screen.add_argument("--interpretation", help="folder of the explanations")
    screen.add_argument("--max-pairs", type=int, help="refuse more pairs than this without --top-k")
    command("score", "pairs of a CSV").add_argument("--pairs", required=True)
    command("evaluate", "test pairs of a data folder").add_argument("--data", required=True)
    split = command("split", "split the pairs of a CSV", model=False)
    split.add_argument("--pairs", required=True)
    split.add_argument("--kind", choices=["random", "group", "cold"], default="random")
    split.add_argument("--column", nargs="+", default=["ID"])
    split.add_argument("--fractions", nargs=3, type=float, default=[0.7, 0.1, 0.2])
    split.add_argument("--seed", type=int, default=0)
    return top


def _model(name: str) -> dict:
    """The parts of the model; its code travels to the executors with the job."""
    module = importlib.import_module(name)
    cloudpickle.register_pickle_by_value(module)
    parts = {n: getattr(module, n) for n in ("protein_features", "ligand_features", "make_scorer")}
    return parts | {n: getattr(module, n) for n in ("feature_type", "heads") if hasattr(module, n)}


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.getActiveSession() or build_session()
    if given.command == "split":
        pairs = spark.read.option("header", True).csv(given.pairs)
        column = given.column if given.kind == "cold" else given.column[0]
        done = {r["split"]: r["n"] for r in jobs.write_splits(
            pairs, given.output, given.kind, column, given.fractions, given.seed).collect()}  # three rows at most
    elif given.command == "screen":
        module = importlib.import_module(given.model)
        done = jobs.run_screening(spark, jobs.Screening(
            given.fasta, given.ligands, given.output, given.cache, top_k=given.top_k, max_pairs=given.max_pairs,
            interpretation=given.interpretation, batch_size=given.batch_size,
            canonical=getattr(module, "canonical", None), explain=getattr(module, "explain", None), **_model(given.model)))
    else:
        job = jobs.PairScoring(given.cache, batch_size=given.batch_size, **_model(given.model))
        if given.command == "score":
            done = jobs.score_pair_list(spark, given.pairs, given.output, job)
        else:
            report = jobs.evaluate_folder(spark, given.data, given.output, job)
            done = {r["metric"]: r["value"] for r in report.collect()}  # one row per metric
    print(json.dumps(done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
