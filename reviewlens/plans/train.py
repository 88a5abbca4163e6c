"""The training program: TSV -> seeded split -> candidate search -> final metrics -> stored model.

    python -m reviewlens.plans.train --training TEXTS.tsv --model PATH [--budget 300] [--cluster]

The report job scores reviews with the stored model (``reviewlens.plans.job --model PATH``).
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.model import final_metrics, save_model, split_training, train_sentiment
from reviewlens.schemas import MODEL_BUDGET_SECONDS, MODEL_SEED
from reviewlens.session import build_session
from reviewlens.sources.files import read_training


def train_from_tsv(spark: SparkSession, path: str, budget_s: float = MODEL_BUDGET_SECONDS,
                   seed: int = MODEL_SEED, **options) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(best model, leaderboard, one row of final metrics); rows without text or label are left out."""
    data = (read_training(spark, path).dropna(subset=["text", "sentiment"])
            .select("text", F.col("sentiment").cast("int").alias("label")))
    training, validation = split_training(data, seed=seed)
    model, board = train_sentiment(training, validation, budget_s=budget_s, seed=seed, **options)
    return model, board, final_metrics(model, validation)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("--training", required=True, help="text and label, TSV")
    ap.add_argument("--model", required=True, help="where the best model is stored")
    ap.add_argument("--budget", type=float, default=MODEL_BUDGET_SECONDS, help="seconds")
    ap.add_argument("--partitions", type=int, help="spread an unsplittable input over so many tasks")
    ap.add_argument("--master")
    ap.add_argument("--cluster", action="store_true")
    args = ap.parse_args(argv)
    spark = build_session(args.master, cluster=args.cluster)
    model, board, metrics = train_from_tsv(spark, args.training, args.budget, partitions=args.partitions)
    save_model(model, args.model)
    board.show(truncate=False)
    metrics.show(truncate=False)


if __name__ == "__main__":
    main()
