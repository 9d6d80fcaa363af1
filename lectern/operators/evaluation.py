"""Precision, recall and F1 of result sets, latency, and the golden questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def precision_recall_f1(retrieved: set, relevant: set) -> tuple[float, float, float]:
    """1 where nothing is wanted and nothing found; 0 where either is empty alone."""
    if not retrieved and not relevant:
        return 1.0, 1.0, 1.0
    common = len(retrieved & relevant)
    if not common:
        return 0.0, 0.0, 0.0
    p, r = common / len(retrieved), common / len(relevant)
    return p, r, 2 * p * r / (p + r)


def evaluated(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, item: str = "doc_id") -> DataFrame:
    """(qid, precision, recall, f1) for all queries (qid), of distinct pairs (qid, item)."""
    found = retrieved.select("qid", item).distinct().withColumn("found", F.lit(1))
    wanted = relevant.select("qid", item).distinct().withColumn("wanted", F.lit(1))
    counts = found.join(wanted, ["qid", item], "full_outer").groupBy("qid").agg(F.count("found").alias("n_found"), F.count("wanted").alias("n_wanted"), F.count(F.when(F.col("found") + F.col("wanted") == 2, 1)).alias("n_both"))
    rows = queries.select("qid").distinct().join(counts, "qid", "left").fillna(0, ["n_found", "n_wanted", "n_both"])
    empty = (F.col("n_found") == 0) & (F.col("n_wanted") == 0)

    def share(below):
        return F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(F.col("n_both"), below), F.lit(0.0)))

    return rows.select("qid", share(F.col("n_found")).alias("precision"), share(F.col("n_wanted")).alias("recall"), share((F.col("n_found") + F.col("n_wanted")) / 2).alias("f1"))


def macro_mean(results: DataFrame) -> DataFrame:
    return results.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def latency_ms(run: Callable[[], object], runs: int = 10) -> float:
    """Mean milliseconds of a call, after one that warms up."""
    run()
    began = time.perf_counter()
    for _ in range(runs):
        run()
    return (time.perf_counter() - began) / runs * 1000


def golden_table(spark: SparkSession, golden: Iterable[tuple[str, str, set[str]]]) -> DataFrame:
    """(qid, query, article) rows of (id, question, relevant articles)."""
    return spark.createDataFrame([(i, q, a) for i, q, articles in golden for a in sorted(articles)], "qid string, query string, article string")


def run_evaluation(service, golden: list[tuple[str, str, set[str]]], runs: int = 0, report: str | None = None) -> DataFrame:
    """(qid, query, precision, recall, f1, ms, retrieved, relevant) of a search service over golden questions; report: a folder for JSON."""
    spark = service.index.documents.sparkSession
    questions = {i: q for i, q, _ in golden}
    found = service.run_many(questions).select("qid", "article").distinct()
    relevant = golden_table(spark, golden).select("qid", "article")
    ids = spark.createDataFrame([(i, q, latency_ms(lambda q=q: service.run(q).collect(), runs) if runs else 0.0) for i, q, _ in golden], "qid string, query string, ms double")
    scores = evaluated(found, relevant, ids, "article")
    lists = [t.groupBy("qid").agg(F.sort_array(F.collect_set("article")).alias(n)) for t, n in ((found, "retrieved"), (relevant, "relevant"))]
    out = ids.join(scores, "qid")
    for table in lists:
        out = out.join(table, "qid", "left")
    out = out.select("qid", "query", "precision", "recall", "f1", "ms", "retrieved", "relevant").orderBy("qid")
    if report:
        out.coalesce(1).write.mode("overwrite").json(report)
    return out


def plot_results(results: list[dict], folder: str) -> list[str]:
    """Bar charts of precision, recall, F1 and latency; needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    written = []
    for name, columns in (("eval_precision_recall", ("precision", "recall", "f1")), ("eval_timing", ("ms",))):
        figure, axes = pyplot.subplots(figsize=(max(8, len(results)), 4))
        for k, column in enumerate(columns):
            axes.bar([x + 0.25 * k for x in range(len(results))], [r[column] for r in results], 0.25, label=column)
        axes.set_xticks(range(len(results)), [r["qid"] for r in results])
        axes.legend()
        figure.savefig(f"{folder}/{name}.png")
        pyplot.close(figure)
        written.append(f"{folder}/{name}.png")
    return written
