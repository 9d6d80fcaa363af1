"""Scoring of many queries at once: a small table of clauses joined with the postings.

The conjunction within a group is a relational division: a document stays if it meets as many
clauses as the group has. A term that the corpus lacks gives no row, so its group matches
nothing.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.index import Index, dense_ids, of_terms
from lectern.plans.ast import ParsedQuery

# Weights of clauses by zone, and the parameters of BM25.
TITLE_IN_TITLE, CONTENT_IN_TITLE, CONTENT_IN_TEXT = 3.0, 3.0, 1.0
K1, B = 1.5, 0.75

CLAUSES = "qid string, group_id int, clause_id int, kind string, term string, n_clauses int"


def clause_table(spark: SparkSession, queries: list[tuple[str, ParsedQuery]]) -> DataFrame:
    return spark.createDataFrame([(qid, *c) for qid, q in queries for c in q.clauses()], CLAUSES)


def zone_weight(title: float = TITLE_IN_TITLE, content_title: float = CONTENT_IN_TITLE, content_text: float = CONTENT_IN_TEXT) -> Column:
    """A clause's weight for a posting; null where the clause does not look."""
    title_kind, in_title = F.col("kind") == "title", F.col("zone") == "titre"
    return F.when(title_kind & in_title, title).when(title_kind, None).when(in_title, content_title).otherwise(content_text)


def hits(clauses: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings that a clause looks at, with the weight. Spark broadcasts the clauses if they are few."""
    return of_terms(postings, clauses).join(clauses, "term").withColumn("weight", zone_weight()).where("weight IS NOT NULL")


def divided(rows: DataFrame, value: str) -> DataFrame:
    """(qid, doc_id, score) of rows (qid, group_id, clause_id, n_clauses, doc_id, value)."""
    met = rows.groupBy("qid", "group_id", "doc_id", "n_clauses", "clause_id").agg(F.sum(value).alias("s"))
    groups = met.groupBy("qid", "group_id", "doc_id", "n_clauses").agg(F.count("*").alias("met"), F.sum("s").alias("s"))
    return groups.where("met = n_clauses").groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))


class Scorer(ABC):
    @abstractmethod
    def score(self, clauses: DataFrame, index: Index) -> DataFrame:
        """(qid, doc_id, score) for the documents that match."""


class FrequencyScorer(Scorer):
    """Weighted raw term frequencies."""

    def score(self, clauses: DataFrame, index: Index) -> DataFrame:
        rows = hits(clauses, index.frequencies())
        return divided(rows.withColumn("v", F.col("weight") * F.col("tf")), "v").withColumn("score", F.col("score").cast("double"))


class BM25Scorer(Scorer):
    """BM25F: frequencies are weighted by zone and normed by the zone's length before they saturate.

    Scores are summed as decimals of six places, so that they do not depend on the order of rows.
    """

    def __init__(self, k1: float = K1, b: float = B) -> None:
        self.k1, self.b = k1, b

    def score(self, clauses: DataFrame, index: Index) -> DataFrame:
        n = index.statistics
        mean = {z: n.select(f"avg_len_{z}").scalar() for z in ("titre", "texte")}
        count = n.select("n").scalar()
        own = F.when(F.col("zone") == "titre", F.col("len_titre") / mean["titre"]).otherwise(F.col("len_texte") / mean["texte"])
        rows = hits(clauses, index.frequencies()).join(index.lengths, "doc_id")
        rows = rows.withColumn("w", F.round(F.col("weight") * F.col("tf") / (1 - self.b + self.b * own), 9).cast("decimal(20,9)"))
        keys = ["qid", "group_id", "doc_id", "n_clauses", "clause_id", "term"]
        met = rows.groupBy(*keys).agg(F.sum("w").cast("double").alias("w")).join(of_terms(index.vocabulary.select("term", "df"), clauses), "term")
        idf = F.ln(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5))
        value = F.round(idf * F.col("w") * (self.k1 + 1) / (F.col("w") + self.k1), 6).cast("decimal(18,6)")
        return divided(met.withColumn("v", value), "v").withColumn("score", F.col("score").cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class EmbeddingScorer(Scorer):
    """alpha * lexical + (1 - alpha) * cosine of query and document vectors, over the lexical matches.

    query_vectors: (qid, vector); document_vectors: (doc_id, vector).
    """

    def __init__(self, query_vectors: DataFrame, document_vectors: DataFrame, lexical: Scorer | None = None, alpha: float = 0.5) -> None:
        self.queries = query_vectors.select("qid", F.col("vector").alias("__q"))
        self.documents = document_vectors.select("doc_id", F.col("vector").alias("__d"))
        self.lexical, self.alpha = lexical or FrequencyScorer(), alpha

    def score(self, clauses: DataFrame, index: Index) -> DataFrame:
        rows = self.lexical.score(clauses, index).join(self.documents, "doc_id", "left").join(self.queries, "qid", "left")
        near = F.coalesce(cosine(F.col("__q"), F.col("__d")), F.lit(0.0))
        return rows.select("qid", "doc_id", (self.alpha * F.col("score") + (1 - self.alpha) * near).alias("score"))


#: Similarities in one array at most.
CELLS = 1 << 20


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None = None, block: int = 1024) -> DataFrame:
    """(qid, doc_id, similarity) of all vectors to each of a stated set of queries; with k the k nearest, and their place.

    Queries are taken in blocks of about that many, each broadcast as a matrix and multiplied with
    the vectors where they lie. With k a batch's best k of each query go on, then the best k of
    those. Null and zero vectors, and those of another length than the queries', are near nothing.
    """
    context = queries.sparkSession.sparkContext
    n_blocks = max(1, -(-queries.count() // block))
    number = F.pmod(F.xxhash64("qid"), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        rows = sorted((r["qid"], [float(x) for x in r["vector"]]) for r in queries.where(number == b).where("vector IS NOT NULL").select("qid", "vector").collect())
        part = _similarities(vectors, context.broadcast([(q, v) for q, v in rows if any(v)]), k)
        out = part if out is None else out.unionByName(part)
    return out if k is None else ranked(out, "similarity").where(F.col("place") <= k)


def _similarities(vectors: DataFrame, queries: Broadcast, k: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[int]] = {}
        for at, (_, v) in enumerate(queries.value):
            by_size.setdefault(len(v), []).append(at)
        names = pa.array([q for q, _ in queries.value], pa.string())
        matrices = {size: np.array([queries.value[at][1] for at in own]) for size, own in by_size.items()}
        rows = max(1, CELLS // max(1, len(queries.value)))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            for size, own in by_size.items():
                at = np.flatnonzero(sizes == size)
                values = np.asarray(pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())).reshape(len(at), size)
                norms = np.sqrt((values * values).sum(axis=1))
                at, values, norms = at[norms > 0], values[norms > 0], norms[norms > 0]
                wanted = matrices[size]
                near = wanted @ values.T / np.sqrt((wanted * wanted).sum(axis=1))[:, None] / norms
                if k is not None and len(at) > k:
                    least = np.partition(near, len(at) - k, axis=1)[:, len(at) - k]
                    row, column = np.nonzero(near >= least[:, None])
                else:
                    row, column = (x.ravel() for x in np.indices(near.shape))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.array(own)[row])), ids.take(pa.array(at[column])), pa.array(near[row, column])], names=["qid", "doc_id", "similarity"])

    return vectors.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "qid string, doc_id long, similarity double")


def ranked(scores: DataFrame, by: str = "score") -> DataFrame:
    """Place of each document within its query: best first, then by id. A limit on place is applied before the shuffle."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "doc_id")))


def _order(mode: str) -> list[Column]:
    """booleen: newest first, undated last. classe: best first, then the first character of the date, downwards. Ties by id."""
    if mode == "booleen":
        return [F.desc_nulls_last("date"), F.col("doc_id")]
    return [F.desc("score"), F.desc(F.ascii(F.coalesce(F.col("date").cast("string"), F.lit("")))), F.col("doc_id")]


def ordered(results: DataFrame, mode: str = "classe") -> DataFrame:
    return results.orderBy(*_order(mode))


def placed(results: DataFrame, mode: str = "classe") -> DataFrame:
    """results with their place in that order, numbered by ranges, so that no task sees them all."""
    return dense_ids(results, *_order(mode), name="place")
