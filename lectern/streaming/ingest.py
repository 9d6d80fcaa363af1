"""Documents that arrive as a stream: counts are kept by batch, an index is made of what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as X
from lectern.functions.lemmas import Lemmatizer
from lectern.operators import index as I


@dataclass
class StreamingIndexer:
    """Writes each micro-batch's documents, term counts and surface forms below a folder.

    A batch's files are overwritten if it runs again, so every document counts once however
    often a batch is tried. A document that comes again takes the place of the one before: of an
    id only its last batch counts, and of its rows within a batch the greatest.
    """

    spark: SparkSession
    folder: str
    lemmatizer: Lemmatizer | None = None

    def _write(self, batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("doc_id").agg(F.max(F.struct(*[c for c in batch.columns if c != "doc_id"])).alias("row")).select("doc_id", "row.*").persist()
        tokens = I.tokens_of(rows, self.lemmatizer)
        forms = tokens.where(X.is_alphabetic(F.col("surface"))).groupBy("doc_id", "surface", F.col("term").alias("lemma")).agg(F.count("*").alias("freq"))
        for name, frame in (("documents", rows), ("counts", I.counts_of(rows, self.lemmatizer, distinct=True)), ("surfaces", forms)):
            frame.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        rows.unpersist()

    def start(self, documents: DataFrame, **trigger) -> StreamingQuery:
        """documents: a streaming DataFrame with doc_id, titre and texte."""
        return documents.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def _current(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}").withColumn("batch", F.col("batch").cast("long"))
        last = self.spark.read.parquet(f"{self.folder}/documents").groupBy("doc_id").agg(F.max("batch").cast("long").alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")

    def index(self) -> I.Index:
        documents, counts, forms = (self._current(n) for n in ("documents", "counts", "surfaces"))
        lengths = I.document_lengths(documents, counts)
        n = documents.agg(F.count("*")).scalar()
        vocabulary = I.with_idf(I.document_frequencies(counts), n)
        postings = I.postings_of(counts, vocabulary)
        surfaces = forms.groupBy("surface", "lemma").agg(F.sum("freq").alias("freq"))
        return I.Index(documents, postings, vocabulary, lengths, I.corpus_statistics(lengths), surfaces, I.noise_terms(I.greatest_weights_of(documents, n, self.lemmatizer, distinct=True)), counts)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) of a stream of events by tumbling windows; later rows than `late` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")
