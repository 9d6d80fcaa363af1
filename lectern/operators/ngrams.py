"""Character and word n-grams as columns, and an index of them."""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.index import BaseIndex, has_own_ids
from lectern.scratch import Scratch


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order; none of shorter texts."""
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.substring(text, k, F.lit(n)))


def word_ngrams(text: Column, n: int) -> Column:
    """All n-grams of words, joined by blanks. The words are bound once, as the only entry of an array."""

    def grams(words: Column) -> Column:
        last = F.size(words) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k, F.lit(n)), " "))

    return F.flatten(F.transform(F.array(X.words(text)), grams))


def ngram_postings(documents: DataFrame, n: int = 3, unit: str = "char", text: str = "text", distinct: bool | None = None, wanted: list[str] | None = None) -> DataFrame:
    """(ngram, doc_id, tf) over lower-cased texts, of characters within words or of words, of wanted n-grams or of all.

    Where each document has an id of its own (distinct; looked up if it is not told), they are counted within its row.
    """
    grams = word_ngrams(F.col(text), n) if unit == "word" else F.flatten(F.transform(X.words(F.col(text)), lambda w: ngrams(w, n)))
    if wanted is not None:
        grams = F.filter(grams, lambda g: g.isin(wanted))
    if has_own_ids(documents) if distinct is None else distinct:
        return documents.select("doc_id", F.explode(X.counted(grams, "ngram")).alias("g")).select("g.ngram", "doc_id", "g.tf")
    return documents.select("doc_id", F.explode(grams).alias("ngram")).groupBy("ngram", "doc_id").agg(F.count("*").alias("tf"))


class NgramIndex(BaseIndex):
    """Postings of n-grams over documents (doc_id, text), which have one zone only."""

    def __init__(self, documents: DataFrame, n: int = 3, unit: str = "char", text: str = "text") -> None:
        self.documents = documents
        self.how = n, unit, text
        self.postings = ngram_postings(documents, *self.how)

    def of(self, wanted: list[str]) -> NgramIndex:
        """The index of these n-grams only, whose postings are found in one reading of the documents and written."""
        part = copy(self)
        part.postings = Scratch(self.documents.sparkSession, "ngrams").keep(ngram_postings(self.documents, *self.how, wanted=wanted), "postings")
        return part

    def get_postings(self, term: str, zone: str = "text") -> DataFrame:
        """(doc_id, tf) of an n-gram."""
        return self.postings.where(F.col("ngram") == term).select("doc_id", "tf")

    def get_idf(self, terms: DataFrame) -> DataFrame:
        """terms (ngram) with their idf, 0 for those that the corpus has not."""
        df = self.postings.groupBy("ngram").agg(F.count("*").alias("df"))
        n = self.documents.agg(F.count("*").alias("n")).scalar()
        return terms.join(df, "ngram", "left").select("ngram", F.coalesce(X.idf(F.col("df"), n), F.lit(0.0)).alias("idf"))
