"""The inverted index as tables: documents, postings, vocabulary, lengths, surface forms, statistics.

Everything is built from one table of tokens (doc_id, zone, surface, term). Counts are hash
aggregates with a partial step before each shuffle, spread by document and term together, so
that frequent terms do not gather in one task; the join of term counts with document
frequencies is left to adaptive execution, which splits frequent terms.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.lemmas import Lemmatizer, LowerCase
from lectern.scratch import Scratch

# Zones, the threshold under which a term carries nothing, and terms that never do.
ZONES = ("titre", "texte")
NOISE_THRESHOLD = 1e-4
SEED_NOISE = (
    "un", "de", "ce", "être", "le", "que", "à", "pour", "et", "qui", "avoir", "permettre", "notamment", "en", "plus", "dans", "par",
    "au", "recherche", "industriel", "se", "avec", "développer", "mais", "aussi", "sur", "il", "ainsi", "dernier", "son", "tout",
    "deux", "ne", "où",
)


def tokens_of(documents: DataFrame, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """(doc_id, zone, surface, term) of documents (doc_id, titre, texte)."""
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), X.surfaces(F.coalesce(F.col(z), F.lit(""))).alias("words")) for z in ZONES])
    rows = documents.select("doc_id", F.explode(zones).alias("z")).select("doc_id", "z.zone", F.explode("z.words").alias("surface"))
    return (lemmatizer or LowerCase()).apply(rows)


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "zone", "term").agg(F.count("*").alias("tf"))


def counts_of(documents: DataFrame, lemmatizer: Lemmatizer | None = None, distinct: bool | None = None) -> DataFrame:
    """As term_counts, from the documents themselves; distinct: whether each has an id of its own, which is looked up if it is not told.

    Then a document's terms are counted within its row, and nothing is shuffled.
    """
    lemmatizer = lemmatizer or LowerCase()
    if lemmatizer.column(F.lit("")) is None or not (has_own_ids(documents) if distinct is None else distinct):
        return term_counts(tokens_of(documents, lemmatizer))
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), _zone_counts(z, lemmatizer).alias("terms")) for z in ZONES])
    return documents.select("doc_id", F.explode(zones).alias("z")).select("doc_id", "z.zone", F.explode("z.terms").alias("t")).select("doc_id", "zone", "t.term", "t.tf")


def _zone_counts(zone: str, lemmatizer: Lemmatizer) -> Column:
    return X.counted(F.transform(X.surfaces(F.coalesce(F.col(zone), F.lit(""))), lemmatizer.column))


def has_own_ids(documents: DataFrame) -> bool:
    """Whether no two documents have the same id."""
    return documents.groupBy("doc_id").count().where("count > 1").isEmpty()


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Documents that have a term in any zone, from the counts of their zones."""
    return counts.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def frequencies_of(documents: DataFrame, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """As document_frequencies, from documents with an id each.

    Where a term is an expression of its surface, a document's distinct terms are found
    within its row, and only partial counts of terms are shuffled.
    """
    lemmatizer = lemmatizer or LowerCase()
    if lemmatizer.column(F.lit("")) is None:
        return document_frequencies(term_counts(tokens_of(documents, lemmatizer)))
    return terms_of(documents, lemmatizer).groupBy("term").agg(F.count("*").alias("df"))


def terms_of(documents: DataFrame, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """(doc_id, term): the distinct terms of each row, of any zone, found within it."""
    words = F.concat(*[X.surfaces(F.coalesce(F.col(z), F.lit(""))) for z in ZONES])
    return documents.select("doc_id", F.explode(F.array_distinct(F.transform(words, (lemmatizer or LowerCase()).column))).alias("term"))


def with_idf(frequencies: DataFrame, n: Column) -> DataFrame:
    return frequencies.withColumn("idf", X.idf(F.col("df"), n))


def of_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows of the terms of a query table, which is as small as its batch. The semi-join goes below the counting of what is not written yet."""
    return rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def postings_of(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, doc_id, zone, tf, tfidf)."""
    rows = counts.join(vocabulary.select("term", "idf"), "term")
    return rows.select("term", "doc_id", "zone", "tf", X.tfidf(F.col("tf"), F.col("idf")).alias("tfidf"))


def document_lengths(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Tokens of each zone, 0 for documents without any."""
    sums = counts.groupBy("doc_id").agg(*[F.sum(F.when(F.col("zone") == z, F.col("tf")).otherwise(0)).alias(f"len_{z}") for z in ZONES])
    return documents.select("doc_id").join(sums, "doc_id", "left").select("doc_id", *[F.coalesce(f"len_{z}", F.lit(0)).cast("long").alias(f"len_{z}") for z in ZONES])


def lengths_of(documents: DataFrame) -> DataFrame:
    """As document_lengths, from the documents alone, without a shuffle."""
    return documents.select("doc_id", *[F.size(X.surfaces(F.coalesce(F.col(z), F.lit("")))).cast("long").alias(f"len_{z}") for z in ZONES])


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row: n and the mean lengths, 0 for an empty corpus."""
    means = [F.coalesce(F.try_divide(F.sum(f"len_{z}"), F.count("*")), F.lit(0.0)).cast("double").alias(f"avg_len_{z}") for z in ZONES]
    return lengths.agg(F.count("*").alias("n"), *means)


def greatest_weights(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.max("tfidf").alias("max_tfidf"))


def greatest_weights_of(documents: DataFrame, n: Column, lemmatizer: Lemmatizer | None = None, distinct: bool | None = None) -> DataFrame:
    """As greatest_weights of their postings: a weight grows with its frequency, so only each term's greatest is weighed.

    Where each document has an id of its own, one reading gives a term's documents and its
    greatest frequency: its counts in both zones, and a row that takes a document away which has it in both.
    """
    lemmatizer = lemmatizer or LowerCase()
    if lemmatizer.column(F.lit("")) is None or not (has_own_ids(documents) if distinct is None else distinct):
        counts = counts_of(documents, lemmatizer, False)
        terms = counts.groupBy("term").agg(F.max("tf").alias("tf")).join(document_frequencies(counts), "term")
    else:
        zones = documents.select(*[_zone_counts(z, lemmatizer).alias(z) for z in ZONES])
        rows = [F.transform(z, lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), F.lit(1).alias("df"))) for z in ZONES]
        both = F.transform(F.array_intersect(*[F.transform(z, lambda t: t["term"]) for z in ZONES]), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(-1).alias("df")))
        terms = zones.select(F.explode(F.concat(*rows, both)).alias("t")).groupBy("t.term").agg(F.max("t.tf").alias("tf"), F.sum("t.df").alias("df"))
    return terms.select("term", X.tfidf(F.col("tf"), X.idf(F.col("df"), n)).alias("max_tfidf"))


def noise_terms(greatest: DataFrame, threshold: float = NOISE_THRESHOLD, seeds: tuple[str, ...] = SEED_NOISE) -> DataFrame:
    spark = greatest.sparkSession
    fixed = spark.createDataFrame([(s,) for s in seeds], "term string")
    return greatest.where(F.col("max_tfidf") <= threshold).select("term").unionByName(fixed).distinct()


def without_noise(terms: DataFrame, noise: DataFrame) -> DataFrame:
    return terms.join(noise, "term", "left_anti")


def surface_forms(tokens: DataFrame) -> DataFrame:
    """How often each alphabetic surface stands for each term."""
    return tokens.where(X.is_alphabetic(F.col("surface"))).groupBy("surface", F.col("term").alias("lemma")).agg(F.count("*").alias("freq"))


def merged_surface_forms(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sum of two tables of surface forms."""
    return old.unionByName(new).groupBy("surface", "lemma").agg(F.sum("freq").alias("freq"))


def best_lemmas(forms: DataFrame) -> DataFrame:
    """The most frequent lemma of each surface, the first in order of equals; an aggregate, not a window."""
    return forms.groupBy("surface").agg(F.min_by("lemma", F.struct(-F.col("freq"), F.col("lemma"))).alias("lemma"))


def dense_ids(frame: DataFrame, *order: str | Column, name: str = "doc_id") -> DataFrame:
    """frame with ids 1, 2, 3, ... in an order that is the same for no two rows.

    Rows are sorted by ranges and written once with their range and their place in it, so that
    every later step reads the same numbers. A range's offset is the count of those before it;
    the driver gets one number for each range.
    """
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it below
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = Scratch(frame.sparkSession, "dense").keep(placed.withColumn("__at", at), "placed")
    part = F.shiftright("__at", 33)
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg((F.max(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n")).collect())
    offsets, total = [], 0
    for number, count in counts:
        offsets.append((number, total))
        total += count
    table = frame.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __offset long")
    out = kept.withColumn("__part", part).join(F.broadcast(table), "__part", "left")
    offset = F.coalesce("__offset", F.raise_error(F.lit("a range without an offset")).cast("long"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + offset + 1
    return out.select(place.cast("long").alias(name), *[c for c in frame.columns if c.lower() != name.lower()])


class BaseIndex(ABC):
    """What search needs of an index over documents, a table with doc_id."""

    documents: DataFrame

    @abstractmethod
    def get_postings(self, term: str, zone: str) -> DataFrame:
        """(doc_id, tfidf) of a term in a zone."""

    @abstractmethod
    def get_idf(self, terms: DataFrame) -> DataFrame:
        """terms (term) with their idf, 0 for those that the corpus has not."""

    def all_doc_ids(self) -> DataFrame:
        return self.documents.select("doc_id")

    def get_documents(self, ids: DataFrame) -> DataFrame:
        """The documents of ids (doc_id)."""
        return self.documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


@dataclass(frozen=True)
class Index(BaseIndex):
    """documents: doc_id, titre, texte, and any of fichier, article, auteur, rubrique, date, has_image, bulletin."""

    documents: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    statistics: DataFrame
    surfaces: DataFrame
    noise: DataFrame
    counts: DataFrame | None = None  # of an index that is not saved: postings without weights
    noise_rule: tuple[float, tuple[str, ...]] | None = None  # of an index that is built: threshold and seeds

    TABLES = ("documents", "postings", "vocabulary", "lengths", "statistics", "surfaces", "noise")

    @classmethod
    def build(cls, documents: DataFrame, lemmatizer: Lemmatizer | None = None, threshold: float = NOISE_THRESHOLD, seeds: tuple[str, ...] = SEED_NOISE) -> Index:
        tokens, distinct = tokens_of(documents, lemmatizer), has_own_ids(documents)
        counts = counts_of(documents, lemmatizer, distinct)
        lengths = lengths_of(documents)
        statistics = corpus_statistics(lengths)
        n = documents.agg(F.count("*").alias("n")).scalar()
        vocabulary = with_idf(frequencies_of(documents, lemmatizer), n)
        postings = postings_of(counts, vocabulary)
        noise = noise_terms(greatest_weights_of(documents, n, lemmatizer, distinct), threshold, seeds)
        return cls(documents, postings, vocabulary, lengths, statistics, surface_forms(tokens), noise, counts, (threshold, seeds))

    def frequencies(self) -> DataFrame:
        """(term, doc_id, zone, tf)."""
        return (self.postings if self.counts is None else self.counts).select("term", "doc_id", "zone", "tf")

    def save(self, folder: str) -> Index:
        """Writes all tables and gives the index that reads them.

        Postings lie by zone and, in each file, by term, so that a lookup skips row groups
        by their ranges. The range partitioning puts a frequent term into several files. Of an
        index that was built, a table that follows from others is made from what is written of these.
        """
        spark = self.documents.sparkSession
        for name in ("documents", "vocabulary", "lengths", "statistics", "surfaces", "postings", "noise"):
            frame = getattr(self, name)
            if self.noise_rule is not None:
                read = {k: spark.read.parquet(f"{folder}/{k}") for k in {"postings": ["vocabulary"], "statistics": ["lengths"], "noise": ["postings"]}.get(name, [])}
                if name == "postings":
                    frame = postings_of(self.counts, read["vocabulary"])
                elif name == "statistics":
                    frame = corpus_statistics(read["lengths"])
                elif name == "noise":
                    frame = noise_terms(greatest_weights(read["postings"]), *self.noise_rule)
            if name == "postings":
                frame = frame.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
                frame.write.mode("overwrite").partitionBy("zone").parquet(f"{folder}/{name}")
            else:
                frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return self.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in cls.TABLES])

    def cached(self) -> Index:
        return replace(self, **{name: getattr(self, name).cache() for name in self.TABLES})

    def get_postings(self, term: str, zone: str) -> DataFrame:
        return self.postings.where((F.col("term") == term) & (F.col("zone") == zone)).select("doc_id", "tfidf")

    def get_idf(self, terms: DataFrame) -> DataFrame:
        return terms.join(self.vocabulary.select("term", "idf"), "term", "left").select("term", F.coalesce("idf", F.lit(0.0)).alias("idf"))

    def vocabulary_terms(self) -> DataFrame:
        return self.vocabulary.select("term").orderBy("term")

    def doc_count(self) -> DataFrame:
        return self.documents.agg(F.count("*").alias("n"))

    def violations(self) -> DataFrame:
        """(rule, n): how many rows break each rule that the tables must keep.

        Postings are read twice, once to be summed by term and once by document; the sums are written, as rules share them.
        """

        def one(rule: str, frame: DataFrame, n: Column | None = None) -> DataFrame:
            n = F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0)).cast("long")
            return frame.agg(n.alias("n")).select(F.lit(rule).alias("rule"), "n")

        def repeated(frame: DataFrame, *keys: str) -> DataFrame:
            return frame.groupBy(*keys).count().where("count > 1")

        kept = Scratch(self.documents.sparkSession, "rules")
        ids, terms = self.documents.select("doc_id"), self.vocabulary.select("term")
        zone, known = F.col("zone"), F.coalesce(F.col("zone").isin(*ZONES), F.lit(False))
        pairs = self.postings.groupBy("term", "doc_id").agg(F.count("*").alias("rows"), *[F.count(F.when(zone == z, 1)).alias(z) for z in ZONES])
        more = sum(((F.col(z) > 1).cast("int") for z in ZONES), F.lit(0))
        by_term = kept.keep(pairs.groupBy("term").agg(F.sum("rows").alias("rows"), F.sum(more).alias("more"), F.count("*").alias("found")), "terms")
        by_id = self.postings.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count(F.when(~zone.isin(*ZONES), 1)).alias("zoneless"), F.count(F.when(F.col("tf") < 1, 1)).alias("empty"))
        by_id = kept.keep(by_id, "ids")
        others = repeated(self.postings.where(~known), "term", "doc_id", "zone").select(F.lit(1).alias("more"))
        parts = [
            one("a document's id is one document's", repeated(self.documents, "doc_id")),
            one("a term is one term's", repeated(self.vocabulary, "term")),
            one("a term, document and zone have one posting", by_term.select("more").unionByName(others), F.col("more")),
            one("a posting is of a document", by_id.join(ids, "doc_id", "left_anti"), F.col("rows")),
            one("a posting is of a term", by_term.join(terms, "term", "left_anti"), F.col("rows")),
            one("a posting is of a zone", by_id, F.col("zoneless")),
            one("a posting counts one at least", by_id, F.col("empty")),
            one("a term's df is its documents", self.vocabulary.join(by_term, "term", "left").where("df <> coalesce(found, 0)")),
            one("a length is of a document", self.lengths.join(ids, "doc_id", "left_anti")),
            one("a surface is not empty", self.surfaces.where("surface = '' OR lemma = ''")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
