"""The search service: correct, parse, score, filter, exclude, order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.correction import CorrectionResult, Corrector, LevenshteinCorrector, SurfaceLexicon, TableCorrector, lexicon_table
from lectern.operators.filters import FILTER_SCHEMA, excluded, filter_table, passes_filters
from lectern.operators.index import Index
from lectern.operators.scoring import FrequencyScorer, Scorer, clause_table, ordered
from lectern.plans.ast import ParsedQuery
from lectern.plans.parser import FrenchQueryParser, QueryParser
from lectern.scratch import Scratch

_DEFAULT = object()


def run_batch(queries: list[tuple[str, ParsedQuery]], index: Index, scorer: Scorer | None = None, fallback: str = "all") -> DataFrame:
    """(qid, score, and the columns of the documents) for all queries in one plan.

    A query without any scored document takes all documents as candidates with score 0,
    unless fallback is none. Only such queries meet every document, and only in a join with
    their own rows of the filter table, which is as small as the batch.
    """
    spark = index.documents.sparkSession
    scores = (scorer or FrequencyScorer()).score(clause_table(spark, queries), index)
    if fallback == "all":  # read twice below
        scores = Scratch(spark, "search").keep(scores, "scores")
    filters = spark.createDataFrame(filter_table([(qid, q.filters) for qid, q in queries]), FILTER_SCHEMA)
    found = scores.join(index.documents, "doc_id").join(F.broadcast(filters), "qid")
    if fallback == "all":
        unmatched = filters.join(scores.select("qid").distinct(), "qid", "left_anti")
        one = F.lit(1).alias("__one")
        # no more rows than the batch has queries, which the driver holds
        bare = index.documents.select("*", one).join(F.broadcast(unmatched.select("*", one)), "__one").drop("__one").withColumn("score", F.lit(0.0))
        found = found.unionByName(bare.select(*found.columns))
    kept = found.where(passes_filters())
    words = [(qid, t) for qid, q in queries for t in q.exclusions]
    if words:
        kept = kept.join(excluded(index.frequencies(), spark.createDataFrame(words, "qid string, term string")), ["qid", "doc_id"], "left_anti")
    return kept.select("qid", "score", *index.documents.columns)


@dataclass
class SearchService:
    """corrector: None reads questions as they are; by default one is built from the index when first needed.

    A lexicon of more than driver_words words stays a table, and questions are joined with it.
    """

    index: Index
    scorer: Scorer = field(default_factory=FrequencyScorer)
    corrector: Corrector | TableCorrector | None | object = _DEFAULT
    parser: QueryParser | None = None
    lenient: bool = False
    driver_words: int = 2_000_000
    last_correction: CorrectionResult | None = None

    def _corrector(self) -> Corrector | TableCorrector | None:
        if self.corrector is _DEFAULT:
            words = max(t.select(c).distinct().limit(self.driver_words + 1).count() for t, c in ((self.index.surfaces, "surface"), (self.index.vocabulary, "term")))
            if words > self.driver_words:
                spark = self.index.documents.sparkSession
                self.corrector = TableCorrector(Scratch(spark, "lexicon").keep(lexicon_table(self.index, metadata=True), "words"))
            else:
                self.corrector = LevenshteinCorrector(SurfaceLexicon.from_index(self.index, metadata=True, most=self.driver_words))
        return self.corrector

    def _parser(self) -> QueryParser:
        if self.parser is None:
            noise = [r["term"] for r in self.index.noise.collect()]
            rubriques = [r["rubrique"] for r in self.index.documents.select("rubrique").where("rubrique <> ''").distinct().collect()] if "rubrique" in self.index.documents.columns else []
            self.parser = FrenchQueryParser(noise, rubriques, lenient=self.lenient)
        return self.parser

    def parse(self, raw: str) -> ParsedQuery:
        corrector = self._corrector()
        self.last_correction = corrector.correct(raw) if corrector is not None else None
        return self._parser().parse(self.last_correction.corrected_query if self.last_correction else raw)

    def hint(self, raw: str) -> str | None:
        """What a correction changed, if it did."""
        done = self.last_correction
        if done is None or done.corrected_query == raw or not any(t.status.startswith("corrige") for t in done.tokens):
            return None
        return f"Corrected: {raw!r} → {done.corrected_query!r}"

    def run(self, raw: str, mode: str = "classe") -> DataFrame:
        return ordered(run_batch([("q", self.parse(raw))], self.index, self.scorer).drop("qid"), mode)

    def run_many(self, questions: dict[str, str]) -> DataFrame:
        """A batch; unless there is a corrector already, its tokens are joined with the lexicon, which need not be on the driver then."""
        corrector = TableCorrector(lexicon_table(self.index, metadata=True)) if self.corrector is _DEFAULT else self.corrector
        raw = list(questions.values())
        if corrector is not None and raw:
            done = corrector.correct_many(raw) if isinstance(corrector, TableCorrector) else [corrector.correct(r) for r in raw]
            self.last_correction, raw = done[-1], [d.corrected_query for d in done]
        parser = self._parser()
        return run_batch([(qid, parser.parse(r)) for qid, r in zip(questions, raw, strict=True)], self.index, self.scorer)
