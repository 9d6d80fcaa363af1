import json
import math
import random
from collections import Counter
from datetime import date
from threading import Thread
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import edit_distance
from lectern.operators import index as I
from lectern.operators.codecs import CODECS
from lectern.operators.correction import (
    EmbeddingCorrector,
    LevenshteinCorrector,
    NgramCorrector,
    SurfaceLexicon,
    SymSpellCorrector,
    TableCorrector,
    corrected_tokens,
    embedding_candidates,
    lexicon_table,
    ngram_candidates,
    symspell_candidates,
)
from lectern.operators.evaluation import evaluated, precision_recall_f1, run_evaluation
from lectern.operators.scoring import BM25Scorer, EmbeddingScorer, FrequencyScorer, clause_table, nearest
from lectern.plans.ast import KeywordGroup, ParsedQuery
from lectern.plans.search import SearchService, run_batch
from lectern.web import server

DOCS = [
    (1, "Airbus et la chimie", "un avion airbus vole vite", "Focus", date(2013, 3, 5), True, "10"),
    (2, "La biologie", "la chimie du vivant et la chimie verte", "Focus", date(2012, 7, 1), False, "20"),
    (3, "Le projet Taxibot", "un taxi pour avion", "A lire", date(2014, 1, 2), True, "30"),
    (4, "", "", "A lire", None, False, "40"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, titre string, texte string, rubrique string, date date, has_image boolean, article string")
    return I.Index.build(docs).cached()


def test_counts_fit_together(index):
    n = len(DOCS)
    assert index.statistics.first()["n"] == n
    assert index.vocabulary.where((F.col("df") > n) | (F.col("df") < 1)).isEmpty()
    sums = {r["doc_id"]: r["s"] for r in index.postings.groupBy("doc_id").agg(F.sum("tf").alias("s")).collect()}
    for r in index.lengths.collect():
        assert r["len_titre"] + r["len_texte"] == sums.get(r["doc_id"], 0)
    assert index.postings.where("tfidf < 0").isEmpty()
    assert {"le", "de"} <= {r["term"] for r in index.noise.collect()}
    assert index.vocabulary.where("term = 'chimie'").first()["df"] == 2


def test_save_and_load(spark, index, tmp_path):
    again = index.save(f"file://{tmp_path}/index")
    for name in I.Index.TABLES:
        a, b = (sorted(map(repr, (r.asDict() for r in getattr(x, name).select(sorted(getattr(x, name).columns)).collect()))) for x in (index, again))
        assert a == b, name


def test_an_empty_corpus(spark):
    empty = I.Index.build(spark.createDataFrame([], "doc_id long, titre string, texte string"))
    assert tuple(empty.statistics.first()) == (0, 0.0, 0.0)
    assert empty.postings.isEmpty()


def test_dense_ids(spark):
    names = [f"n{k:03d}" for k in range(100)]
    rows = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, 100)], "name string").repartition(5)
    got = {r["name"]: r["doc_id"] for r in I.dense_ids(rows, "name").collect()}
    assert got == {n: k + 1 for k, n in enumerate(names)}


def test_dense_ids_of_many_wide_rows(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        rows = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), 2000).alias("text"))
        out = I.dense_ids(rows, "name")
        numbered = out.groupBy().agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.sum(F.length("text"))).first()
        assert tuple(numbered) == (40_000, 40_000, 1, 40_000, 80_000_000)
        names = [r["name"] for r in out.where("doc_id <= 500").orderBy("doc_id").collect()]
        assert names == [r["name"] for r in rows.orderBy("name").limit(500).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_dense_ids_by_several_columns(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 9)], "id long, d int")
    got = {r["id"]: r["place"] for r in I.dense_ids(rows, F.desc_nulls_last("d"), F.col("id"), name="place").collect()}
    assert got == {4: 1, 2: 2, 3: 3, 1: 4}
    assert I.dense_ids(rows.limit(0), "id").isEmpty()


def brute(query: ParsedQuery) -> dict[int, float]:
    import re

    out: dict[int, float] = {}
    for doc in DOCS:
        titre, texte = (re.findall(r"\w+", t.lower()) for t in doc[1:3])
        for g in query.groups:
            scores = [3.0 * titre.count(t) for t in g.title] + [3.0 * titre.count(t) + texte.count(t) for t in g.content]
            if scores and all(scores):
                out[doc[0]] = out.get(doc[0], 0.0) + sum(scores)
    return out


QUERIES = {
    "a": ParsedQuery([KeywordGroup(["chimie"], ["airbus"])]),
    "b": ParsedQuery([KeywordGroup([], ["chimie"]), KeywordGroup([], ["avion"])]),
    "c": ParsedQuery([KeywordGroup([], ["chimie", "nichts"])]),
    "d": ParsedQuery([KeywordGroup(["chimie"], ["chimie"])]),
}


def test_frequency_scores_are_those_of_set_algebra(spark, index):
    rows = FrequencyScorer().score(clause_table(spark, list(QUERIES.items())), index).collect()
    got = {q: {r["doc_id"]: r["score"] for r in rows if r["qid"] == q} for q in QUERIES}
    assert got == {q: brute(p) for q, p in QUERIES.items()}


def test_a_batch_is_its_queries_one_by_one(index):
    both = run_batch(list(QUERIES.items()), index)
    for q, p in QUERIES.items():
        one = {(r["doc_id"], r["score"]) for r in run_batch([(q, p)], index).collect()}
        assert one == {(r["doc_id"], r["score"]) for r in both.where(F.col("qid") == q).collect()}
    assert run_batch([("c", QUERIES["c"])], index).count() == len(DOCS)
    assert run_batch([("c", QUERIES["c"])], index, fallback="none").isEmpty()


def test_search_service(index):
    service = SearchService(index)
    assert [(r["doc_id"], r["score"]) for r in service.run("articles qui parlent de chimie").collect()] == [(1, 3.0), (2, 2.0)]
    assert {r["doc_id"] for r in service.run("articles qui parlent de chimie de la rubrique Focus").collect()} == {1, 2}
    assert [r["doc_id"] for r in service.run("articles parus entre le 1 mars 2013 et le 4 mai 2013").collect()] == [1]
    assert {r["doc_id"] for r in service.run("articles avec des images").collect()} == {1, 3}
    assert [r["doc_id"] for r in service.run("articles qui parlent d'avion mais pas de taxi").collect()] == [1]
    assert {r["doc_id"] for r in service.run("articles qui parlent de airbis").collect()} == {1}
    assert "airbus" in service.hint("articles qui parlent de airbis")
    dates = [r["date"] for r in service.run("articles", "booleen").collect()]
    assert dates == sorted((d for d in dates if d), reverse=True) + [None]
    assert SearchService(index, corrector=None).run("articles de la rubrique inconnue").isEmpty()


def test_search_over_http(index):
    web = server(SearchService(index))
    Thread(target=web.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{web.server_address[1]}"
        with urlopen(f"{base}/search?q=articles+qui+parlent+de+airbis") as reply:
            answer = json.load(reply)
        assert [r["doc_id"] for r in answer["results"]] == [1] and "airbus" in answer["hint"]
        with urlopen(f"{base}/search?q=articles&mode=booleen") as reply:
            assert [r["doc_id"] for r in json.load(reply)["results"]] == [3, 1, 2, 4]
        for path in ("/", "/search", "/search?q=a&mode=x"):
            with pytest.raises(HTTPError):
                urlopen(f"{base}{path}")
    finally:
        web.shutdown()


def test_bm25_and_embeddings(spark, index):
    clauses = clause_table(spark, [("b", QUERIES["b"])])
    scores = {r["doc_id"]: r["score"] for r in BM25Scorer().score(clauses, index).collect()}
    assert set(scores) == set(brute(QUERIES["b"])) and all(s > 0 for s in scores.values())
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "doc_id long, vector array<double>")
    wanted = spark.createDataFrame([("b", [1.0, 0.0])], "qid string, vector array<double>")
    mixed = {r["doc_id"]: r["score"] for r in EmbeddingScorer(wanted, vectors, alpha=0.0).score(clauses, index).collect()}
    assert mixed[1] == pytest.approx(1.0) and mixed[2] == pytest.approx(0.0)
    assert [(r["doc_id"], r["place"]) for r in nearest(wanted, vectors, 2).orderBy("place").collect()] == [(1, 1), (3, 2)]


def lexicon(*pairs):
    return SurfaceLexicon(dict(pairs))


def test_correction_statuses():
    c = LevenshteinCorrector(lexicon(("avion", "avion"), ("Avions", "avion")))
    assert c.correct("2024-03-15").tokens[0].status == "entite"
    assert c.correct("AVIONS").tokens[0].status == "valide" and c.lexicon.lemma_for("avions") == "avion"
    assert c.correct("xyzqq").tokens[0].status == "introuvable"
    assert LevenshteinCorrector(lexicon(("avion", "avion"))).correct("avian").tokens[0].status == "corrige-candidat-unique"
    tie = LevenshteinCorrector(lexicon(("airbus", "airbus"), ("airbuy", "airbuy"))).correct("L'airbux!")
    assert tie.tokens[1].status == "corrige-levenshtein" and tie.corrected_query == "L'airbus!"
    assert LevenshteinCorrector(lexicon(("aabcz", "a"), ("zabcd", "z"))).correct("zabcz").tokens[0].correction == "zabcd"
    for word, known in (("a", "avion"), ("z", "zabcd"), ("ab", "abcdefgh")):
        assert LevenshteinCorrector(lexicon((known, known))).correct(word).tokens[0].status == "introuvable"


@pytest.mark.parametrize("kind", [SymSpellCorrector, NgramCorrector, EmbeddingCorrector])
def test_other_correctors(kind):
    c = kind(lexicon(("airbus", "airbus"), ("enseignement", "enseignement")))
    assert c.correct("enseignment").tokens[0].correction == "enseignement"
    assert c.correct("airbos").tokens[0].correction == "airbus"
    assert c.correct("zzzzz").tokens[0].status == "introuvable"


def test_the_join_corrects_as_the_driver_does(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(400)})
    tokens = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"", "3.14"})
    driver = LevenshteinCorrector(SurfaceLexicon({w: w for w in words}))
    table = spark.createDataFrame([(w, w) for w in words], "word string, lemma string")
    got = {r["token"]: (r["status"], r["correction"], r["lemma"]) for r in corrected_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), table).collect()}
    for t in tokens:
        a = driver.analyze(t)
        assert got[t] == (a.status, a.correction, a.lemma), t


def test_a_lexicon_table_is_that_of_the_driver(index):
    for metadata in (False, True):
        got = {r["word"]: r["lemma"] for r in lexicon_table(index, metadata).collect()}
        assert got == dict(SurfaceLexicon.from_index(index, metadata).items())


def test_a_service_with_a_lexicon_too_large_for_the_driver(index):
    small, large = SearchService(index), SearchService(index, driver_words=3)
    assert isinstance(large._corrector(), TableCorrector)
    for question in ("articles qui parlent de airbis", "l'AVION de taxibut, 3.14", "xyzqq", ""):
        a, b = (s._corrector().correct(question) for s in (small, large))
        assert (a.corrected_query, a.lemmatized_query, [t.status for t in a.tokens]) == (b.corrected_query, b.lemmatized_query, [t.status for t in b.tokens])
    assert {r["doc_id"] for r in large.run("articles qui parlent de airbis").collect()} == {1}


def test_violations(spark, index):
    assert {r["n"] for r in index.violations().collect()} == {0}


def test_nearest_ignores_zero_and_other_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 0.0, 0.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.0, 2.0])], "qid string, vector array<double>")
    for block in (1, 100):
        got = {(r["qid"], r["doc_id"]): round(r["similarity"], 6) for r in nearest(queries, vectors, block=block).collect()}
        assert got == {("a", 1): 1.0, ("a", 4): 0.707107, ("d", 1): 0.0, ("d", 4): 0.707107}
        assert [(r["qid"], r["doc_id"]) for r in nearest(queries, vectors, 1, block).orderBy("qid").collect()] == [("a", 1), ("d", 4)]


@pytest.mark.parametrize("find", [symspell_candidates, ngram_candidates, embedding_candidates])
def test_candidates_are_those_of_brute_force(spark, find):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(300)})
    tokens = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(60)} | {words[0]})

    def grams(w, padded):
        w = f"^{w}$" if padded else w
        return Counter(w[k : k + 3] for k in range(len(w) - 2))

    def near(t, w):
        if find is symspell_candidates:
            return edit_distance(t, w) if edit_distance(t, w) <= 2 else None
        a, b = grams(t, find is embedding_candidates), grams(w, find is embedding_candidates)
        if find is ngram_candidates:
            a, b = Counter(set(a)), Counter(set(b))
            value = round(2 * sum((a & b).values()) / max(1, a.total() + b.total()), 6)
            return value if value >= 0.5 else None
        value = round(sum(a[g] * b[g] for g in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 6)
        return value if value >= 0.4 else None

    wanted = {(t, w): near(t, w) for t in tokens for w in words if near(t, w) is not None}
    rows = find(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {(r["token"], r["word"]): r[-1] for r in rows} == pytest.approx(wanted, abs=2e-6) and len(rows) == len(wanted)


def test_precision_recall(spark):
    assert precision_recall_f1(set(), set()) == (1.0, 1.0, 1.0)
    assert precision_recall_f1({1}, set()) == precision_recall_f1(set(), {1}) == (0.0, 0.0, 0.0)
    found, wanted = {"x": {1, 2, 3}, "y": set(), "z": {5}, "w": set()}, {"x": {2, 3, 4}, "y": {1}, "z": set(), "w": set()}
    frames = [spark.createDataFrame([(q, d) for q, s in t.items() for d in s], "qid string, doc_id long") for t in (found, wanted)]
    queries = spark.createDataFrame([(q,) for q in found], "qid string")
    for r in evaluated(*frames, queries).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(precision_recall_f1(found[r["qid"]], wanted[r["qid"]]))


def test_evaluation_run(index, tmp_path):
    golden = [("Q1", "articles qui parlent de chimie", {"10", "20"}), ("Q2", "articles de la rubrique A lire avec des images", {"30"})]
    rows = run_evaluation(SearchService(index), golden, report=f"file://{tmp_path}/report").collect()
    assert [r["f1"] for r in rows] == [1.0, 1.0] and rows[0]["retrieved"] == ["10", "20"]
    assert list((tmp_path / "report").glob("*.json"))


@pytest.mark.parametrize("name", CODECS)
def test_codecs(spark, name):
    codec = CODECS[name]()
    rng = random.Random(name)
    for values in ([], [0], [1, 1, 2], sorted(rng.randrange(1 << 27) for _ in range(200)), list(range(300))):
        assert codec.decode(codec.encode(values)) == values
    table = spark.createDataFrame([(1, [3, 7, 300]), (2, []), (3, None)], "id int, v array<long>")
    got = {r["id"]: r["w"] for r in table.select("id", codec.decoded(codec.encoded(F.col("v"))).alias("w")).collect()}
    assert got == {1: [3, 7, 300], 2: [], 3: None}
