"""Queries do their work on executors, once, and in proportion to their tables."""

import os
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import correction, index, scoring
from lectern.operators.codecs import CODECS
from lectern.operators.correction import COMPARED_TOKENS, LevenshteinCorrector, SurfaceLexicon, edit_candidates, embedding_candidates, ngram_candidates
from lectern.operators.ngrams import ngram_postings
from lectern.plans import search
from lectern.queries import QUERIES, words_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_a_lexicon_does_not_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.delattr(SurfaceLexicon, "from_index")
    assert QUERIES["lexicon"](spark, FOLDER).count() > 0


def test_only_distinct_words_are_normalized(spark):
    plan = words_of(spark, FOLDER, "documents")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_the_status_of_tokens_reads_the_lexicon_once(spark):
    plan = QUERIES["token_status"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_many_tokens_of_a_prefix_and_few_have_all_their_candidates(spark):
    letters = "abcdefghij"
    many = [f"pre{a}{b}z" for a in letters for b in letters]  # more than are compared one by one
    few, words = ["prefab", "ab", "zz", "longerwordx"], [f"pre{a}{b}" for a in letters for b in letters] + ["prefabs", "prfab", "abc", "ab", "longerword", "lungerword", "z", ""]
    tokens = spark.createDataFrame([(t,) for t in [*many, *few]], "token string")
    got = {(r["token"], r["word"], r["distance"]) for r in edit_candidates(tokens, spark.createDataFrame([(w, w) for w in words], "word string, lemma string")).collect()}
    corrector = LevenshteinCorrector(SurfaceLexicon({w: w for w in words}))
    assert len(many) > COMPARED_TOKENS and got == {(t, c.word, c.distance) for t in [*many, *few] for c in corrector.candidates(t)}


@pytest.mark.parametrize("find", [ngram_candidates, embedding_candidates])
def test_blocks_of_tokens_give_the_pairs_of_one_block_without_a_join(spark, monkeypatch, find):
    words = ["aaaa", "aaaab", "banana", "bananas", "ananas", "pre", "prefix", "prefixes", "suffix", "é😀é😀", "", "a"]
    lexicon = spark.createDataFrame([(w, w) for w in [*words, None]], "word string, lemma string")
    tokens = spark.createDataFrame([(w,) for w in [*words, "bananaana", "préfix", None]], "token string")
    whole = find(tokens, lexicon)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(correction, "TOKEN_BLOCK", 5)
    monkeypatch.setattr(correction, "TOKEN_CELLS", 20)
    assert sorted(map(tuple, find(tokens, lexicon).collect())) == sorted(map(tuple, whole.collect()))
    assert {("bananas", "banana"), ("prefixes", "prefix")} <= {(r["token"], r["word"]) for r in whole.collect()}


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["token_tf", "char_ngrams", "word_ngrams"])
def test_documents_with_their_own_ids_are_counted_within_their_rows(spark, name):
    assert "Aggregate" not in plan_of(QUERIES[name](spark, FOLDER))


def test_documents_of_one_id_are_counted_together(spark):
    rows = [(1, "A a b", "a"), (1, "b b", ""), (2, None, "c C"), (None, "a", "a"), (None, "a", None)]
    documents = spark.createDataFrame(rows, "doc_id long, titre string, texte string")
    for part in (documents, documents.where("titre IS NULL OR texte = 'a'")):
        wanted = sorted(map(repr, index.term_counts(index.tokens_of(part)).select("doc_id", "zone", "term", "tf").collect()))
        assert sorted(map(repr, index.counts_of(part).select("doc_id", "zone", "term", "tf").collect())) == wanted
        texts = part.selectExpr("doc_id", "concat_ws(' ', titre, texte) AS text")
        got = [sorted(map(repr, ngram_postings(texts, 1, distinct=d).collect())) for d in (False, None)]
        assert got[0] == got[1]


@pytest.mark.parametrize("name", ["integrity", "ngram_lookup", "index_tables"])
def test_what_reads_an_index_often_reads_it_written(spark, name):
    assert "regexp_extract_all" not in plan_of(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["term_max_tfidf", "streaming_upserts"])
def test_weights_and_counts_need_no_join_with_postings(spark, name):
    assert "Join Inner" not in plan_of(QUERIES[name](spark, FOLDER))


def test_a_batch_of_questions_takes_no_lexicon_to_the_driver(spark, monkeypatch):
    monkeypatch.delattr(SurfaceLexicon, "from_index")
    tables = []
    monkeypatch.setattr(search, "lexicon_table", lambda *a, **b: tables.append(1) or correction.lexicon_table(*a, **b))
    assert QUERIES["search_questions"](spark, FOLDER).count() > 0 and len(tables) == 1


def test_long_lists_are_coded_in_few_steps():
    values = np.arange(60_000)
    lists = [values, values[:0], values[5:6], values[::3]]
    data, first = np.concatenate(lists), np.append(0, np.cumsum([len(v) for v in lists]))
    for kind in CODECS.values():
        began = time.perf_counter()
        again, places = kind().decode_lists(*kind().encode_lists(data, first))
        assert (again == data).all() and (places == first).all()
        assert time.perf_counter() - began < 1.0  # one numpy call or more for each number of the longest list took longer


def test_similarities_are_taken_in_bounded_pieces(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(scoring.np, "partition", lambda a, *b, f=np.partition, **c: sizes.append(a.size) or f(a, *b, **c))
    monkeypatch.setattr(scoring, "CELLS", 12)
    queries = SimpleNamespace(value=[(str(k), [1.0, float(k)]) for k in range(3)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([[1.0, float(k % 7)] for k in range(20)], pa.list_(pa.float64()))], names=["doc_id", "vector"])
    frame = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: list(run(iter([batch])))))
    rows = [r for b in scoring._similarities(frame, queries, 2) for r in b.to_pylist()]
    assert max(sizes) <= 12 and {r["doc_id"] for r in rows if r["qid"] == "0"} == {0, 7, 14, *[r["doc_id"] for r in rows if r["qid"] == "0"]}
