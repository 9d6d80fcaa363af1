"""URL filter, decontamination, WARC, pieces, near-duplicates, chat."""

import os
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, minhash, sentencepiece, url_filter, warc
from lectern.llm.components import components
from lectern.llm.queries import ORACLES, QUERIES, listed_hosts, table
from lectern.scratch import Scratch
from lectern.llm.textarrays import Piece, mix, text_pieces
from tests.llm.tables import LONG, ODD, labels, odd_documents, prose

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, tmp_path, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    QUERIES[name](spark, FOLDER).write.parquet(f"{tmp_path}/out")
    columns = ", ".join(sorted(c.sql(ORACLES[name]).columns))
    wanted = sorted(map(repr, c.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()))
    assert sorted(map(repr, c.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'").fetchall())) == wanted


# ---- URL filter


@pytest.mark.parametrize(("hashes", "segment_bits"), [(1, 1 << 26), (4, 1 << 26), (4, 700), (2, 100)])
def test_the_cascade_tells_every_key(spark, hashes, segment_bits):
    keys = [f"host{k}.example.net" for k in range(3000)]
    listed = set(random.Random(1).sample(keys, 400))
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[0],)], "key string")
    cascade = url_filter.build(spark.createDataFrame([(k,) for k in listed] + [("elsewhere",), (None,)], "key string"), universe, Scratch(spark, "t"), url_filter.Settings(hashes, segment_bits))
    assert len(cascade.levels) > 1 and (len(cascade.levels[0].segments) > 1) == (segment_bits < 1000)
    assert all(s.selectExpr('size(bits)').first()[0] * 64 <= max(64, segment_bits) + 64 for s in cascade.levels[0].segments)
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == listed
    none = url_filter.build(universe.limit(0), universe, Scratch(spark, "t"))
    assert universe.where(none.holds(F.col("key"))).isEmpty()


URLS = [
    (1, None), (2, "nothing"), (3, "http://A.Example.ORG/es/x?y#z"), (4, "https://example.org/en/12"), (5, "https://x.org?q=/a"),
    (6, "https://x.org/"), (7, "ftp://a.com/fr/b"), (8, "http://b.com/de/"), (9, "http://blocked.host.net/en"), (10, "x://y://z/w"),
    (11, "http://notexample.org/es/"), (12, "http://ÉX.com/de/x"), (13, "http://long.com/fr/" + "x" * 1_000_000), (None, "http://x.com"), (3, "http://A.Example.ORG/es/x?y#z"),
]


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("blocked.host.net",), ("unseen.org",)], "key string")
    for settings in (url_filter.Settings(), url_filter.Settings(segment_bits=64)):
        rows = url_filter.judge(pages, listed, settings=settings).collect()
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
        assert len(rows) == len(URLS)
        assert got[1] == got[2] == ("", "", None, "allow")
        assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
        assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
        assert got[5] == ("x.org", "", None, "allow") and got[6][2:] == ("org/", "allow")
        assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block")
        assert got[9] == ("blocked.host.net", "/en", None, "block")
        assert got[10][:2] == ("y:", "//z/w") and got[11][2:] == ("org/", "allow") and got[12][0] == "Éx.com"
        assert len(got[13][1]) == 1_000_004 and got[13][2:] == ("com/fr/", "allow")
    assert url_filter.judge(pages.limit(0), listed).count() == 0


@needs_tables
def test_native_plans_have_no_python(spark):
    pages = table(spark, FOLDER, "pages")
    for frame in (url_filter.judge(pages, listed_hosts(pages)), QUERIES["op10_chat_preference"](spark, FOLDER)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ---- decontamination


def test_containment_is_that_of_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(prose(10_000 + k, n))) for k, n in enumerate([3, 4, 5, 6, 8, 12, 20, 37, 60, 200] * 3)]
    items += [(100, None), (101, ""), (102, items[7][1]), (None, items[8][1])]
    docs = []
    for k in range(160):
        body = prose(20_000 + k, rng.choice([0, 5, 60, 400, 3000]))
        item = items[rng.randrange(30)][1].split()
        if k % 2 == 0:
            kept = item[: max(1, int(len(item) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + kept + body[at:]
        if k % 5 == 0:  # in two halves, far apart
            half = len(item) // 2
            body = item[:half] + body + item[half:]
        docs.append((k, " ".join(body).upper() if k % 3 else " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, LONG + " " + items[9][1])]
    wanted = set()
    for d, text in docs:
        for i, item in items:
            n = min(5, len(words(item)))
            q = shingles(item, n) if n else set()
            x = shingles(text, n) if n else set()
            if q and len(q & x) >= 0.8 * len(q):
                wanted.add((d, i, len(q & x), len(q)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_words=100)):
        got = decontaminate.matches(*frames, settings).collect()
        assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == wanted and len(got) == len(wanted)
    kept = {r["doc_id"] for r in decontaminate.clean(*frames).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in wanted}


def test_decontamination_on_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "twice the same row of text here"), (2, None), (3, "one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect())
    assert got == [(5, 1), (5, 1), (7, 3)]
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ODD)
    assert decontaminate.matches(docs.limit(0), items).count() == 0


# ---- WARC

PAGES = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é" * 3000), (7, "http://b/", "same"), (None, "u", "lost")]


def test_archives_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("content", F.lit("clash"))
    rows = warc.read_archives(warc.write_archives(pages, warc.Settings(archive_bytes=500))).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    wanted = [(0, "response", None, 4), (1, "revisit", 7, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 6000), (7, "response", None, 4), (7, "response", None, 4)]
    assert got == wanted and all(r["kind"] == "record" and r["reason"] is None for r in rows)
    assert {r["payload_digest"] for r in rows if r["payload_bytes"] == 4 and r["page_id"]} == {warc.base32_sha1(b"same")}
    assert next(bytes(r["payload"]).decode() for r in rows if r["page_id"] == 5) == "é" * 3000
    assert {r["record_type"] for r in warc.read_archives(warc.write_archives(pages, warc.Settings(revisit_from=5))).where("page_id = 1").collect()} == {"response"}
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_salvage_within_a_member():
    rng = random.Random(4)
    records = [warc.page_record(k, "u", bytes(rng.randrange(33, 126) for _ in range(30_000)), None, "d") for k in range(4)]

    def ids(content):
        return [warc._page_number(x.headers["warc-record-id"]) for x in warc.salvage(content) if isinstance(x, warc.Record)]

    whole = warc.member(b"".join(records))
    assert ids(whole) == [0, 1, 2, 3]
    bad = bytearray(records[1])
    bad[-20] ^= 1
    found = list(warc.salvage(warc.member(records[0] + bytes(bad) + b"".join(records[2:]))))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert len(found) == 4 and [(g.start, g.end, g.member) for g in gaps] == [(len(records[0]), len(records[0] + records[1]), 0)]
    assert ids(warc.member(b"".join(records[:3]) + records[3][:-9])) == [0, 1, 2]
    assert ids(whole[: len(whole) * 7 // 8] + warc.member(records[3])) == [0, 1, 2, 3]
    assert ids(whole[:-4]) == [0, 1, 2]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [warc.page_record(k, f"http://h/{k}", (b"x%d " % k) * 50, None, "2000-01-01T00:00:00Z") for k in range(12)]
    members = [warc.member(r) if packed else r for r in records]

    def read(content):
        found = list(warc.salvage(content))
        ids = [int(f.headers["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for f in found if isinstance(f, warc.Record)]
        return ids, [f for f in found if isinstance(f, warc.Gap)]

    assert read(b"".join(members)) == (list(range(12)), [])
    sizes = np.cumsum([0, *map(len, members)])
    rng = random.Random(2)
    for _ in range(60):
        hit = sorted(rng.sample(range(12), 3))
        damaged = list(members)
        for k in hit:
            m = bytearray(damaged[k])
            if rng.random() < 0.3:
                m = bytearray(rng.randbytes(len(m)))
            else:
                m[rng.randrange(len(m) // 2, len(m) - 9)] ^= 0x5A
            damaged[k] = bytes(m)
        ids, gaps = read(b"".join(damaged))
        assert set(range(12)) - set(hit) <= set(ids)
        for k in set(hit) - set(ids):
            assert any(g.start <= sizes[k] and g.end >= sizes[k + 1] for g in gaps)
    ids, gaps = read(b"junk" + members[0] + b"\x1f\x8b\x08more junk WARC/1.1 no" + members[1] + members[2][:-3])
    assert ids == [0, 1] and len(gaps) == 3 and gaps[0] == warc.Gap(0, 4, gaps[0].reason)
    assert all(a.end <= b.start for a, b in zip(gaps, gaps[1:], strict=False))
    assert read(b"") == ([], [])


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(sentencepiece.MODEL_FILE):
        pytest.skip("no tokenizer files")
    return sentencepiece.load_vocabulary()


def odd_strings():
    rng = random.Random(6)
    out = ["", " ", "   ", "hello  world", " a\nb\tc  ", "ﬁ ½ é", "e\u0301", "\u3000x", "a\r\nb\x00c", "Ich häb 𝒳", "     x", "  𝒳", "\n\n a", "a" * 300, "=-=-==", "日本語 中文 한국어", "1234567890.5", "abc\u00a0def", "\xff\x00\x00", "x" + " " * 40 + "y"]
    out += ["".join(rng.choice(["a", "b", "th", "e", " ", "  ", "\n", "é", "the", "ing", "0", "_", "𝒳", "\t"]) for _ in range(rng.randrange(50))) for _ in range(500)]
    return [*out, LONG[:20_000]]


def test_pieces_are_those_of_the_library(vocabulary):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)
    texts = odd_strings()
    for size in (1 << 20, 200):
        encoder, decoder = sentencepiece.Encoder(vocabulary), sentencepiece.Decoder(vocabulary)
        for p in text_pieces(pa.array(texts), size):
            ids, first = encoder.encode(p)
            for d in range(p.n_docs):
                assert ids[first[d] : first[d + 1]].tolist() == model.encode(texts[p.first + d]), texts[p.first + d][:40]
            data, _ = decoder.decode(ids, first)
            assert data.tobytes() == p.data.tobytes()


def long_strings():
    rng = random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    out = [" " * n + "x" for n in (1, 2, 3, 15, 16, 17, 31, 33, 1000, 5001)] + [" " * n for n in (1, 2, 7, 16, 4099)]
    out += [word, "日本語の文" * 900, "a" * 5000, "é" * 3000 + word[:2000], "ab" * 3000 + " " * 900 + word[:1500] + "\n" + " " * 5 + word[:3000]]
    return [*out, "".join(rng.choice(["th", "ing", "𝒳", "=", "-", "0", "tion", "ß"]) for _ in range(4000))]


def test_long_words_and_runs_of_blanks_are_those_of_the_library(vocabulary, monkeypatch):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)
    texts = long_strings()
    for stretch, overlap in ((512, 128), (64, 8)):
        monkeypatch.setattr(sentencepiece, "STRETCH", stretch)
        monkeypatch.setattr(sentencepiece, "OVERLAP", overlap)
        encoder = sentencepiece.Encoder(vocabulary)
        for p in text_pieces(pa.array(texts), 1 << 20):
            ids, first = encoder.encode(p)
            for d in range(p.n_docs):
                assert ids[first[d] : first[d + 1]].tolist() == model.encode(texts[p.first + d]), texts[p.first + d][:40]


def test_very_long_texts_take_time_in_proportion(vocabulary):
    encoder, decoder = sentencepiece.Encoder(vocabulary), sentencepiece.Decoder(vocabulary)
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", k=400_000))
    for text, most in ((" " * 1_000_000 + "x", 20), (word, 60)):
        began = time.perf_counter()
        (p,) = text_pieces(pa.array([text]))
        assert sentencepiece._verified(encoder, decoder, p)[2].all()
        assert time.perf_counter() - began < most


def test_words_of_one_hash_are_told_apart(vocabulary, monkeypatch):
    monkeypatch.setattr(Piece, "span_hashes", lambda self, starts, ends: mix((ends - starts).astype(np.uint64)))
    texts = [" ".join(prose(k, 30)) for k in range(5)]
    encoder, decoder = sentencepiece.Encoder(vocabulary), sentencepiece.Decoder(vocabulary)
    for p in text_pieces(pa.array(texts)):
        ids, first, same = sentencepiece._verified(encoder, decoder, p)
        assert same.all()


def test_known_words_do_not_change_results(vocabulary):
    texts = [" ".join(prose(k, 50)) for k in range(30)]
    plain, small = sentencepiece.Encoder(vocabulary), sentencepiece.Encoder(vocabulary)
    small.known = sentencepiece.KnownWords(bits=4, words=20)
    for _ in range(2):
        for p in text_pieces(pa.array(texts), 500):
            assert all((a == b).all() for a, b in zip(plain.encode(p), small.encode(p), strict=True))


def test_pieces_on_odd_rows(spark, vocabulary):
    docs = odd_documents(spark)
    out = sentencepiece.encoded(docs, vocabulary)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["ids"] is None and rows[1]["round_trip"] is None and rows[2]["ids"] == []
    assert all(r["round_trip"] == (k != 8) for k, r in rows.items() if k != 1)  # row 8 has the mark
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decoded(out.select("doc_id", "ids"), vocabulary).collect()}
    assert all(back[o[0]] == (o[1].replace("▁", " ") if o[1] is not None else None) for o in ODD)
    assert sentencepiece.encoded(docs.limit(0), vocabulary, keep_text=False).count() == 0


# ---- near-duplicates


def brute_classes(docs, least=0.8):
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    reps = [(min(v), s) for s, v in by_set.items() if s]
    for s, v in by_set.items():
        if s:
            root.update((i, min(v)) for i in v)
    for k, (i, s) in enumerate(reps):
        for j, t in reps[:k]:
            if len(s & t) >= least * len(s | t) - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_classes_are_those_of_brute_force(spark):
    rng = random.Random(8)
    docs, base = [], " ".join(prose(1, 150))
    for _ in range(160):  # a large group, near to and far from its base
        docs.append(edited(base, rng.randrange(12), rng))
    docs += [base] * 60
    for k in range(60):
        text = " ".join(prose(100 + k, rng.choice([3, 5, 8, 40, 200, 900])))
        docs += [text, edited(text, 1, rng), text.upper().replace(" ", "  "), edited(text, max(1, len(text.split()) // 30), rng)]
    shared = " ".join(prose(7, 55))
    docs += [" ".join(prose(5000 + k, 40)) + " " + shared for k in range(80)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    wanted = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 300).astype(float), rng.integers(0, 6, 300).astype(float)
    y[:200] = x[:200]
    wanted = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    names = np.arange(300, dtype=np.uint64) * np.uint64(7919)
    minima = [minhash.dart_minima(names[w > 0], w[w > 0], np.array([0, (w > 0).sum()]), 2000)[0] for w in (x, y)]
    assert (minima[0] == minima[1]).mean() == pytest.approx(wanted, abs=0.04)
    empty = minhash.dart_minima(names[:0], x[:0], np.array([0, 0]), 5)
    assert np.isinf(empty).all()


def test_a_signature_does_not_depend_on_its_neighbours():
    names = np.arange(50, dtype=np.uint64) * np.uint64(104729)
    alone = minhash.dart_minima(names[:20], np.ones(20), np.array([0, 20]), 60)
    both = minhash.dart_minima(names, np.ones(50), np.array([0, 20, 21, 50]), 60)
    assert (alone[0] == both[0]).all()


def test_weighted_classes(spark):
    a, b = "a b c d e f " * 30, "a b c d e f " * 10
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    by = {w: {r["class_id"] for r in minhash.near_duplicates(rows, minhash.Settings(weights=w)).collect()} for w in ("distinct", "count")}
    assert by == {"distinct": {1}, "count": {1, 2}}


def test_near_duplicates_on_odd_rows(spark):
    docs = odd_documents(spark, [*ODD, (20, ODD[6][1].upper(), "en", "s", 1), (21, LONG + " end", "en", "s", 1)])
    rows = minhash.near_duplicates(docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(ODD) + 2
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7, 8: 8, 20: 20, 21: 4, None: 20}
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 20]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_broadcasts_do_not_change_results(spark):
    rng = random.Random(1)
    text = " ".join(prose(3, 100))
    rows = spark.createDataFrame([(k, edited(text, k % 4, rng)) for k in range(30)], "doc_id long, text string")
    a, b = (sorted(minhash.near_duplicates(rows, minhash.Settings(broadcast_rows=n)).collect()) for n in (0, 1000))
    assert a == b


def test_small_intermediate_tables_are_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions; the classes are the same."""
    rng = random.Random(2)
    texts = [edited(" ".join(prose(k % 20, 100)), k // 20, rng) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    wanted = sorted(minhash.near_duplicates(docs).collect())
    files, keep = [], Scratch.keep

    def counted(*given, **named):
        kept = keep(*given, **named)
        files.append((given[2], len(kept.inputFiles())))
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(minhash.near_duplicates(docs).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == wanted and len({r["class_id"] for r in got}) < len(got)
    assert len(files) > 10 and max(n for _, n in files) <= spark.sparkContext.defaultParallelism, files


def plan_rows(frame, name):
    """Rows that the nodes of that name made, after the frame was collected."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        made = node.metrics().apply("numOutputRows").value() if node.nodeName() == name else 0
        return made + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_sets_that_share_a_frequent_element_are_not_all_compared(spark, broadcast_rows):
    rng = random.Random(12)
    base = " ".join(prose(4, 150))
    near = [edited(base, rng.randrange(1, 3), rng) for _ in range(300)]
    far = [edited(base, 5, rng) for _ in range(300)]  # below 0.8 from all others, yet with frequent elements in their prefixes
    twins = [edited(t, 1, rng) for t in far[:20]] + [" ".join(t.split()[:128]) for t in near[:5]]
    texts = dict(enumerate(near + far + twins))
    rooted = spark.createDataFrame([(k, 0 if k < 300 else k) for k in texts], "id long, root long")
    settings = minhash.Settings(broadcast_rows=broadcast_rows)
    sets = minhash.packed_sets(spark.createDataFrame(list(texts.items()), "id long, text string"), settings)
    found = minhash.prefix_pairs(rooted, sets, settings, Scratch(spark, "prefixes"))
    got = {(r["a"], r["b"]) for r in found.collect()}
    names = {k: frozenset(shingles(t)) for k, t in texts.items()}
    wanted = {(a, b) for b in names for a in range(b) if b >= 300 and 5 * len(names[a] & names[b]) >= 4 * len(names[a] | names[b])}
    assert len(wanted) > 20 and wanted <= got
    assert plan_rows(found, "Generate") < 20 * len(texts)


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5), (3, 1), (3, 1)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["root"] for r in components(frame, Scratch(spark, "t")).collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
    assert components(frame.limit(0), Scratch(spark, "t")).count() == 0


# ---- chat


TURNS = [
    (0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "good <|im_end|>"), (0, 3, "user", "thanks"),
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad"),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"),
    (6, 0, "user", None), (6, 0, "user", None), (7, 0, None, None), (None, 0, "user", "x"), (6, None, "user", "x"),
]


def test_preference_pairs(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7)], "pair_id long, chosen_id long, rejected_id long")
    rows = chat.preference_segments(chat.paired_turns(frame, pairs)).orderBy("pair_id", "part", "turn").collect()
    got = [(r["pair_id"], r["part"], r["turn"], r["masked"], r["target"]) for r in rows]
    o, c = chat.OPEN, chat.CLOSE
    assert got == [
        (0, "chosen", 2, f"{o}assistant\n", f"good < |im_end|>{c}"),
        (0, "chosen", 3, f"{o}user\nthanks{c}", ""),
        (0, "prompt", 0, f"{o}system\ns{c}", ""),
        (0, "prompt", 1, f"{o}user\nu{c}", ""),
        (0, "rejected", 2, f"{o}assistant\n", f"bad{c}"),
        (1, "prompt", 0, f"{o}user\nsame{c}", ""),
        (3, "chosen", 0, f"{o}user\n{c}", ""),
        (3, "rejected", 0, f"{o}\n{c}", ""),
    ]
    assert chat.preference_segments(chat.paired_turns(frame.limit(0), pairs)).count() == 0
    swapped = chat.preference_segments(chat.swapped_replies(frame)).collect()
    assert sorted(swapped) == sorted(chat.preference_segments(chat.swapped_replies(frame), broadcast_rows=0).collect())
    assert {(r["pair_id"], r["part"], r["turn"], r["target"]) for r in swapped} == {
        (0, "prompt", 0, ""), (0, "prompt", 1, ""), (0, "chosen", 2, f"good < |im_end|>{c}"), (0, "chosen", 3, ""), (0, "rejected", 2, f"bad{c}"), (0, "rejected", 3, ""),
        (1, "prompt", 0, ""), (1, "prompt", 1, ""), (1, "chosen", 2, f"bad{c}"), (1, "rejected", 2, f"good < |im_end|>{c}"),
        (2, "prompt", 0, ""), (3, "prompt", 0, ""), (4, "prompt", 0, ""), (6, "prompt", 0, ""), (7, "prompt", 0, ""),
    }
    assert chat.preference_segments(chat.swapped_replies(frame.limit(0))).count() == 0


@needs_tables
def test_prompt_and_completion_are_the_whole_conversation(spark):
    rows = QUERIES["op10_chat_preference"](spark, FOLDER).collect()
    turns = defaultdict(list)
    for r in table(spark, FOLDER, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    parts = defaultdict(str)
    for r in sorted(rows, key=lambda r: (r["turn"], r["role"])):
        parts[r["pair_id"], r["part"]] += r["masked"] + r["target"]
    last = {k: max((t, x) for t, role, x in own if role == "assistant") for k, own in turns.items() if any(role == "assistant" for _, role, _ in own)}

    def shown(own):
        return "".join(f"{chat.OPEN}{role}\n{text}{chat.CLOSE}" for _, role, text in sorted(own))

    for k, own in turns.items():
        other = [(t, role, last[k ^ 1][1] if role == "assistant" and t == last[k][0] else x) for t, role, x in own] if k in last and k ^ 1 in last else own
        assert parts[k, "prompt"] + parts[k, "chosen"] == shown(own)
        assert parts[k, "prompt"] + parts[k, "rejected"] == shown(other)
    swapped = [k for k in turns if parts[k, "rejected"]]
    assert len(swapped) > len(turns) / 2 and sum(bool(parts[k, "prompt"]) for k in swapped) > 0.9 * len(swapped)


# ---- the pipeline


def test_pipeline_stages(spark, tmp_path, vocabulary):
    import corpus_pipeline

    rng = random.Random(12)
    rows, marks = [], []
    item = " ".join(prose(777, 40))
    for k in range(120):
        body = " ".join(prose(3000 + k, 120))
        bad = k % 6 == 5
        text = " ".join(f"{w}&&&" for w in body.split()) if bad else body
        rows.append((k, text, "en", "s", len(text)))
        marks.append((k, 0 if bad else 1, 0))
    rows.append((200, rows[0][1], "en", "s", 1))
    rows.append((201, edited(rows[1][1], 2, rng), "en", "s", 1))
    rows.append((202, " ".join(prose(8001, 90)) + " " + item + " " + " ".join(prose(8002, 90)), "en", "s", 1))
    rows.append((203, " ".join(prose(8003, 90)) + " write to a.b@c.example.com now", "en", "s", 1))
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{len(seen)}")
        docs = spark.read.parquet(f"{folder}/stage{len(seen)}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    good = {k for k, q, _ in marks if q} | {200, 201, 202, 203}
    assert set(seen[0]) == good
    assert set(seen[1]) == good - {200, 201}
    assert set(seen[2]) == set(seen[3]) == good - {200, 201, 202}
    assert seen[3][203]["text"].endswith("write to [EMAIL] now") and seen[3][203]["n_chars"] == len(seen[3][203]["text"])
    assert all(seen[3][k]["text"] == seen[2][k]["text"] for k in seen[3] if k != 203)
    result = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in result} == set(seen[3]) and all(r["round_trip"] and r["ids"] for r in result)


def test_pipeline_stages_on_odd_rows(spark, tmp_path, vocabulary):
    import corpus_pipeline

    docs = odd_documents(spark)
    folder = f"file://{tmp_path}"
    for name, items, marks in (("some", [(1, "a benchmark item of more than five words"), (2, None)], labels(spark)), ("none", [], labels(spark, []))):
        marks.write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
        for frame in (docs, docs.limit(0)):
            for title, stage in corpus_pipeline.STAGES if name == "some" else ():
                out = stage(spark, frame, f"{folder}/{name}")
                rows = out.collect()
                assert title == "encoding" or out.columns == frame.columns
                if title in ("decontamination", "personal data"):
                    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in frame.collect())
                if title == "near-dedup" and rows:
                    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 7, 8]
                if title == "encoding":
                    assert all((r["ids"] is None) == (r["doc_id"] == 1) for r in rows)
    for title in ("quality classifier", "decontamination"):  # nothing to learn from, and no items
        assert stage_rows(corpus_pipeline, title, spark, docs, f"{folder}/none") == len(ODD)


def stage_rows(pipeline, title, spark, docs, folder):
    return dict(pipeline.STAGES)[title](spark, docs, folder).count()


@needs_tables
def test_the_pipeline_is_that_of_brute_force(spark, vocabulary):
    import sentencepiece as library

    import corpus_pipeline
    from lectern.llm import pii, quality_classifier
    from tests.llm.test_models import brute_quality

    documents = table(spark, FOLDER, "documents")
    model = quality_classifier.train(documents, table(spark, FOLDER, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows = [(i, t) for i, t in rows if brute_quality(t, model) >= 0.3]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    items = [shingles(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(q and len(q & shingles(t)) >= 0.8 * len(q) for q in items)]
    tagger = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    coder = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)
    wanted = {}
    for i, t in rows:
        spans = pii.spans_of([t or ""], tagger, pii.Settings())[0][1]
        wanted[i] = coder.encode(pii.masked(t, spans)) if t is not None else None
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == wanted


def test_a_very_long_turn(spark):
    frame = spark.createDataFrame([(0, 0, "user", "u" * 1_000_000), (0, 1, "assistant", "a" * 1_000_000), (1, 0, "user", "v"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = {(r["pair_id"], r["part"]): r for r in chat.preference_segments(chat.swapped_replies(frame)).collect()}
    assert rows[0, "chosen"]["target"] == "a" * 1_000_000 + chat.CLOSE and rows[0, "prompt"]["masked"].count("u") > 999_999 and rows[0, "rejected"]["target"] == "b" + chat.CLOSE
