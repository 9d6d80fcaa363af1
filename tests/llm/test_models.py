"""Text arrays, classifier, language identification, rules, personal data."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id, pii, quality_classifier, quality_rules
from lectern.llm.queries import QUERIES, table
from lectern.llm.sampling import held_out, may_learn
from lectern.llm.textarrays import Piece, mix, text_pieces
from tests.llm.tables import LONG, ODD, labels, odd_documents, prose

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts():
    rng = random.Random(7)
    out = ["", None, "\n", "\n\n a\n a\n", "a", "a b c d e f", LONG[:5000], "é è\x1cx y\x0bz", "a b c a b c a b", "x\n\nx\nx \n x"]
    out += ["".join(rng.choice("ab \n\té#$") for _ in range(rng.randrange(60))) for _ in range(200)]
    return out


def pieces(texts, size=64):
    return list(text_pieces(pa.array(texts, pa.string()), size))


def test_words_lines_and_shingles():
    texts = some_texts()
    seen = 0
    hash_of: dict[tuple, int] = {}
    for p in pieces(texts):
        starts, ends, first = p.words
        line_starts, line_ends, line_docs = p.lines()
        shingles, owners = p.shingles(3)
        for d in range(p.n_docs):
            text = (texts[p.first + d] or "").encode()
            words = [m[0].encode() for m in WORD.finditer(text.decode())]
            assert [p.data[a:b].tobytes() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]], strict=True)] == words
            own = line_docs == d
            assert [p.data[a:b].tobytes() for a, b in zip(line_starts[own], line_ends[own], strict=True)] == text.split(b"\n")
            wanted = [tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
            got = shingles[owners == d].tolist()
            assert len(got) == len(wanted)
            for w, g in zip(wanted, got, strict=True):
                assert hash_of.setdefault(w, g) == g
        seen += p.n_docs
    assert seen == len(texts) and len(set(hash_of.values())) == len(hash_of)


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)]


def test_base_statistics():
    texts = some_texts()
    got = np.concatenate([quality_rules.base_statistics(p) for p in pieces(texts, 300)])
    assert got.tolist() == [brute_base(t) for t in texts]


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_thue_morse_words_apart():
    for n in (3, 8, 10, 12):
        a, b = thue_morse(n)
        (p,) = pieces([f"{a}\n{b}\n{a}"], 1 << 20)
        starts, ends, _ = p.words
        assert len(set(p.word_hashes.tolist())) == 2
        assert p.same_spans(starts[[0, 0]], ends[[0, 0]], starts[[1, 2]], ends[[1, 2]]).tolist() == [False, True]
        assert quality_rules.base_statistics(p).tolist() == [brute_base(f"{a}\n{b}\n{a}")]


def test_base_statistics_do_not_rest_on_hashes(monkeypatch):
    texts = some_texts()
    monkeypatch.setattr(Piece, "span_hashes", lambda self, starts, ends: mix((ends - starts).astype(np.uint64)))
    got = np.concatenate([quality_rules.base_statistics(p) for p in pieces(texts, 300)])
    assert got.tolist() == [brute_base(t) for t in texts]


def test_isolation_forest_finds_what_lies_apart():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 0.05, (400, 3)), rng.normal(1, 0.05, (12, 3))])
    good = np.arange(412) < 400
    forest = quality_rules.calibrated(quality_rules.grow(rows, quality_rules.Settings()), rows, good, 200)
    odd = quality_rules.anomaly(forest, rows) >= forest.threshold
    assert odd[~good].all() and odd[good].mean() < 0.01


def test_the_threshold_is_set_on_all_labelled_rows(spark, monkeypatch):
    seen = []
    whole = quality_rules.calibrated_on
    monkeypatch.setattr(quality_rules, "calibrated_on", lambda forest, counts, cost: seen.append(counts) or whole(forest, counts, cost))
    rows = [(k, " ".join(prose(k, 60)) + " #" * (k % 5 if k < 60 else 60)) for k in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 60)) for k, _ in rows], "doc_id long, quality int")
    kept = [k for k, t in rows if not quality_rules.failed(np.array([brute_base(t)]))[0]]
    forest = quality_rules.train(docs, marks, quality_rules.Settings(per_class=5))
    assert len(seen) == len(quality_rules.GROUPS)
    for counts in seen:
        assert [sum(r[j] for r in counts) for j in (2, 3)] == [sum(k < 60 for k in kept), sum(k >= 60 for k in kept)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, forest).collect()}
    assert sum(not got[k]["kept"] for k in kept if k < 60) <= 60 / 200


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    for frame in (docs, docs.limit(0)):
        out = quality_rules.judge(frame, quality_rules.train(frame, labels(spark)))
        assert set(docs.columns) - {"kept"} <= set(out.columns)
        got = {r["doc_id"]: r for r in out.collect()}
        for doc_id, r in got.items():
            text = next(o[1] for o in ODD if o[0] == doc_id)
            assert [r[n] for n in quality_rules.BASE] == brute_base(text)
            assert not r["kept"] or not r["base_failed"]


@needs_tables
def test_rules_keep_good_documents(spark):
    rows = QUERIES["op9_quality_rules"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.6
    every = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, FOLDER).collect()}
    for doc in table(spark, FOLDER, "documents").collect():
        assert [every[doc["doc_id"]][n] for n in quality_rules.BASE] == brute_base(doc["text"])


def test_words_and_lines_have_a_forest(spark):
    rng = random.Random(2)
    good = [(k, " ".join(prose(k, 120))) for k in range(150)]
    odd = [(1000 + k, " ".join("".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(60 + k))) for k in range(40)]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 1000)) for k, _ in good[:100] + odd[:20]], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, quality_rules.train(docs, marks)).collect()}
    assert all(kept[k] for k, _ in good) and sum(kept[k] for k, _ in odd[20:]) <= 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_rules_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, marks = (table(spark, folder, n) for n in ("documents", "labels"))
    learned = marks.where(may_learn(F.col("doc_id")))
    rows = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.train(docs, learned)).join(marks, "doc_id").where(held_out(F.col("doc_id")) & ~F.col("base_failed"))
    kept = {r["quality"]: r["kept"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.995 and kept[0] <= 0.15


@needs_tables
def test_classifier_on_held_out_rows(spark):
    rows = QUERIES["op1_quality_classifier"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_on_odd_rows(spark):
    docs = odd_documents(spark)
    model = quality_classifier.train(docs, labels(spark))
    out = quality_classifier.score(docs, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    blank = quality_classifier.train(docs.limit(0), labels(spark).limit(0))
    assert {r["score"] for r in quality_classifier.score(docs, blank).collect()} == {0.5}


def test_classifier_learns():
    rng = random.Random(0)
    rows = []
    for k in range(200):
        text = " ".join(prose(k, 40)) if k % 2 else " ".join([rng.choice("abc")] * 40)
        (p,) = pieces([text], 1 << 20)
        buckets, first = quality_classifier.ngram_features(p, 16)
        own, n = np.unique(buckets, return_counts=True)
        rows.append((own, n / n.sum(), k % 2))
    model = quality_classifier.fit(rows, quality_classifier.Settings(bits=16))
    (p,) = pieces([" ".join(prose(1000, 50)), "zz " * 50], 1 << 20)
    good, bad = quality_classifier.scores_of(p, model)
    assert good > 0.8 and bad < 0.2


@needs_tables
def test_language_on_held_out_rows(spark):
    rows = QUERIES["op6_language_id"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97


def test_language_on_odd_rows(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert {out[k]["lang_pred"] for k in (1, 2, 3)} == {"und"} and {out[k]["score"] for k in (1, 2, 3)} == {0.0}
    assert out[4]["lang_pred"] in model.languages
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert language_id.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(d[-1::-2]) % 10 == -sum((2 * x) // 10 + (2 * x) % 10 for x in d[-2::-2]) % 10

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    texts = ["", "a@b.c@d.e", "a@@b.c.d-e@f.g", "1.2.3.4.5.6.7.8", "0001.2.3.255 256.1.1.1", "4111 1111-1111 1111", "x4111111111111111y", "+1 (555) 123-4567.", "++1 2 3 4 5 6 7 8 9", "é+33 1 23 45 67 89"]
    texts += ["".join(rng.choice("ab1234567890.@+- ()") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice("14@.a-") for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_the_greatest_sum_stays():
    assert pii.reconciled([(0, 5, 0, 0.9), (4, 9, 1, 0.95), (8, 12, 2, 0.9)]) == [(0, 5, 0, 0.9), (8, 12, 2, 0.9)]
    assert pii.reconciled([(0, 5, 0, 0.5), (0, 5, 0, 0.9)]) == [(0, 5, 0, 0.9)]
    assert pii.reconciled([]) == []


def test_gradients():
    s = pii.Settings(hidden=3, embedding=3, epochs=0)
    rng = np.random.default_rng(0)
    windows, tags = rng.integers(0, 20, (4, 7)), np.zeros((4, 7), np.int64)
    tags[:, 2], tags[:, 3] = 1, 2
    model = {k: v.astype(float) for k, v in pii.fit(windows, tags, s).items()}
    _, grads = pii._gradients(model, windows, tags)
    for key in ("embed", "fx", "fh", "bb", "out", "bias", "moves"):
        at = tuple(int(rng.integers(n)) for n in model[key].shape)
        if key == "embed":
            at = (int(windows[0, 0]), 1)
        ends = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in model.items()}
            moved[key][at] += step
            ends.append(pii._gradients(moved, windows, tags)[0])
        assert grads[key][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6), key


@pytest.fixture(scope="module")
def tagger():
    texts = [" ".join(prose(k, 60)) + f" a.{k}@mail{k % 9}.example.com +1 (555) 123-45{k % 90 + 10} 10.0.{k}.1 " + " ".join(prose(k + 500, 60)) for k in range(60)]
    s = pii.Settings()
    return pii.fit(*pii.training_windows(texts, s), s)


def test_the_tagger_adds_what_the_patterns_miss(tagger):
    clean = [" ".join(prose(k, 300)) for k in range(20)] + ["version 2.0 of 3 apples, 12 pears and 1,204.50 in 2024"]
    assert not any(pii.added_spans(clean, tagger, pii.Settings()))
    filler = " ".join(prose(5, 40))
    cards = f"{filler} 4111111111111111 5500005555555559 {filler}"
    base, every = pii.spans_of([cards], tagger, pii.Settings())[0]
    assert base["card"] == [] and every["card"]
    mixed = f"{filler} a@b.com {filler}"
    assert pii.spans_of([mixed], tagger, pii.Settings())[0][1]["email"] == brute_spans(mixed)["email"]


def planted_texts(seed, carriers):
    """Carrier texts with written variants and look-alikes among their words, and the variants' (kind, start, end)."""
    rng = np.random.default_rng(seed)
    out = []
    for carrier in carriers:
        words, text, spans = carrier.split(), "", []
        for w in words:
            if rng.random() < 0.03:
                shown, kind = pii.variant(rng, words)
                if kind:
                    spans.append((kind, len(text), len(text) + len(shown)))
                text += shown + " "
            text += w + " "
        out.append((text, spans))
    return out


def rates(tagger, rows, settings):
    """For each kind the share of planted spans that are found, and of found spans that are planted."""
    wanted, got, both = Counter(), Counter(), Counter()
    for (_, spans), (_, every) in zip(rows, pii.spans_of([t for t, _ in rows], tagger, settings), strict=True):
        found = {(k, a, b) for k, own in every.items() for a, b in own}
        for counter, items in ((wanted, spans), (got, found), (both, found & set(spans))):
            counter.update(k for k, _, _ in items)
    return {k: (both[k] / max(1, wanted[k]), both[k] / max(1, got[k]), wanted[k]) for k in pii.KINDS}


def test_written_variants_are_found_in_texts_not_trained_on(tagger):
    rows = planted_texts(99, [" ".join(prose(k + 7000, 300)) for k in range(60)])
    for kind, (recall, precision, n) in rates(tagger, rows, pii.Settings()).items():
        assert n > 20 and recall >= 0.9 and precision >= 0.9, (kind, recall, precision, n)


def test_a_card_must_pass_its_check(tagger):
    filler = " ".join(prose(5, 40))
    for shown, is_card in (("4111.1111.1111.1111", True), ("4111.1111.1111.1112", False), ("４１１１１１１１１１１１１１１１", True)):
        assert bool(pii.spans_of([f"{filler} {shown} {filler}"], tagger, pii.Settings())[0][1]["card"]) == is_card, shown


def test_the_tagger_reads_texts_without_a_digit_or_an_at_sign(tagger):
    filler = " ".join(prose(5, 40))
    text = f"{filler} jane at example dot org {filler}"
    assert not re.search("[0-9@]", text)
    assert "jane at example dot org" in [text[a:b] for a, b, _, _ in pii.added_spans([text], tagger, pii.Settings())[0]]


def test_digits_of_all_scripts_are_one_class():
    assert pii.classes_of("５٣१7𝟗＠").tolist() == pii.classes_of("11111@").tolist()


def _planted(monkeypatch, a, b, text):
    """added_spans with a tagger that is sure of the stretch a to b of the text."""

    def all_windows(model, prepared, windows):
        return np.ones(len(windows), bool)

    def tags_of(model, windows):
        tags = np.zeros(windows.shape, np.int64)
        for row in range(len(windows)):
            own = np.arange(row * 48, row * 48 + 96)
            inside = (own >= a) & (own < b)
            tags[row, inside] = 2
            if inside.any():
                tags[row, inside.argmax()] = 1
        return tags, np.full(windows.shape, 0.95)

    monkeypatch.setattr(pii, "_has_span", all_windows)
    monkeypatch.setattr(pii, "_window_spans", tags_of)
    monkeypatch.setattr(pii, "WIDTH_STEP", 96)
    s = pii.Settings(width=96, overlap=48)
    model = pii.fit(np.zeros((1, 4), np.int64), np.zeros((1, 4), np.int64), pii.Settings(epochs=0))
    return pii.added_spans([text], model, s)[0]


@pytest.mark.parametrize(("a", "b"), [(10, 20), (40, 110), (48, 96), (30, 300), (0, 400), (96, 400), (47, 97), (95, 144)])
def test_spans_are_joined_across_windows(monkeypatch, a, b):
    assert [x[:3] for x in _planted(monkeypatch, a, b, "x" * 400)] == [(a, b, 0)]


def test_the_screen_keeps_every_window_with_a_span(tagger):
    texts = [" ".join(prose(k, 30)) + f" jane at example dot org {k}4111111111111111 (555) 123-4567 " + " ".join(prose(k + 90, 30)) for k in range(40)]
    seen = 0
    for windows, _ in pii._windows_of([pii.classes_of(t) for t in texts], pii.Settings(width=128)):
        tags, _ = pii._window_spans(tagger, windows)
        some = (tags > 0).any(axis=1)
        seen += some.sum()
        assert not (some & ~pii._has_span(tagger, pii._prepared(tagger), windows)).any()
    assert seen


def test_windows_cover_all_texts():
    s = pii.Settings(width=128, overlap=32)
    lengths = [0, 1, 63, 64, 65, 127, 128, 129, 200, 224, 225, 1000, 5000]
    texts = [np.arange(1, n + 1, dtype=np.int32) for n in lengths]
    seen = [np.zeros(n, bool) for n in lengths]
    for windows, where in pii._windows_of(texts, s, rows=3):
        for window, (number, offset) in zip(windows, where, strict=True):
            own = window[window > 0]
            assert (own == np.arange(offset + 1, offset + 1 + len(own))).all()
            seen[number][offset : offset + len(own)] = True
    assert all(x.all() for x in seen)


def test_personal_data_on_odd_rows(spark, tagger):
    docs = odd_documents(spark, [*ODD, (9, "mail x@y.org and 10.0.0.1, +1 (555) 123-4567, 4111 1111 1111 1111!", "en", "s", 1)])
    out = {r["doc_id"]: r for r in pii.detect(docs, tagger).collect()}
    assert [out[9][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert out[1]["spans"] == out[4]["spans"] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs, tagger).collect()}
    assert text[9] == "mail [EMAIL] and [IP], [PHONE], [CARD]!"
    assert all(text[o[0]] == o[1] for o in ODD)
    assert pii.detect(docs.limit(0), None).count() == 0
    assert pii.redact(docs, tagger).columns == docs.columns


@needs_tables
def test_personal_data_query(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    for r in QUERIES["op3_pii"](spark, FOLDER).collect():
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        shown = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in sorted(base[k]))
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


# ---- whole results against brute force

SMALL = "/root/testdata/sf0.001"
needs_small = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def hash_of(content: bytes) -> int:
    p = Piece(0, np.frombuffer(content, np.uint8), np.array([0, len(content)]))
    return int(p.span_hashes(np.array([0]), np.array([len(content)]))[0])


def scrambled(value: int, seed: int) -> int:
    return int(mix(np.array([value % 2**64], np.uint64), seed)[0])


def brute_quality(text: str | None, model) -> float:
    """The dot product of one text's n-grams with the weights, n-gram by n-gram."""
    tokens = [hash_of(t.encode()) for t in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text or "")]
    features = list(tokens)
    features += [scrambled(1 if a == b else scrambled(3 * a + b, 5), 9) for a, b in zip(tokens, tokens[1:], strict=False)]
    total = sum(float(model.weights[f >> (64 - model.bits)]) for f in features)
    return 1 / (1 + math.exp(-(total * model.scale / max(1, len(features)) + model.bias)))


@needs_small
def test_all_quality_scores_are_those_of_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, SMALL, "labels"))
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in QUERIES["op1_quality_classifier"](spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        score = brute_quality(r["text"], model)
        held, found, predicted = got[r["doc_id"]]
        assert found == pytest.approx(score, abs=1e-5) and predicted == (found >= 0.3) and held == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def brute_language(text: str | None, model) -> tuple[str, float]:
    """The mean of one text's subword rows, subword by subword."""
    folded = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 128 or 0x61 <= b <= 0x7A else 32 for b in (text or "").encode())
    rows = []
    for size in (3, 4):
        for k in range(len(folded) - size + 1):
            sub = folded[k : k + size]
            if 32 not in sub[1:-1]:
                key = int.from_bytes(sub, "little") + (size << 40)
                rows.append(((key * 0x9E3779B97F4A7C15) % 2**64) >> (64 - model.bits))
    logits = (model.table[rows].astype(float).sum(axis=0) / max(1, len(rows)) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


@needs_small
def test_all_languages_are_those_of_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        name, score = brute_language(r["text"], model) if lettered else ("und", 0.0)
        assert got[r["doc_id"]]["lang_pred"] == name and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-4)


def brute_anomaly(forest, row) -> float:
    paths = 0.0
    for t in range(len(forest.split)):
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + (2 if row[forest.feature[t, node]] > forest.split[t, node] else 1)
        paths += forest.length[t, node]
    return 2 ** (-paths / len(forest.split) / forest.norm)


@needs_small
def test_all_rule_verdicts_are_those_of_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    forests = quality_rules.train(docs, table(spark, SMALL, "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text, base = r["text"] or "", brute_base(r["text"])
        n, chars = max(1, base[0]), max(1, base[1])
        capitals, marks, digits = (sum(bool(re.match(p, c)) for c in text) for p in (r"[A-Z]", r"[!-/:-@\[-`{-~]", r"[0-9]"))
        rules = [base[2] / chars, capitals / chars, marks / chars, base[1] / n, digits / chars, base[3] / (1 + text.count("\n")), base[4] / n]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        odd = [brute_anomaly(f, [rules[k] for k in own]) for f, own in zip(forests, quality_rules.GROUPS, strict=True)]
        found = got[r["doc_id"]]
        assert [found[name] for name in quality_rules.BASE] == base and found["base_failed"] == failed
        assert found["anomaly"] == pytest.approx(max(odd)) and found["kept"] == (not failed and all(x < f.threshold for x, f in zip(odd, forests, strict=True)))


@needs_small
def test_all_spans_are_those_of_brute_force(spark, monkeypatch):
    """Without the screen, and a text at a time."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op3_pii"](spark, SMALL).collect()}
    model = pii.train(docs)
    monkeypatch.setattr(pii, "_has_span", lambda model, prepared, windows: np.ones(len(windows), bool))
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        base, every = pii.spans_of([text], model, pii.Settings())[0]
        assert base == brute_spans(text)
        assert got[r["doc_id"]] == pii.joined(every), r["doc_id"]
