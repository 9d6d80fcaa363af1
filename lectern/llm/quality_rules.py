"""Quality rules: rule statistics of whole texts, and isolation forests over them.

Words are runs other than ASCII white space. The base statistics and the base rule are
fixed; the forests add a verdict: documents whose mean path length over random splits is
short are anomalous, and the score from which they are dropped is set on all labelled rows.

There is a forest for each group of statistics, so that those in which good texts vary widely do
not shorten the paths that others need: one on shares of characters (symbols, capitals,
punctuation), one on words and lines (mean word length, digits, repeated lines, words in
repeated windows). A forest whose threshold would cost more good rows than the bad ones it
catches are worth drops nothing.

Defined results: null and empty texts have no words, so the base rule drops them; an empty
table gives an empty one, and without good labelled rows the base rule decides alone. Very long
texts are read whole. Repeated rows are judged each by itself; of repeated labels of one id 1
counts; a score at the threshold is dropped. Extra columns are kept, and one named like an
added one, in whatever case, gives way to it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.sampling import labelled_ids
from lectern.llm.textarrays import CONTINUATION, U64, Piece, mix, text_pieces, with_text_columns

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics of each forest, as rule_statistics has them.
GROUPS = ((0, 1, 2), (3, 4, 5, 6))
WINDOW = 3
BINS = 1 << 17


@dataclass(frozen=True)
class Settings:
    """per_class: most labelled documents of a class the forest grows on. cost: rejected good documents that one caught bad document may not cost, as shares of their classes. impure: share of bad rows among those the forest grows on, so that it splits on what only they vary in."""

    per_class: int = 2000
    trees: int = 100
    sample: int = 256
    cost: float = 200.0
    impure: float = 0.02
    seed: int = 3


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    norm: float
    threshold: float


def _repeats(text: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, without hashes."""
    words = text.split()  # of bytes, at ASCII white space
    lines = [x for x in text.split(b"\n") if x.split()]
    places = defaultdict(list)
    for k in range(len(words) - WINDOW + 1):
        places[tuple(words[k : k + WINDOW])].append(k)
    marked = {k + j for found in places.values() if len(found) > 1 for k in found for j in range(WINDOW)}
    return len(lines) - len(set(lines)), len(marked)


def base_statistics(piece: Piece) -> np.ndarray:
    """n_docs x 5, as BASE names them. What hashes find equal is compared byte by byte."""
    n = piece.n_docs
    starts, ends, first = piece.words
    docs, counts = piece.word_docs, np.diff(first)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

    line_starts, line_ends, line_docs = piece.lines()
    solid = np.concatenate([[0], np.cumsum(piece.solid, dtype=np.int64)])
    wordy = solid[line_ends] > solid[line_starts]
    line_starts, line_ends, line_docs = line_starts[wordy], line_ends[wordy], line_docs[wordy]
    keys = mix(piece.span_hashes(line_starts, line_ends) ^ mix(line_docs.astype(U64), 1), 2)
    _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    again = np.bincount(line_docs, minlength=n) - np.bincount(line_docs[at], minlength=n)
    like = at[inverse]
    later = np.flatnonzero(like != np.arange(len(like)))
    other = like[later]
    alike = piece.same_spans(line_starts[later], line_ends[later], line_starts[other], line_ends[other])
    unlike = [line_docs[later[~alike | (line_docs[later] != line_docs[other])]]]

    repeated = np.zeros(n, np.int64)
    m = len(starts) - WINDOW + 1
    if m > 0:
        h = piece.word_hashes
        keys = mix(h[:m], 21) + mix(h[1 : m + 1], 22) + mix(h[2:], 23)
        keys = mix(keys ^ mix(docs[:m].astype(U64), 1), 2)
        whole = np.flatnonzero(docs[:m] == docs[WINDOW - 1 :])
        _, at, inverse, times = np.unique(keys[whole], return_index=True, return_inverse=True, return_counts=True)
        often = whole[times[inverse] > 1]
        like = whole[at[inverse[times[inverse] > 1]]]
        marked = np.zeros(len(starts), bool)
        alike = docs[often] == docs[like]
        for j in range(WINDOW):
            marked[often + j] = True
            alike &= piece.same_spans(starts[often + j], ends[often + j], starts[like + j], ends[like + j])
        repeated = np.bincount(docs[marked], minlength=n)
        unlike.append(docs[often[~alike]])
    # texts in which unequal lines or words have one hash are counted by themselves
    for d in np.unique(np.concatenate(unlike)):
        again[d], repeated[d] = _repeats(piece.data[piece.offsets[d] : piece.offsets[d + 1]].tobytes())
    return np.stack([counts, total(piece.solid & ~CONTINUATION[piece.data]), total(_SYMBOL[piece.data]), again, repeated], axis=1)


def rule_statistics(piece: Piece, base: np.ndarray) -> np.ndarray:
    """What the forests split on, none of which grows with a text's length.

    The shares of symbols, capitals and punctuation among the characters in words; their mean
    number in a word and the share of digits; the shares of repeated lines and of words in
    repeated windows.
    """

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

    words, chars = np.maximum(base[:, 0], 1), np.maximum(base[:, 1], 1)
    lines = 1 + total(piece.data == 10)
    shares = [total(kind[piece.data]) / chars for kind in (_UPPER, _MARK, _DIGIT)]
    return np.stack([base[:, 2] / chars, shares[0], shares[1], base[:, 1] / words, shares[2], base[:, 3] / lines, base[:, 4] / words], axis=1)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


def grow(rows: np.ndarray, settings: Settings) -> Forest:
    rng = np.random.default_rng(settings.seed)
    size = min(settings.sample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.zeros((settings.trees, nodes), np.int32)
    split = np.full((settings.trees, nodes), np.inf)
    length = np.zeros((settings.trees, nodes))
    for t in range(settings.trees):
        todo = [(0, 0, rng.choice(len(rows), size, replace=False))]
        while todo:
            node, level, own = todo.pop()
            length[t, node] = level + _expected(len(own))
            spread = np.ptp(rows[own], axis=0) if len(own) else np.zeros(rows.shape[1])
            able = np.flatnonzero(spread > 0)
            if level == depth or len(own) < 2 or not len(able):
                for child in (2 * node + 1, 2 * node + 2):
                    if child < nodes:
                        todo.append((child, level + 1, own[:0]))
                        length[t, child] = length[t, node]
                continue
            f = int(rng.choice(able))
            low, high = rows[own, f].min(), rows[own, f].max()
            feature[t, node], split[t, node] = f, rng.uniform(low, high)
            left = rows[own, f] <= split[t, node]
            todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
    # a leaf passes its path length down, so that every row can walk the full depth
    for t in range(settings.trees):
        for node in range((nodes - 1) // 2):
            if np.isinf(split[t, node]):
                length[t, 2 * node + 1] = length[t, 2 * node + 2] = length[t, node]
    return Forest(feature, split, length, depth, float(max(_expected(size), 1.0)), np.inf)


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean path length / expected length): near 1 for what few splits isolate."""
    paths = np.zeros(len(rows))
    at = np.arange(len(rows))
    for t in range(len(forest.split)):
        node = np.zeros(len(rows), np.int64)
        for _ in range(forest.depth):
            node = 2 * node + 1 + (rows[at, forest.feature[t, node]] > forest.split[t, node])
        paths += forest.length[t, node]
    return 2 ** (-paths / len(forest.split) / forest.norm)


def calibrated_on(forest: Forest, counts: list[tuple[float, float, int, int]], cost: float) -> Forest:
    """The threshold that gains most: share of bad rows above it, less cost times that of good rows; none if nothing is gained.

    counts: (least score, end of scores, good rows, bad rows) of ranges of scores that do not overlap.
    """
    rows = sorted(counts, reverse=True)
    good, bad = (np.array([r[k] for r in rows], float) for k in (2, 3))
    if not good.sum() or not bad.sum():
        return forest
    gain = np.cumsum(bad / bad.sum() - cost * good / good.sum())
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return forest
    below = rows[best + 1][1] if best + 1 < len(rows) else 0.0
    return replace(forest, threshold=float((rows[best][0] + below) / 2))


def calibrated(forest: Forest, rows: np.ndarray, good: np.ndarray, cost: float) -> Forest:
    """calibrated_on for rows at hand."""
    if not len(rows):
        return forest
    scores, at = np.unique(anomaly(forest, rows), return_inverse=True)
    n_good, n = np.bincount(at[good], minlength=len(scores)), np.bincount(at, minlength=len(scores))
    return calibrated_on(forest, list(zip(scores, scores, n_good, n - n_good, strict=True)), cost)


def failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def anomalies(forests: list[Forest], rows: np.ndarray) -> np.ndarray:
    """rows x forests: each group's score."""
    return np.stack([anomaly(f, rows[:, list(own)]) for f, own in zip(forests, GROUPS, strict=True)], axis=1)


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[Forest] | None:
    """Forests grown on good labelled rows and a few bad ones, at most 2 * per_class of them; their thresholds are set on all labelled rows.

    Rows that the base rule drops take no part. Without good rows there is no forest. The
    driver gets counts by ranges of 1 / BINS of the scores, so as many as there are ranges at most.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = labelled_ids(labels, "quality", settings.per_class, learnable=False)
    chosen = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")

    def make():
        def compute(piece: Piece):
            base = base_statistics(piece)
            return [failed(base), list(rule_statistics(piece, base))]

        return compute

    got = with_text_columns(chosen, "text", [T.StructField("failed", T.BooleanType()), T.StructField("rules", T.ArrayType(T.DoubleType()))], make)
    kept = sorted((r["doc_id"], r["label"], r["rules"]) for r in got.where(~F.col("failed")).select("doc_id", "label", "rules").collect())
    rows, good = np.array([r[2] for r in kept], float), np.array([r[1] == 1 for r in kept], bool)
    if not good.any():
        return None
    few = rows[~good][: int(np.ceil(settings.impure * good.sum()))]
    grown = [grow(np.concatenate([rows[good], few])[:, list(own)], settings) for own in GROUPS]

    def score():
        def compute(piece: Piece):
            base = base_statistics(piece)
            return [failed(base), list(np.floor(anomalies(grown, rule_statistics(piece, base)) * BINS).astype(np.int64))]

        return compute

    # all texts are scored where they lie, and the scores joined with the labels, so that no text is shuffled
    scored = with_text_columns(texts, "text", [T.StructField("failed", T.BooleanType()), T.StructField("bins", T.ArrayType(T.LongType()))], score, keep_text=False)
    rated = scored.where(~F.col("failed")).select("doc_id", "bins").join(labelled_ids(labels, "quality", None, learnable=False), "doc_id")
    bins = rated.select("label", F.posexplode("bins").alias("forest", "bin"))
    counts = bins.groupBy("forest", "bin").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("bad")).collect()
    of = [[(r["bin"] / BINS, (r["bin"] + 1) / BINS, r["good"], r["bad"]) for r in counts if r["forest"] == k] for k in range(len(GROUPS))]
    return [calibrated_on(f, own, settings.cost) for f, own in zip(grown, of, strict=True)]


def judge(documents: DataFrame, forests: list[Forest] | None, text: str = "text") -> DataFrame:
    """documents with the base statistics, base_failed, the greatest anomaly score and kept."""
    fields = [T.StructField(n, T.LongType()) for n in BASE]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        def compute(piece: Piece):
            base = base_statistics(piece)
            bad = failed(base)
            if not forests:
                return [*base.T, bad, np.zeros(piece.n_docs), ~bad]
            odd = anomalies(forests, rule_statistics(piece, base))
            return [*base.T, bad, odd.max(axis=1), ~bad & (odd < [f.threshold for f in forests]).all(axis=1)]

        return compute

    return with_text_columns(documents, text, fields, make)
