"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

A text is a bag of unigrams and bigrams of tokens, a token being a run of letters, digits
and bytes beyond ASCII, or a run of ASCII punctuation. Each n-gram is hashed into one of
``2**bits`` weights; its value is its share of the text's n-grams, so a score is a sparse
dot product that does not depend on length. A token followed by itself is one common
feature, whatever the token.

Null and empty texts have the bias alone. Ties, repeated rows and very long texts need no
rule: every row is scored by itself, in memory that follows the longest text. An empty table
gives an empty one; of repeated labels of one id 1 counts. Extra columns are kept, and one
named like the added one, in whatever case, gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.sampling import labelled_ids
from lectern.llm.textarrays import SPACE, U64, Piece, mix, segment_sums, text_pieces, with_text_columns

_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PUNCTUATION = ~_WORDY & ~SPACE
_REPEAT = 1


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the number of weights. per_class: most labelled documents of a class that are learned from."""

    bits: int = 18
    per_class: int = 2500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 8.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    scale: float

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1


def ngram_features(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a piece's documents, and where each document's begin."""
    marks = [piece.runs(kind[piece.data]) for kind in (_WORDY, _PUNCTUATION)]
    starts, ends = (np.concatenate([m[k] for m in marks]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    tokens = piece.span_hashes(starts, ends)
    first = np.searchsorted(starts, piece.offsets)
    docs = np.repeat(np.arange(piece.n_docs), np.diff(first))
    pairs = mix(tokens[:-1] * U64(3) + tokens[1:], 5)
    pairs[tokens[:-1] == tokens[1:]] = U64(_REPEAT)
    same = docs[:-1] == docs[1:]
    features = np.concatenate([tokens, mix(pairs[same], 9)])
    owners = np.concatenate([docs, docs[:-1][same]])
    order = np.argsort(owners, kind="stable")
    buckets = (features[order] >> U64(64 - bits)).astype(np.int64)
    return buckets, np.searchsorted(owners[order], np.arange(piece.n_docs + 1))


def scores_of(piece: Piece, model: Model) -> np.ndarray:
    buckets, first = ngram_features(piece, model.bits)
    dots = segment_sums(model.weights[buckets], first) * model.scale / np.maximum(np.diff(first), 1)
    return 1 / (1 + np.exp(-np.clip(dots + model.bias, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """rows: for each text its distinct buckets, their shares, and 0 or 1."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        short = np.abs(z[at]) - settings.l1
        return np.where(short <= 0, 0.0, -np.sign(z[at]) * short / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    order = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs if rows else 0):
        for k in order.permutation(len(rows)):
            buckets, shares, label = rows[k]
            at = np.append(buckets, size)
            x = np.append(shares * settings.scale, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), settings.scale)


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from at most 2 * per_class labelled documents whose crc32 remainder by 5 is not 0.

    Their n-grams are counted on the executors; the driver gets bucket counts, at most
    2**bits for a text. Without labelled rows every score is 0.5.
    """
    bits = settings.bits
    ids = labelled_ids(labels, "quality", settings.per_class)
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for piece in text_pieces(batch.column(0)):
                buckets, first = ngram_features(piece, bits)
                for d in range(piece.n_docs):
                    own, times = np.unique(buckets[first[d] : first[d + 1]], return_counts=True)
                    out.append((own.astype(np.int32).tobytes(), (times / max(1, times.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1), batch.column(2)], names=["buckets", "shares", "label", "doc_id"])

    got = chosen.select("text", "label", "doc_id").mapInArrow(count, "buckets binary, shares binary, label int, doc_id long").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    return fit([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32).astype(float), r["label"]) for r in got], settings)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """documents with a score in [0, 1]: how likely label 1 is."""
    return with_text_columns(documents, text, [T.StructField(name, T.DoubleType())], lambda: lambda piece: [scores_of(piece, model)])
