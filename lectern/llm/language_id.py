"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of three and four bytes of the text with ASCII letters lower-cased and
other ASCII characters as blanks; a blank may stand only at a subword's ends. Embeddings
and the output layer are trained by stochastic gradient descent in numpy. The mean of
embeddings times the output layer is the mean of their products, so a fitted model is one
row of class scores for each bucket. A temperature and the probability under which a
prediction is rejected are set on rows kept out of the descent.

Null texts, and texts without any letter, are ``und`` with score 0, as is every text when
there was nothing to learn from. A letter is what ``\\p{L}`` matches. Of languages with one
probability the first in order counts. Very long texts are read whole; repeated rows are
predicted each by itself; an empty table gives an empty one, and nothing is learned from it.
Extra columns are kept, and one named like an added column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.sampling import may_learn
from lectern.llm.textarrays import U64, Piece, segment_sums, text_pieces, with_text_columns

UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[b for b in range(128) if not (0x61 <= _FOLD[b] <= 0x7A)]] = 32


@dataclass(frozen=True)
class Settings:
    """per_language: most documents of a language that are learned from. precision: wanted of accepted predictions."""

    bits: int = 16
    dimensions: int = 16
    per_language: int = 400
    epochs: int = 6
    rate: float = 1.0
    short_sample: int = 24
    precision: float = 0.99
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    @property
    def bits(self) -> int:
        return int(len(self.table)).bit_length() - 1


def subword_buckets(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords in the order of their documents, and where each document's begin."""
    plain = _FOLD[piece.data]
    n = len(plain)
    docs = np.repeat(np.arange(piece.n_docs, dtype=np.int32), np.diff(piece.offsets))
    solid = plain != 32
    wide = plain.astype(np.uint32)
    found, owners = [], []
    for size in (3, 4):
        if n < size:
            continue
        m = n - size + 1
        inner = np.ones(m, bool)
        for j in range(1, size - 1):
            inner &= solid[j : j + m]
        inner &= docs[:m] == docs[size - 1 :]
        at = np.flatnonzero(inner)
        key = wide[at]
        for j in range(1, size):
            key = key | (wide[at + j] << np.uint32(8 * j))
        mixed = (key.astype(U64) + U64(size << 40)) * U64(0x9E3779B97F4A7C15)
        found.append((mixed >> U64(64 - bits)).astype(np.int32))
        owners.append(docs[at])
    if not found:
        return np.zeros(0, np.int32), np.zeros(piece.n_docs + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(piece.n_docs + 1))


def logits_of(piece: Piece, model: Model) -> np.ndarray:
    buckets, first = subword_buckets(piece, model.bits)
    counts = np.maximum(np.diff(first), 1)
    return np.stack([segment_sums(column[buckets], first) / counts for column in model.table.T], axis=1) + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], settings: Settings) -> Model | None:
    """rows: for each text its distinct buckets, their counts and its language."""
    rows = [r for r in rows if len(r[0])]
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(settings.seed)
    number = {name: k for k, name in enumerate(languages)}
    embeddings = rng.normal(0, 0.1, (1 << settings.bits, settings.dimensions))
    output = np.zeros((settings.dimensions, len(languages)))
    output[:] = rng.normal(0, 0.1, output.shape)
    bias = np.zeros(len(languages))

    def sample(buckets, counts):
        if rng.random() < 0.5:
            at = rng.choice(len(buckets), size=int(rng.integers(2, settings.short_sample + 1)), p=counts / counts.sum())
            buckets, counts = np.unique(buckets[at], return_counts=True)
        return buckets, counts / counts.sum()

    aside = [k for k in range(len(rows)) if k % 5 == 4]
    kept = [k for k in range(len(rows)) if k % 5 != 4]
    steps, step = settings.epochs * len(kept), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(kept):
            rate = settings.rate * (1 - step / steps)
            step += 1
            buckets, shares = sample(rows[k][0], rows[k][1])
            mean = shares @ embeddings[buckets]
            error = softmax((mean @ output + bias)[None])[0]
            error[number[rows[k][2]]] -= 1
            back = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embeddings[buckets] -= rate * shares[:, None] * back * 4
    table = (embeddings @ output).astype(np.float32)
    logits, truth = [], []
    for k in aside or kept:
        for _ in range(3):
            buckets, shares = sample(rows[k][0], rows[k][1])
            logits.append(shares @ table[buckets] + bias)
            truth.append(number[rows[k][2]])
    x, y = np.array(logits), np.array(truth)
    heat = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(softmax(x / t)[np.arange(len(y)), y], 1e-12)).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = softmax(x / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= settings.precision
    threshold = float(best[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(languages, table, bias, temperature, threshold)


def train(documents: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learns from at most per_language documents of each non-null language, the first by a hash of the id.

    Rows whose crc32 remainder by 5 is 0 are left out. Every language is learned; each takes
    2**bits numbers of the model. The driver gets bucket counts, at most 2**bits for a text.
    """
    bits = settings.bits
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & may_learn(F.col("doc_id")))
    # a row for each language, of which the model holds 2**bits numbers
    common = F.broadcast(rows.groupBy("lang").count())
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # of a language's ids only a share that should hold four times the wanted ones goes on to be ranked
    share = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * F.col("count") < 4 * settings.per_language + 100
    ids = rows.join(common, "lang").where(share).withColumn("place", F.row_number().over(place)).where(F.col("place") <= settings.per_language).select("doc_id", F.col("lang").alias("language")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = texts.join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("language"))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for piece in text_pieces(batch.column(0)):
                buckets, first = subword_buckets(piece, bits)
                for d in range(piece.n_docs):
                    own, times = np.unique(buckets[first[d] : first[d + 1]], return_counts=True)
                    out.append((own.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1), batch.column(2)], names=["buckets", "counts", "lang", "doc_id"])

    got = chosen.select("text", "lang", "doc_id").mapInArrow(count, "buckets binary, counts binary, lang string, doc_id long").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    return fit([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32).astype(float), r["lang"]) for r in got], settings)


def predict(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """documents with lang_pred, score (the calibrated probability) and accepted (score at or above the rejection threshold)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return documents.drop("lang_pred", "score", "accepted").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})

    def make():
        names = np.array(model.languages, object)

        def compute(piece: Piece):
            p = softmax(logits_of(piece, model) / model.temperature)
            best = p.max(axis=1)
            return names[p.argmax(axis=1)], best, best >= model.threshold

        return compute

    out = with_text_columns(documents, text, fields, make)
    return out.withColumns({"lang_pred": F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(lettered, F.col("score")).otherwise(0.0), "accepted": lettered & F.col("accepted")})
