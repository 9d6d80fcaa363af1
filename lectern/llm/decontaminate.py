"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items and documents are sets of runs of five words, lower-cased. An item is found in a
document if at least `containment` of its runs are there, wherever they stand.

Items fall into size classes [2^s, 2^(s+1)) and so do documents. For each pair of classes
the number of MinHash coordinates follows from the sizes: so many that a document which
contains an item agrees with it on no coordinate with a chance of at most `miss`. A
coordinate is a part of the hash range, as in one-permutation MinHash, and its minimum the
least hash of the set in that part; so a document is hashed once for each class of items,
however many coordinates there are. Agreeing pairs are candidates, and each is checked on
the whole sets of hashes; what passes is checked once more on the runs of words themselves.

The items are taken in blocks of bounded size, each against all documents. A block leaves
the driver's memory as soon as it is broadcast, so the driver holds one at a time. Items of fewer
than five words are one run of all their words, looked for among the documents' runs of
that many words. Null and empty items or documents match nothing; empty tables match nothing;
repeated rows and items match each by itself; an item is found at just `containment` too. Very
long documents are searched whole. Extra columns are kept, and a column named like the added
one, in whatever case, gives way to it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textarrays import U64, Piece, mix, text_pieces, with_text_columns

_TOP = U64(2**64 - 1)
_TABLE_BITS = 20


@dataclass(frozen=True)
class Settings:
    """block_words: a block of items has about so many words at most (and one item at least), of some 20 bytes each."""

    words: int = 5
    containment: float = 0.8
    miss: float = 1e-4
    block_words: int = 1_000_000


Item = tuple[int | None, int, np.ndarray, bytes]


HITS = T.StructField(
    "hits",
    T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])),
)


def load(least_shared: int, miss: float) -> float:
    """Elements for each coordinate at which all of least_shared common elements are hidden with chance miss."""
    wanted = 1 - miss ** (1 / least_shared)
    low, high = 1e-6, 64.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if -math.expm1(-middle) / middle > wanted else (low, middle)
    return low


@dataclass
class ItemClass:
    """Items of one run length and size class: their sets, and for a class of documents their minima."""

    run: int
    size_class: int
    per_coordinate: float
    items: list[tuple[int | None, np.ndarray, bytes]]
    _sketches: dict[int, tuple] = field(default_factory=dict)

    def coordinates(self, document_class: int) -> int:
        """0: so many that every element is a minimum."""
        return 0 if self.per_coordinate < 0.25 else math.ceil(2 ** (document_class + 1) / self.per_coordinate)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes, 300 + self.size_class)

    def sketch(self, document_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All items' minima in ascending order, the items they belong to, and a table of their top bits."""
        if document_class not in self._sketches:
            k = self.coordinates(document_class)
            minima, owners = [], []
            for number, (_, hashes, _) in enumerate(self.items):
                values = self.values(hashes)
                if k:
                    order = np.lexsort((values, values % U64(k)))
                    parts = (values % U64(k))[order]
                    values = values[order][np.append(True, parts[1:] != parts[:-1])]
                minima.append(values)
                owners.append(np.full(len(values), number))
            minima, owners = np.concatenate(minima), np.concatenate(owners)
            order = np.argsort(minima, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(minima >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self._sketches[document_class] = minima[order], owners[order], table
        return self._sketches[document_class]


def classes_of(items: list[Item], settings: Settings) -> list[ItemClass]:
    """items: id, run length, distinct hashes and lower-cased text."""
    groups = defaultdict(list)
    for item_id, run, hashes, text in items:
        if len(hashes):
            groups[run, len(hashes).bit_length() - 1].append((item_id, hashes, text))
    return [ItemClass(run, size, load(math.ceil(settings.containment * 2**size - 1e-9), settings.miss), own) for (run, size), own in sorted(groups.items(), key=lambda x: x[0])]


def word_runs(text: bytes, run: int) -> set[bytes]:
    """All runs of so many words, as their words with single blanks."""
    words = text.split()  # of bytes, at ASCII white space
    return {b" ".join(words[k : k + run]) for k in range(len(words) - run + 1)}


def candidates(hashes: np.ndarray, docs: np.ndarray, n_docs: int, kind: ItemClass) -> set[tuple[int, int]]:
    """(document, item) pairs that agree on a coordinate."""
    found: set[tuple[int, int]] = set()
    sizes = np.bincount(docs, minlength=n_docs)
    size_classes = np.where(sizes > 0, np.frexp(np.maximum(sizes, 1))[1] - 1, -1)
    values = kind.values(hashes)
    for document_class in np.unique(size_classes[size_classes >= 0]):
        members = size_classes == document_class
        inside = members[docs]
        v, d = values[inside], docs[inside]
        k = kind.coordinates(int(document_class))
        if k:
            place = np.cumsum(members) - 1
            minima = np.full(int(members.sum()) * k, _TOP)
            np.minimum.at(minima, place[d] * k + (v % U64(k)).astype(np.int64), v)
            at = np.flatnonzero(minima != _TOP)
            v, d = minima[at], np.flatnonzero(members)[at // k]
        known, owners, table = kind.sketch(int(document_class))
        near = table[(v >> U64(64 - _TABLE_BITS)).astype(np.int64)]
        v, d = v[near], d[near]
        left, right = np.searchsorted(known, v, "left"), np.searchsorted(known, v, "right")
        for hit in np.flatnonzero(right > left):
            found.update((int(d[hit]), int(owner)) for owner in owners[left[hit] : right[hit]])
    return found


def search(piece: Piece, kinds: list[ItemClass], settings: Settings) -> list[list[dict]]:
    hits: list[list[dict]] = [[] for _ in range(piece.n_docs)]
    for run in sorted({k.run for k in kinds}):
        hashes, docs = piece.shingles(run)
        first = np.searchsorted(docs, np.arange(piece.n_docs + 1))
        runs_of: dict[int, set[bytes]] = {}
        for kind in (k for k in kinds if k.run == run):
            for d, number in sorted(candidates(hashes, docs, piece.n_docs, kind)):
                item_id, wanted, text = kind.items[number]
                shared = int(np.isin(wanted, hashes[first[d] : first[d + 1]]).sum())
                if shared < settings.containment * len(wanted) - 1e-9:
                    continue
                if d not in runs_of:
                    runs_of = {d: word_runs(piece.data[piece.offsets[d] : piece.offsets[d + 1]].tobytes(), run)}
                own = word_runs(text, run)
                shared = len(own & runs_of[d])
                if shared >= settings.containment * len(own) - 1e-9:
                    hits[d].append({"item_id": item_id, "n_shared": shared, "n_item": len(own)})
    return hits


def _lowered(frame: DataFrame, text: str) -> DataFrame:
    return frame.withColumn("__lowered", F.lower(F.col(text).cast("string")))


def _item_sets(items: DataFrame, settings: Settings, text: str, item_id: str) -> list[Item]:
    def run(batches):
        for batch in batches:
            runs, sets = [], []
            for piece in text_pieces(batch.column(1)):
                hashes, docs = piece.shingles(settings.words)
                counts = np.diff(piece.words[2])
                for d in range(piece.n_docs):
                    runs.append(int(min(counts[d], settings.words)))
                    sets.append(np.unique(hashes[docs == d]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.int32()), pa.array(sets, pa.binary()), batch.column(1)], names=["item_id", "run", "hashes", "text"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.lower(F.col(text).cast("string")).alias("text"))
    got = rows.mapInArrow(run, "item_id long, run int, hashes binary, text string").collect()
    return [(r["item_id"], r["run"], np.frombuffer(r["hashes"], U64), (r["text"] or "").encode()) for r in got]


def find(documents: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """documents with the column hits: the items found in each, with the shared runs and the item's."""
    words = items.agg(F.sum(F.length(F.col(item_text).cast("string"))).alias("n")).first()["n"] or 0
    n_blocks = max(1, math.ceil(words / 6 / settings.block_words))
    block = F.pmod(F.xxhash64(item_text), F.lit(n_blocks))
    out = documents.drop("hits").withColumn("hits", F.lit(None).cast(HITS.dataType))
    for k in range(n_blocks):
        sets = documents.sparkSession.sparkContext.broadcast(_item_sets(items.where(F.coalesce(block, F.lit(0)) == k), settings, item_text, item_id))

        def make(sets=sets):
            kinds = classes_of(sets.value, settings)
            return lambda piece: [search(piece, kinds, settings)]

        out = with_text_columns(_lowered(out.withColumnRenamed("hits", "__before"), text), "__lowered", [HITS], make)
        out = out.withColumn("hits", F.concat(F.coalesce("__before", F.array().cast(HITS.dataType)), "hits")).drop("__before", "__lowered")
    return out


def matches(documents: DataFrame, items: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    rows = find(documents.select(doc_id, "text"), items, settings).select(doc_id, F.explode("hits").alias("hit"))
    return rows.select(doc_id, "hit.item_id", "hit.n_shared", "hit.n_item", (F.col("hit.n_shared") / F.col("hit.n_item")).alias("containment"))


def clean(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found."""
    return find(documents, items, settings).where(F.size("hits") == 0).select(*[f"`{c}`" for c in documents.columns])
