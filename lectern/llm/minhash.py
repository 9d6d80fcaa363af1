"""Near-duplicate detection with DartMinHash signatures and a banded join.

A document is the set of its runs of five words, lower-cased (one run of all its words if
they are fewer). Every element owns a region of weight and rank; darts are thrown into it
by hashing alone, so equal elements get equal darts in every document. The earliest dart of
each coordinate among those that fall below an element's weight is the document's minimum
there, and two documents agree on a coordinate with their weighted Jaccard similarity.

1. Documents of equal sets are one: the least id stands for them (`rep`). Signatures go no
   further than the representative; the other copies are looked up as narrow rows, salted.
2. Representatives that agree on all rows of a band share a bucket. Each member of a bucket
   is paired with the bucket's least id, and pairs are checked on the whole sets. These are
   written once, for the members of buckets of two or more, and serve every later step. A
   centre's pairs are checked in a stream behind the centre's set, in groups by a salt, so that
   no row carries a copy of it and a centre with many members is many groups.
3. Members of buckets that still hold several components are joined exactly by the prefix
   filter: the elements of each set are ordered by how many of these sets have them, rarest
   first, and two sets can only be similar enough if they share an element of the prefix
   that is as heavy as the similarity leaves open, and if enough weight lies ahead of it in
   both. Members of different components that do are checked. What lies ahead of an element
   in a set caps the other set's weight, and the lighter set of a pair is within its own cap;
   so an element joins only such lighter sets with those heavier ones whose caps admit the
   lightest of them, and never the sets of its main component with each other. So all pairs of a bucket are
   decided: by a check, by the filter, or because they are connected already. Sets that differ from all others in many elements, as edited
   copies in a large group do, have prefixes of elements that no other has.

The chance that a pair of similarity s shares no bucket is (1 - s^rows)^bands; with the
defaults 1e-4 at 0.8 and 1e-10 at 0.9.

Elements are 64-bit hashes of the runs of words, of which two different ones are equal with a
chance of 2**-64; similarities are those of the whole sets of hashes.

Defined results: documents without words (null, empty, white space) are each their own
class; a pair at just the similarity is one; an empty table gives an empty one. Rows of one id
are one document. A null id gets the class of its copies, else null. Very long texts are
taken whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.scratch import Scratch
from lectern.llm.textarrays import U64, Piece, bounded_batches, mix, release, text_pieces

#: Groups that the copies of one set are looked up in, and that the pairs of one centre are checked in.
COPY_SALTS, STAR_SALTS = 16, 64
#: An element of so many sets or more is not shuffled by its value.
HOT_SPREAD = 256


@dataclass(frozen=True)
class Settings:
    """weights: `distinct` gives each element weight 1 (plain Jaccard), `count` as often as it occurs.

    broadcast_rows: an id list of at most so many rows is broadcast; a longer one is joined by a shuffle.
    """

    words: int = 5
    similarity: float = 0.8
    rows: int = 7
    bands: int = 40
    weights: str = "distinct"
    broadcast_rows: int = 500_000


def weighted_sets(piece: Piece, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles' hashes in ascending order by document, their counts, and where each document's begin."""
    hashes, docs = piece.shingles(words)
    bounds = np.searchsorted(docs, np.arange(piece.n_docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(docs[at], np.arange(piece.n_docs + 1))


def dart_minima(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """n_docs x k ranks of the earliest darts; infinite for documents without elements.

    An element's weight axis is cut into regions [0, 1), [1, 2), [2, 4), ... In each, darts
    arrive over the rank axis as a Poisson process of the region's width, whose gaps are
    hashes of (element, region, number of the dart). A dart counts if its place on the
    weight axis is below the element's weight. Darts are thrown up to the rank at which a
    document should have k (ln k + 2) of them; where a coordinate stays empty, to twice it.
    """
    n = len(first) - 1
    out = np.full((n, k), np.inf)
    totals = np.add.reduceat(np.append(weights, 0.0), np.minimum(first[:-1], len(weights))) * (np.diff(first) > 0)
    todo = np.flatnonzero(totals > 0)
    reach = np.where(totals > 0, k * (np.log(k) + 2) / np.maximum(totals, 1e-12), 0.0)
    owner_of = np.repeat(np.arange(n), np.diff(first))
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        at = np.flatnonzero(chosen[owner_of])
        level, low, width = 0, 0.0, 1.0
        while len(at):
            _throw(elements[at], weights[at], owner_of[at], reach, level, low, width, k, out)
            low, width, level = (1.0, 1.0, 1) if level == 0 else (low + width, width * 2, level + 1)
            at = at[weights[at] > low]
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        reach[todo] *= 2
    return out


def _throw(elements, weights, owners, reach, level, low, width, k, out) -> None:
    seeds = mix(elements, 100 + level)
    ranks = np.zeros(len(seeds))
    flat = out.reshape(-1)
    number = 0
    while len(seeds):
        limit = reach[owners]
        steps = int(max(1, min(4096, 500_000 // len(seeds), np.ceil(limit.mean() * width))))
        darts = mix(seeds[:, None] + np.arange(number, number + steps, dtype=U64)[None, :] * U64(0xD1342543DE82EF95), 1)
        gaps = -np.log(((darts >> U64(11)).astype(float) + 0.5) * 2.0**-53) / width
        gaps[:, 0] += ranks
        arrivals = np.cumsum(gaps, axis=1)
        row, column = np.nonzero(arrivals <= limit[:, None])
        if len(row):
            rank = arrivals[row, column]
            marks = mix(darts[row, column], 2)
            if (weights[row] < low + width).any():
                below = low + width * ((mix(marks, 3) >> U64(11)).astype(float) * 2.0**-53) < weights[row]
                row, rank, marks = row[below], rank[below], marks[below]
            np.minimum.at(flat, owners[row] * k + (marks % U64(k)).astype(np.int64), rank)
        ranks = arrivals[:, -1]
        more = ranks <= limit
        seeds, ranks, owners, weights = seeds[more], ranks[more], owners[more], weights[more]
        number += steps


def band_keys(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = minima.view(U64).reshape(len(minima), bands, rows)
    keys = np.zeros((len(minima), bands), U64)
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r], r)
    return mix(keys + np.arange(bands, dtype=U64)[None, :], 50).view(np.int64)


def _weights(counts: np.ndarray, kind: str) -> np.ndarray:
    return counts.astype(float) if kind == "count" else np.ones(len(counts))


def signatures(documents: DataFrame, settings: Settings, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, n, set_a, set_b, bands): the number of elements, a 128-bit hash of the weighted set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = settings.rows * settings.bands
        for batch in batches:
            for piece in text_pieces(batch.column(1)):
                elements, counts, first = weighted_sets(piece, settings.words)
                weights = _weights(counts, settings.weights)
                keys = band_keys(dart_minima(elements, weights, first, k), settings.rows, settings.bands)
                sums = []
                for seed in (7, 8):
                    total = np.zeros(len(elements) + 1, U64)
                    np.cumsum(mix(elements * U64(3) + mix(weights.astype(U64), seed), seed), out=total[1:])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                n = np.diff(first)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * settings.bands, settings.bands), pa.int32()), pa.array(keys.ravel()))
                ids = batch.column(0).slice(piece.first, piece.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), bands], names=["id", "n", "set_a", "set_b", "bands"])
            release()

    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.col(text).cast("string")).alias("text"))
    return bounded_batches(rows).mapInArrow(run, "id long, n long, set_a long, set_b long, bands array<long>")


def packed_sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """(id, elements, counts) of (id, text) rows, the text lower-cased already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch.column(1)):
                elements, counts, first = weighted_sets(piece, settings.words)
                if settings.weights != "count":
                    counts = counts[:0]
                spans = list(zip(first[:-1], first[1:], strict=True))
                columns = [batch.column(0).slice(piece.first, piece.n_docs), pa.array([elements[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "elements", "counts"])
            release()

    return bounded_batches(texts).select("id", "text").mapInArrow(run, "id long, elements binary, counts binary")


def set_similarity(a: bytes, b: bytes, counts_a: bytes = b"", counts_b: bytes = b"") -> float:
    """Weighted Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    w = np.frombuffer(counts_a, "<u4").astype(float) if counts_a else np.ones(len(x))
    v = np.frombuffer(counts_b, "<u4").astype(float) if counts_b else np.ones(len(y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.minimum(w[i], v[j]).sum()
    whole = w.sum() + v.sum() - common
    return float(common / whole) if whole else 0.0


def _narrow(ids: DataFrame, settings: Settings) -> DataFrame:
    """ids, broadcast if they are few enough."""
    return F.broadcast(ids) if ids.limit(settings.broadcast_rows + 1).count() <= settings.broadcast_rows else ids


def similar_pairs(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar enough. sets: (id, elements, counts)."""
    salted = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(STAR_SALTS)).cast("int").alias("salt"), "b")
    members = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "elements", "counts")
    centres = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "elements", "counts")
    rows = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, []
        for batch in batches:
            left, salts, right, elements, counts = (batch.column(k) for k in range(5))
            out: tuple[list, list] = ([], [])
            for k in range(batch.num_rows):
                a, b, packed, times = left[k].as_py(), right[k].as_py(), elements[k].as_py(), counts[k].as_py()
                if centre != (a, salts[k].as_py()):
                    centre, own = (a, salts[k].as_py()), []
                if b is None:
                    own.append((packed, times))
                elif any(set_similarity(x, packed, y, times) >= settings.similarity for x, y in own):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return bounded_batches(rows).mapInArrow(run, "a long, b long")


def prefix_pairs(rooted: DataFrame, sets: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ids with different roots whose sets share an element of both prefixes. rooted: (id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                elements = [np.frombuffer(x.as_py(), "<i8") for x in part.column(1)]
                weights = [np.frombuffer(x.as_py(), "<u4").astype(float) if len(x.as_py()) else np.ones(len(e)) for x, e in zip(part.column(2), elements, strict=True)]
                n, whole = [len(e) for e in elements], [w.sum() for w in weights]
                columns = [np.repeat(np.asarray(part.column(0)), n), np.concatenate(elements), np.concatenate(weights), np.repeat(whole, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "element", "weight", "whole"])

    own = bounded_batches(sets.join(_narrow(rooted.select("id"), settings), "id", "left_semi")).select("id", "elements", "counts")
    rows = scratch.keep(own.mapInArrow(run, "id long, element long, weight double, whole double"), "elements")
    most = rows.count()
    spread = scratch.keep(rows.groupBy("element").agg(F.count("*").alias("spread")).where("spread > 1"), "spread", rows=most)
    # what many sets have is looked up where it lies; no more than one in HOT_SPREAD rows names such an element
    often = _narrow(spread.where(F.col("spread") >= HOT_SPREAD), settings)
    known = rows.join(often.withColumnRenamed("spread", "often"), "element", "left")
    rare = known.where("often IS NULL").drop("often").join(spread.where(F.col("spread") < HOT_SPREAD), "element")
    common = rare.unionByName(known.where("often IS NOT NULL").withColumnRenamed("often", "spread"))
    own = Window.partitionBy("id")
    upto = own.orderBy("spread", "element").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what no other set has comes first, so the suffix from an element on is made of common ones
    after = F.sum("weight").over(own) - F.sum("weight").over(upto) + F.col("weight")
    prefix = common.withColumn("after", after).where(F.col("after") >= F.lit(settings.similarity) * F.col("whole") - 1e-9)
    heads = scratch.keep(prefix.select("id", "element", "after", "whole").join(rooted, "id"), "prefixes", rows=most)
    # at the first common element, what lies ahead in either set bounds the common weight, so each set has a cap on the other's;
    # the lighter set of a pair, being within the other's cap and no heavier, is within its own
    share = settings.similarity / (1 + settings.similarity)
    light = F.col("whole") <= F.col("cap")
    heads = heads.withColumn("cap", F.col("after") / F.lit(share) * (1 + 1e-9) - F.col("whole") + 1e-6)
    own_roots = heads.groupBy("element", "root").agg(F.count(F.when(light, 1)).alias("n"))
    main = own_roots.groupBy("element").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n"), F.count("*").alias("roots"))
    main = scratch.keep(main.where("roots > 1 AND n > 0").select("element", "main"), "main", rows=most)
    heads = heads.join(_narrow(main, settings), "element")
    # part 0: light sets of an element's main root with heavier ones of other roots; part 1: light sets of the other roots with all
    lights = heads.where(light).withColumn("part", (F.col("root") != F.col("main")).cast("int")).drop("main")
    others = heads.where("root <> main").withColumn("part", F.lit(0)).unionByName(heads.withColumn("part", F.lit(1))).drop("main")
    key = ["element", "part"]
    floors = scratch.keep(lights.groupBy(key).agg(F.min("whole").alias("floor")), "floors", rows=most)
    others = scratch.keep(others.join(_narrow(floors, settings), key).where("floor <= cap").drop("floor"), "heavier", rows=2 * most)
    caps = scratch.keep(others.groupBy(key).agg(F.max("cap").alias("most"), F.count("*").alias("n_b")), "caps", rows=most)
    lights = scratch.keep(lights.join(_narrow(caps, settings), key).where("whole <= most").drop("most"), "lighter", rows=most)
    counts = _narrow(scratch.keep(lights.groupBy(key).agg(F.count("*").alias("n_a"), F.max("n_b").alias("n_b")), "counts", rows=most), settings)
    compared = counts.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0
    # where either side is long there are many groups: a row of the longer side is in one, a row of the shorter in all
    salts = F.when(F.greatest("n_a", "n_b") >= HOT_SPREAD, COPY_SALTS).otherwise(1)

    def side(rows: DataFrame, k: str, longer: Column) -> DataFrame:
        salt = F.when(longer, F.array(F.pmod(F.xxhash64("id"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
        return rows.join(counts, key).select(*key, F.explode(salt).alias("salt"), F.col("id").alias(k), F.col("root").alias(f"r{k}"), F.col("after").alias(f"after_{k}"), F.col("whole").alias(f"whole_{k}"))

    x, y = side(lights.drop("n_b"), "a", F.col("n_a") >= F.col("n_b")), side(others, "b", F.col("n_a") < F.col("n_b"))
    needed = F.lit(share) * (F.col("whole_a") + F.col("whole_b")) - 1e-9
    alike = (F.col("ra") != F.col("rb")) & (F.col("whole_a") <= F.col("whole_b")) & (F.least("after_a", "after_b") >= needed)
    return scratch.few(x.join(y, [*key, "salt"]).where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), compared)


def near_duplicates(documents: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id) for every row: the least id of the group of copies and near copies that it belongs to."""
    scratch = Scratch(documents.sparkSession, "near")
    signed = scratch.keep(signatures(documents, settings, text, doc_id), "signed")
    most = signed.count()
    sized = signed.where("n > 0")
    reps = scratch.keep(sized.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.count("*").alias("times"), F.min("n").alias("n")), "reps", rows=most * settings.bands / 2)
    alone = reps.where("times = 1").select(F.col("rep").alias("id"), "rep")
    salts = F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))
    copied = reps.where("times > 1").select("set_a", "set_b", "rep", salts.alias("salt"))
    copies = sized.select("id", "set_a", "set_b", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int").alias("salt")).join(copied, ["set_a", "set_b", "salt"]).select("id", "rep")
    blank = signed.where("n = 0").select("id", F.col("id").alias("rep"))
    members = scratch.keep(alone.unionByName(copies).unionByName(blank), "members", rows=most)
    scratch.drop(signed)

    entries = reps.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    shared = scratch.keep(entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo"), "shared", rows=most * settings.bands / 2)
    placed = scratch.keep(entries.join(_narrow(shared, settings), "key").select("key", "id", "n", "lo"), "placed", rows=most * settings.bands)
    scratch.drop(reps)
    ids = scratch.keep(placed.select("id").distinct(), "ids", rows=most)
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.col(text).cast("string")).alias("text"))
    sets = scratch.keep(packed_sets(texts.join(_narrow(ids, settings), "id", "left_semi"), settings), "sets", compression="none")
    stars = scratch.keep(placed.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"), "n").groupBy("a", "b").agg(F.max("n").alias("n")), "stars", rows=placed.count())
    # a pair is read with its whole set
    pairs, read = stars.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = scratch.keep(similar_pairs(stars, sets, settings), "links", rows=read)
    roots = scratch.keep(components(links, scratch), "roots", rows=most)

    # members of buckets that hold more than one component
    rooted = placed.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    loose = scratch.keep(rooted.join(mixed, "key", "left_semi").select("id", "root").distinct(), "loose", rows=most)
    crossing = prefix_pairs(loose, sets, settings, scratch).join(_narrow(stars, settings), ["a", "b"], "left_anti")
    crossing = scratch.keep(crossing, "crossing")
    more = crossing.count()
    if more:
        links = scratch.keep(links.unionByName(similar_pairs(crossing, sets, settings)), "links", rows=read + more * read / max(pairs, 1))
        roots = scratch.keep(components(links, scratch), "roots", rows=most)
    scratch.drop(sets)
    members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int"))
    classes = members.join(roots.select(F.col("id").alias("rep"), "root", salts.alias("salt")), ["rep", "salt"], "left")
    return classes.select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"))


def one_of_each(documents: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents without copies and near copies: of each class the row with the least id stays.

    Of repeated rows of that id one stays. Rows without an id cannot be told apart and stay.
    """
    scratch = Scratch(documents.sparkSession, "kept")
    classes = scratch.keep(near_duplicates(documents, settings, text, doc_id).where("doc_id IS NOT NULL"), "classes")
    dropped = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__id")).distinct()
    rest = documents.join(_narrow(dropped, settings), F.col(doc_id).cast("long") == F.col("__id"), "left_anti")
    if classes.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rest
    return rest.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(rest.where(F.col(doc_id).isNull()))
