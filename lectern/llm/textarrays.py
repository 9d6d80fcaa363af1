"""Arrow string batches as numpy arrays: bytes, words, lines, n-gram hashes.

Texts are looked at whole. A batch is cut between documents into pieces of about
``PIECE_BYTES``, so the working memory follows the longest document, not the batch.
Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which in
UTF-8 never cuts a code point.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE_BYTES = 1 << 19
BATCH_BYTES = 8 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + U64((_BASE * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 512


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k]:first[k + 1]], each by itself."""
    return np.add.reduceat(np.append(values, 0.0), np.minimum(first[:-1], len(values))) * (np.diff(first) > 0)


@dataclass
class Piece:
    """Some consecutive documents: their bytes back to back, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _windows(self) -> np.ndarray:
        """The eight bytes from each place on, as one number; zeros beyond the end."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        return np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))

    def _blocks(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self._windows[starts] & _MASKS[np.minimum(left, 8)]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings [start, end): eight bytes at a time are scrambled into the state.

        Equal hashes do not prove equal strings; same_spans() does.
        """
        left = ends - starts
        state = mix(left.astype(U64), 99)
        live = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
        at, left_of = starts[live], left[live]
        while len(live):
            state[live] = mix(state[live] ^ self._blocks(at, left_of), 77)
            more = left_of > 8
            live, at, left_of = live[more], at[more] + 8, left_of[more] - 8
        for k in np.flatnonzero(left > LONG_SPAN):
            digest = hashlib.blake2b(self.data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            state[k] = int.from_bytes(digest, "little")
        return state

    def same_spans(self, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether the byte strings [start, end) and [other, other_end) are equal, pair by pair."""
        left = ends - starts
        same = left == other_ends - others
        live = np.flatnonzero(same & (left > 0) & (left <= LONG_SPAN))
        at, other, left_of = starts[live], others[live], left[live]
        while len(live):
            equal = self._blocks(at, left_of) == self._blocks(other, left_of)
            same[live[~equal]] = False
            more = equal & (left_of > 8)
            live, at, other, left_of = live[more], at[more] + 8, other[more] + 8, left_of[more] - 8
        for k in np.flatnonzero(same & (left > LONG_SPAN)):
            same[k] = np.array_equal(self.data[starts[k] : ends[k]], self.data[others[k] : other_ends[k]])
        return same

    @cached_property
    def solid(self) -> np.ndarray:
        return ~SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the number of its first word (and of the last + 1)."""
        return self.runs(self.solid)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n_docs + 1, np.int64)
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        opens[cuts] |= inside[cuts]
        closes[cuts - 1] |= inside[cuts - 1]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, self.offsets)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return self.span_hashes(starts, ends)

    @cached_property
    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.words[2]))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines between line feeds; each document has one at least."""
        feeds = np.flatnonzero(self.data == 10)
        keys = np.sort(np.concatenate([feeds * 2 + 1, self.offsets[1:] * 2]))
        ends, feed = keys >> 1, keys & 1
        starts = np.concatenate([[0], (ends + feed)[:-1]]).astype(np.int64)
        docs = np.concatenate([[0], np.cumsum(1 - feed)[:-1]]).astype(np.int64)
        return starts, ends, docs

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and documents of all runs of n words; a document with 1 to n - 1 words has one run, of all its words."""
        _, _, first = self.words
        hashes, docs = self.word_hashes, self.word_docs
        counts = np.diff(first)
        factor = [U64(pow(_BASE, 3 * j + 1, 1 << 64)) for j in range(n)]
        total = len(hashes) - n + 1
        out, owner = np.zeros(0, U64), np.zeros(0, np.int64)
        if total > 0:
            out = hashes[:total] * factor[0]
            for j in range(1, n):
                out = out + hashes[j : j + total] * factor[j]
            whole = docs[:total] == docs[n - 1 :]
            out, owner = mix(out[whole], n), docs[:total][whole]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.zeros(len(short), U64)
            for j in range(n - 1):
                has = counts[short] > j
                extra[has] += hashes[first[short[has]] + j] * factor[j]
            for m in np.unique(counts[short]):
                extra[counts[short] == m] = mix(extra[counts[short] == m], int(m))
            out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
        return out, owner


def text_pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow column; null is taken as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        begin = offsets[first]
        yield Piece(first, data[begin : offsets[last]], offsets[first : last + 1] - begin)
        first = last


_kept: dict[str, object] = {}


def kept_by_worker(key: str, make: Callable[[], object], fresh: Callable[[object], bool]) -> object:
    """What a worker process keeps from task to task: one object, until release() is called for another key."""
    if key not in _kept or not fresh(_kept[key]):
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release(key: str = "") -> None:
    """Gives memory back to the system, and what is kept for other keys; a worker that waits for its next task should not hold it."""
    for other in [k for k in _kept if k != key]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_blas_thread() -> None:
    """A task has one core, so its worker's matrix products should use one thread, where numpy's OpenBLAS can be told so."""
    try:
        with open("/proc/self/maps") as maps:
            libraries = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # not on this system
        return
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


def bounded_batches(frame: DataFrame) -> DataFrame:
    """frame, in whose session no Arrow batch is filled beyond BATCH_BYTES from now on.

    Spark's own bound is for numbers; batches of texts are held by both the executor and its
    worker, as input and as output.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = conf.get(key).lower().rstrip("b")
    if not bound.isdecimal() or int(bound) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return frame


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_text_columns(
    frame: DataFrame,
    text: str,
    added: list[T.StructField],
    make: Callable[[], Callable[[Piece], Iterable]],
    piece_bytes: int = PIECE_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """The rows of frame with columns computed from whole texts, a piece at a time.

    make() is called once in each task and gives the function from a piece to one list or
    array for each added column. A column of frame that has an added column's name, in
    whatever case, gives way to it, and so does the text if keep_text is not set.
    """
    names = {f.name.lower() for f in added}
    kept = [f for f in frame.schema.fields if f.name.lower() not in names or f.name == text]
    source = frame.select(*[f"`{f.name}`" for f in kept])
    out_fields = [f for f in kept if f.name.lower() not in names and (keep_text or f.name != text)]
    schema = T.StructType(out_fields + added)
    out_names, types = [f.name for f in out_fields], [f.dataType for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        kinds = [arrow_type(t) for t in types]
        for batch in batches:
            parts: list[list[pa.Array]] = [[] for _ in kinds]
            for piece in text_pieces(batch.column(batch.schema.get_field_index(text)), piece_bytes):
                for part, values, kind in zip(parts, compute(piece), kinds, strict=True):
                    part.append(values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
            new = [pa.concat_arrays(p) if p else pa.array([], k) for p, k in zip(parts, kinds, strict=True)]
            old = [batch.column(batch.schema.get_field_index(n)) for n in out_names]
            yield pa.RecordBatch.from_arrays(old + new, names=out_names + [f.name for f in added])
            del batch, old, new, parts
            release()

    return bounded_batches(source).mapInArrow(run, schema)
