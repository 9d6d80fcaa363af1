"""Codecs for lists of non-negative integers, as posting lists are: gamma, gaps, variable bytes, Simple-9.

Lists are coded many at a time, as one array of numbers with the places where lists begin, so
that short lists, of which there are most, cost no call each. Columns of lists are coded by Pandas
UDFs; long posting lists are cut into blocks of documents before (`posting_blocks`), so that no
list is one unbounded value. Parquet's own encodings serve the tables.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists laid end to end, and where each begins; one place more for the end of the last.
Lists = tuple[np.ndarray, np.ndarray]


def _laid(lists: Sequence, kind: type) -> Lists:
    first = np.append(0, np.cumsum([len(v) for v in lists])).astype(np.int64)
    if kind is np.uint8:
        return np.frombuffer(b"".join(lists), np.uint8), first
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in lists)]), first


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups laid end to end, each element's group and place in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _groups(values: np.ndarray, bits: int) -> np.ndarray:
    """How many groups of so many bits each number needs, one at least."""
    out = np.ones(len(values), np.int64)
    rest = values >> bits
    while (rest > 0).any():
        out += rest > 0
        rest = rest >> bits
    return out


def _ends(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the lists begin when their elements have these lengths."""
    return np.append(0, np.cumsum(lengths))[first]


class PostingCodec(ABC):
    """encode_lists gives the lists' bytes laid end to end, decode_lists the numbers."""

    @abstractmethod
    def encode_lists(self, values: np.ndarray, first: np.ndarray) -> Lists: ...

    @abstractmethod
    def decode_lists(self, blob: np.ndarray, first: np.ndarray) -> Lists: ...

    def encode(self, values: Sequence[int]) -> bytes:
        return self.encode_lists(*_laid([values], np.int64))[0].tobytes()

    def decode(self, blob: bytes) -> list[int]:
        return self.decode_lists(*_laid([blob], np.uint8))[0].tolist()

    def encoded(self, column: Column) -> Column:
        return self._udf(self.encode_lists, np.int64, lambda data, a, b: data[a:b].tobytes(), "binary")(column)

    def decoded(self, column: Column) -> Column:
        return self._udf(self.decode_lists, np.uint8, lambda data, a, b: data[a:b], "array<long>")(column)

    def _udf(self, code: Callable[..., Lists], kind: type, cut: Callable, name: str) -> Callable[[Column], Column]:
        nothing = () if kind is np.int64 else self.encode(())

        def run(values: pd.Series) -> pd.Series:
            data, first = code(*_laid([nothing if v is None else v for v in values], kind))
            return pd.Series([None if v is None else cut(data, first[k], first[k + 1]) for k, v in enumerate(values)], dtype=object)

        run.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, name)


class VariableByte(PostingCodec):
    """Seven bits a byte, the lowest first; the high bit marks a number's last byte."""

    def encode_lists(self, values: np.ndarray, first: np.ndarray) -> Lists:
        lengths = _groups(values, 7)
        owner, nth = _spread(lengths)
        out = (values[owner] >> (7 * nth)) & 0x7F
        out[np.cumsum(lengths) - 1] |= 0x80
        return out.astype(np.uint8), _ends(lengths, first)

    def decode_lists(self, blob: np.ndarray, first: np.ndarray) -> Lists:
        last = np.flatnonzero(blob & 0x80)
        begins = np.append(0, last[:-1] + 1)[: len(last)]
        _, nth = _spread(last - begins + 1)
        parts = (blob[: len(nth)] & 0x7F).astype(np.int64) << (7 * nth)
        values = np.add.reduceat(parts, begins) if len(begins) else np.zeros(0, np.int64)
        return values, np.searchsorted(last, first)


class Gaps(PostingCodec):
    """Ascending lists as the gaps between their numbers, in another codec."""

    def __init__(self, inner: PostingCodec | None = None) -> None:
        self.inner = inner or VariableByte()

    def encode_lists(self, values: np.ndarray, first: np.ndarray) -> Lists:
        gaps = np.diff(values, prepend=0)
        heads = first[:-1][np.diff(first) > 0]
        gaps[heads] = values[heads]
        return self.inner.encode_lists(gaps, first)

    def decode_lists(self, blob: np.ndarray, first: np.ndarray) -> Lists:
        gaps, at = self.inner.decode_lists(blob, first)
        sums = np.append(0, np.cumsum(gaps, dtype=np.int64))
        return sums[1:] - np.repeat(sums[at[:-1]], np.diff(at)), at


class Gamma(PostingCodec):
    """Elias gamma codes of n + 1, behind the count of numbers in four bytes; each list is filled up to whole bytes."""

    def encode_lists(self, values: np.ndarray, first: np.ndarray) -> Lists:
        wanted, counts = values + 1, np.diff(first)
        widths = _groups(wanted, 1)
        sizes = 2 * widths - 1
        used = np.diff(_ends(sizes, first))
        at = np.append(0, np.cumsum(4 + -(-used // 8)))
        owner, nth = _spread(widths)
        bits = np.zeros(8 * int(at[-1]), np.uint8)
        begins = np.repeat(8 * (at[:-1] + 4) - (np.cumsum(used) - used), counts) + np.cumsum(sizes) - sizes + widths - 1  # behind the zeros
        bits[begins[owner] + nth] = (wanted[owner] >> (widths[owner] - 1 - nth)) & 1
        out = np.packbits(bits)
        for k in range(4):
            out[at[:-1] + k] = (counts >> (24 - 8 * k)) & 0xFF
        return out, at

    def decode_lists(self, blob: np.ndarray, first: np.ndarray) -> Lists:
        heads = first[:-1]
        counts = sum(blob[heads + k].astype(np.int64) << (24 - 8 * k) for k in range(4)) if len(heads) else np.zeros(0, np.int64)
        bits = np.unpackbits(blob)
        place = np.append(0, np.cumsum(counts))
        found, ends, find = [], [], bits.tobytes().find
        for at, count in zip((8 * (heads + 4)).tolist(), counts.tolist(), strict=True):  # a number's place follows from the one before, so by turns
            for _ in range(count):
                one = find(b"\1", at)
                found.append(one)
                ends.append(at := 2 * one - at + 1)
        starts = np.array(found, np.int64)
        widths = np.array(ends, np.int64) - starts
        owner, nth = _spread(widths)
        parts = bits[starts[owner] + nth].astype(np.int64) << (widths[owner] - 1 - nth)
        values = np.add.reduceat(parts, np.cumsum(widths) - widths) - 1 if len(widths) else np.zeros(0, np.int64)
        return values, place


class Simple9(PostingCodec):
    """Words of 32 bits: 4 choose how many numbers of equal width the other 28 hold. Numbers are below 2**28. The first word counts a list's numbers."""

    # Numbers in a word and the bits of each, by selector.
    LAYOUTS = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))

    def encode_lists(self, values: np.ndarray, first: np.ndarray) -> Lists:
        if len(values) and values.max() >= 1 << 28:
            raise ValueError("a number needs more than 28 bits")
        n, counts = len(values), np.diff(first)
        of_list = np.repeat(np.arange(len(counts)), counts)
        places, ends = np.arange(n), first[1:][of_list]
        # the layout of a word that would begin with each number, and how many numbers it would hold
        chosen, size = np.full(n, -1), np.zeros(n, np.int64)
        for selector, (count, width) in enumerate(self.LAYOUTS):
            wide = np.append(np.flatnonzero(values >= 1 << width), n)
            end = np.minimum(places + count, ends)
            fits = (chosen < 0) & (wide[np.searchsorted(wide, places)] >= end)
            chosen[fits], size[fits] = selector, (end - places)[fits]
        begins, at, after = [], 0, (places + size).tolist()
        while at < n:  # a word begins where the one before ends, in the last one of a list with the next list
            begins.append(at)
            at = after[at]
        begins = np.array(begins, np.int64)
        size, chosen = size[begins], chosen[begins]
        owner, nth = _spread(size)
        width = np.array([w for _, w in self.LAYOUTS])[chosen]
        parts = values[begins[owner] + nth] << (width[owner] * nth)
        packed = chosen.astype(np.int64) << 28 | (np.add.reduceat(parts, np.cumsum(size) - size) if n else np.zeros(0, np.int64))
        owner, word = np.append(np.arange(len(counts)), of_list[begins]), np.append(counts.astype(np.int64), packed)
        order = np.argsort(owner, kind="stable")
        return word[order].astype(">u4").view(np.uint8), 4 * np.append(0, np.cumsum(np.bincount(owner, minlength=len(counts)))).astype(np.int64)

    def decode_lists(self, blob: np.ndarray, first: np.ndarray) -> Lists:
        words = np.frombuffer(blob.tobytes(), ">u4").astype(np.int64)
        heads = first[:-1] // 4
        totals = words[heads]
        body = np.ones(len(words), bool)
        body[heads] = False
        owner_of = np.repeat(np.arange(len(heads)), np.diff(first // 4))[body]
        own = words[body]
        counts, widths = (np.array(x)[own >> 28] for x in zip(*self.LAYOUTS, strict=True))
        owner, nth = _spread(counts)
        values = own[owner] >> (widths[owner] * nth) & ((1 << widths[owner]) - 1)
        held = np.bincount(owner_of[owner], minlength=len(heads)) if len(owner) else np.zeros(len(heads), np.int64)
        _, place = _spread(held)
        return values[place < np.repeat(totals, held)], np.append(0, np.cumsum(totals))


CODECS = {"vbyte": VariableByte, "delta": Gaps, "gamma": Gamma, "simple9": Simple9}


def posting_blocks(postings: DataFrame, bits: int = 16) -> DataFrame:
    """(term, block, ids) of (term, doc_id): ascending distinct ids, in blocks of 2**bits ids, so that a list has no more."""
    keyed = postings.select("term", F.shiftright("doc_id", bits).alias("block"), "doc_id")
    return keyed.groupBy("term", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
