"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The vocabulary is given; nothing is trained. A text is encoded in these steps, a batch at a
time:

1. White space becomes the word mark and one is put in front. No piece has a mark behind
   another character, so no merge crosses the beginning of a word; a character outside the
   vocabulary takes part in no merge either. The batch's distinct words are laid end to end.
2. A suffix array of that text is built, each suffix cut at the longest piece.
3. Every piece is looked up by binary search; its range in the array gives all places where
   it occurs. They are the edges of a graph over the text's positions.
4. The edges are sorted by position and relaxed in that order. BPE's tokens of a text are the
   one path on which every two neighbouring pieces are stable, that is, BPE would not have
   merged across their boundary. A position is reached by the edge whose start is reached and
   whose piece is stable behind the piece that reached the start.
5. The words' tokens are put in the places of the words. A worker keeps the tokens of a
   bounded number of words, so that later batches index only the words it has not met. Words
   are told apart by hashes, and every text is decoded and compared; one that differs is encoded
   again with its words told apart by their bytes.

A word of more than LONG_WORD bytes is matched in stretches that overlap. Where two stretches
have a boundary in common, with pieces that are stable there, both are on the one path, so they
are joined there; stretches without such a place are matched as one. A run of marks before
a word is merged run by run instead of mark by mark. Both take time in proportion to the text.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces, turns marks
to blanks and drops the first. The round trip is exact but for the mark character itself,
which, as in the library, decodes to a blank; round_trip is false for texts that have it.

Defined results: null texts have null ids; an empty text has none; an empty table gives an
empty one. Very long texts, texts without a blank and long runs of blanks are encoded whole.
Repeated rows are encoded each by itself; there are no ties, as the path is the only one.
Extra columns are kept, and one named like an added column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.textarrays import CONTINUATION, U64, Piece, arrow_type, bounded_batches, kept_by_worker, release, text_pieces

#: Where the public tokenizers' files are; any SentencePiece BPE model with byte pieces will do.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
_MARKS = re.compile(b"(?:" + MARK + b")*")
_NONE = -1
#: A longer word is matched in stretches of STRETCH bytes that overlap by OVERLAP.
LONG_WORD, STRETCH, OVERLAP = 1024, 512, 128


@dataclass(frozen=True)
class Vocabulary:
    """pieces: the bytes of each id. ranks: merges by rising rank come first; -1 for what no merge makes.

    left, right: the two pieces whose merge makes a piece, itself where none does.
    byte_ids: the ids of the 256 byte pieces. unknown: of what cannot be encoded.
    """

    pieces: list[bytes]
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that merge, as left * size + right in ascending order, and the rank of each merge."""
        made = np.flatnonzero(self.usable & (self.left != np.arange(len(self.pieces))))
        pairs = self.left[made].astype(np.int64) * len(self.pieces) + self.right[made]
        order = np.argsort(pairs)
        return pairs[order], self.ranks[made][order]

    @cached_property
    def singles(self) -> dict[bytes, int]:
        return {self.pieces[i]: int(i) for i in np.flatnonzero(self.usable & (self.ranks < 0))}

    @cached_property
    def scored(self) -> dict[bytes, tuple[int, int]]:
        """bytes -> (rank, id) of all pieces that a merge may make."""
        return {self.pieces[i]: (int(self.merge_rank[i]), int(i)) for i in range(len(self.pieces)) if self.merge_rank[i] >= 0}

    @property
    def merge_rank(self) -> np.ndarray:
        return self.ranks


def _last_merge(text: bytes, rank_of: dict[bytes, tuple[int, int]]) -> tuple[bytes, bytes] | None:
    """The two parts from which plain BPE makes the whole of text in the end, if it does."""
    parts = [c.encode() for c in text.decode()]
    while len(parts) > 2:
        best, at = None, -1
        for k in range(len(parts) - 1):
            found = rank_of.get(parts[k] + parts[k + 1])
            if found is not None and (best is None or found[0] < best):
                best, at = found[0], k
        if best is None:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def load_vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(size)]
    is_byte = np.array([model.is_byte(i) for i in range(size)])
    special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)])
    byte_ids = np.zeros(256, np.int32)
    for i in np.flatnonzero(is_byte):
        byte_ids[int(names[i][3:5], 16)] = i
    pieces = [bytes([int(n[3:5], 16)]) if b else b"" if s else n.encode() for n, b, s in zip(names, is_byte, special, strict=True)]
    usable = ~is_byte & ~special
    scores = np.array([model.get_score(i) for i in range(size)])
    order = np.argsort(-scores, kind="stable")
    # pieces of one score are equals: the leftmost merge comes first
    _, level = np.unique(-scores[order], return_inverse=True)
    ranks = np.full(size, -1)
    ranks[order] = level
    long = np.array([len(n) > 1 for n in names])
    ranks[~(usable & long)] = -1
    ids = {pieces[i]: i for i in np.flatnonzero(usable)}
    rank_of = {pieces[i]: (int(ranks[i]), int(i)) for i in np.flatnonzero(usable & long)}
    left, right = np.arange(size), np.arange(size)
    for i in np.flatnonzero(usable & long):
        parts = _last_merge(pieces[i], rank_of)
        if parts is None or parts[0] not in ids or parts[1] not in ids:
            usable[i] = False
        else:
            left[i], right[i] = ids[parts[0]], ids[parts[1]]
    return Vocabulary(pieces, ranks, left, right, usable, byte_ids)


def stable(vocabulary: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For pairs of pieces, whether BPE of their two texts together gives just these two.

    The merges that made the two are undone from the latest on. Should the piece left of the
    boundary and the one right of it merge with a rank better than the merges undone so far,
    BPE would have crossed the boundary there. Between equal ranks the left merge comes first.
    """
    pairs, ranks = vocabulary.merges
    size = len(vocabulary.pieces)
    a, b = first.copy(), second.copy()
    good = np.ones(len(a), bool)
    limit = np.full(len(a), np.iinfo(np.int64).max)
    loose = np.zeros(len(a), bool)  # whether a merge of equal rank at the boundary would come first
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        keys = x * size + y
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        merged = pairs[at] == keys
        crossing = merged & ((ranks[at] < limit[live]) | ((ranks[at] == limit[live]) & loose[live]))
        good[live[crossing]] = False
        rx, ry = vocabulary.ranks[x], vocabulary.ranks[y]
        undo_left = rx > ry
        done = crossing | ((rx < 0) & (ry < 0))
        limit[live] = np.where(undo_left, rx, ry)
        loose[live] = ~undo_left
        a[live] = np.where(undo_left, vocabulary.right[x], x)
        b[live] = np.where(undo_left, y, vocabulary.left[y])
        live = live[~done]
    return good


class Matcher:
    """All occurrences of all pieces in a text, by binary search in its suffix array."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = np.flatnonzero(vocabulary.usable)
        self.ids = ids
        self.lengths = np.array([len(vocabulary.pieces[i]) for i in ids], np.int64)
        self.width = -(-int(self.lengths.max()) // 8) * 8
        table = np.zeros((len(ids), self.width), np.uint8)
        for row, i in enumerate(ids):
            table[row, : self.lengths[row]] = np.frombuffer(vocabulary.pieces[i], np.uint8)
        order = np.lexsort(table.view(">u8").astype(U64).T[::-1])
        self.ids, self.lengths, self.words = ids[order], self.lengths[order], table[order].view(">u8").astype(U64)

    def occurrences(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and ids of all occurrences that begin at the given places. Byte 0 ends a suffix."""
        padded = np.concatenate([text, np.zeros(self.width + 8, np.uint8)])
        windows = np.zeros(len(text) + self.width, U64)
        for j in range(8):
            windows = (windows << U64(8)) | padded[j : j + len(windows)].astype(U64)
        suffixes = self._suffix_array(windows, starts)
        low = self._bound(windows, suffixes, upper=False)
        high = self._bound(windows, suffixes, upper=True)
        times = high - low
        rows = np.repeat(np.arange(len(times)), times)
        ends = np.cumsum(times)
        within = np.arange(len(rows)) - np.repeat(ends - times, times)
        return suffixes[np.repeat(low, times) + within], self.lengths[rows], self.ids[rows]

    def _suffix_array(self, windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """starts in the order of the bytes from there on, up to the longest piece; equals in any order."""
        order = starts[np.argsort(windows[starts], kind="stable")]
        for depth in range(8, self.width, 8):
            ahead = windows[order]
            same = np.append(False, ahead[1:] == ahead[:-1])
            if depth > 8:
                same &= tied
            tied = same
            follows = np.append(tied[1:], False)
            block = np.flatnonzero(tied | follows)
            if not len(block):
                break
            group = np.cumsum(~tied[block])
            own = order[block]
            last = self._next(windows, own, depth)
            inner = np.lexsort((last, group))
            order[block] = own[inner]
            # the ties that remain are those that also agree in the next eight bytes
            keys = last[inner]
            tied = tied.copy()
            tied[block] &= np.append(False, keys[1:] == keys[:-1])
            ahead = None
        return order

    @staticmethod
    def _next(windows: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        return windows[np.minimum(at + depth, len(windows) - 1)]

    def _bound(self, windows: np.ndarray, suffixes: np.ndarray, upper: bool) -> np.ndarray:
        """For each piece the first suffix that is not less (upper: that is greater) in the piece's length."""
        low = np.zeros(len(self.ids), np.int64)
        high = np.full(len(self.ids), len(suffixes))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            at = suffixes[middle]
            less = np.zeros(len(open_), bool)
            decided = np.zeros(len(open_), bool)
            for k in range(self.width // 8):
                left = np.clip(self.lengths[open_] - 8 * k, 0, 8)
                todo = np.flatnonzero(~decided & (left > 0))
                if not len(todo):
                    break
                cut = U64(64) - left[todo].astype(U64) * U64(8)
                have = (self._next(windows, at[todo], 8 * k) >> cut) << cut
                want = self.words[open_[todo], k]
                less[todo] = have < want
                decided[todo] = have != want
            if upper:
                less |= ~decided
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]


class KnownWords:
    """Tokens of words met before, by the words' 64-bit hashes, in a table of one slot for each hash's top bits.

    The first words to come stay, up to a bound of words and of tokens; those beyond it, or
    in a slot that is taken, are kept for the piece at hand only.
    """

    def __init__(self, bits: int = 20, words: int = 300_000, most_tokens: int = 2_000_000) -> None:
        self.shift, self.words, self.most_tokens = U64(64 - bits), words, most_tokens
        self.keys, self.entry = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)
        self.tokens, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fixed = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        return np.where(self.keys[slot] == hashes, self.entry[slot], -1)

    def add(self, hashes: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        number = len(self.size) + np.arange(len(hashes))
        self.begin = np.append(self.begin, len(self.tokens) + first[:-1])
        self.size = np.append(self.size, np.diff(first))
        self.tokens = np.append(self.tokens, tokens)
        if len(self.size) <= self.words and len(self.tokens) <= self.most_tokens:
            slot = (hashes >> self.shift).astype(np.int64)
            free = self.entry[slot] < 0
            self.keys[slot[free]], self.entry[slot[free]] = hashes[free], number[free]
            self.fixed = len(self.size)
        return number

    def trim(self) -> None:
        if len(self.size) > self.fixed:
            self.tokens = self.tokens[: self.begin[self.fixed - 1] + self.size[self.fixed - 1] if self.fixed else 0]
            self.begin, self.size = self.begin[: self.fixed], self.size[: self.fixed]


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known = KnownWords()
        self.matcher = Matcher(vocabulary)
        self.sizes = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.mark = vocabulary.singles.get(MARK, _NONE)

    def words_of(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The marked bytes of a piece's documents, the starts of all words in them, and each document's first word.

        A word is a run of marks with what follows up to the next mark; a line feed stands alone.
        """
        n = np.diff(piece.offsets)
        filled = n > 0
        blank = piece.data == 32
        size = np.where(blank, 3, 1).astype(np.int64)
        ends = np.cumsum(size)
        shift = np.repeat(np.cumsum(filled) * 3, n)
        at = ends - size + shift
        out = np.zeros(int(ends[-1]) + 3 * int(filled.sum()) if len(size) else 0, np.uint8)
        out[at[~blank]] = piece.data[~blank]
        marks = np.concatenate([at[blank], at[piece.offsets[:-1][filled]] - 3])
        for j in range(3):
            out[marks + j] = MARK[j]
        is_mark = np.zeros(len(out) + 1, bool)
        is_mark[marks] = True
        after = np.zeros(len(out) + 1, bool)
        after[marks + 3] = True
        feed = np.append(out == 10, False)
        opens = (is_mark & ~after) | feed
        opens[1:] |= feed[:-1]
        doc_starts = at[piece.offsets[:-1][filled]] - 3 if filled.any() else np.zeros(0, np.int64)
        opens[doc_starts] = True
        starts = np.flatnonzero(opens[:-1])
        first = np.zeros(piece.n_docs + 1, np.int64)
        where = np.searchsorted(starts, doc_starts)
        first[:-1][filled] = where
        last = len(starts)
        for d in range(piece.n_docs - 1, -1, -1):
            if not filled[d]:
                first[d] = last
            last = first[d]
        first[-1] = len(starts)
        return out, starts, first

    def encode_words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words [start, end) back to back, and where each word's begin."""
        lengths = ends - starts
        n = len(starts)
        # the words end to end, a zero byte behind each
        base = np.append(0, np.cumsum(lengths + 1))
        laid = np.zeros(int(base[-1]), np.uint8)
        source = np.repeat(starts - (base[:-1] - np.arange(n)), lengths) + np.arange(int(lengths.sum()))
        place = np.repeat(np.arange(n), lengths) + np.arange(int(lengths.sum()))
        laid[place] = text[source]
        zero = laid[place] == 0
        laid[place[zero]] = 0xFF  # a byte of no piece, so that only the ends are zero
        heads = place[~CONTINUATION[laid[place]]]
        edge_from, edge_size, edge_id = self.matcher.occurrences(laid, heads)
        word_of = np.repeat(np.arange(n), lengths + 1)

        # characters that no single piece covers become byte pieces, and nothing merges with them
        known = np.zeros(len(laid), bool)
        single = self.vocabulary.ranks[edge_id] < 0
        known[edge_from[single]] = True
        alien = heads[~known[heads]]
        following = np.append(heads, len(laid))
        sizes = following[np.searchsorted(heads, alien) + 1] - alien
        sizes = np.minimum(sizes, base[word_of[alien] + 1] - 1 - alien)
        edge_from = np.concatenate([edge_from, alien])
        edge_size = np.concatenate([edge_size, sizes])
        edge_id = np.concatenate([edge_id, np.full(len(alien), _NONE)])

        edge_to = edge_from + edge_size
        step = edge_to - base[word_of[edge_from]]
        order = np.argsort(step, kind="stable")
        edge_from, edge_to, edge_id, step = edge_from[order], edge_to[order], edge_id[order], step[order]
        last = np.full(len(laid) + 1, -3)  # the piece that reaches a position; -3: none does
        back = np.zeros(len(laid) + 1, np.int64)
        last[base[:-1]] = -2
        bounds = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        for k in range(len(bounds) - 1):
            f, t, i = (x[bounds[k] : bounds[k + 1]] for x in (edge_from, edge_to, edge_id))
            before = last[f]
            reached = before != -3
            f, t, i, before = f[reached], t[reached], i[reached], before[reached]
            test = np.flatnonzero((before >= 0) & (i >= 0))
            good = np.ones(len(f), bool)
            good[test] = stable(self.vocabulary, before[test], i[test])
            last[t[good]], back[t[good]] = i[good], f[good]

        # back from the words' ends
        out_word, out_from, out_id = [], [], []
        words, at = np.arange(n), base[1:] - 1
        live = at > base[:-1]
        words, at = words[live], at[live]
        while len(words):
            out_word.append(words)
            out_id.append(last[at])
            out_from.append(back[at])
            at = back[at]
            live = at > base[words]
            words, at = words[live], at[live]
        if not out_word:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        word, frm, ids = (np.concatenate(x) for x in (out_word, out_from, out_id))
        order = np.argsort(frm, kind="stable")
        word, frm, ids = word[order], frm[order], ids[order]
        width = np.ones(len(ids), np.int64)
        raw = ids == _NONE
        width[raw] = following[np.searchsorted(heads, frm[raw]) + 1] - frm[raw]
        width[raw] = np.minimum(width[raw], base[word[raw] + 1] - 1 - frm[raw])
        spread = np.repeat(np.arange(len(ids)), width)
        tokens = ids[spread].astype(np.int32)
        nth = np.arange(len(spread)) - np.repeat(np.cumsum(width) - width, width)
        bytes_ = np.flatnonzero(raw[spread])
        places = frm[spread[bytes_]] + nth[bytes_]
        values = laid[places]
        lost = np.zeros(len(laid), bool)
        lost[place[zero]] = True
        values = np.where(lost[places], 0, values)
        tokens[bytes_] = self.vocabulary.byte_ids[values]
        return tokens, np.searchsorted(word[spread], np.arange(n + 1))

    def encode(self, piece: Piece, by_bytes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents back to back, and where each document's begin. by_bytes: words are not told apart by hashes."""
        text, starts, first = self.words_of(piece)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(piece.n_docs + 1, np.int64)
        ends = np.append(starts[1:], len(text))
        if by_bytes:
            number: dict[bytes, int] = {}
            entry = np.array([number.setdefault(text[a:b].tobytes(), len(number)) for a, b in zip(starts, ends, strict=True)])
            _, at = np.unique(entry, return_index=True)
            pool, begins = self._distinct(text, starts[at], ends[at])
            begin, size = begins[entry], np.diff(begins)[entry]
        else:
            hashes = Piece(0, text, np.array([0, len(text)])).span_hashes(starts, ends)
            entry = self.known.find(hashes)
            new = np.flatnonzero(entry < 0)
            if len(new):
                _, at, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
                at = new[at]
                tokens, token_first = self._distinct(text, starts[at], ends[at])
                entry[new] = self.known.add(hashes[at], tokens, token_first)[inverse]
            pool, begin, size = self.known.tokens, self.known.begin[entry], self.known.size[entry]
        total = np.append(0, np.cumsum(size))
        out = pool[np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))]
        self.known.trim()
        return out, total[first]

    def _distinct(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words back to back, and where each word's begin. A run of marks before a word's last one is merged by itself."""
        marks = self._marks(text, starts, ends)
        own = starts + 3 * np.maximum(marks - 1, 0)
        long = np.flatnonzero(ends - own > LONG_WORD)
        short = np.flatnonzero(ends - own <= LONG_WORD)
        tokens, first = self.encode_words(text, own[short], ends[short])
        if not len(long) and not (marks > 1).any():
            return tokens, first
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        for row, word in enumerate(short):
            parts[word] = tokens[first[row] : first[row + 1]]
        for word in long:
            parts[word] = self._in_stretches(text, int(own[word]), int(ends[word]))
        for word in np.flatnonzero(marks > 1):
            # what follows the last mark takes that mark or leaves it to the run before
            rest, n = parts[word], int(marks[word]) - 1
            if len(rest) and rest[0] == self.mark:
                rest, n = rest[1:], n + 1
            parts[word] = np.concatenate([self.mark_run(n), rest])
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    @staticmethod
    def _marks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many marks each word begins with; counted beyond the first only where there are two."""

        def mark_at(at: np.ndarray) -> np.ndarray:
            inside = np.minimum(at[:, None] + np.arange(3), len(text) - 1)
            return (text[inside] == np.frombuffer(MARK, np.uint8)).all(axis=1)

        marks = np.zeros(len(starts), np.int64)
        wide = np.flatnonzero(ends - starts >= 3)
        wide = wide[mark_at(starts[wide])]
        marks[wide] = 1
        wide = wide[ends[wide] - starts[wide] >= 6]
        for word in wide[mark_at(starts[wide] + 3)]:
            lead = _MARKS.match(text[starts[word] : ends[word]].tobytes())
            marks[word] = lead.end() // 3
        return marks

    def mark_run(self, n: int) -> np.ndarray:
        """BPE of n marks, with runs of equal pieces as (piece, times).

        The best merge is done for a whole run at once if none that it makes possible is as
        good, and once, at the leftmost place, if one is.
        """
        v, size = self.vocabulary, len(self.vocabulary.pieces)
        pairs, ranks = v.merges
        runs = [(self.mark, n)] if n else []

        def rank(a: int, b: int) -> int | None:
            at = int(np.searchsorted(pairs, a * size + b))
            return int(ranks[at]) if at < len(pairs) and pairs[at] == a * size + b else None

        while True:
            found = [(r, k, 0) for k, (p, times) in enumerate(runs) if times > 1 and (r := rank(p, p)) is not None]
            found += [(r, k, 1) for k in range(len(runs) - 1) if (r := rank(runs[k][0], runs[k + 1][0])) is not None]
            if not found:
                break
            best, k, across = min(found)
            p, times = runs[k]
            if across:
                made = v.scored[v.pieces[p] + v.pieces[runs[k + 1][0]]][1]
                new = [(p, times - 1), (made, 1), (runs[k + 1][0], runs[k + 1][1] - 1)]
                runs[k : k + 2] = new
            else:
                made = v.scored[v.pieces[p] * 2][1]
                before = [runs[k - 1][0]] if k else []
                opened = [rank(made, p), rank(made, made), *(rank(b, made) for b in before)]
                many = times // 2 if all(r is None or r > best for r in opened) else 1
                runs[k : k + 1] = [(made, many), (p, times - 2 * many)]
            joined: list[tuple[int, int]] = []
            for p, times in runs:
                if times and joined and joined[-1][0] == p:
                    joined[-1] = (p, joined[-1][1] + times)
                elif times:
                    joined.append((p, times))
            runs = joined
        return np.repeat([p for p, _ in runs], [t for _, t in runs]).astype(np.int32)

    def _in_stretches(self, text: np.ndarray, start: int, end: int) -> np.ndarray:
        """Tokens of one long word, matched in stretches."""
        heads = start + np.flatnonzero(~CONTINUATION[text[start:end]])
        cut = np.unique(heads[np.searchsorted(heads, np.arange(start, end, STRETCH))[: -1 if end - start > STRETCH else None]])
        upto = np.append(heads, end)[np.searchsorted(heads, np.minimum(np.append(cut[1:], end) + OVERLAP, end))]
        out, at = [], start
        tail: np.ndarray | None = None
        for begin in range(0, len(cut), 256):
            own = slice(begin, begin + 256)
            tokens, first = self.encode_words(text, cut[own], upto[own])
            for k in range(len(first) - 1):
                here, a = tokens[first[k] : first[k + 1]], int(cut[begin + k])
                if tail is None:
                    tail, at = here, a
                    continue
                joint = self._joint(tail, at, here, a)
                if joint is None:
                    tail, _ = self.encode_words(text, np.array([at]), np.array([int(upto[begin + k])]))
                    continue
                n, m = joint
                out.append(tail[:n])
                at += int(self.sizes[tail[:n]].sum())
                tail = here[m:]
        return np.concatenate([*out, tail]) if tail is not None else np.zeros(0, np.int32)

    def _joint(self, left: np.ndarray, left_at: int, right: np.ndarray, right_at: int) -> tuple[int, int] | None:
        """How many tokens of left to keep and of right to drop, so that the two meet at a stable boundary."""
        ends = left_at + np.cumsum(self.sizes[left])
        begins = right_at + np.append(0, np.cumsum(self.sizes[right])[:-1])
        _, i, j = np.intersect1d(ends, begins, return_indices=True)
        if not len(i):
            return None
        a, b = left[i].astype(np.int64), right[j].astype(np.int64)
        plain = self.vocabulary.usable[a] & self.vocabulary.usable[b]
        good = np.ones(len(a), bool)
        good[plain] = stable(self.vocabulary, a[plain], b[plain])
        met = np.flatnonzero(good)
        return (int(i[met[0]]) + 1, int(j[met[0]])) if len(met) else None


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        shown = [p.replace(MARK, b" ") for p in vocabulary.pieces]
        self.lengths = np.array([len(p) for p in shown], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))
        self.data = np.frombuffer(b"".join(shown), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents back to back, and where each document's begin; the first blank of each is dropped."""
        n = self.lengths[ids]
        total = np.append(0, np.cumsum(n))
        out = self.data[np.repeat(self.starts[ids] - total[:-1], n) + np.arange(int(total[-1]))]
        begins = total[first]
        filled = np.flatnonzero(np.diff(begins) > 0)
        drop = begins[filled][out[begins[filled]] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        return out[keep], begins - np.searchsorted(drop, begins)


def _same(decoder: Decoder, ids: np.ndarray, first: np.ndarray, piece: Piece) -> np.ndarray:
    """Whether each document's ids decode to its bytes."""
    data, at = decoder.decode(ids, first)
    if len(data) == len(piece.data) and (np.diff(at) == np.diff(piece.offsets)).all():
        wrong = np.append(0, np.cumsum(data != piece.data))
        return wrong[piece.offsets[1:]] == wrong[piece.offsets[:-1]]
    return np.array([data[at[d] : at[d + 1]].tobytes() == piece.data[piece.offsets[d] : piece.offsets[d + 1]].tobytes() for d in range(piece.n_docs)])


def _verified(encoder: Encoder, decoder: Decoder, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, where each document's begin, and whether they decode to the text; if some do not, words may have shared a hash, and bytes decide."""
    ids, first = encoder.encode(piece)
    same = _same(decoder, ids, first, piece)
    if not same.all():
        ids, first = encoder.encode(piece, by_bytes=True)
        same = _same(decoder, ids, first, piece)
    return ids, first, same


def _worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for a worker process, which lives on from task to task."""
    return kept_by_worker("encoder", lambda: Encoder(vocabulary), lambda e: e.vocabulary is vocabulary)


def encoded(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", check: bool = True, keep_text: bool = True) -> DataFrame:
    """documents with ids and, if check is set, round_trip: whether the ids decode to the text again. The text goes if keep_text is not set."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    kept = [f for f in documents.schema.fields if f.name not in ("ids", "round_trip") and (keep_text or f.name != text)]
    schema = T.StructType(kept + (fields if check else fields[:1]))
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker_encoder(shared.value), Decoder(shared.value)
        kind = arrow_type(fields[0].dataType)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for piece in text_pieces(pc.replace_substring(texts, MARK.decode(), " ")):
                ids, first, same = _verified(encoder, decoder, piece)
                missing = np.asarray(texts.slice(piece.first, piece.n_docs).is_null())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32(), mask=np.append(missing, False)), pa.array(ids)).cast(kind)
                columns = [batch.column(batch.schema.get_field_index(n)).slice(piece.first, piece.n_docs) for n in names] + [lists]
                if check:
                    marked = np.asarray(pc.fill_null(pc.match_substring(texts.slice(piece.first, piece.n_docs), MARK.decode()), False).cast(pa.uint8())).astype(bool)
                    columns.append(pa.array(same & ~marked, pa.bool_(), mask=missing))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
            release("encoder")

    used = names if text in names else [*names, text]
    return bounded_batches(documents).select(*[f"`{n}`" for n in used]).mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "text") -> DataFrame:
    """rows with the text of their ids; ids beyond the vocabulary are an error. Bytes that are not UTF-8 become U+FFFD."""
    kept = [f for f in rows.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            values = np.asarray(pc.list_flatten(lists).cast(pa.int64()))
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            data, at = decoder.decode(values, np.append(0, np.cumsum(counts)))
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            column = pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [column], names=[f.name for f in schema.fields])

    return rows.select(*[f"`{f.name}`" for f in rows.schema.fields if f.name != name or name == ids]).mapInArrow(run, schema)
