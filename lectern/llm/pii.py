"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; what
they find always stays. The tagger is trained in numpy from labelled spans: those of the
patterns' shapes in sampled documents, and written variants that the patterns miss (numbers
without a plus sign, addresses with "at" and "dot", and so on) set into sampled text, among
look-alikes that are no personal data. It adds the spans that it is sure of and that have what
their kind cannot do without; so it learns the shape of a card number, whatever its check digit,
and a card that it finds must pass Luhn's check.

Every text is tagged whole, in windows of `width` characters that overlap by `overlap`. Each
window is decoded by itself. A span that an inner border cuts is left to the neighbouring window if that sees
it whole; a longer one is joined from its parts, if the windows on both sides of the border have it.
The spans of all windows of a text are then reconciled at once: of those that overlap, the choice
with the greatest sum of confidences stays. Decimal digits of all scripts are one class, and
full-width forms are as their ASCII forms.

Defined results: null is as empty; an empty table gives an empty one, and a model may be
trained on it. Positions are code points, the end exclusive. A very long text is tagged window
by window. Of sets of spans with equal sums the one that ends first stays. Repeated rows are
tagged each by itself. Extra columns are kept; one named like an added column gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textarrays import Piece, one_blas_thread, with_text_columns

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N_TAGS = len(TAGS)
WIDTH_STEP = 64
#: Texts are tagged in pieces of so many bytes, so that windows of each width are many.
PIECE_BYTES = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Anchored at the at signs, so that a long run of letters is looked at once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind that do not overlap; those that fail their check are dropped."""

    def small(part: str) -> bool:
        part = part.lstrip("0") or "0"
        return len(part) <= 3 and int(part) <= 255

    def digits(m: re.Match) -> str:
        return "".join(c for c in m[0] if "0" <= c <= "9")

    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m)) <= 15] if "+" in text else [],
    }


def shapes(text: str) -> list[tuple[int, int, str]]:
    """What the tagger learns of a sampled text: the patterns' spans, and card numbers whatever their check digit."""
    spans = [(a, b, k) for k, own in base_spans(text).items() for a, b in own if k != "card"]
    spans += [(*m.span(), "card") for m in _CARD.finditer(text) if 16 <= sum("0" <= c <= "9" for c in m[0]) <= 19]
    return sorted(spans)


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, [])))


# ---- the tagger

_PLAIN = "0123456789@.+-()_/:#='\"%,abcdefghijklmnopqrstuvwxyz"
_CLASS = np.full(0x110000, len(_PLAIN) + 2, np.int16)
for _k, _c in enumerate(_PLAIN):
    _CLASS[ord(_c)] = _k + 1
_CLASS[[ord(c) for c in " \t"]] = len(_PLAIN) + 3
_CLASS[[ord(c) for c in "\r\n"]] = len(_PLAIN) + 4
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = len(_PLAIN) + 5
_CLASS[0xFF01:0xFF5F] = _CLASS[0x21:0x7F]
_CLASS[[k for k in range(len(_CLASS)) if unicodedata.category(chr(k)) == "Nd"]] = 1
N_CLASSES = len(_PLAIN) + 6  # 0 is beyond the text


@dataclass(frozen=True)
class Settings:
    """width, overlap: of the windows that texts are tagged in; a span of up to overlap characters is whole in one.

    sample: most documents that are labelled. around, around_chars: most pieces of a sampled
    document about its digits and at signs, and their characters. centres: most training windows of a
    piece. train_width: characters of a training window. sure: least confidence of a span that is added.
    """

    width: int = 256
    overlap: int = 48
    train_width: int = 96
    hidden: int = 12
    embedding: int = 8
    sample: int = 300
    around: int = 20
    around_chars: int = 400
    centres: int = 12
    windows: int = 1600
    epochs: int = 16
    batch: int = 40
    rate: float = 0.03
    sure: float = 0.9
    seed: int = 23


Model = dict[str, np.ndarray]


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[points]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """x: steps x rows x inputs. Outputs of all steps, and what the way back needs."""
    steps, rows, _ = x.shape
    h, c = np.zeros((rows, wh.shape[0]), x.dtype), np.zeros((rows, wh.shape[0]), x.dtype)
    n = wh.shape[0]
    into = x @ wx + b
    hs, kept = np.empty((steps, rows, n), x.dtype), []
    for t in range(steps):
        z = into[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        before = (h, c)
        c = gates[:, n : 2 * n] * c + gates[:, :n] * g
        tc = np.tanh(c)
        h = gates[:, 2 * n :] * tc
        hs[t] = h
        kept.append((before, gates, g, tc))
    return hs, kept


def _lstm_back(x, wx, wh, kept, dhs):
    n = wh.shape[0]
    dwx, dwh, db, dx = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * n, x.dtype), np.zeros_like(x)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for t in range(len(kept) - 1, -1, -1):
        (h0, c0), gates, g, tc = kept[t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwx += x[t].T @ dz
        dwh += h0.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ wx.T
        dh = dz @ wh.T
        dc = dc * f
    return dwx, dwh, db, dx


_FORBIDDEN = np.zeros((N_TAGS, N_TAGS), np.float32)
for _a in range(N_TAGS):
    for _b in range(2, N_TAGS, 2):
        if _a not in (_b - 1, _b):
            _FORBIDDEN[_a, _b] = -1e4
_NO_START = np.zeros(N_TAGS, np.float32)
_NO_START[2::2] = -1e4


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _emissions(model: Model, windows: np.ndarray):
    x = model["embed"][windows.T]
    forward = _lstm(x, model["fx"], model["fh"], model["fb"])
    backward = _lstm(x[::-1], model["bx"], model["bh"], model["bb"])
    both = np.concatenate([forward[0], backward[0][::-1]], axis=2)
    return x, forward, backward, both, both @ model["out"] + model["bias"]


def _forward_backward(e: np.ndarray, moves: np.ndarray):
    """Log alphas, log betas and log partition of emissions steps x rows x tags."""
    steps = len(e)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + _NO_START
    for t in range(1, steps):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + moves[None], 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(moves[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    return alpha, beta, _logsum(alpha[-1], 1)


def _gradients(model: Model, windows: np.ndarray, tags: np.ndarray) -> tuple[float, Model]:
    x, forward, backward, both, e = _emissions(model, windows)
    moves = model["moves"] + _FORBIDDEN
    alpha, beta, whole = _forward_backward(e, moves)
    gold = tags.T
    steps, rows = gold.shape
    at = np.arange(rows)
    path = e[np.arange(steps)[:, None], at[None, :], gold].sum(axis=0) + moves[gold[:-1], gold[1:]].sum(axis=0)
    de = np.exp(alpha + beta - whole[None, :, None])
    dmoves = np.zeros_like(moves)
    for t in range(1, steps):
        pairs = alpha[t - 1][:, :, None] + moves[None] + (e[t] + beta[t])[:, None, :] - whole[:, None, None]
        dmoves += np.exp(pairs).sum(axis=0)
        np.add.at(dmoves, (gold[t - 1], gold[t]), -1)
    de[np.arange(steps)[:, None], at[None, :], gold] -= 1
    de /= rows
    n = model["fh"].shape[0]
    dboth = de @ model["out"].T
    fx, fh, fb, dx = _lstm_back(x, model["fx"], model["fh"], forward[1], dboth[:, :, :n])
    bx, bh, bb, dx2 = _lstm_back(x[::-1], model["bx"], model["bh"], backward[1], dboth[::-1, :, n:])
    dembed = np.zeros_like(model["embed"])
    np.add.at(dembed, windows.T, dx + dx2[::-1])
    flat = both.reshape(-1, 2 * n)
    grads = {"embed": dembed, "fx": fx, "fh": fh, "fb": fb, "bx": bx, "bh": bh, "bb": bb, "out": flat.T @ de.reshape(-1, N_TAGS), "bias": de.sum(axis=(0, 1)), "moves": dmoves / rows}
    return float((whole - path).mean()), grads


def fit(windows: np.ndarray, tags: np.ndarray, settings: Settings) -> Model:
    rng = np.random.default_rng(settings.seed)
    n, k = settings.hidden, settings.embedding

    def start(*shape: int) -> np.ndarray:
        return (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

    model: Model = {"embed": start(N_CLASSES, k) * 2, "fx": start(k, 4 * n), "fh": start(n, 4 * n), "fb": np.zeros(4 * n, np.float32), "bx": start(k, 4 * n), "bh": start(n, 4 * n), "bb": np.zeros(4 * n, np.float32), "out": start(2 * n, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "moves": np.zeros((N_TAGS, N_TAGS), np.float32)}
    for b in ("fb", "bb"):
        model[b][n : 2 * n] = 1
    first, second = ({key: np.zeros_like(v) for key, v in model.items()} for _ in range(2))
    step, total = 0, settings.epochs * -(-len(windows) // settings.batch)
    for _ in range(settings.epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), settings.batch):
            own = order[begin : begin + settings.batch]
            _, grads = _gradients(model, windows[own], tags[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = settings.rate * (1 - step / (total + 1))
            for key, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[key] = 0.9 * first[key] + 0.1 * g
                second[key] = 0.99 * second[key] + 0.01 * g * g
                model[key] = (model[key] - rate * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---- labelled spans


def _digits(rng, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _card(rng) -> str:
    """Sixteen digits that pass Luhn's check."""
    number = _digits(rng, 15)
    return next(number + c for c in "0123456789" if luhn(number + c))


def _word(rng, words: list[str]) -> str:
    w = re.sub(r"[^A-Za-z]", "", words[int(rng.integers(len(words)))]).lower()
    return w or "name"


def variant(rng, words: list[str]) -> tuple[str, str | None]:
    """A written piece of personal data and its kind, or a look-alike and None."""
    pick = int(rng.integers(15))
    name, host, top = _word(rng, words), _word(rng, words), str(rng.choice(["com", "org", "net", "fr", "de", "es", "info"]))
    if pick == 0:
        return f"{name}.{_digits(rng, 2)}@{host}{_digits(rng, 1)}.{host[:4] or 'x'}.{top}", "email"
    if pick == 1:
        return f"{name}{_digits(rng, 2)}[at]{host}.{top}", "email"
    if pick == 2:
        return f"{name} @ {host}.{top}", "email"
    if pick == 3:
        return ".".join(str(int(rng.integers(256))) for _ in range(4)), "ip"
    if pick == 4:
        return _card(rng), "card"
    if pick == 5:
        number = _card(rng)
        return str(rng.choice([" ", "-", "."])).join(number[k : k + 4] for k in range(0, 16, 4)), "card"
    if pick == 6:
        return f"+{_digits(rng, 1)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", "phone"
    if pick == 7:
        return str(rng.choice([f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", f"00{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}"])), "phone"
    if pick in (8, 9, 10):
        return f"{name} at {host} dot {top}", "email"
    hexed = "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(12, 41))))
    return str(rng.choice([f'token = "{hexed}"', f"password={hexed}", f"AKIA{hexed[:12].upper()}", f"version {_digits(rng, 1)}.{_digits(rng, 1)}.", f"{_digits(rng, int(rng.integers(1, 7)))}", f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{_digits(rng, 3)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"{_digits(rng, 1)}.{_digits(rng, 2)}.{_digits(rng, 1)}", f"@{name}", f"{name} @ {host}", f"{name} at {host}", f"{name} at {host} {top}", f"{name} dot {host}", f"no. {_digits(rng, 8)}"])), None


def _tagged(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 * KINDS.index(kind) + 2
        tags[a] -= 1
    return tags


def training_windows(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: the patterns' spans in the texts, and variants set into them."""
    rng, width = np.random.default_rng(settings.seed), settings.train_width
    texts = [t for t in texts if t.strip()] or ["the text and the words of the line"]
    rows: list[tuple[str, np.ndarray]] = []
    for text in texts:
        flat = shapes(text)
        tags = np.zeros(len(text), np.int64)
        for a, b, k in flat:
            if not tags[a:b].any():
                tags[a:b] = _tagged(b - a, [(k, 0, b - a)])
        centres = [a for a, _, _ in flat] + [m.start() for m in re.finditer(r"[0-9@]+", text)] + [int(rng.integers(len(text)))]
        for centre in centres[: settings.centres]:
            a = max(0, centre - int(rng.integers(0, width)))
            rows.append((text[a : a + width], tags[a : a + width]))
    rows = [rows[k] for k in rng.permutation(len(rows))[: settings.windows // 4]]
    while len(rows) < settings.windows:
        text = texts[int(rng.integers(len(texts)))]
        a = int(rng.integers(len(text)))
        carrier = re.sub(r"[0-9@]", "", text[a : a + 3 * width])
        words = text[a : a + 400].split() or ["name"]
        out, tags = "", np.zeros(0, np.int64)
        for part in re.split(r"(?<=\s)", carrier):
            if rng.random() < 0.2:
                parts = [variant(rng, words)]
                if parts[0][1] == "card" and rng.random() < 0.3:
                    parts.append((_card(rng), "card"))  # two side by side, which the pattern takes for one
                for shown, kind in parts:
                    tail = " " if len(parts) > 1 else str(rng.choice([" ", " ", ", ", ". ", "\n"]))
                    tags = np.concatenate([tags, _tagged(len(shown), [(kind, 0, len(shown))] if kind else []), np.zeros(len(tail), np.int64)])
                    out += shown + tail
            out += part
            tags = np.concatenate([tags, np.zeros(len(part), np.int64)])
        begin = int(rng.integers(max(1, len(out) - width)))
        rows.append((out[begin : begin + width], tags[begin : begin + width]))
    windows = np.zeros((len(rows), width), np.int64)
    tags = np.zeros((len(rows), width), np.int64)
    for k, (text, own) in enumerate(rows):
        windows[k, : len(text)] = classes_of(text)
        tags[k, : len(text)] = own
    # a span that a window's left border cuts goes on without a beginning; give it one
    cut = (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
    tags[cut, 0] -= 1
    return windows, tags


def train(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from the pieces of at most `sample` documents that lie around digits and at signs, and some without.

    The documents are the first by a hash of the text; the driver gets at most settings.around
    pieces of settings.around_chars characters of each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit = text.rlike("[0-9@]")
    rows = documents.select(text.alias("text")).where("text <> ''")
    most, n = settings.sample, max(1, documents.count())
    parts = []
    for which, number in ((digit, most * 2 // 3), (~digit, most // 3)):
        # a share of the rows that should hold many more than are wanted, though few have a digit
        few = (F.col("h") / F.lit(2.0**64) + 0.5) * n < 64 * number + 1000
        chosen = rows.select("text", F.xxhash64("text").alias("h")).where(few).where(which)
        keys = chosen.select("h").distinct().orderBy("h").limit(number)
        half = settings.around_chars // 2
        around = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s).{{0,{half}}}[0-9@].{{0,{half}}}"), 0), 1, settings.around)
        pieces = F.when(which, around).otherwise(F.array(F.substring("text", 1, settings.around_chars)))
        parts.append(chosen.join(F.broadcast(keys), "h").groupBy("h").agg(F.min(pieces).alias("pieces")))
    got = sorted((r["h"], r["pieces"]) for r in parts[0].unionByName(parts[1]).collect())
    return fit(*training_windows([p for _, own in got for p in own], settings), settings)


# ---- tagging whole texts


def _window_spans(model: Model, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags of each window, and the marginal probability of each of them."""
    e = _emissions(model, windows)[-1]
    moves = model["moves"] + _FORBIDDEN
    steps, rows, _ = e.shape
    score = e[0] + _NO_START
    back = np.zeros((steps, rows, N_TAGS), np.int8)
    for t in range(1, steps):
        ways = score[:, :, None] + moves[None]
        back[t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + e[t]
    tags = np.zeros((steps, rows), np.int64)
    tags[-1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(rows), tags[t]]
    alpha, beta, whole = _forward_backward(e, moves)
    sure = np.exp(alpha + beta - whole[None, :, None])
    return tags.T, np.take_along_axis(sure, tags[:, :, None], axis=2)[:, :, 0].T


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of (start, end, kind, confidence), the set without overlaps that has the greatest sum of confidences."""
    best_of: dict[tuple[int, int, int], float] = {}
    for a, b, k, c in spans:
        best_of[a, b, k] = max(c, best_of.get((a, b, k), 0.0))
    rows = sorted(((b, a, k, c) for (a, b, k), c in best_of.items()))
    ends, totals, taken = [0], [0.0], []
    for b, a, _, c in rows:
        before = bisect_right(ends, a) - 1
        use = totals[before] + c > totals[-1]
        taken.append((use, before))
        totals.append(totals[before] + c if use else totals[-1])
        ends.append(b)
    out, k = [], len(rows)
    while k:
        use, before = taken[k - 1]
        if use:
            b, a, kind, c = rows[k - 1]
            out.append((a, b, kind, c))
            k = before
        else:
            k -= 1
    return out[::-1]


def _prepared(model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each direction the weights of (twice the state, input, 1), such that tanh gives 2 * gate - 1 and the cell's input, and those of the output."""
    n = model["fh"].shape[0]
    scale = np.where(np.arange(4 * n) < 3 * n, 0.5, 1.0)
    out = []
    for wx, wh, b, own in (("fx", "fh", "fb", model["out"][:n]), ("bx", "bh", "bb", model["out"][n:])):
        weights = np.concatenate([model[wh] / 2, model[wx], model[b][None]]) * scale
        out.append((np.ascontiguousarray(weights.T, np.float32), np.ascontiguousarray(own.T / 2, np.float32)))
    return out


def _has_span(model: Model, prepared: list[tuple[np.ndarray, np.ndarray]], windows: np.ndarray) -> np.ndarray:
    """Whether a path that leaves O is the best of its window, or within rounding of it; without the way back.

    These are the sums of _window_spans with the rows last, and every gate as a tanh. While the
    backward direction is read, the most that a stretch of other tags may gain over O is summed
    up: `heads` and `tails` are the gains of stretches from a step on that begin there with B or go
    on with I. Only moves from one stretch into the next are taken as the best of their like, so
    windows in which nothing is gained have no such path; the others go on to the exact sums.
    """
    rows, steps = windows.shape
    n, k = model["fh"].shape[0], model["embed"].shape[1]
    embed, columns = np.ascontiguousarray(model["embed"].T), np.ascontiguousarray(windows.T, np.intp)
    e = np.empty((steps, N_TAGS, rows), np.float32)
    z = np.empty((4 * n, rows), np.float32)
    moves = model["moves"] + _FORBIDDEN
    over = moves - moves[0, 0]
    begin, leave, cross = over[0, 1::2, None], float(over[1:, 0].max()), float(over[1:, 1::2].max())
    first_on, on = (np.array([over[2 * j + i, 2 * j + 2] for j in range(len(KINDS))], np.float32)[:, None] for i in (1, 2))
    heads, tails = (np.full((len(KINDS), rows), -1e4, np.float32) for _ in range(2))
    gain = np.full(rows, -np.inf, np.float32)
    gates, g, i, f, o = z[: 3 * n], z[3 * n :], z[:n], z[n : 2 * n], z[2 * n : 3 * n]
    for last, (weights, own), order in zip((False, True), prepared, (range(steps), range(steps - 1, -1, -1)), strict=True):
        both = np.ones((n + k + 1, rows), np.float32)
        h, c, seen = both[:n], np.zeros((n, rows), np.float32), both[n : n + k]
        h[:] = 0
        for t in order:
            np.take(embed, columns[t], axis=1, out=seen, mode="clip")
            np.matmul(weights, both, out=z)
            np.tanh(z, out=z)
            gates += 1
            np.multiply(i, g, out=g)
            c *= f
            c += g
            c *= 0.5
            np.tanh(c, out=h)
            h *= o
            if not last:
                np.matmul(own, h, out=e[t])
                continue
            now = e[t]
            now += own @ h
            out = np.maximum(heads.max(axis=0) + cross, leave if t < steps - 1 else 0.0)
            lead = now[1:] - (now[0] - model["bias"][1:, None] + model["bias"][0])
            np.maximum(tails + first_on, out, out=heads)
            heads += lead[::2]
            tails += on
            np.maximum(tails, out, out=tails)
            tails += lead[1::2]
            np.maximum(gain, (heads + begin if t else heads).max(axis=0), out=gain)
    able = np.flatnonzero(gain >= -1e-2)
    found = np.zeros(rows, bool)
    if len(able):
        found[able] = _leaves_plain(e[:, :, able] + model["bias"][:, None], moves)
    return found


def _leaves_plain(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Of emissions steps x tags x rows, whether the best path with a tag other than O is above the one of O alone, or near it."""
    steps, _, rows = e.shape
    moves = moves[:, :, None]
    plain, left = e[0, 0].copy(), e[0] + _NO_START[:, None]
    left[0] = -1e4
    ways = np.empty((N_TAGS, N_TAGS, rows), np.float32)
    for t in range(1, steps):
        np.add(left[:, None], moves, out=ways)
        left = ways.max(axis=0)
        np.maximum(left[1:], plain + moves[0, 1:], out=left[1:])
        left += e[t]
        plain += moves[0, 0]
        plain += e[t, 0]
    return left.max(axis=0) > plain - 1e-2


def _windows_of(all_classes: list[np.ndarray], settings: Settings, rows: int = 1024):
    """Batches of windows of one width that cover all texts, with (text, offset) of each.

    A text's last window is as wide as its rest needs, in steps of WIDTH_STEP; what lies
    beyond the text is of class 0.
    """
    width, stride = settings.width, settings.width - settings.overlap
    ready: dict[int, tuple[list[np.ndarray], list[tuple[int, int]]]] = {}
    for number, classes in enumerate(all_classes):
        for offset in range(0, max(0, len(classes) - settings.overlap), stride) if len(classes) > width else [0] * (len(classes) > 0):
            rest = len(classes) - offset
            own = min(width, -(-rest // WIDTH_STEP) * WIDTH_STEP)
            window = classes[offset : offset + own]
            if len(window) < own:
                window = np.append(window, np.zeros(own - len(window), classes.dtype))
            cuts, where = ready.setdefault(own, ([], []))
            cuts.append(window)
            where.append((number, offset))
            if len(cuts) == rows:
                yield np.stack(cuts), where
                del ready[own]
    for cuts, where in ready.values():
        yield np.stack(cuts), where


def _tagged_windows(all_classes: list[np.ndarray], model: Model, settings: Settings) -> list[tuple[int, int, int, list[tuple[int, int, int, float]]]]:
    """(text, offset, width, spans as (start, end, kind, confidence)) of the windows with a span, in order."""
    prepared = _prepared(model)
    ready: dict[int, tuple[list[np.ndarray], list[tuple[int, int]]]] = {}
    out = []

    def tag(cuts: list[np.ndarray], where: list[tuple[int, int]]) -> None:
        tags, sure = _window_spans(model, np.stack(cuts))
        width = tags.shape[1]
        spans: list[list[tuple[int, int, int, float]]] = [[] for _ in where]
        for row, a in zip(*(tags % 2 == 1).nonzero(), strict=True):
            kind, b = int(tags[row, a]), int(a) + 1
            while b < width and tags[row, b] == kind + 1:
                b += 1
            spans[row].append((int(a), b, kind, float(sure[row, a:b].min())))
        out.extend((*place, width, own) for place, own in zip(where, spans, strict=True))

    for windows, where in _windows_of(all_classes, settings):
        cuts, places = ready.setdefault(windows.shape[1], ([], []))
        for row in np.flatnonzero(_has_span(model, prepared, windows)):
            cuts.append(windows[row])
            places.append(where[row])
        if len(cuts) >= 256:
            tag(*ready.pop(windows.shape[1]))
    for cuts, places in ready.values():
        if cuts:
            tag(cuts, places)
    return sorted(out, key=lambda w: w[:2])


def added_spans(texts: list[str], model: Model, settings: Settings) -> list[list[tuple[int, int, int, float]]]:
    """For each text the tagger's spans of enough confidence, reconciled over all windows."""
    stride = settings.width - settings.overlap
    all_classes = [classes_of(t) for t in texts]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    # (text, where the window ends, kind): the start and confidence of a span that the end cuts
    cut: dict[tuple[int, int, int], tuple[int, float]] = {}
    for number, offset, width, spans in _tagged_windows(all_classes, model, settings):
        length = len(all_classes[number])
        for a, b, kind, confidence in spans:
            if offset + b > length:
                continue
            start = offset + a
            if a == 0 and offset > 0:
                before = cut.pop((number, offset + settings.overlap, kind), None)
                if before is None or b < settings.overlap:
                    continue
                start, confidence = before[0], min(before[1], confidence)
            if b == width and offset + width < length:
                if start <= offset + stride:
                    cut[number, offset + width, kind] = (start, confidence)
            elif confidence >= settings.sure:
                found[number].append((start, offset + b, (kind - 1) // 2, confidence))
    return [reconciled(f) for f in found]


_AT = re.compile(r"[@\uff20]|(?<![^\W_])at(?![^\W_])", re.IGNORECASE)
_DOT_TOP = re.compile(r"(?:[.\uff0e]|(?<![^\W_])dot(?![^\W_]))\s*[^\W\d_]{2,}$", re.IGNORECASE)


def _checked(kind: str, shown: str) -> bool:
    """Whether what the tagger found has what its kind cannot do without, whatever the digits' script.

    email: an at sign or "at", and a dot or "dot" before letters at its end. ip: four numbers up
    to 255. card: 16 to 19 digits that pass Luhn's check. phone: 8 to 15 digits.
    """
    if kind == "email":
        at = _AT.search(shown)
        return at is not None and at.start() > 0 and _DOT_TOP.search(shown, at.end()) is not None
    plain = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else " " for c in shown)
    digits = "".join(plain.split())
    if kind == "ip":
        return len(plain.split()) == 4 and all(int(x) <= 255 for x in plain.split())
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def spans_of(texts: list[str], model: Model | None, settings: Settings) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """For each text the patterns' spans, and all spans: those and the tagger's that overlap none of them."""
    added = added_spans(texts, model, settings) if model else [[] for _ in texts]
    out = []
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        taken = sorted(s for own in base.values() for s in own)
        every = {k: list(v) for k, v in base.items()}
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for a, b, kind, _ in more:
            at = bisect_right(taken, (b - 1, 1 << 62))
            if (not at or reach[at - 1] <= a) and _checked(KINDS[kind], text[a:b]):
                every[KINDS[kind]].append((a, b))
        out.append((base, {k: sorted(v) for k, v in every.items()}))
    return out


def _filled(piece: Piece) -> np.ndarray:
    return np.flatnonzero(np.diff(piece.offsets))


def _texts(piece: Piece, numbers: np.ndarray) -> list[str]:
    return [piece.data[piece.offsets[d] : piece.offsets[d + 1]].tobytes().decode("utf-8", "replace") for d in numbers]


def detect(documents: DataFrame, model: Model | None, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """documents with n_email, n_ip, n_card and n_phone (of the patterns), base_sha256 and spans."""
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    nothing = hashlib.sha256(b"").hexdigest()

    def make():
        one_blas_thread()

        def compute(piece: Piece):
            counts = np.zeros((len(KINDS), piece.n_docs), np.int64)
            sums, shown = [nothing] * piece.n_docs, [""] * piece.n_docs
            numbers = _filled(piece)
            for d, (base, every) in zip(numbers, spans_of(_texts(piece, numbers), model, settings), strict=True):
                counts[:, d] = [len(base[k]) for k in KINDS]
                sums[d] = hashlib.sha256(joined(base).encode()).hexdigest()
                shown[d] = joined(every)
            return [*counts, sums, shown]

        return compute

    return with_text_columns(documents, text, fields, make, PIECE_BYTES)


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """text with [EMAIL], [IP], [CARD] or [PHONE] for each span; overlapping spans are one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, own in spans.items() for a, b in own):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model | None, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """documents with all spans masked in the text; other columns as they are, null texts too."""
    name = "__masked"

    def make():
        one_blas_thread()

        def compute(piece: Piece):
            out: list[str | None] = [None] * piece.n_docs
            numbers = _filled(piece)
            whole = _texts(piece, numbers)
            for d, t, (_, every) in zip(numbers, whole, spans_of(whole, model, settings), strict=True):
                if any(every.values()):
                    out[d] = masked(t, every)
            return [out]

        return compute

    changed = with_text_columns(documents, text, [T.StructField(name, T.StringType())], make, PIECE_BYTES)
    return changed.withColumn(text, F.coalesce(name, text)).select(*[f"`{c}`" for c in documents.columns])
