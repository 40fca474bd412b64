"""Secret scans: published patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are words between ASCII white space.  The field tags each as begin, inside or outside of a secret from its shape, its neighbours and
features of the whole text (share of suspicious words), and Viterbi decodes the tags.  It is trained by gradient steps on windows of about
``fit_rows`` texts, picked by a hash of their id and labelled by the base patterns, and on generated secrets of public key formats.  Windows
with a long mixed word that no pattern matches are left out, as nothing says whether it is a secret.

Words without digits, ``=`` or a key word are plain.  A plain word between plain words is outside on every best path; ``Model.locked`` proves
it from the weights, and then only the stretches around other words are decoded, which gives the tags of the whole chain.

Base patterns match leftmost and non-overlapping, each on its own; their spans always stay, and a decoded span that meets one of them isn't
added.  Spans are in code points, the end exclusive.  Null and empty texts have no spans; repeated rows give repeated results; empty tables
none; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import itertools
import random
import re
import string
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, find_words, text_chunks

# Base patterns (fixed values): kind, pattern, the group that is measured and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KEY_WORDS = ("pass", "pwd", "secr", "toke", "api", "key", "auth", "cred", "bear", "priv")
_STARTS = np.array(sorted(int.from_bytes(w[:3].encode(), "little") for w in KEY_WORDS))
FIT_ROWS = 20_000
WINDOWS = 3_000
FEATURES = 1 << 12
LENGTH = 12
REACH = 2  # words around a suspicious one that a stretch holds
B, I, O = 0, 1, 2  # noqa: E741


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Model(NamedTuple):
    """Weights of features by tag, and of tag pairs; a text starts and ends outside."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in features])

    def locked(self) -> bool:
        """Whether a plain word between plain words or the text's ends is outside on each best path, whatever the tags around it."""
        sides = ("plain", "edge")
        for share, size, before, after in itertools.product(range(SHARES), range(SIZES), sides, sides):
            e = self.weights[plain_features(size, share, before, after)].sum(axis=0)
            for a, c in itertools.product(range(3) if before == "plain" else (O,), range(3) if after == "plain" else (O,)):
                if max(e[s] + self.moves[a, s] + self.moves[s, c] for s in (B, I)) >= e[O] + self.moves[a, O] + self.moves[O, c]:
                    return False
        return True

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi's tags of one stretch between outside words."""
        e = self.scores(features)
        best, back = e[0] + self.moves[O], []
        for k in range(1, len(e)):
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e[k]
        tag = int((best + self.moves[:, O]).argmax())
        tags = [tag]
        for step in reversed(back):
            tag = int(step[tag])
            tags.append(tag)
        return tags[::-1]


# ---- base patterns


def base_spans(text: str, long_word: bool = True) -> list[Span]:
    """Spans of the base patterns, by start and then kind.  ``long_word``: false if no word is long enough for a hexadecimal match."""
    found = []
    low = text.lower()
    wanted = any(w in low for w in _ASSIGN_WORDS), "AKIA" in text, long_word
    for (kind, pattern, group, least), look in zip(BASE, wanted):
        if look:
            found += [Span(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s.start, ORDER[s.kind]))


# ---- features

SHARES, SIZES = 4, 5


def _hash(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) % FEATURES


def _size(n: int) -> int:
    return min(SIZES - 1, n // 6)


def _share(suspicious: int, words: int) -> int:
    """Level of the suspicious words' share in a text."""
    x = suspicious / max(words, 1)
    return 0 if x < 0.01 else 1 if x < 0.05 else 2 if x < 0.2 else 3


def suspicious(word: str) -> bool:
    """The same test as the vectorised scan makes: digits in a longer word, ``=``, or the start of a key word."""
    return (len(word.encode()) >= 6 and any("0" <= c <= "9" for c in word)) or "=" in word or word.strip("\"'([{<")[:3].lower() in {w[:3] for w in KEY_WORDS}


def _kind(word: str | None) -> str:
    if word is None:
        return "edge"
    if not suspicious(word):
        return "plain"
    bare = word.strip("\"'()[]{}<>,;:=.").lower()
    if word.strip("\"'") in ("=", ":", ":=", "=>"):
        return "equals"
    if any(bare.startswith(w) for w in KEY_WORDS) and len(bare) < 24:
        return "key" if not any(c.isdigit() for c in bare) else "keyvalue"
    return "value" if len(bare) >= 16 else "short"


def _unknown(word: str) -> bool:
    """Whether a word may be a secret as far as its shape tells: long, neither address nor URL, letters and digits mixed."""
    return _kind(word) in ("value", "keyvalue") and "@" not in word and "://" not in word and sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:])) >= 3


def plain_features(size: int, share: int, before: str = "plain", after: str = "plain") -> list[int]:
    return [_hash("plain"), _hash("plain", size), _hash("share", share), _hash("before", before), _hash("after", after), _hash("between", before, after)]


def features(words: list[str | None], k: int, share: int) -> list[int]:
    """Hashed features of word ``k``; none stands beyond the text's ends."""
    word, before, after = words[k], _kind(words[k - 1] if k else None), _kind(words[k + 1] if k + 1 < len(words) else None)
    if not suspicious(word):
        return plain_features(_size(len(word)), share, before, after)
    value = re.split(r"[=:]", word)[-1].strip("\"'()[]{}<>,;.")
    classes = re.sub(r"[^a-zA-Z0-9]", "-", value)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", classes))))[:6]
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    kind, size = _kind(word), min(len(value) // 4, 12)
    letters = sum(c.isalpha() for c in value)
    rest = {
        "kind": kind, "shape": shape, "size": size, "changes": min(changes, 8), "letters": 8 * letters // max(len(value), 1),
        "head": value[:4].lower(), "sign": "".join(c for c in ("=", ":", '"', "'", "@", "/") if c in word), "upper": 4 * sum(c.isupper() for c in value) // max(letters, 1),
    }
    out = [_hash(a, b) for a, b in rest.items()]
    out += [_hash("share", share), _hash("before", before), _hash("after", after), _hash("between", before, after), _hash(kind, before), _hash(kind, size, min(changes, 8) // 2), _hash("suspicious")]
    if before == "equals" and k >= 2:
        out.append(_hash("assigned", kind, _kind(words[k - 2])))
    return out


# ---- training


def generated(seed: int, plain: list[str], n: int = 400) -> list[tuple[list[str], list[int]]]:
    """Windows of plain words with a secret of a public key format, or with an innocent number."""
    rnd = random.Random(seed)
    some = lambda chars, k: "".join(rnd.choices(chars, k=k))
    mixed, small_hex = string.ascii_letters + string.digits, "0123456789abcdef"
    plain = plain or ["the", "of", "and", "alpha", "omega"]
    secrets = (
        lambda: ["ghp_" + some(mixed, 36)], lambda: ["sk-" + some(mixed, 40)], lambda: ["AKIA" + some(string.ascii_uppercase + string.digits, 16)],
        lambda: ["xoxb-" + some(string.digits, 11) + "-" + some(mixed, 24)], lambda: ["eyJ" + some(mixed, 30) + "." + some(mixed, 40)], lambda: [some(small_hex, rnd.choice((32, 40, 64)))],
        lambda: ["password=" + some(small_hex, 18)], lambda: ["token", "=", f'"{some(small_hex, 40)}"'], lambda: ["pwd:", some(mixed, 14) + some(string.digits, 3)], lambda: ["api_key:", some(mixed, 28) + "7"], lambda: ["secret=" + some(mixed, 22)], lambda: ["Bearer", some(mixed, 34) + "3"],
    )
    innocent = (
        lambda: [some(string.digits, 16)], lambda: [f"({some(string.digits, 3)})", f"{some(string.digits, 3)}-{some(string.digits, 4)}"], lambda: [f"user{some(string.digits, 3)}@mail.example.com"], lambda: [f"https://a{some(string.digits, 2)}.example.org/{some(string.digits, 4)}"],
        lambda: ["20" + some(string.digits, 2) + "-0" + some("123456789", 1) + "-1" + some(string.digits, 1)], lambda: ["token"], lambda: ["password"], lambda: ["key"], lambda: [some(string.digits, 3) + "." + some(string.digits, 3) + "." + some(string.digits, 1) + ".1"], lambda: ["=" * 8],
    )
    out = []
    for k in range(n):
        real = k % 2 == 0
        middle = rnd.choice(secrets if real else innocent)()
        head, tail = rnd.choices(plain, k=rnd.randint(0, 4)), rnd.choices(plain, k=rnd.randint(0, 4))
        tags = [O] * len(head) + ([B] + [I] * (len(middle) - 1) if real else [O] * len(middle)) + [O] * len(tail)
        out.append((head + middle + tail, tags))
    return out


def train(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 80, decay: float = 1e-3) -> Model:
    """Gradient steps on the likelihood of all sequences (at most ``LENGTH`` words) at once; forward and backward sums run over all in step."""
    sequences = [s for s in sequences if s[0]]
    weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not sequences:
        weights[:, O] = 1.0
        return Model(weights, moves)
    n, t = len(sequences), max(len(s[0]) for s in sequences)
    real = np.array([[k < len(s[0]) for k in range(t)] for s in sequences])
    gold = np.array([[s[1][k] if k < len(s[1]) else O for k in range(t)] for s in sequences])
    place = np.concatenate([np.full(len(f), i * t + k) for i, s in enumerate(sequences) for k, f in enumerate(s[0])])
    which = np.concatenate([np.array(f) for s in sequences for f in s[0]])
    onehot = np.eye(3)[gold] * real[:, :, None]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (np.concatenate([np.full((n, 1), O), gold], axis=1).ravel(), np.concatenate([gold, np.full((n, 1), O)], axis=1).ravel()), 1)
    square_w, square_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for step in range(rounds):
        e = np.stack([np.bincount(place, weights[which, s], n * t) for s in range(3)], axis=1).reshape(n, t, 3)
        e[~real] = (-50.0, -50.0, 0.0)  # padding is outside
        e = np.exp(np.clip(e - e.max(axis=2, keepdims=True), -50, 0))
        m = np.exp(np.clip(moves - moves.max(), -30, 0))
        forward, backward = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        now = e[:, 0] * m[O]
        forward[:, 0] = now / now.sum(axis=1, keepdims=True)
        for k in range(1, t):
            now = (forward[:, k - 1] @ m) * e[:, k]
            forward[:, k] = now / now.sum(axis=1, keepdims=True)
        backward[:, -1] = m[:, O]
        for k in range(t - 2, -1, -1):
            now = (backward[:, k + 1] * e[:, k + 1]) @ m.T
            backward[:, k] = now / now.sum(axis=1, keepdims=True)
        p = forward * backward
        p /= p.sum(axis=2, keepdims=True)
        expected = np.zeros((3, 3))
        expected[O] += p[:, 0].sum(axis=0)
        expected[:, O] += p[:, -1].sum(axis=0)
        for k in range(1, t):
            joint = forward[:, k - 1, :, None] * m * (e[:, k] * backward[:, k])[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        error = ((onehot - p) * real[:, :, None]).reshape(n * t, 3)
        grad = np.stack([np.bincount(which, error[place, s], FEATURES) for s in range(3)], axis=1) / n - decay * weights
        turn = (pairs - expected) / n - decay * moves
        square_w, square_m = 0.9 * square_w + 0.1 * grad**2, 0.9 * square_m + 0.1 * turn**2
        rate = 0.15 / (1 + step / 40)
        weights += rate * grad / np.sqrt(square_w + 1e-10)
        moves += rate * turn / np.sqrt(square_m + 1e-10)
    return Model(weights, moves)


# ---- scanning


_DIGITS = np.array([48 <= b < 58 for b in range(256)])
_EQUALS = np.array([b == 61 for b in range(256)])
_OPENING = np.array([chr(b) in "\"'([{<" for b in range(256)])
_SMALL = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.int64)


def _suspects(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are suspicious; the same as ``suspicious``."""
    if not len(starts):
        return np.zeros(0, bool)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    inside = lambda total: total[ends] > total[starts]
    first = starts.copy()
    for _ in range(8):  # opening quotes and brackets before the word
        opening = (first < ends) & _OPENING[data[np.minimum(first, len(data) - 1)]]
        if not opening.any():
            break
        first += opening
    low = _SMALL[data]
    code = np.zeros(len(starts), np.int64)
    for k in range(3):
        code |= np.where(first + k < ends, low[np.minimum(first + k, len(data) - 1)], 0) << 8 * k
    return ((ends - starts >= 6) & inside(running(_DIGITS))) | inside(running(_EQUALS)) | np.isin(code, _STARTS)


class Scanned(NamedTuple):
    """One text with something to look at: row, text, word ranges in code points, and its suspicious words."""

    row: int
    text: str
    starts: np.ndarray
    ends: np.ndarray
    suspects: np.ndarray
    long_word: bool


def _keyed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a chunk that hold what an assign or access match implies, anywhere in a word."""
    raw = data.tobytes()
    low, held = raw.lower(), np.zeros(len(offsets) - 1, bool)
    for text, word in [(low, w.encode()) for w in _ASSIGN_WORDS] + [(raw, b"AKIA")]:
        at = text.find(word)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            held[k] = True
            at = text.find(word, int(offsets[k + 1]))
    return held


def _scan(column: pa.Array, every: bool = False) -> Iterator[tuple[int, int, list[Scanned]]]:
    """Rows of each chunk, and its texts that have a suspicious or long word or can match a base pattern (or all)."""
    for first, end, data, offsets in text_chunks(column):
        starts, ends, at = find_words(data, offsets)
        flags = _suspects(data, starts, ends)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        counted, long = np.concatenate([[0], np.cumsum(flags)])[at], np.concatenate([[0], np.cumsum(ends - starts >= 24)])[at]
        found = []
        for k in np.flatnonzero((np.diff(counted) > 0) | (np.diff(long) > 0) | _keyed(data, offsets) | every).tolist():
            a, b = at[k], at[k + 1]
            zero = points[offsets[k]]
            found.append(Scanned(first + k, data[offsets[k] : offsets[k + 1]].tobytes().decode(), points[starts[a:b]] - zero, points[ends[a:b]] - zero, np.flatnonzero(flags[a:b]), bool(long[k + 1] > long[k])))
        yield first, end, found


def _stretches(suspects: np.ndarray, n: int, whole: bool = False) -> Iterator[tuple[int, int]]:
    """Word ranges to decode: ``REACH`` words around each suspicious one, merged; or all."""
    if whole and n:
        yield 0, n
        return
    first = last = None
    for k in suspects.tolist():
        if first is None:
            first, last = max(0, k - REACH), min(n, k + REACH + 1)
        elif k - REACH <= last:
            last = min(n, k + REACH + 1)
        else:
            yield first, last
            first, last = max(0, k - REACH), min(n, k + REACH + 1)
    if first is not None:
        yield first, last


def _around(x: Scanned, a: int, b: int) -> list[str | None]:
    """Words a-1 to b, none beyond the ends."""
    return [x.text[x.starts[k] : x.ends[k]] if 0 <= k < len(x.starts) else None for k in range(a - 1, b + 1)]


def decoded_spans(x: Scanned, model: Model, whole: bool) -> list[Span]:
    """Spans of the field's begin-inside runs, without quotes and stops around them."""
    share, out = _share(len(x.suspects), len(x.starts)), []
    for a, b in _stretches(x.suspects, len(x.starts), whole):
        words = _around(x, a, b)
        tags = model.decode([features(words, k, share) for k in range(1, len(words) - 1)])
        k = 0
        while k < len(tags):
            if tags[k] == B or tags[k] == I:
                stop = k + 1
                while stop < len(tags) and tags[stop] == I:
                    stop += 1
                start, end = int(x.starts[a + k]), int(x.ends[a + stop - 1])
                while end > start and x.text[end - 1] in "\"'.,;:)]}>":
                    end -= 1
                while start < end and x.text[start] in "\"'([{<":
                    start += 1
                if end > start:
                    out.append(Span("crf", start, end))
                k = stop
            else:
                k += 1
    return out


def _windows(texts: DataFrame, fit_rows: int) -> list[tuple[list[str], list[int], int]]:
    """At most ``WINDOWS`` labelled windows of about ``fit_rows`` texts, in the order of their checksum."""
    bounded_batches(texts.sparkSession)
    total = texts.count()
    share = min(1.0, fit_rows / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, found in _scan(batch.column(0)):
                for x in found:
                    spans, level = base_spans(x.text, x.long_word), _share(len(x.suspects), len(x.starts))
                    for a, b in _stretches(x.suspects, len(x.starts)):
                        b = min(b, a + LENGTH)
                        words, tags, last = _around(x, a, b), [], None
                        for k in range(a, b):
                            hit = next((j for j, s in enumerate(spans) if s.start < x.ends[k] and x.starts[k] < s.end), None)
                            tags.append(O if hit is None else I if last is not None and hit == last else B)
                            last = hit
                        if not any(t == O and _unknown(w) for w, t in zip(words[1:], tags)):
                            out.append(([w or "" for w in words], tags, level))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.int32())], ["words", "tags", "level"])

    picked = texts.where(F.coalesce(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * share), F.lit(False))).select("text")
    rows = picked.mapInArrow(run, "words array<string>, tags array<int>, level int").distinct()
    secret = F.array_min("tags") < O
    both = [rows.where(c).orderBy(F.xxhash64("words"), "words", "level", "tags").limit(WINDOWS // 2).collect() for c in (secret, ~secret)]
    return [(r.words, r.tags, r.level) for part in both for r in part]


def fit(texts: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """The field's weights from a frame ``id, text``."""
    rows = _windows(texts, fit_rows)
    plain = sorted({w for words, tags, _ in rows for w in words if w and not suspicious(w)})[:500]
    sequences = []
    for words, tags, level in rows:
        padded = [w or None for w in words]
        sequences.append(([features(padded, k, level) for k in range(1, len(padded) - 1)], list(tags)))
    for k, (words, tags) in enumerate(generated(seed, plain)):
        padded = [None if k % 5 == 0 else "the", *words, None if k % 7 == 0 else "the"]
        sequences.append(([features(padded, j, k % 2) for j in range(1, len(padded) - 1)], tags))
    for size in range(SIZES):  # plain text, whatever the rest of the text looks like
        for level in range(SHARES):
            inner = plain_features(size, level)
            ends = [plain_features(size, level, "edge"), plain_features(size, level, "plain", "edge")]
            sequences += [([inner] * LENGTH, [O] * LENGTH)] * 5 + [([ends[0], *[inner] * (LENGTH - 2), ends[1]], [O] * LENGTH), ([plain_features(size, level, "edge", "edge")], [O])]
    return train(sequences)


def scan(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, base, added``: spans (kind, start, end) of the base patterns, and what the field adds, of each text."""
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(source, fit_rows)
    whole = not model.locked()
    shipped = texts.sparkSession.sparkContext.broadcast((np.asarray(model.weights), np.asarray(model.moves)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            for first, end, found in _scan(batch.column(1), whole):
                base, added = [[] for _ in range(end - first)], [[] for _ in range(end - first)]
                for x in found:
                    spans = base_spans(x.text, x.long_word)
                    more = [s for s in decoded_spans(x, own, whole) if not any(s.start < t.end and t.start < s.end for t in spans)] if len(x.suspects) or whole else []
                    base[x.row - first], added[x.row - first] = [s._asdict() for s in spans], [s._asdict() for s in more]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(base, kind), pa.array(added, kind)], ["id", "base", "added"])

    of_id = source.schema["id"].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(run, f"id {of_id}, base {span}, added {span}").withColumnRenamed("id", id_col)


def redacted(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, mark: str = "<secret>") -> DataFrame:
    """The rows with every span in the text replaced by ``mark``; other columns stay."""
    model = fit(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fit_rows)
    whole = not model.locked()
    shipped = texts.sparkSession.sparkContext.broadcast((np.asarray(model.weights), np.asarray(model.moves)))
    at = texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            out = batch.column(at).to_pylist()
            for _, _, found in _scan(batch.column(at), whole):
                for x in found:
                    spans = base_spans(x.text, x.long_word)
                    spans += decoded_spans(x, own, whole) if len(x.suspects) or whole else []
                    parts, last = [], 0
                    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
                        if s.end <= last:
                            continue
                        if s.start >= last:
                            parts += [x.text[last : s.start], mark]
                        last = s.end
                    if parts:
                        out[x.row] = "".join(parts) + x.text[last:]
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return texts.mapInArrow(run, texts.schema)
