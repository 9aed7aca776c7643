"""Personal data: patterns, and a linear-chain conditional random field over word shapes that finds other spellings.

The field labels blank-separated tokens of a line with begin/inside tags of four kinds.  A token is seen through its
shape (letters as a, digits as 0, marks as they are) and the shapes of its neighbours; features are hashed.  It is
trained from a small labelled table by maximum likelihood (forward-backward, Adam), and decoded by Viterbi over many lines
at once.  Pattern findings always stay; the field's spans are added where they touch none and hold a plausible value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.common import add_columns, without

# Kinds in the order of results, and the patterns.  Possessive quantifiers and the look-behinds change no
# match: what they refuse to retry would fail at the same character again.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield "email", begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Pattern findings, leftmost and non-overlapping per kind, by start and kind; failing matches are dropped."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- features ---------------------------------------------------------------------------------------------------

_SHAPED = {**{ord(c): "0" for c in "0123456789"}, **{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
_LETTERS = re.compile(r"[^\W\d_]+")
_REST = re.compile(r"[^\x00-\x7f]+")
_MARKS = ".,;:!?\"'()[]{}<>|*"


def shape(token: str) -> str:
    """Letters as one a, each digit as 0 (at most 20), marks as they are; at most 48 characters, both ends kept."""
    s = _LETTERS.sub("a", token.translate(_SHAPED))
    s = _REST.sub("~", s)
    s = re.sub("0{20,}", "0" * 20, s)
    return s if len(s) <= 48 else s[:24] + s[-24:]


def _features(s: str) -> list[str]:
    core = s.strip(_MARKS)
    digits = s.count("0")
    return [
        f"shape {s}", f"core {core}", f"digits {digits}", f"core dots {core.count('.')} at {core.count('@')}",
        f"starts {s[:1]} ends {s[-1:]}", f"letters {'a' in s} marks {bool(core.strip('a0'))} digits {min(digits, 1)}",
    ]


BITS = 12
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EDGE = ""  # shape beyond either end of a line


def _slots(s: str, place: str) -> list[int]:
    return [xxhash.xxh32_intdigest(f"{place} {f}") & ((1 << BITS) - 1) for f in _features(s)]


@dataclass(frozen=True)
class Field:
    """Weights of the field: features x tags, tag to tag, and of the first tag."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def tags_of(line: str, spans: list[Span]) -> tuple[list[str], list[int]]:
    """Tokens of a line and their tags under labelled spans."""
    tokens, tags = [], []
    for m in _TOKEN.finditer(line):
        tag = 0
        for kind, begin, end in spans:
            if m.start() < end and begin < m.end():
                tag = 1 + 2 * KINDS.index(kind) + (begin < m.start())
                break
        tokens.append(m[0])
        tags.append(tag)
    return tokens, tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 50, rate: float = 0.25, penalty: float = 1e-3) -> Field:
    """Maximum likelihood over labelled token rows, all rows at once, padded to the longest."""
    weights, moves, first = (np.zeros(s, np.float32) for s in ((1 << BITS, TAGS), (TAGS, TAGS), TAGS))
    rows = [r for r in rows if r[0]]
    if not rows:
        return Field(weights, moves, first)
    n, width = len(rows), max(len(t) for t, _ in rows)
    per = len(_features("a"))
    slots = np.zeros((n, width, 3 * per), np.int64)
    gold, real = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (tokens, tags) in enumerate(rows):
        shapes = [EDGE, *map(shape, tokens), EDGE]
        for t in range(len(tokens)):
            slots[i, t] = [*_slots(shapes[t + 1], "own"), *_slots(shapes[t], "before"), *_slots(shapes[t + 2], "after")]
        gold[i, : len(tags)], real[i, : len(tags)] = tags, True
    flat = slots[real]
    where = np.arange(n)
    target = np.eye(TAGS, dtype=np.float32)[gold]
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves, first)]
    for step in range(1, rounds + 1):
        emit = weights[slots].sum(2)
        ahead, behind = np.zeros((2, n, width, TAGS), np.float32)
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, width):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        whole = _log_sum(ahead[:, -1], 1)
        for t in range(width - 2, -1, -1):
            new = _log_sum(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, behind[:, t])
        chance = np.exp(ahead + behind - whole[:, None, None])
        error = (target - chance)[real]
        g_weights = np.empty_like(weights)
        for k in range(TAGS):
            g_weights[:, k] = np.bincount(flat.ravel(), np.repeat(error[:, k], flat.shape[1]), 1 << BITS)
        g_moves = np.zeros_like(moves)
        for t in range(1, width):
            on = real[:, t]
            pair = ahead[on, t - 1, :, None] + moves + (emit[on, t] + behind[on, t])[:, None, :] - whole[on, None, None]
            g_moves -= np.exp(pair).sum(0)
            np.add.at(g_moves, (gold[on, t - 1], gold[on, t]), 1.0)
        g_first = (target[where, 0] - chance[where, 0]).sum(0)
        for (p, m, v), g in zip(state, (g_weights, g_moves, g_first)):
            g = g / n - penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves, first)


class Decoder:
    """Viterbi over many lines; emission scores of every shape are computed once."""

    LIMIT = 200_000  # tokens and shapes remembered before starting anew

    def __init__(self, field: Field) -> None:
        self.field = field
        gain = max(float((field.moves - field.moves[0, 0]).max()), float((field.first - field.first[0]).max()), 0.0)
        #: If outside leads by more than this at every token of a line, no other path can make up for it: a detour of
        #: k tokens crosses at most k + 1 moves, each worth at most ``gain``.
        self.margin = 2 * gain
        self._reset()

    def _reset(self) -> None:
        self.tokens: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.emit = [[], [], []]
        self._shape(EDGE)
        self.arrays = None

    def _shape(self, s: str) -> int:
        k = self.shapes.get(s)
        if k is None:
            k = self.shapes[s] = len(self.shapes)
            for rows, place in zip(self.emit, ("own", "before", "after")):
                rows.append(self.field.weights[_slots(s, place)].sum(0))
            self.arrays = None
        return k

    def _ids(self, lines: list[list[str]]) -> np.ndarray:
        known = self.tokens
        if len(known) > self.LIMIT or len(self.shapes) > self.LIMIT:
            self._reset()
            known = self.tokens
        for token in set(chain.from_iterable(lines)).difference(known):
            known[token] = self._shape(shape(token))
        return np.fromiter(map(known.__getitem__, chain.from_iterable(lines)), np.int32, sum(map(len, lines)))

    def decode(self, lines: list[list[str]]) -> dict[int, np.ndarray]:
        """Tags of the lines (lists of tokens) that have any; the other lines are outside throughout."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return {}
        own = self._ids(lines)
        if self.arrays is None:
            self.arrays = [np.array(rows, np.float32) for rows in self.emit]
        begin = np.r_[0, np.cumsum(sizes[filled])]
        before, after = np.r_[0, own[:-1]], np.r_[own[1:], 0]
        before[begin[:-1]], after[begin[1:] - 1] = 0, 0
        emit = self.arrays[0][own] + self.arrays[1][before] + self.arrays[2][after]
        lead = emit[:, 0] - emit[:, 1:].max(1)
        open_ = np.flatnonzero(np.minimum.reduceat(lead, begin[:-1]) <= self.margin)
        out: dict[int, np.ndarray] = {}
        open_ = open_[np.argsort(sizes[filled[open_]], kind="stable")]
        at = 0
        while at < len(open_):
            longest_fit = max(1, 200_000 // max(1, int(sizes[filled[open_[min(at + 2000, len(open_) - 1)]]])))
            part = open_[at : at + min(2000, longest_fit)]
            at += len(part)
            for k, tags in zip(part.tolist(), self._viterbi(emit, begin[part], sizes[filled[part]])):
                if tags.any():
                    out[int(filled[k])] = tags
        return out

    def _viterbi(self, emit: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        n, width = len(begin), int(sizes.max())
        best = self.field.first + emit[begin]
        came = np.zeros((width, n, TAGS), np.int8)
        for t in range(1, width):
            on = np.flatnonzero(sizes > t)
            step = best[on, :, None] + self.field.moves
            came[t, on] = step.argmax(1)
            best[on] = step.max(1) + emit[begin[on] + t]
        tag = best.argmax(1)
        tags = np.zeros((n, width), np.int8)
        for t in range(width - 1, -1, -1):
            on = sizes > t
            tags[on, t] = tag[on]
            if t:
                tag[on] = came[t, on, tag[on]]
        return [tags[i, : sizes[i]] for i in range(n)]


# --- from tags to spans -----------------------------------------------------------------------------------------

def _plausible(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "email":
        return len(re.findall(r"[A-Za-z0-9]+", value)) >= 2 and bool(re.search(r"@|\bat\b", value))
    if kind == "ip":
        numbers = re.findall(r"[0-9]+", value)
        return len(numbers) == 4 and all(map(_byte, numbers))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and bool(re.search(r"[0-9)][\x20().-]+[0-9(]", value))


def _line_spans(line: str, tags: np.ndarray) -> Iterator[Span]:
    found, open_ = [m.span() for m in _TOKEN.finditer(line)], None
    for (begin, end), tag in zip([*found, (0, 0)], [*tags.tolist(), 0]):
        kind, inside = (tag - 1) // 2, tag > 0 and tag % 2 == 0
        if open_ and not (inside and open_[0] == kind):
            value = line[open_[1] : open_[2]]
            core = value.strip(_MARKS.replace("(", "")) if KINDS[open_[0]] == "phone" else value.strip(_MARKS)
            start = open_[1] + value.find(core)
            if core and _plausible(KINDS[open_[0]], core):
                yield KINDS[open_[0]], start, start + len(core)
            open_ = None
        if tag:
            open_ = (kind, open_[1] if open_ else begin, end)


def find(decoder: Decoder, texts: list[str], block: int = 1_000_000) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    extra: list[list[Span]] = [[] for _ in texts]
    lines, owner, held = [], [], 0

    def flush() -> None:
        tokens = [line.split() for line in lines]
        for k, tags in decoder.decode(tokens).items():
            i, shift = owner[k]
            extra[i] += [(kind, b + shift, e + shift) for kind, b, e in _line_spans(lines[k], tags)]
        lines.clear()
        owner.clear()

    for i, text in enumerate(texts):
        shift = 0
        for line in text.split("\n"):
            lines.append(line)
            owner.append((i, shift))
            shift += len(line) + 1
        held += len(text)
        if held >= block:
            flush()
            held = 0
    flush()
    spans = []
    for i, own in enumerate(base):
        added = [s for s in extra[i] if all(s[2] <= b or e <= s[1] for _, b, e in own)] if extra[i] else []
        spans.append(sorted(own + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else own)
    return base, spans


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlaps merged, replaced by its kind in square brackets."""
    out, at = [], 0
    for kind, begin, end in spans:
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base``, ``pii_spans`` (arrays of kind, start, end in code points) and ``pii_redacted``.

    Whole texts; a null text counts as empty, has no span and stays null in ``pii_redacted``.  Each row is its own, also where
    rows repeat; columns of these names are replaced, others kept; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.first))

    def make() -> Callable[[list], dict[str, pa.Array]]:
        decoder = Decoder(Field(*shared.value))

        def columns(texts: list) -> dict[str, pa.Array]:
            base, spans = find(decoder, [t or "" for t in texts])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            arrow = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], kind)
            clean = [t if t is None else redacted(t, s) for t, s in zip(texts, spans)]
            return {"pii_base": arrow(base), "pii_spans": arrow(spans), "pii_redacted": pa.array(clean, pa.string())}

        return columns

    added = [T.StructField("pii_base", SPANS), T.StructField("pii_spans", SPANS), T.StructField("pii_redacted", T.StringType())]
    return add_columns(without(docs, [f.name for f in added]), text, make, T.StructType(added))


# --- labelled table ---------------------------------------------------------------------------------------------

#: Other spellings of a pattern finding, by kind; each makes one more labelled row from a row with such a finding.
SPELLINGS: dict[str, list[Callable[[str], str]]] = {
    "email": [lambda v: v.replace("@", " at "), lambda v: v.replace("@", " @ "), lambda v: f"<{v}>"],
    "ip": [lambda v: v.replace(".", "[.]"), lambda v: v.replace(".", " . ")],
    "card": [lambda v: ".".join(re.findall("[0-9]{1,4}", _digits(v)))],
    "phone": [lambda v: v.lstrip("+").split(" ", 1)[-1], lambda v: re.sub(r"[() ]+", ".", v.lstrip("+")).strip("."),
              lambda v: re.sub(r"[()]", "", v.lstrip("+").split(" ", 1)[-1]).replace(" ", "-")],
}


def labelled_table(docs: DataFrame, rows: int = 300, text: str = "text") -> DataFrame:
    """A small labelled table ``(line, spans)`` made from the corpus: lines with findings, and as many without.

    Pattern findings label their lines; ``SPELLINGS`` adds rows in which a finding is written in another way.  About
    ``rows`` lines of either sort are taken, by the smallest hash of the text's line, at most 2 x ``rows`` altogether
    before spellings.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                value = value.as_py()
                for line in (value or "").split("\n"):
                    found = base_spans(line)
                    if not found and xxhash.xxh32_intdigest(line) % 64:
                        continue  # lines without a finding are far more than needed
                    middle = (found[0][1] if found else 0) - 100
                    cut = line[max(0, middle) : max(0, middle) + 300]
                    out.append((cut, xxhash.xxh64_intdigest(cut) >> 1, bool(base_spans(cut))))
            if out:
                lines, order, some = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines, pa.string()), pa.array(order, pa.int64()), pa.array(some, pa.bool_())], ["line", "h", "some"]
                )

    lines = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(label, "line string, h long, some boolean")
    both = [lines.where(c).select("line", "h").orderBy("h", "line").limit(rows) for c in (F.col("some"), ~F.col("some"))]
    return both[0].union(both[1])


def fit(labelled: DataFrame, window: int = 5) -> Field:
    """Train from the lines of a labelled table; tokens farther than ``window`` from a finding are left out."""
    rows: list[tuple[list[str], list[int]]] = []

    def add(line: str, spans: list[Span]) -> None:
        tokens, tags = tags_of(line, spans)
        at = [k for k, t in enumerate(tags) if t]
        for begin, end in [(max(0, at[0] - window), at[-1] + window + 1)] if at else [(0, 2 * window)]:
            rows.append((tokens[begin:end][:24], tags[begin:end][:24]))

    for r in sorted({r["line"] for r in labelled.select("line").collect()}):
        spans = base_spans(r)
        add(r, spans)
        for kind, begin, end in spans[:2]:
            for spell in SPELLINGS[kind]:
                value = spell(r[begin:end])
                head = r[max(0, begin - 60) : begin]
                head = head[head.find(" ") + 1 :] if begin > 60 else head
                around = f"{head}{value}"
                tail = r[end : end + 60]
                add(around + tail[: tail.rfind(" ")] if " " in tail else around, [(kind, len(head), len(around))])
    return train(rows)
