"""BPE encoding and decoding through a deterministic tokenization automaton.

The automaton reads *tokens*.  It starts as one state with a loop for every base symbol and then takes the merges in
order.  The gadget for a merge (u, v) -> w does three things:

* the state entered by ``u`` is replaced by a copy without the arc ``v`` (u followed by v no longer occurs),
* wherever ``u`` then ``v`` could be read, an arc ``w`` is added,
* ``w`` leads where ``v`` led.

The target of an arc depends on its label only, so a state is "what was read last", and a copy differs from its
original by one forbidden label.  A state is therefore stored as a chain: the state of ``w`` extends the state ``v`` had
when ``w`` was born, and each later merge (w, x) forbids one more label.  An arc ``x`` leaves the state of ``t`` unless
a gadget forbade it: some merge (a, b) with ``a`` on the right edge of ``t`` and ``b`` on the left edge of ``x`` came
before both edges were closed by a larger token.  ``arc`` looks that up in the merge table; ``Tables`` keeps the answers,
so the transition table fills with the arcs that texts use.  Every word has exactly one path.  Decoding emits the labels
of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinprofile.llm.common import HELD, add_columns

#: White space as the tokenizer file's patterns mean it; Python's own split also takes four control characters.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_MARKS = ".,;:!?"
_SPACES = re.compile(f"[{SPACE}]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Automaton:
    """The compiled merges: ``encode`` a word, ``labels`` of the arcs."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.labels = [""] * (max(vocab.values()) + 1)
        for label, i in vocab.items():
            self.labels[i] = label
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        dead = set()
        for time, (a, b) in enumerate(pairs):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if (u, v) in self.merged or w in self.born:
                raise ValueError(f"merge {a!r} {b!r} repeats a pair or a product")
            if u in dead or v in dead or not self._open(u, v, time):
                dead.add(w)  # the pair never meets, so the merge adds no arc
            self.left[w], self.right[w], self.born[w] = u, v, time
            self.merged[u, v] = time
        alive = {label: i for label, i in vocab.items() if i not in dead}
        self.final = {x[: -len(suffix)]: i for x, i in alive.items() if x.endswith(suffix) and len(x) > len(suffix)}
        self.inner = {x: i for x, i in alive.items() if not x.endswith(suffix)}
        self.longest = max(map(len, [*self.final, *self.inner]))

    def _open(self, t: int, x: int, until: int) -> bool:
        """Whether no gadget before ``until`` forbade ``x`` in the state entered by ``t``."""
        cut = until
        while True:
            other, bound = x, until
            while True:
                time = self.merged.get((t, other))
                if time is not None and time < cut and time <= bound and time < until:
                    return False
                if other not in self.left:
                    break
                bound, other = self.born[other], self.left[other]
            if t not in self.right:
                return True
            cut, t = min(cut, self.born[t]), self.right[t]

    def arc(self, t: int, x: int) -> bool:
        """Whether the state entered by ``t`` has an arc ``x``."""
        return self._open(t, x, 1 << 60)

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word, given in the byte alphabet: the longest open arc, a step back at a dead end."""
        size, longest = len(word), self.longest
        path: list[tuple[int, int, int]] = []
        at, last, end = 0, -1, min(size, longest)
        while at < size:
            while end > at:
                x = (self.final if end == size else self.inner).get(word[at:end])
                if x is not None and (last < 0 or self.arc(last, x)):
                    path.append((at, last, end))
                    at, last, end = end, x, min(size, end + longest)
                    break
                end -= 1
            else:
                at, last, end = path.pop()
                end -= 1
        return [step[1] for step in path[1:]] + [last]


class Tables:
    """The automaton as arrays: a trie of arc labels over bytes and a hashed table of known arcs.

    ``encode`` advances many words together, one byte at a time.  The tokens of a prefix do not depend on what follows,
    so a word's state after byte i is the last token of its first i bytes: the one label ending there whose arc leaves
    the state at the label's start.
    """

    SLOTS = 1 << 20

    def __init__(self, automaton: Automaton, alphabet: list[str]) -> None:
        self.automaton = automaton
        byte = {c: b for b, c in enumerate(alphabet)}
        children: list[dict[int, int]] = [{}]
        inner, final = [-1], [-1]
        for labels, ids in ((automaton.inner, inner), (automaton.final, final)):
            for label, i in labels.items():
                node = 0
                for c in label:
                    if byte[c] not in children[node]:
                        children[node][byte[c]] = len(children)
                        children.append({})
                        inner.append(-1)
                        final.append(-1)
                    node = children[node][byte[c]]
                ids[node] = i
        self.inner, self.final = np.array(inner, np.int32), np.array(final, np.int32)
        rows = [n for n, c in enumerate(children) if c]
        self.row = np.full(len(children), 256 * len(rows), np.int64)  # the last row has no child
        self.row[rows] = 256 * np.arange(len(rows))
        table = np.full((len(rows) + 1, 256), -1, np.int32)
        for k, n in enumerate(rows):
            table[k, list(children[n])] = list(children[n].values())
        self.next = table.ravel()
        self._forget()

    def _forget(self) -> None:
        self.known = np.full(self.SLOTS, -1, np.int64)  # twice the key, plus one where the arc is open
        self.filled = 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or of the empty slot where it belongs, and what the slot holds."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        held = self.known[slot]
        wrong = np.flatnonzero((held >> 1 != keys) & (held >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.SLOTS - 1)
            held[wrong] = again = self.known[slot[wrong]]
            wrong = wrong[(again >> 1 != keys[wrong]) & (again >= 0)]
        return slot, held

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with the label."""
        keys = states.astype(np.int64) << 20 | labels
        held = self._find(keys)[1]
        absent = held < 0
        if absent.any():
            new = np.unique(keys[absent])
            if self.filled + len(new) > self.SLOTS // 2:
                self._forget()
                new = np.unique(keys)
            for key in new.tolist():
                at = key * 0x9E3779B97F4A7C15 % (1 << 64) >> 44
                while self.known[at] >= 0:
                    at = (at + 1) & (self.SLOTS - 1)
                self.known[at] = key << 1 | self.automaton.arc(key >> 20, key & 0xFFFFF)
            self.filled += len(new)
            held = self._find(keys)[1]
        return (held & 1).astype(bool)

    def _read(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in the rows of ``text``, the longest first: an array filled from the right, and where each row begins.

        What stands in a row after its word is not read.
        """
        longest = text.shape[1]
        wide = longest + 1
        base = np.arange(len(text)) * wide
        last = np.full(len(text) * wide, -1, np.int32)  # by cell: a row and how many of its bytes are read
        came = np.repeat(base, wide)  # the cell where the last token of a cell begins
        columns = np.ascontiguousarray(text.T)
        word = cell = node = np.empty(0, np.int64)
        for i in range(1, longest + 1):
            ending, live = (int(np.searchsorted(-size, -i, side)) for side in ("left", "right"))
            keep = word < live  # those still being read are a prefix
            word = np.concatenate([word[keep], np.arange(live)])
            cell = np.concatenate([cell[keep], base[:live] + (i - 1)])
            node = np.concatenate([node[keep], np.zeros(live, np.int64)])
            node = self.next[self.row[node] + columns[i - 1][word]]
            some = np.flatnonzero(node >= 0)
            word, cell, node = word[some], cell[some], node[some].astype(np.int64)
            label = self.inner[node]
            if ending < live:
                whole = np.flatnonzero(word >= ending)
                label[whole] = self.final[node[whole]]
            some = np.flatnonzero(label >= 0)
            label, origin, row = label[some], cell[some], base[word[some]]
            state = last[origin]
            good = origin == row
            inside = np.flatnonzero(state >= 0)
            good[inside] = self.arcs(state[inside], label[inside])
            last[row[good] + i], came[row[good] + i] = label[good], origin[good]
        ids = np.zeros((len(text), longest), "<u4")
        at, fill, rows = base + size, np.full(len(text), longest, np.int64), np.arange(len(text))
        while len(rows):
            fill[rows] -= 1
            ids[rows, fill[rows]] = last[at]
            at = came[at]
            more = np.flatnonzero(at != base[rows])
            rows, at = rows[more], at[more]
        return ids, fill

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-split words, as little-endian unsigned 32-bit integers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        longest = int(size[order[0]])
        text = np.frombuffer(b"".join(words[k].ljust(longest, b"\0") for k in order.tolist()), np.uint8).reshape(-1, longest)
        ids, fill = self._read(text, size[order])
        flat, out = ids.tobytes(), [b""] * len(words)
        for k, row, first in zip(order.tolist(), range(0, 4 * ids.size, 4 * longest), fill.tolist()):
            out[k] = flat[row + 4 * first : row + 4 * longest]
        return out

    def encode_flat(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words at ``begin`` in ``data`` (none empty) one after another, where each word's begin, their number.

        ``data`` goes on for the longest word's size behind the last word.
        """
        order = np.argsort(-size, kind="stable")
        first, count, flat, held = np.empty(len(size), np.int64), np.empty(len(size), np.int64), [], 0
        for part in np.array_split(order, len(order) // 20_000 + 1) if len(order) else []:
            longest = int(size[part[0]])
            ids, fill = self._read(data[begin[part, None] + np.arange(longest)], size[part])
            flat.append(ids[np.arange(longest) >= fill[:, None]])
            count[part] = n = longest - fill
            first[part] = held + np.cumsum(n) - n
            held += len(flat[-1])
        return np.concatenate(flat) if flat else np.empty(0, "<u4"), first, count


class Words:
    """Ids of words met before, in arrays: words of up to ``WIDE`` bytes are found again by a hash of their bytes."""

    WIDE = 31
    _MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.count, self.bits = 0, 16
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((0, 4), np.uint64)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(0, "<u4"), 0

    def keys_of(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes and size of each word as four numbers; ``data`` goes on for 32 bytes behind the last word."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        keys = np.empty((len(size), 4), np.uint64)
        for k in range(4):
            keys[:, k] = eight[begin + 8 * k] & self._MASK[np.clip(size - 8 * k, 0, 8)]
        keys[:, 3] |= size.astype(np.uint64) << np.uint64(56)
        return keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * self._MIX[0]
        for k in range(1, 4):
            h += keys[:, k] * self._MIX[k]
        return (((h ^ h >> np.uint64(32)) * self._MIX[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not met."""
        slot = self._slot(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero(found >= 0)
        while True:
            wrong = wrong[(self.keys[found[wrong]] != keys[wrong]).any(1)]
            if not len(wrong):
                return found
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[found[wrong] >= 0]

    def _link(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.keys[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of those that meet in a slot one stays
            rest = np.flatnonzero(self.slots[slot] != numbers)
            numbers, slot = numbers[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Numbers of new words with their ids; those not ``short`` are not found again."""
        numbers = np.arange(self.count, self.count + len(keys))
        self.keys, self.first, self.size = (_room(x, self.count + len(keys)) for x in (self.keys, self.first, self.size))
        self.ids = _room(self.ids, self.used + len(ids))
        self.keys[numbers], self.first[numbers], self.size[numbers] = keys, self.used + first, size
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = self.count + len(keys), self.used + len(ids)
        if 2 * self.count > len(self.slots):
            old = self.slots[self.slots >= 0]
            self.bits = int(4 * self.count).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._link(old)
        self._link(numbers[short])
        return numbers


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` rows and as many again."""
    if size <= len(array):
        return array
    out = np.empty((2 * size, *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


class Codec:
    """A tokenizer file with word ends, NFC, lower case and dropped white space, as ids and back."""

    #: Words up to this many bytes are read together as rows of one array, longer ones one by one.
    LONG = 64

    def __init__(self, text: str, memo: int = 300_000, block: int = 2_000_000) -> None:
        """``memo``: words kept before a worker starts anew; ``block``: characters whose words are encoded together."""
        spec = json.loads(text)
        model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (
            steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model["end_of_word_suffix"]
            or level["type"] != "ByteLevel" or not split["invert"] or spec["decoder"] or model["unk_token"]
        ):
            raise ValueError("not a word-end BPE file of the supported kind")
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.alphabet = byte_alphabet()
        self.tables = Tables(self.automaton, self.alphabet)
        self.labels = self.automaton.labels
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = content
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.memo, self.block = memo, block
        self._chunks: dict[str, bytes] = {}
        self._words = Words()

    def _split(self, text: str) -> list[str]:
        """Normalised text cut at white space; no pre-split word crosses such a cut."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter, no final sigma
        return [c for c in _SPACES.split(text) if c] if any(c in text for c in _CONTROLS) else text.split()

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks not met before: their distinct pre-split words together, then the chunks from them."""
        own = self._chunks
        whole = [c for c in chunks if c.isalpha()]
        cut = {}
        for c in chunks.difference(whole):
            # The common case, a word and one mark after it, needs no pattern: letters are one word, a mark is another.
            cut[c] = [c[:-1], c[-1]] if c[-1] in _MARKS and c[:-1].isalpha() else self.words.findall(c)
        words = whole + list({w for ws in cut.values() for w in ws}.difference(own, whole))
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        by_size = np.argsort(size, kind="stable")
        by_size = by_size[: np.searchsorted(size[by_size], self.LONG, "right")]
        for part in np.array_split(by_size, len(by_size) // 20_000 + 1):
            some = part.tolist()
            if some:
                own.update(zip([words[k] for k in some], self.tables.encode([raw[k] for k in some]), strict=True))
        for k in np.flatnonzero(size > self.LONG).tolist():
            ids = self.automaton.encode("".join(self.alphabet[x] for x in raw[k]))
            own[words[k]] = np.array(ids, "<u4").tobytes()
        own.update([(c, b"".join([own[w] for w in ws])) for c, ws in cut.items()])

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if len(self._chunks) > self.memo:
            self._chunks.clear()
        cut = [self._split(t) for t in texts]
        found = [list(map(self._chunks.get, chunks)) for chunks in cut]
        gaps = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        if new := {chunks[i] for chunks, own in zip(cut, gaps) for i in own}:
            self._learn(new)
            for chunks, own, ids in zip(cut, gaps, found):
                for i in own:
                    ids[i] = self._chunks[chunks[i]]
        return list(map(b"".join, found))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        collecting = gc.isenabled()
        gc.disable()  # many lists of strings and no cycles: walking through them again and again would cost a fifth
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        parts: list[str] = []
        plan: list[list[int | bytes]] = []  # of each text: places in parts, or the bytes of a special token
        held = 0

        def flush() -> None:
            done = self._encode_plain(parts)
            out.extend(b"".join(x if isinstance(x, bytes) else done[x] for x in own) for own in plan)
            parts.clear()
            plan.clear()

        for text in texts:
            marked = text and any(m in text for m in self.special)
            pieces = self.marks.split(text) if marked else [text or ""]
            own: list[int | bytes] = []
            for i, piece in enumerate(pieces):
                if i % 2:
                    own.append(np.array([self.special[piece]], "<u4").tobytes())
                else:
                    own.append(len(parts))
                    parts.append(piece)
            plan.append(own)
            held += len(text or "")
            if held >= self.block:
                flush()
                held = 0
        flush()
        return out

    def _places(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the ids of ``_words`` those of each distinct word begin, and their number; new words are encoded."""
        own, store = self._chunks, self._words
        begin = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size, begin = np.diff(begin), begin[:-1]
        raw = words.buffers()[2]
        data = np.r_[np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8), np.zeros(max(self.LONG, 32), np.uint8)]
        short = size <= store.WIDE
        keys = np.zeros((len(words), 4), np.uint64)
        keys[short] = store.keys_of(data, begin[short], size[short])
        found = np.full(len(words), -1, np.int32)
        found[short] = store.find(keys[short])
        new = np.flatnonzero(found < 0)
        if len(new):
            text = words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
            plain = np.fromiter(map(str.isalpha, text), bool, len(text)) & (size[new] <= self.LONG)
            ids, first, count = self.tables.encode_flat(data, begin[new[plain]], size[new[plain]])
            rest = [text[k] for k in np.flatnonzero(~plain).tolist()]
            if unknown := set(rest).difference(own, [""]):
                self._learn(unknown)
            other = [own[w] if w else b"" for w in rest]
            n = np.fromiter(map(len, other), np.int64, len(rest)) // 4
            at, many = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
            at[plain], many[plain] = first, count
            at[~plain], many[~plain] = len(ids) + np.cumsum(n) - n, n
            found[new] = store.add(keys[new], np.r_[ids, np.frombuffer(b"".join(other), "<u4")], at, many, short[new])
        return store.first[found], store.size[found].astype(np.int64)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more number at the end).

        The words of the texts are cut and numbered in Arrow, so Python meets each distinct word once a call.
        """
        for kept, held in ((self._chunks, len(self._chunks)), (self._words, self._words.count)):
            if held > self.memo:
                kept.clear()
        fast, slow, plain = [], {}, []
        for i, text in enumerate(texts):
            if text and (any(m in text for m in self.special) or any(c in text for c in _CONTROLS)):
                slow[i] = np.frombuffer(self.encode([text])[0], "<u4")
            elif text:
                if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                fast.append(i)
                plain.append(text.replace("Σ", "σ").lower())
        # A letter ends a pre-split word before marks, so the marks may stand alone: fewer distinct words.
        cut = pc.replace_substring_regex(pa.array(plain, pa.large_string()), pattern=r"(\pL)([!-/:-@\[-`{-~]+)(\s|$)", replacement=r"\1 \2\3")
        cut = pc.utf8_split_whitespace(cut)
        words = cut.flatten().dictionary_encode()
        first, size = self._places(words.dictionary)
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.r_[0, np.cumsum(n)]
        place = np.repeat(first[at] - ends[:-1], n)
        place += np.arange(ends[-1])
        flat = self._words.ids[place]
        lists = cut.offsets.to_numpy().astype(np.int64)
        of_fast = ends[lists - lists[0]] if len(fast) else np.zeros(1, np.int64)
        length = np.zeros(len(texts), np.int64)
        length[fast] = np.diff(of_fast)
        if slow:
            length[list(slow)] = [len(v) for v in slow.values()]
            begin = np.r_[0, np.cumsum(length)]
            out = np.empty(begin[-1], "<u4")
            inside = np.ones(len(out), bool)
            for i, v in slow.items():
                out[begin[i] : begin[i + 1]] = v
                inside[begin[i] : begin[i + 1]] = False
            out[inside] = flat
            return out, begin
        return flat, np.r_[0, np.cumsum(length)]

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, joined by blanks: the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(text: str, memo: int = 300_000) -> Codec:
    """One compiled codec per worker process."""
    return Codec(text, memo)


def forget() -> None:
    codec.cache_clear()


HELD.append(forget)


def encode_column(df: DataFrame, tokenizer: str, source: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit) and, if named, the ``decoded`` text made from these ids.

    ``tokenizer`` is the path of the vocabulary file; its content (a fixed few MB) travels with the tasks.  Whole texts;
    a null or empty text has no ids and decodes to the empty text.  Columns of those names are replaced, others kept.
    A row is one unit of work, so nothing is shuffled; equal words are encoded once per worker (bounded memo).
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    added = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def make():
        own = codec(spec.value)

        def columns(texts: list) -> dict[str, pa.Array]:
            found = own.encode(texts)
            out = {ids: pa.array(found, pa.binary())}
            if decoded:
                out[decoded] = pa.array(list(map(own.decode, found)), pa.string())
            return out

        return columns

    return add_columns(df, source, make, T.StructType(added), kept_by=__name__)
