"""Token ids of many texts at once, through a table of words that are told by their bytes.

Texts of ASCII and Latin-1 letters are split by array operations, each word of up to 16 letters
is two 64-bit numbers, and a hash table of those gives its ids; the tokenizer library encodes
each word on its first sight, and whole texts with any other character.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .bpe import END, OTHER, PIECE

SPACE, LETTER, DIGIT, MARK, BAD = range(5)
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each byte as a Latin-1 character."""
    kind, low = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if OTHER.match(c):
            kind[b], low[b] = BAD, b
            continue
        low[b] = ord(c.lower())
        first = PIECE.match(c.lower())
        kind[b] = SPACE if first is None else LETTER if first[0].isalpha() else DIGIT if first[0].isdigit() else MARK
    return kind, low


KIND, LOW = _classes()
#: Keeps the first n bytes of a little-endian number.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
PAD = 24


def split_words(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each word; both arrays end in at least three spaces."""
    start = np.empty(len(kind), bool)
    start[0] = kind[0] != SPACE
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == DIGIT
    start &= kind != SPACE
    at = np.flatnonzero((low == ord("'")) & start)
    if len(at):
        # 's 't 'm 'd and 're 've 'll are words; letters behind them start anew
        a, b = low[at + 1], low[at + 2]
        two = np.isin(a, list(b"stmd"))
        three = ((b == ord("e")) & np.isin(a, list(b"rv"))) | ((a == ord("l")) & (b == ord("l")))
        start[at[two | three] + 1] = False
        for behind in (at[two] + 2, at[three] + 3):
            start[behind[kind[behind] == LETTER]] = True
    open_ = kind != SPACE
    last = open_[:-1] & (~open_[1:] | start[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(last) + 1 - starts


class WordTable:
    """Words and their ids; emptied when it holds `most` words, which changes no result."""

    def __init__(self, content: str, most: int = 500_000):
        from tokenizers import Tokenizer

        data = json.loads(content)
        self.content, self._library, self.most = content, None, most
        tokens = data["model"]["vocab"]
        if max(tokens.values()) > 0xFFFF:
            raise ValueError("ids must fit in 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith(END)]] = True
        # words come normalised and split: the same model without those two steps
        data |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.plain = Tokenizer.from_str(json.dumps(data))
        self.slots = 1 << (2 * most - 1).bit_length()
        self.clear()

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def clear(self) -> None:
        # a row: the word's two numbers, and its number plus one
        self.rows = np.zeros((self.slots, 3), np.uint64)
        self.long: dict[bytes, int] = {}
        self.count = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.used = 0

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0x9FB21C651E98DF25))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & (self.slots - 1)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        slot = self._slot(a, b)
        row = self.rows[slot]
        out = row[:, 2].astype(np.int64) - 1
        open_ = np.flatnonzero((out >= 0) & ((row[:, 0] != a) | (row[:, 1] != b)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            row = self.rows[slot[open_]]
            out[open_] = row[:, 2].astype(np.int64) - 1
            open_ = open_[(row[:, 2] > 0) & ((row[:, 0] != a[open_]) | (row[:, 1] != b[open_]))]
        return out

    def _add(self, words: list[bytes]) -> int:
        """Encodes words and gives them the next numbers; returns the first."""
        ids = []
        text = [w.decode("latin-1") for w in words]
        for i in range(0, len(text), 4000):
            for e in self.plain.encode_batch_fast([" ".join(text[j : j + 200]) for j in range(i, min(i + 4000, len(text)), 200)], add_special_tokens=False):
                ids += e.ids
        ids = np.array(ids, np.uint16)
        cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        assert len(cuts) == len(words) + 1, "a word came out in more than one piece"
        at, n = self.count, len(words)
        while at + n > len(self.first):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[at : at + n], self.size[at : at + n] = self.used + cuts[:-1], np.diff(cuts)
        self.used, self.count = self.used + len(ids), at + n
        return at

    def _learn(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b = a[new], b[new]
        spelled = np.stack([a, b], 1).astype("<u8").tobytes()
        number = np.uint64(self._add([spelled[i : i + 16].rstrip(b"\0") for i in range(0, len(spelled), 16)])) + np.arange(1, len(a) + 1, dtype=np.uint64)
        slot, left = self._slot(a, b), np.arange(len(a))
        while len(left):
            free = left[self.rows[slot[left], 2] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.rows[slot[put]] = np.stack([a[put], b[put], number[put]], 1)
            left = left[~np.isin(left, put)]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them without special tokens."""
        parts: list[bytes] = []
        whole: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            try:
                parts.append(t.encode("latin-1") if "<|" not in t or not SPECIAL.search(t) else b"\x01")
            except UnicodeEncodeError:
                parts.append(b"\x01")
        raw = np.frombuffer(b"\n".join(parts) + b"\n" * PAD, np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        kind = KIND[raw]
        if (bad := np.flatnonzero(kind == BAD)).size:
            for i in np.unique(np.searchsorted(ends, bad, "right")).tolist():
                whole[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint16)
                kind[ends[i] - len(parts[i]) - 1 : ends[i]] = SPACE
        low = LOW[raw]
        starts, sizes = split_words(low, kind)
        windows = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        a = windows[starts] & KEEP[np.minimum(sizes, 8)]
        b = windows[starts + 8] & KEEP[np.clip(sizes - 8, 0, 8)]
        short = sizes <= 16
        if self.count > self.most:
            self.clear()
        number = self._find(a, b)
        missing = np.flatnonzero((number < 0) & short)
        if len(missing):
            self._learn(a[missing], b[missing])
            number[missing] = self._find(a[missing], b[missing])
        far = np.flatnonzero(~short)
        if len(far):
            flat = low.tobytes()
            words = [flat[s : s + n] for s, n in zip(starts[far].tolist(), sizes[far].tolist())]
            if new := sorted(set(words).difference(self.long)):
                self.long.update(zip(new, range(self._add(new), self.count)))
            number[far] = [self.long[w] for w in words]
        size = self.size[number]
        through = np.cumsum(size)
        flat = self.pool[np.repeat(self.first[number] - (through - size), size) + np.arange(through[-1] if len(through) else 0)]
        words_through = np.searchsorted(starts, ends)
        cut = np.append(0, np.append(0, through)[words_through])
        return [whole[i] if i in whole else flat[cut[i] : cut[i + 1]] for i in range(len(texts))]
