"""BPE encoding by a depth-first walk of a trie of distinct words.

The encoding of a string is settled by its last token and the encoding of what stands before
it: a token is last exactly if it merges with nothing of its left neighbour. So one state, the
last token, suffices at each node of a trie of words, and a prefix that words share is encoded
once. The walk visits words in sorted order, which is the trie's depth-first order, and keeps
the states of the current path only.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, slices, worker_cache

END = "</w>"
#: Characters for which the tokenizer's normaliser and splitter act as PIECE and lower() do:
#: ASCII without controls, and the letters of Latin-1. Texts with any other are normalised and
#: split into words by the library; the trie encodes the words of all texts.
OTHER = re.compile("[^\t\n\r\x0b\x0c\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\\|(?:start|end)oftext\\|>")
PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+")
SPECIAL = re.compile(r"(<\|(?:start|end)oftext\|>)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes distinct words over one vocabulary, with the states shared along the trie."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        self.ranks = {(a, b): r for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges)}
        self.tokens = {i: t for t, i in vocab.items()}
        #: the length of the longest token that ends in each letter, by its mark
        self.reach: dict[str, dict[str, int]] = {"": {}, END: {}}
        for t in vocab:
            body = t.removesuffix(END)
            reach = self.reach["" if body == t else END]
            reach[body[-1:]] = max(reach.get(body[-1:], 0), len(body))
        self.letters = byte_letters()
        self.apart: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        out = list(body)
        if len(body) < len(token):
            out[-1] += END
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest rank first, leftmost on ties."""
        while len(parts) > 1:
            best = min(((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are, side by side."""
        key = (left, right)
        if (known := self.apart.get(key)) is None:
            known = self.apart[key] = self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def encode(self, words) -> dict[str, list[int]]:
        """Ids of each distinct word; a word is whole, its last letter ends it."""
        out: dict[str, list[int]] = {}
        if len(self.apart) > 400_000:
            self.apart.clear()
        vocab, apart, fits, reach = self.vocab, self.apart, self.fits, self.reach
        letters = self.letters
        spelled = sorted((w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]), w) for w in words)
        last: list[str] = [""]  # last token of each prefix of the current path
        path = ""

        def step(s: str, i: int, mark: str) -> str:
            # the last token of s[:i], with mark at its end; the longest candidate first
            for j in range(max(0, i - reach[mark].get(s[i - 1], 1)), i):
                token = s[j:i] + mark
                if token in vocab and (j == 0 or ((known := apart.get((last[j], token))) if (last[j], token) in apart else fits(last[j], token))):
                    if j == 0 and self.whole(token) is False:
                        continue
                    return token
            raise KeyError(s[:i])

        for s, word in spelled:
            n = len(s)
            common = 0
            top = min(len(path), n - 1)
            while common < top and path[common] == s[common]:
                common += 1
            del last[common + 1 :]
            for i in range(common + 1, n):
                last.append(step(s, i, ""))
            path = s[: n - 1]
            token = step(s, n, END)
            ids, i = [vocab[token]], n - len(token.removesuffix(END))
            while i > 0:
                ids.append(vocab[last[i]])
                i -= len(last[i])
            out[word] = ids[::-1]
        return out

    def whole(self, token: str) -> bool:
        """Whether a token's own letters merge to it; else it never comes out."""
        key = ("", token)
        if (known := self.apart.get(key)) is None:
            known = self.apart[key] = self.merge(self.symbols(token)) == [token]
        return known


class WordBpe:
    """A tokenizer file with word-end marks, and a bounded memory of words seen.

    keep turns (ids of words end to end, where each word ends) into one list of values a word
    for each dict of known. The memory has two generations of at most `most` words of
    `most_letters` letters in all: full, the younger one becomes the older, from which words in
    use come back. That bounds it and changes no result.
    """

    def __init__(self, content: str, keep, most: int = 200_000, most_letters: int = 4_000_000):
        data = json.loads(content)
        self.content, self._library = content, None
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in data["model"]["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.trie = TrieEncoder(data["model"]["vocab"], data["model"]["merges"])
        self.keep, self.most, self.most_letters, self.letters = keep, most, most_letters, 0
        self.known: list[dict] = [{} for _ in keep([0], [1], self.tokens)]
        self.older: list[dict] = [{} for _ in self.known]

    @property
    def library(self):
        """The tokenizer as its file has it; its normaliser and splitter serve texts with OTHER."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content)
        return self._library

    def words(self, text: str) -> list[str]:
        """The words of a text, each to be encoded for itself; an added token is one."""
        if not OTHER.search(text):
            return PIECE.findall(text.lower())
        out: list[str] = []
        for part in SPECIAL.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                out += [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of the words end to end, where each ends)."""
        ids: list[int] = []
        added = self.added
        got, cuts = self.trie.encode(w for w in words if w not in added), []
        for w in words:
            ids += got[w] if w in got else [added[w]]
            cuts.append(len(ids))
        return ids, cuts

    def _learn(self, new: set[str]) -> None:
        letters = sum(map(len, new))
        if len(self.known[0]) + len(new) > self.most or self.letters + letters > self.most_letters:
            self.letters = 0
            for i, known in enumerate(self.known):
                self.older[i], self.known[i] = known, {}
        self.letters += letters
        if self.older[0]:
            old = [w for w in new if w in self.older[0]]
            for known, older in zip(self.known, self.older):
                known.update(zip(old, map(older.__getitem__, old)))
            new = new.difference(old)
        words = sorted(new)
        for known, values in zip(self.known, self.keep(*self._encode(words), self.tokens)):
            known.update(zip(words, values))

    def values(self, texts: list[str], size: int = 500_000):
        """For each text in turn: a list of its words' values for each dict of known."""
        i = 0
        while i < len(texts):
            j, total, rows, missed = i, 0, [], set()
            known = self.known
            while j < len(texts) and (j == i or total + len(texts[j]) <= size):
                words = self.words(texts[j])
                found = [list(map(d.get, words)) for d in known]
                if None in found[0]:
                    holes = [k for k, v in enumerate(found[0]) if v is None]
                    missed.update(map(words.__getitem__, holes))
                    rows.append((found, holes, words))
                else:
                    rows.append((found, (), ()))
                total += len(texts[j])
                j += 1
            if missed:
                self._learn(missed)
            for found, holes, words in rows:
                for d, values in zip(self.known, found):
                    for k in holes:
                        values[k] = d[words[k]]
                yield found
            i = j


def tokenizer_content(path: str | None = None) -> str:
    """The tokenizer file as text, read on the driver; executors get it with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; a null or empty one has no ids.

    Rows are independent: repeated rows and ties give equal rows, and null ids pass through.
    Extra columns are not read. A text of any length is encoded whole.
    """
    return _encode(docs, path, id_col, text_col, digest=False)


def encode_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_decode in digests."""
    return _encode(docs, path, id_col, text_col, digest=True)


def _encode(docs: DataFrame, path: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    df = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_content(path))
    kind = df.schema["doc_id"].dataType.simpleString()
    name = "bpe_" + hashlib.sha256(content.value.encode()).hexdigest()[:16]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def kept(ids, cuts, tokens):
        # the library's decode joins tokens by a space where the file names no decoder
        numbers, names = list(map(str, ids)), list(map(tokens.__getitem__, ids))
        spans = list(zip([0, *cuts], cuts))
        return [" ".join(numbers[a:b]) for a, b in spans], [" ".join(names[a:b]) for a, b in spans]

    def run(batches):
        bpe = worker_cache(name, lambda: WordBpe(content.value, kept))
        for batch in slices(batches, 1, 2_000_000, keep="bpe_"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for found in bpe.values(texts):
                ids, decoded = map(" ".join, found)
                n = ids.count(" ") + 1 if ids else 0
                if digest:
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((list(map(int, ids.split())), decoded))
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return df.mapInArrow(run, schema)
