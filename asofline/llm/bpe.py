"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of an Arrow batch form a trie.  It is held in its depth-first layout: the sorted
words, each with the length of the prefix that it shares with the word before it.  Every trie node
carries one *last-token state*: the token that ends the encoding of the prefix the node spells.  A
token fits a node when it is a suffix of the prefix and is compatible with the state of the node it
starts from; exactly one does.  The walk keeps the states of the current path, so a prefix that many
words share is encoded once, and a word's ids are read back along its states.

Defined results: a null text is an empty text and has no tokens; equal texts have equal rows; repeated
rows stay, and so do rows with a null id; an empty table has no rows; columns of the input other than the id and the
text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached_by, in_tasks

#: Distinct chunks of text whose encodings a Python worker keeps; beyond it the cache starts anew with the batch's own.
CACHE_WORDS = 400_000
#: Last bytes of a prefix by which the lengths of the tokens that can end it are looked up.
TAIL = 4


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class TrieBpe:
    """Encoder of a vocabulary file with byte symbols and a suffix on the last symbol of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in _byte_symbols().items()}
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for text, i in model["vocab"].items():
            ends = text.endswith(self.suffix) and len(text) > len(self.suffix)
            raw = bytes(byte_of[c] for c in (text[: -len(self.suffix)] if ends else text))
            (self.final if ends else self.inner)[raw] = i
            self.symbols[i] = (*raw[:-1], raw[-1] + 256 * ends)
        self.unit = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        self.long: tuple[dict[bytes, set[int]], ...] = ({}, {})
        for table, long in zip((self.inner, self.final), self.long):
            for token in table:
                if len(token) > TAIL:
                    long.setdefault(token[-TAIL:], set()).add(len(token))
        self.tails: dict[tuple[bytes, bool], tuple[int, ...]] = {}
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.fits: dict[tuple[int, int], bool] = {}
        #: Encodings of chunks: ids as bytes, and the decoded tokens with a blank after each.
        self.kept = {"": (b"", "")} | {t: (array("I", [i]).tobytes(), t + " ") for t, i in self.special.items()}
        self.cache = dict(self.kept)

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain BPE of a few symbols: the merge of lowest rank first, from the left."""
        ids = [self.unit[s] for s in symbols]
        while len(ids) > 1:
            best = min((self.rank[p] + (k,) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            at = best[2]
            ids[at : at + 2] = [best[1]]
        return ids

    def compatible(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart when their symbols are encoded together; before: -1 at a word's start."""
        known = self.fits.get((before, token))
        if known is None:
            head = self.symbols[before] if before >= 0 else ()
            known = self.merged(head + self.symbols[token]) == ([before] if before >= 0 else []) + [token]
            if len(self.fits) > 4 * CACHE_WORDS:
                self.fits.clear()
            self.fits[before, token] = known
        return known

    def lengths(self, tail: bytes, of: dict[bytes, int]) -> tuple[int, ...]:
        """Lengths, the longest first, of the tokens that can end with the last bytes of a prefix."""
        known = self.tails.get((tail, of is self.final))
        if known is None:
            found = {len(tail) - k for k in range(len(tail)) if tail[k:] in of}
            if len(tail) == TAIL:
                found |= self.long[of is self.final].get(tail, set())
            known = self.tails[tail, of is self.final] = tuple(sorted(found, reverse=True))
        return known

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the sorted distinct words: the depth-first walk over their trie."""
        inner, final, compatible, fits, tails, lengths = self.inner, self.final, self.compatible, self.fits, self.tails, self.lengths
        last, size = [-1], [0]
        before = b""
        for word in words:
            n = len(word)
            shared, most = 0, min(len(before), n - 1, len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, n):
                tail = word[end - TAIL if end > TAIL else 0 : end]
                for length in tails.get((tail, False)) or lengths(tail, inner):
                    if length <= end and (token := inner.get(word[end - length : end])) is not None:
                        state = last[end - length]
                        ok = fits.get((state, token))
                        if ok or ok is None and compatible(state, token):
                            last.append(token)
                            size.append(length)
                            break
            tail = word[-TAIL:]
            for length in tails.get((tail, True)) or lengths(tail, final):
                if length <= n and (token := final.get(word[n - length :])) is not None:
                    ok = fits.get((last[n - length], token))
                    if ok or ok is None and compatible(last[n - length], token):
                        break
            ids, at = [token], n - length
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            yield ids
            before = word

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks of text without white space: their words go through one trie."""
        split = {c: [c.lower()] if c.isascii() and c.isalpha() else self.split(c) for c in chunks}  # plain letters are one word
        distinct = sorted({w.encode() for words in split.values() for w in words})
        packed = {}
        text_of = self.text_of
        for word, ids in zip(distinct, self.walk(distinct)):
            packed[word.decode()] = (array("I", ids).tobytes(), "".join([text_of[i] + " " for i in ids]))
        for chunk, words in split.items():
            if len(words) == 1:
                self.cache[chunk] = packed[words[0]]
            else:
                found = [packed[w] for w in words]
                self.cache[chunk] = (b"".join([f[0] for f in found]), "".join([f[1] for f in found]))

    def split(self, text: str) -> list[str]:
        """Words of a piece of text without special tokens, normalised as the vocabulary file asks."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case without the context of a word's end
        return self.words.findall(text.lower())

    def chunks(self, text: str | None) -> list[str]:
        """Pieces of a text that no token crosses: between blanks and line ends, special tokens by themselves."""
        if not text:
            return []
        if self.specials is not None and "<" in text:
            text = self.specials.sub(" \\1 ", text)
        return text.replace("\n", " ").split(" ")

    def batch(self, texts: list[str | None], tell: Callable[[list[tuple[bytes, str]]], object]) -> list[object]:
        """tell(the encoded chunks) of each text."""
        split = [self.chunks(t) for t in texts]
        wanted = set().union(*split)
        new = wanted - self.cache.keys()
        if new:
            if len(self.cache) + len(new) > CACHE_WORDS:  # starts anew with all that this batch needs, however much that is
                self.cache = dict(self.kept)
                new = wanted - self.cache.keys()
            self.learn(new)
        get = self.cache.__getitem__
        return [tell([*map(get, chunks)]) for chunks in split]


@lru_cache(2)
def encoder(path: str) -> TrieBpe:
    """One encoder for each Python worker."""
    return TrieBpe(path)


def ids_of(encoded: list[tuple[bytes, str]]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join([e[0] for e in encoded])


def forget() -> None:
    encoder.cache_clear()


def with_ids(docs: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """Columns of docs and ids array<int>, decoded string."""
    return _mapped(docs, path, text, [("ids", "array<int>"), ("decoded", "string")], lambda e: (list(array("I", ids_of(e))), "".join([x[1] for x in e])[:-1]))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row: op7's result."""

    def tell(encoded):
        ids = ids_of(encoded)
        decoded = "".join([e[1] for e in encoded])[:-1]  # without a decoder, tokens are joined by blanks
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs.select(key, *([text] if key != text else [])), path, text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], tell).drop(*([text] if isinstance(text, str) else []))


def _mapped(docs: DataFrame, path: str, text: str, new: list[tuple[str, str]], tell) -> DataFrame:
    names = [n for n, _ in new]
    clash = [c for c in docs.columns if c in names]
    docs = docs.drop(*clash)
    docs = docs.withColumn(text, F.col(text).cast("string"))

    def run(batches):
        cached_by("bpe", forget)
        bpe = encoder(path)
        gc.disable()  # the encoder's many small tuples hold no cycles
        try:
            for b in batches:
                column = b.column(b.schema.get_field_index(text))
                for begin in range(0, b.num_rows, 256):
                    part = b.slice(begin, 256)
                    rows = bpe.batch(column.slice(begin, 256).to_pylist(), tell)
                    cols = [pa.array([r[k] for r in rows], type=_arrow(t)) for k, (_, t) in enumerate(new)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])
        finally:
            gc.enable()  # the worker goes on to other tasks

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", {n} {t}" for n, t in new)
    return in_tasks(docs, run, schema)


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[name]
