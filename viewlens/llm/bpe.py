"""BPE encoding and decoding by batched merge rounds in numpy.

The model is a ``tokenizers`` file whose BPE marks word ends with a suffix, splits texts by a
pattern after NFC, white-space folding and lower-casing, and spells words in byte symbols. NFC and
lower case are Python's, whose tables are of Unicode 15.1: the few cased or composed letters that
came with Unicode 16 stay as they are.

Chunks between white space are looked up in a table that each worker fills as it goes. New
chunks are split into words, and the symbols of all new words stand in one flat array. A round
looks up every pair of neighbours by binary search over the sorted keys of the merge table,
takes the lowest rank within each word, and merges its occurrences from left to right; words
without a known pair leave. Round after round, what remains shrinks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from viewlens.llm.tables import appended, pieces, without

#: Chunks a worker remembers before it starts afresh (about 40 MB with their words). Results don't
#: depend on it.
REMEMBERED = 120_000
#: Unicode's white space, as the model's patterns mean ``\s``.
_SPACE = r"\t\n\x0b\f\r \x85\xa0  -     　"
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character by which byte-level models write each byte: itself if it prints, else the
    next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one model file."""

    def __init__(self, model: bytes):
        spec = json.loads(model)
        bpe, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = bpe["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or first["type"] != "Split" or second["type"] != "ByteLevel":
            raise ValueError("a model with other normalisers or splitters")
        self._pattern = first["pattern"]["Regex"].replace(r"\s", _SPACE)
        self._words = regex.compile(self._pattern)
        self._chunks = regex.compile(f"[^{_SPACE}]+")
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.size = size
        names = [""] * size
        for name, i in [*vocab.items(), *self.specials.items()]:
            names[i] = name
        self._names = names
        symbols = byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int64)
        self._last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        keys, merged = [], []
        for rank, (left, right) in enumerate(bpe["merges"]):
            keys.append(vocab[left] * size + vocab[right])
            merged.append(vocab[left + right])
        order = np.argsort(np.array(keys), kind="stable")
        self._keys, self._ranks = np.array(keys)[order], order.astype(np.int64)
        self._merged = np.array(merged, np.int64)
        # all occurrences of a pair can merge in one round only if no merge can bring up a
        # pair of lower rank than its own
        made = np.full(size, -1, np.int64)
        made[self._merged[::-1]] = np.arange(len(merged))[::-1]
        latest = np.full(size, -1, np.int64)
        np.maximum.at(latest, self._merged, np.arange(len(merged)))
        parts = np.maximum(latest[np.array(keys) // size], latest[np.array(keys) % size])
        self._all_at_once = bool((parts < np.arange(len(merged))).all())
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}  # of chunks
        self._tokens = np.empty(0, np.int32)
        self._ends = np.zeros(1, np.int64)
        self._word: dict[str, int] = {}
        self._word_tokens = np.empty(0, np.int32)
        self._word_ends = np.zeros(1, np.int64)

    def _rank(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that begin at ``at``."""
        after = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] * self.size + symbol[after]
        found = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        known = (self._keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(known, self._ranks[found], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self._inner[raw]
        ends = np.cumsum(sizes)
        symbol[ends - 1] = self._last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = self._rank(symbol, word, np.arange(len(symbol)))
        done_symbol, done_word = [], []
        while len(symbol):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(np.append(starts, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = lowest == _NONE
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
            merges = (rank == lowest) & ~over
            # of overlapping occurrences (a pair of equal symbols) every other one, from the left
            place = np.arange(len(merges))
            first = merges & ~np.append(False, merges[:-1])
            since = place - np.maximum.accumulate(np.where(first, place, 0))
            merges &= since % 2 == 0
            if not self._all_at_once:
                nth = np.cumsum(merges)
                merges &= nth - np.repeat(nth[starts] - merges[starts], lengths) == 1
            at = np.flatnonzero(merges)
            symbol[at] = self._merged[rank[at]]
            stays = ~over
            stays[at + 1] = False
            moved = (np.cumsum(stays) - 1)[at]
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            # only pairs with a new symbol get another rank
            anew = np.concatenate((moved, moved[moved > 0] - 1))
            rank[anew] = self._rank(symbol, word, anew)
        symbol, word = np.concatenate([*done_symbol, symbol]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _words_of(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        if not chunk.isascii() and _HAS_LATER.search(chunk):
            return _without_later(self._pattern).findall(chunk)
        return self._words.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks to the table: their words' tokens, one after another."""
        number, of_chunk, counts, new = self._word, [], [], []
        for chunk in chunks:
            words = self._words_of(chunk)
            for w in words:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    new.append(w.encode())
                of_chunk.append(n)
            counts.append(len(words))
        if new:
            tokens, sizes = self.merge(new)
            self._word_tokens = np.concatenate([self._word_tokens, tokens])
            self._word_ends = np.concatenate([self._word_ends, self._word_ends[-1] + np.cumsum(sizes)])
        out, per_word = _gather(self._word_tokens, self._word_ends, np.array(of_chunk, np.int64))
        ends = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(counts)]
        self._tokens = np.concatenate([self._tokens, out])
        self._ends = np.concatenate([self._ends, self._ends[-1] + ends])

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """A special token's id, or the chunks of what stands between special tokens."""
        for part in self._split.split(text) if "<|" in text else [text]:
            if part in self.specials:
                yield self.specials[part]
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                yield self._chunks.findall(plain) if _ODD.search(plain) else plain.split()

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        if len(self._number) > REMEMBERED:
            self._forget()
        known, new, parted = self._number, [], []
        for text in texts:
            parts: list[np.ndarray | int] = []
            for part in self._parts(text):
                if isinstance(part, list):
                    ids = list(map(known.get, part))
                    if None in ids:
                        for at, n in enumerate(ids):
                            if n is None:
                                ids[at] = n = known.setdefault(part[at], len(known))
                                if n == len(known) - 1 and n - len(self._ends) + 1 == len(new):
                                    new.append(part[at])
                    parts.append(np.array(ids, np.int64))
                else:
                    parts.append(part)
            parted.append(parts)
        if new:
            self._learn(new)
        return [
            np.concatenate(
                [
                    np.empty(0, np.int32),
                    *(
                        np.array([p], np.int32) if isinstance(p, int) else _gather(self._tokens, self._ends, p)[0]
                        for p in parts
                    ),
                ]
            )
            for parts in parted
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens as they are written in the vocabulary, joined by a space: the model names
        no decoder."""
        return " ".join(map(self._names.__getitem__, ids.tolist()))


#: Letters and numbers that ``regex`` knows and the model's library, at Unicode 16,
#: doesn't; to the model they are other characters.
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f
12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_LATER = "[" + regex.sub("[0-9a-f]+", lambda m: chr(int(m[0], 16)), LATER).replace(" ", "").replace("\n", "") + "]"
_HAS_LATER = regex.compile(_LATER)


@functools.cache
def _without_later(pattern: str) -> regex.Pattern:
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f"[{name}]", f"[{name}--{_LATER}]")
    return regex.compile(
        pattern.replace(r"\p{L}\p{N}]", f"[\\p{{L}}--{_LATER}][\\p{{N}}--{_LATER}]]"), regex.V1
    )


#: ASCII separators that ``str.split`` takes for white space and the model doesn't.
_ODD = regex.compile("[\x1c-\x1f]")


def _gather(data: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data[ends[i]:ends[i+1]]`` for each i, one after another, and their lengths."""
    sizes = ends[which + 1] - ends[which]
    skip = np.repeat(ends[which] - (np.cumsum(sizes) - sizes), sizes)
    return data[skip + np.arange(len(skip))], sizes


_loaded: dict[str, WordBpe] = {}


def of_worker(model) -> WordBpe:
    """The model, built once in each Python worker."""
    name = hashlib.sha256(model.value).hexdigest()
    if name not in _loaded:
        _loaded[name] = WordBpe(model.value)
    return _loaded[name]


def read_model(spark: SparkSession, path: str):
    """The model file, broadcast: a vocabulary file is a few MB whatever the input."""
    with open(path, "rb") as file:
        model = file.read()
    if len(model) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(model)


def encode_batches(batches: Iterator[pa.RecordBatch], text_col: str, model) -> Iterator[pa.RecordBatch]:
    """Adds ``token_ids``."""
    bpe = of_worker(model)
    for batch in pieces(batches, text_col):
        ids = bpe.encode(t or "" for t in batch.column(text_col).to_pylist())
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate(ids)
        yield appended(batch, token_ids=pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat, pa.int32())))


def decode_batches(batches: Iterator[pa.RecordBatch], ids_col: str, model) -> Iterator[pa.RecordBatch]:
    """Adds ``decoded``."""
    bpe = of_worker(model)
    for batch in batches:
        lists = batch.column(ids_col)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts = (bpe.decode(flat[a:b]) for a, b in zip(ends, ends[1:]))
        yield appended(batch, decoded=pa.array(texts, pa.string()))


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``token_ids``. A null text counts as empty and has no tokens; every row is
    encoded by itself, so repeated rows and null or repeated ids don't matter. A column named
    ``token_ids`` is replaced."""
    df, model = without(df, "token_ids"), read_model(df.sparkSession, path)
    return df.mapInArrow(lambda b: encode_batches(b, text_col, model), _schema(df, "token_ids array<int>"))


def decode(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, which replaces a column of that name. A null list decodes to an
    empty text."""
    df, model = without(df, "decoded"), read_model(df.sparkSession, path)
    return df.mapInArrow(lambda b: decode_batches(b, ids_col, model), _schema(df, "decoded string"))


def digest_batches(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of ``keep`` and digests of ``token_ids`` and ``decoded``."""
    for batch in batches:
        lists = batch.column("token_ids")
        flat, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                pa.array(np.diff(ends), pa.int64()),
                pa.array(hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])),
                pa.array(hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()),
            ],
            [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip_digests(df: DataFrame, path: str, text_col: str, keep: list[str]) -> DataFrame:
    """Encodes and decodes within one step, so that tokens and decoded texts needn't leave the
    task, and returns the columns of ``keep`` with the digests of both."""
    df, model = df.select(*keep, text_col), read_model(df.sparkSession, path)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest_batches(decode_batches(encode_batches(batches, text_col, model), "token_ids", model), keep)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.mapInArrow(through, f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
