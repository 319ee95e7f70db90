"""Token counts, with huge texts encoded in overlapping chunks.

A chunk of a huge text overlaps the next one, which begins some way before its end. Where they
overlap both are encoded with offsets, each with as much again of its own text beside it; they are
spliced at a boundary that is proven stable: white space, which the model's splitter drops, which
no normaliser joins with a neighbour, and which no special token holds, so nothing to its left
changes the tokens to its right. The tokens between the overlap's first and last such boundary must
agree in both encodings. If there are no two boundaries, or the tokens disagree, the overlap is
widened; once it reaches back to the last splice, the chunk itself grows. A text without any white
space so becomes one chunk.

Between its overlaps a chunk is counted by the same boundaries, and so are texts no longer than
one: the library counts each distinct piece between white space once, and it is remembered. It
takes several times as long to encode a word as its model takes to merge the word's symbols, so
words that are nothing but letters go to the model directly.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Encoding

from viewlens.llm.bpe import _schema, byte_symbols, read_model
from viewlens.llm.tables import appended, pieces, without

#: Characters in a chunk, which a huge text is longer than, and in the first overlap tried. Counts
#: don't depend on them.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 13, 1 << 8
#: Chunks between white space that a worker remembers before it starts afresh, and the longest.
#: At most about 100 MB; results don't depend on it.
REMEMBERED, REMEMBERED_CHARS = 800_000, 64
#: Unicode's white space; ASCII's separators 1C to 1F don't count to the model.
_SPACE = re.compile(r"[^\S\x1c-\x1f]")


class TokenCounter:
    def __init__(self, model: bytes, chunk_chars: int, overlap_chars: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_buffer(model)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._chunk, self._overlap = chunk_chars, overlap_chars
        self._known: dict[str, int] = {}
        spec = json.loads(model)
        self._by_space, self._spells = splits_at_space(spec), spells_letters(spec)
        self._normal, self._merged = self._tokenizer.normalizer, self._tokenizer.model.tokenize
        self._marks = dict(zip(_MARKS, self._encoded_counts([*_MARKS])))

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Of each text its tokens, the splices that its chunks took, and how often an overlap, or
        the chunk itself, was widened for them."""
        if not self._by_space:
            return [(n, 0, 0) for n in self._encoded_counts(texts)]
        return [self._huge(t) if len(t) > self._chunk else (self._between(t), 0, 0) for t in texts]

    def _encoded_counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _between(self, text: str) -> int:
        """Tokens of a text, or of a part of one between two boundaries, by its pieces."""
        parts = _SPACE.split(text) if _ODD.search(text) else text.split()
        if len(self._known) > REMEMBERED:
            self._known = {}
        new = set(parts).difference(self._known)
        if new:
            self._learn(new)
        total = sum(map(self._known.__getitem__, parts))
        for x in new:
            if len(x) > REMEMBERED_CHARS:
                del self._known[x]
        return total

    def _learn(self, new: set[str]) -> None:
        known, others = self._known, []
        for x in new:
            # letters with one mark after them are two words to the splitter
            mark = x[-1:] if x[-1:] in self._marks else ""
            word = x[:-1] if mark else x
            if not _letters(word):
                others.append(x)
                continue
            n = known.get(word)
            if n is None:
                n = self._of_letters(word)
                if len(word) <= REMEMBERED_CHARS:
                    known[word] = n
            known[x] = n + self._marks[mark] if mark else n
        known.update(zip(others, self._encoded_counts(others)))

    def _of_letters(self, word: str) -> int:
        """Tokens of a word that is nothing but letters to the model."""
        if not self._spells:
            return self._encoded_counts([word])[0]
        if word.isascii():
            return len(self._merged(word.lower()))
        normal = self._normal.normalize_str(word)
        if not normal.isalpha():
            return self._encoded_counts([word])[0]
        return len(self._merged(normal.encode().decode("latin-1").translate(_SYMBOLS)))

    def _encoded(self, text: str, start: int, end: int) -> tuple[int, Encoding, list[int]]:
        """Where a part of a chunk starts, its encoding, and its ids."""
        chunk = self._tokenizer.encode(text[start:end], add_special_tokens=False)
        return start, chunk, chunk.ids

    def _splice(self, text: str, counted: int, start: int, end: int) -> tuple[int, int, int] | None:
        """The overlap's first boundary, the last, up to which the left chunk counts and from which
        the right one does, and the tokens between them."""
        spaces = [m.start() for m in _SPACE.finditer(text, start + 1, end)]
        if len(spaces) < 2:
            return None
        left = self._encoded(text, max(counted, 2 * start - end), end)
        right = self._encoded(text, start, 2 * end - start)
        inside = [(tokens_before(chunk, spaces[0]), tokens_before(chunk, spaces[-1])) for chunk in (left, right)]
        (a, b), (c, d) = inside
        # equal ids at equal offsets
        agree = a < b and left[2][a:b] == right[2][c:d]
        agree = agree and all(span(left, a + k) == span(right, c + k) for k in range(b - a))
        return (spaces[0], spaces[-1], b - a) if agree else None

    def _huge(self, text: str) -> tuple[int, int, int]:
        total, splices, widened = 0, 0, 0
        counted, end = 0, self._chunk
        while end < len(text):
            overlap, found = self._overlap, None
            while found is None and end - overlap > counted:
                found = self._splice(text, counted, end - overlap, end)
                overlap *= 2
                widened += found is None
            if found is None:  # no boundary since the last splice
                widened += 1
                end += end - counted
                continue
            first, last, tokens = found
            total += self._between(text[counted:first]) + tokens
            splices += 1
            counted, end = last, end + self._chunk
        return total + self._between(text[counted:]), splices, widened


def span(chunk: tuple[int, Encoding, list[int]], token: int) -> tuple[int, int]:
    """First and last offset in the text of a chunk's token."""
    start, encoding, _ = chunk
    first, last = encoding.token_to_chars(token)
    return start + first, start + last


def tokens_before(chunk: tuple[int, Encoding, list[int]], at: int) -> int:
    """How many of a chunk's tokens begin before ``at``, a place in the text; they are in order."""
    low, high = 0, len(chunk[2])
    while low < high:
        middle = (low + high) // 2
        if span(chunk, middle)[0] < at:
            low = middle + 1
        else:
            high = middle
    return low


#: Never part of a word, nor of a contraction.
_MARKS = tuple(".,;:!?")
_ODD = re.compile("[\x1c-\x1f]")
#: The symbol of each byte.
_SYMBOLS = dict(enumerate(byte_symbols()))


def _letters(word: str) -> bool:
    """Whether the model sees nothing but letters."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def splits_at_space(spec: dict) -> bool:
    """Whether white space is dropped between words and is a boundary whatever stands beside it:
    the splitter keeps only what its pattern finds, which are runs of letters and runs of other
    characters, none with white space in it, and no special token holds or takes white space."""
    splitter = spec.get("pre_tokenizer") or {}
    first = (splitter.get("pretokenizers") or [splitter])[0]
    plain = all(
        not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"]
    )
    dropped = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    pattern = first.get("pattern", {}).get("Regex", "")
    letters = r"[\p{L}]+|" in pattern and r"|[^\s\p{L}\p{N}]+" in pattern
    return plain and bool(dropped) and letters and not re.search(r"(?<!\^)\\s|(?<!\\)\.| ", pattern)


def spells_letters(spec: dict) -> bool:
    """Whether a word of letters alone, once normalised, goes to the model as its bytes' symbols:
    the splitter finds it whole, as nothing in its pattern comes before runs of letters but what
    begins with an apostrophe, no special token is in it, and what the normalisers do to ASCII
    letters is lower case."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal])
    lowered = [s.get("type") for s in steps if s.get("pattern") != {"Regex": r"\s+"}] == ["NFC", "Lowercase"]
    splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in splitters] != ["Split", "ByteLevel"] or not splits_at_space(spec):
        return False
    before = splitters[0]["pattern"]["Regex"].partition(r"[\p{L}]+|")[0].split("|")[:-1]
    spelled = not splitters[1]["add_prefix_space"] and not splitters[1]["use_regex"]
    specials = any(t["content"].isalpha() for t in spec["added_tokens"])
    return lowered and spelled and not specials and all(re.fullmatch("'[a-z]+", x) for x in before)


ADDED = ("n_tokens", "n_splices", "n_widened")
_loaded: dict[tuple, TokenCounter] = {}


def count_batches(batches: Iterator[pa.RecordBatch], text_col: str, model, *sizes: int) -> Iterator[pa.RecordBatch]:
    name = (hashlib.sha256(model.value).hexdigest(), *sizes)
    if name not in _loaded:
        _loaded[name] = TokenCounter(model.value, *sizes)
    for batch in pieces(batches, text_col):
        counts = _loaded[name].count([t or "" for t in batch.column(text_col).to_pylist()])
        yield appended(batch, **{n: pa.array(x, pa.int64()) for n, x in zip(ADDED, zip(*counts))})


def count_tokens(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``df`` with ``n_tokens``, as the library gives them without special tokens added, and with
    ``n_splices`` and ``n_widened``, 0 for texts of one chunk (bigint).

    A null text counts as empty: 0. Every row is counted by itself, so repeated rows and null or
    repeated ids don't matter. Columns named as an added one are replaced. A model whose splitter
    keeps white space has no boundaries proven here, and its texts are encoded whole.
    """
    df, model = without(df, *ADDED), read_model(df.sparkSession, path)
    return df.mapInArrow(
        lambda batches: count_batches(batches, text_col, model, chunk_chars, overlap_chars),
        _schema(df, ", ".join(f"{c} bigint" for c in ADDED)),
    )
