"""Encoding, decoding and counting against the library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from viewlens.llm import bpe, registry, token_counts
from viewlens.llm.tables import load

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "Zz", "é", "É", "ﬁ", "İ", "Σ", "ΑΣ", "'", "'s", "'LL", "9", "½", "Ⅷ", " ", "  ", "\t", "\n", "\x1c", "\x85", "　", "​", "-", "!!", "𝄞", "漢字", "é", "क़", "<|endoftext|>", "<|endo", "|>", "\x00", "՘", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)]
    return [*texts, "", "a" * 3000, "ab" * 2500, "-" * 4000, "word " * 4000, "<|endoftext|>" * 300]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_queries_equal_the_library_on_whole_tables(spark, library, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    texts = {r[0]: r[1] or "" for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    ids = dict(zip(texts, (e.ids for e in library.encode_batch(list(texts.values()), add_special_tokens=False))))
    counts = registry.op8_token_counts(spark, sf_dir).collect()
    assert len(counts) == len(texts)
    for r in counts:
        n = len(ids[r["doc_id"]])
        assert tuple(r)[1:4] == (len(texts[r["doc_id"]].encode()), n, n > 2048)
        # each text longer than a chunk is spliced, and no other
        assert (r["n_splices"] > 0) == (len(texts[r["doc_id"]]) > token_counts.CHUNK_CHARS)
    assert any(r["n_splices"] for r in counts)
    digests = registry.op9_bpe(spark, sf_dir).collect()
    assert len(digests) == len(texts)
    for r in digests:
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in own)).hexdigest()
        decoded = library.decode(own, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_texts_round_trip(spark, library):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Token_IDs", F.lit("old")).withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    none = df.limit(0)
    assert bpe.decode(bpe.encode(none, PATH), PATH).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (200, 150), (5000, 100), (1 << 16, 1 << 10)])
def test_spliced_counts_equal_whole_ones(spark, library, chunk, overlap):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("N_TOKENS", F.lit("old"))
    for r in token_counts.count_tokens(df, PATH, chunk_chars=chunk, overlap_chars=overlap).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_overlaps_without_a_boundary_are_widened(library):
    counter = token_counts.TokenCounter(open(PATH, "rb").read(), 100, 10)
    spaced, glued = "ab cd ef " * 100, ("x" * 30 + " ") * 20 + "y" * 500
    (n, splices, widened), (m, _, more) = counter.count([spaced, glued])
    assert n == len(library.encode(spaced, add_special_tokens=False).ids) and splices == 8 and not widened
    assert m == len(library.encode(glued, add_special_tokens=False).ids) and more > 3


class Recorded:
    """The library, with the characters that it encodes."""

    def __init__(self, library):
        self._library, self.placed, self.batched = library, 0, 0

    def encode(self, text, **named):
        self.placed += len(text)
        return self._library.encode(text, **named)

    def encode_batch_fast(self, texts, **named):
        self.batched += sum(map(len, texts))
        return self._library.encode_batch_fast(texts, **named)


def test_long_texts_are_encoded_only_where_chunks_overlap(library):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 12))) + rng.choice([" ", " ", ", ", ".\n"]) for _ in range(9000)]
    text = "".join(words)
    counter = token_counts.TokenCounter(open(PATH, "rb").read(), token_counts.CHUNK_CHARS, token_counts.OVERLAP_CHARS)
    counter._tokenizer = Recorded(counter._tokenizer)
    (n, splices, widened), (m, _, _) = counter.count([text, text[:5000]])
    assert n == len(library.encode(text, add_special_tokens=False).ids)
    assert m == len(library.encode(text[:5000], add_special_tokens=False).ids)
    assert splices == (len(text) - 1) // token_counts.CHUNK_CHARS > 5 and widened == 0
    # both sides of an overlap, each with as much beside it; words of letters go to the model
    assert counter._tokenizer.placed == 4 * token_counts.OVERLAP_CHARS * splices < len(text) / 6
    assert counter._tokenizer.batched == 0


def test_words_of_letters_equal_the_library(library):
    letters = [c for c in map(chr, range(0x32000)) if c.isalpha()][::7]
    texts = [form % c for c in letters for form in ("%s", "a%sB.", "É%s'S", "%s\u0301!", "x %s, y")]
    counter = token_counts.TokenCounter(open(PATH, "rb").read(), 100, 10)
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [n for n, _, _ in counter.count(texts)] == want
    assert [n for n, _, _ in counter.count(texts)] == want  # remembered


def test_pieces_of_any_length_and_forgetting_keep_counts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    monkeypatch.setattr(token_counts, "REMEMBERED_CHARS", 6)
    rng = random.Random(8)
    pieces = ["abcdef", "abcdef.", "abcdefg", "abcdefg.", "abcdefg,", "été", "été!", "..", "...", "a.b", "straßenbahnen;", "--."]
    texts = [" ".join(rng.choices([*pieces, *map(str, range(40))], k=30)) for _ in range(200)]
    counter = token_counts.TokenCounter(open(PATH, "rb").read(), 100, 10)
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [n for n, _, _ in counter.count(texts)] == want
    assert all(len(x) <= 6 for x in counter._known)


@pytest.mark.parametrize("change", ["special", "prefix", "order", "normal"])
def test_words_that_the_model_sees_otherwise_are_encoded(change):
    spec = json.load(open(PATH))
    assert token_counts.spells_letters(spec)
    splitters = spec["pre_tokenizer"]["pretokenizers"]
    if change == "special":
        spec["added_tokens"][0]["content"] = "the"
    elif change == "prefix":
        splitters[1]["add_prefix_space"] = True
    elif change == "order":
        splitters[0]["pattern"]["Regex"] = "th|" + splitters[0]["pattern"]["Regex"]
    else:
        spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "e"}, "content": "ai"})
    model = json.dumps(spec).encode()
    assert not token_counts.spells_letters(spec)
    whole = Tokenizer.from_buffer(model)
    texts = ["the other thethe", "Eve", "weather bathes", ""]
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for n, _, _ in token_counts.TokenCounter(model, 100, 10).count(texts)] == want


def test_other_splitters_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_counts.splits_at_space(json.load(open(path)))
    whole = Tokenizer.from_file(path)
    rows = [(1, "some  words\n\nand more " * 50), (2, None)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), path, chunk_chars=50).collect()
    assert [r["n_tokens"] for r in got] == [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows]


def test_occurrences_merge_one_by_one_where_order_could_matter(library):
    model = bpe.WordBpe(open(PATH, "rb").read())
    words = [w.encode() for w in ("aaaaaaa", "banana", "mississippi", "éé", "xyxyxyxyx")]
    at_once = model.merge(words)
    model._all_at_once = False
    one_by_one = model.merge(words)
    assert [x.tolist() for x in at_once] == [x.tolist() for x in one_by_one]
