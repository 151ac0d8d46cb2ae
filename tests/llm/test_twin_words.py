"""Long words made by swapping two letters over and over, which hashes by powers of a base cannot tell apart."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracewell.llm import decontaminate, huffman_ids, minhash_dedup, sentence_pieces, substring_dedup, token_counts
from tracewell.llm.words import Splitter, stretch_hashes
from tracewell.sources.workspace import fresh_path

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SIZES = [64, 512, 1024, 2048, 4096]


def twins(size, letters="ac"):
    word, other = letters
    while len(word) < size:
        word, other = word + other, other + word
    return word, other


def pairs():
    return [twins(size, letters) for size in SIZES for letters in ("ac", "ab", "xZ")]


@pytest.fixture(scope="module")
def texts():
    return [f"{fill}{word}" for fill in ("", "so ") for pair in pairs() for word in pair]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_hashes(texts):
    words = Splitter()(pa.array([w for pair in pairs() for w in pair]))
    assert len(set(words.hashes.tolist())) == len(words.hashes)


def test_all_short_stretches_of_two_letters():
    size = 16
    raw = ((np.arange(1 << size)[:, None] >> np.arange(size)) & 1).astype(np.uint8).ravel() + 97
    starts = np.arange(0, len(raw), size)
    assert len(np.unique(stretch_hashes(raw, starts, starts + size))) == 1 << size


def test_a_stretch_has_its_hash_wherever_it_lies():
    rng = random.Random(1)
    for size in (0, 1, 7, 8, 9, 16, 63, 64, 65, 200):
        data = bytes(rng.randrange(256) for _ in range(size))
        buffers = [b"x" * before + data + b"y" * after for before in (0, 3, 8) for after in (0, 1, 9)]
        at = [0, 0, 0, 3, 3, 3, 8, 8, 8]
        found = {
            int(stretch_hashes(np.frombuffer(b, np.uint8), np.array([s]), np.array([s + size]))[0])
            for b, s in zip(buffers, at, strict=True)
        }
        assert len(found) == 1


def test_token_counts(df, texts):
    library = Tokenizer.from_file(BPE)
    expected = [len(library.encode(text, add_special_tokens=False).ids) for text in texts]
    found = {row.doc_id: row.n_tokens for row in token_counts.token_counts(df, BPE).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_written_ids(spark, df, texts):
    library = Tokenizer.from_file(BPE)
    root = fresh_path(spark, "twins")
    files = huffman_ids.write_ids(huffman_ids.tokenised(df, BPE, "doc_id", "text"), root)
    found = {row.doc_id: row.ids for row in huffman_ids.read_ids(files, root).collect()}
    assert [found[i] for i in range(len(texts))] == [
        library.encode(text, add_special_tokens=False).ids + [1] for text in texts
    ]


def test_sentence_pieces(df, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {row.doc_id: row.ids for row in sentence_pieces.encode(df, PIECES).collect()}
    assert [found[i] for i in range(len(texts))] == [library.encode(text) + [2] for text in texts]



@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_windows_and_shingles(spark, size):
    a, b = twins(size)
    first, second = " ".join([a] * 20), " ".join([b] * 20)
    df = spark.createDataFrame([(0, first), (1, second)], "doc_id long, text string").coalesce(1)
    assert {r.n_removed for r in substring_dedup.remove_repeated(df).collect()} == {0}
    assert {r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == {0, 1}


@pytest.mark.parametrize("size", [1024, 4096])
def test_decontamination(spark, size):
    a, b = twins(size)
    docs = spark.createDataFrame([(0, " ".join([b] * 15)), (1, " ".join([a] * 15))], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join([a] * 15))], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items).collect()
    assert [row.doc_id for row in left] == [0]
