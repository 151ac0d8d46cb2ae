from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from conftest import TEXTS

from tracewell.llm.chunk_cache import HashTable
from tracewell.llm.words import Splitter


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_all_texts():
    words = Splitter()(pa.array(TEXTS, pa.string()))
    found = [
        [words.raw[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)]
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)
    ]
    assert found == [plain(text) for text in TEXTS]


def test_equal_words_have_equal_hashes_and_others_not():
    texts = ["Ab ab cd", None, "ab  CD\nxy Ab"]
    exact, folded = Splitter()(pa.array(texts)), Splitter(fold=True)(pa.array(texts))
    names = [w for text in texts for w in plain(text)]
    assert len(set(exact.hashes.tolist())) == len(set(names))
    assert len(set(folded.hashes.tolist())) == len({w.lower() for w in names})
    # A slice of a larger array has the same hashes.
    assert Splitter()(pa.array(texts).slice(2)).hashes.tolist() == exact.hashes[3:].tolist()


def test_windows_stay_within_a_text():
    words = Splitter()(pa.array(["a b c a b c", "a b", None, "c a b"]))
    hashes, whole = words.windows(3)
    assert np.flatnonzero(whole).tolist() == [0, 1, 2, 3, 8]
    assert hashes[0] == hashes[3] and hashes[2] == hashes[8]
    assert len({hashes[i] for i in (0, 1, 2)}) == 3


def test_hash_table_against_a_dict():
    rng = np.random.RandomState(1)
    table, known = HashTable(4), {}
    for _ in range(5):
        new = np.setdiff1d(rng.randint(0, 1 << 62, 3000).astype(np.uint64), np.array(list(known), np.uint64))
        values = rng.randint(0, 1 << 30, len(new)).astype(np.int32)
        table.add(new, values)
        known |= dict(zip(new.tolist(), values.tolist(), strict=True))
    asked = np.concatenate((np.array(list(known), np.uint64), rng.randint(0, 1 << 62, 500).astype(np.uint64)))
    assert table.find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]
