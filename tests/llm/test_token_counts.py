from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def count():
    library = Tokenizer.from_file(PATH)
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts(odd, count):
    found = sorted(token_counts.token_counts(odd, PATH).collect(), key=repr)
    texts = [(row.doc_id, row.text) for row in odd.collect()]
    assert found == sorted(((k, len((t or "").encode()), count(t)) for k, t in texts), key=repr)


def test_documents_with_and_without_the_first_tier(spark, docs, count, monkeypatch):
    expected = sorted((row.doc_id, len((row.text or "").encode()), count(row.text)) for row in docs.collect())
    assert sorted(map(tuple, token_counts.token_counts(docs, PATH).collect())) == expected
    monkeypatch.setattr(token_counts, "frequent_lengths", lambda texts, path: (b"", b""))
    assert sorted(map(tuple, token_counts.token_counts(docs, PATH).collect())) == expected


def test_a_full_cache_starts_afresh(docs, count):
    from tracewell.llm.chunk_cache import ChunkCache
    from tracewell.llm.word_bpe import SPECIAL, chunks, word_bpe

    cache, split = ChunkCache(word_bpe(PATH), limit=50), chunks()
    for text in [row.text for row in docs.limit(40).collect()]:
        import pyarrow as pa

        assert len(cache.ids(split(pa.array([text]), SPECIAL))[0]) == count(text)


def test_nothing(odd):
    assert token_counts.token_counts(odd.limit(0), PATH).count() == 0


def test_the_limit(spark, sf_dir):
    rows = token_counts.op10_token_counts(spark, sf_dir).collect()
    assert all(row.over_limit == (row.n_tokens > 2048) for row in rows) and len(rows) == 200
