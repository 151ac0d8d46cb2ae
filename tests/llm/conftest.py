from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"

#: Null, empty, blank, short, odd and long texts, and one given twice.
TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "two words",
    "<|endoftext|>a<|ENDOFTEXT|> b",
    "It's we'll IT'S don’t 'S x.y",
    "ﬁ İstanbul ΣΑΣ é é É ́abc ½ ١٢٣ 日本語 テスト 🙂🙂",
    "a\x1cb \x00 \x85x y ▁x ▁▁ z",
    " lead  trail \n\n",
    "word " * 3000,
    "x" * 5000,
    "the same text twice over",
    "the same text twice over",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under keys with a null and a repeated one, beside columns with clashing names."""
    keys = [None, *range(1, len(TEXTS))]
    keys[-1] = keys[-2]
    rows = [(key, text, "s", 1, 2, 3) for key, text in zip(keys, TEXTS, strict=True)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, key long, n_tokens long, row long"
    )


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def by_key(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}
