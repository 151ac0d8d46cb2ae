from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import pytest

from tracewell.llm import warc
from tracewell.sources.workspace import fresh_path

PAGES = [
    (1, "http://a", "same"),
    (2, "http://b", "same"),
    (2, "http://b", "same"),
    (3, None, None),
    (4, "http://c d\r\nX: y", ""),
    (None, "http://n", "same"),
    (5, "http://é", "é" * 2000),
    (None, "m", "alone"),
    (None, "m", "alone"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*row, "shard", 7) for row in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, shard long")


def stored(spark, df, **options):
    root = fresh_path(spark, "warc")
    return warc.write_warc(df, root, **options), root


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_odd_pages(spark, pages, roll):
    files, root = stored(spark, pages, roll_bytes=roll)
    found = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        for r in warc.read_warc(files, root).collect()
    ]
    first = {"same": 1, "": 3, "é" * 2000: 5}
    expected, seen = [], set()
    for page, _, html in PAGES:
        to = first.get(html or "")
        revisit = (to != page and html != "alone") or (page, html) in seen
        seen.add((page, html))
        refers = (page if (page, html) in seen and to in (None, page) else to) if revisit else None
        kind = "revisit" if revisit else "response"
        expected.append((page, len((html or "").encode()), digest(html), kind, refers))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert files.count() == (len(PAGES) if roll == 1 else 1)


def test_small_pages_can_be_left_alone(spark, pages):
    files, root = stored(spark, pages, revisit_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in warc.read_warc(files, root).where("payload_bytes < 5").collect()}
    assert {kind for _, kind in kinds} == {"response"}


def content(root, files):
    plain = root.removeprefix("file:")
    return {name: Path(plain, name).read_bytes() for (name,) in files.select("name").collect()}


def test_the_same_bytes_however_pages_are_dealt(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    options = {"shard_bytes": 30_000, "roll_bytes": 5_000}
    one, root = stored(spark, df, **options)
    other, other_root = stored(spark, df.repartition(7), **options)
    assert one.select("shard").distinct().count() > 2
    assert content(root, one) == content(other_root, other)
    keys = [(r.shard, r.number, r.first_key, r.last_key) for r in one.orderBy("shard", "number").collect()]
    assert all(a[3] <= b[2] for a, b in zip(keys[:-1], keys[1:], strict=True))


def test_damage_is_found(spark, pages):
    files, root = stored(spark, pages.limit(1))
    name = files.first().name
    path = Path(root.removeprefix("file:"), name)
    with warc.opened(root, name) as file:
        (record,) = warc.members(file)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record.replace(b"same", b"sane"))
    path.write_bytes(path.read_bytes()[:-20])
    with warc.opened(root, name) as file, pytest.raises(ValueError, match="ends within"):
        list(warc.members(file))


def test_a_root_is_written_once_and_left_clean(spark, pages):
    files, root = stored(spark, pages)
    assert not Path(root.removeprefix("file:"), "temporary").exists() and files.count() == 1
    with pytest.raises(ValueError, match="written before"):
        warc.write_warc(pages, root)


def test_nothing(spark, pages):
    files, root = stored(spark, pages.limit(0))
    assert files.count() == 0 and warc.read_warc(files, root).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for row in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(row.html or "", row.page_id)
    expected = {
        (r.page_id, len((r.html or "").encode()), digest(r.html), "response" if to == r.page_id else "revisit",
         None if to == r.page_id else to)
        for r in rows for to in [first[r.html or ""]]
    }
    assert set(map(tuple, warc.op3_warc(spark, sf_dir).collect())) == expected
