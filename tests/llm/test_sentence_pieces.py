from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import TEXTS

from tracewell.llm import sentence_pieces as s

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*TEXTS, "  a  b ", "▁▁▁", "ﬁ ｱﾞ ①　㌔ é", "<s> </s> <0x0A> <unk>", "​ a b　", "́ x"]


def grafted(rule, trim):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(s._fields(normaliser.serialized_model_proto()))[s.NORMALISER]
    with open(PATH, "rb") as file:
        return s.with_normaliser(file.read(), rule, dict(s._fields(spec))[s.CHARACTER_MAP], True, trim)


MODELS = {"own": {"path": PATH}} | {
    f"{rule}-{trim}": {"model": (rule, trim)} for rule in ("nmt_nfkc", "nfkc_cf") for trim in (True, False)
}


@pytest.mark.parametrize("name", MODELS)
def test_ids_and_spans_are_the_librarys(name, docs):
    given = MODELS[name]
    model = s.Pieces(PATH) if "path" in given else s.Pieces(model=grafted(*given["model"]))
    texts = [*ODD, *(row.text for row in docs.limit(60).collect())]
    ids, begins, ends, bounds = model.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        part = slice(bounds[i], bounds[i + 1])
        assert ids[part].tolist() == model.processor.encode(text or "")
        spans = [(p.begin, p.end) for p in model.processor.encode(text or "", return_type="proto").pieces]
        assert list(zip(begins[part].tolist(), ends[part].tolist(), strict=True)) == spans


def test_frame_and_back(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = s.encode(odd, PATH)
    found = sorted((repr(r.doc_id), r.ids, r.begins[-1], r.ends[-1]) for r in coded.collect())
    rows = [(repr(r.doc_id), r.text or "") for r in odd.collect()]
    expected = [(k, library.encode(t) + [2], len(t.encode()), len(t.encode())) for k, t in rows]
    assert found == sorted(expected)
    back = s.decode(coded, PATH)
    assert sorted((repr(r.doc_id), r.decoded) for r in back.collect()) == sorted(
        (k, library.decode(library.encode(t) + [2])) for k, t in rows
    )
    assert s.encode(odd, PATH, end=False).where("size(ids) = 0").count() == 2
    assert s.encode(odd.limit(0), PATH).count() == s.decode(coded.limit(0), PATH).count() == 0
    missing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert s.decode(missing, PATH).first().decoded == ""


def test_models_without_byte_fallback_are_refused():
    with open(PATH, "rb") as file:
        model = file.read()
    without = b"".join(
        s._message(1, value) for number, value in s._fields(model) if number == 1 and b"<0x" not in value
    )
    with pytest.raises(ValueError, match="byte fallback"):
        s.Pieces(model=without)


def test_query(spark, docs, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = set()
    for row in docs.collect():
        ids = library.encode(row.text or "") + [2]
        texts = " ".join(map(str, ids)), library.decode(ids)
        expected.add((row.doc_id, len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    assert set(map(tuple, s.op5_sentencepiece(spark, sf_dir).collect())) == expected
