import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textwarden.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.read_vocabulary(PATH))


def expected(text):
    found = LIBRARY.encode(text, add_special_tokens=False)
    return " ".join(map(str, found.ids)), LIBRARY.decode(found.ids, skip_special_tokens=False), len(found.ids)


@pytest.mark.parametrize(
    "text",
    ["", " ", "aaaaaaaaaaaaa" * 40, "a<|endoftext|>b <|startoftext|>'s it's WE'LL don'T", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ é", "x\x1cy \x85z\xa0 12 ½", "テスト 🎉🎉 👍🏽", "​ zero ﻿", "a" * 5000 + " b"],
)
def test_matches_library(text):
    assert tuple(x[0] for x in CODEC.run([text])) == expected(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabbeehT'sdlr. ,!1²é<|>\ńÅΣ你") | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=5))
def test_any_text(texts):
    ids, decoded, n = CODEC.run(texts)
    assert list(zip(ids, decoded, n)) == [expected(t) for t in texts]


def test_query_rows(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "hello world")]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids_text"), PATH).collect()
    assert sorted((r.doc_id or 0, r.ids_text, r.decoded, r.n_tokens) for r in got) == sorted((i or 0, *expected(t or "")) for i, t in rows)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_as_arrays(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "x" * 70_000)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, " ".join(map(str, r.ids)), r.n_tokens) for r in got] == [(i, expected(t or "")[0], expected(t or "")[2]) for i, t in rows]


def test_other_vocabularies_are_refused():
    spec = json.loads(bpe.read_vocabulary(PATH))
    for change in ({"pre_tokenizer": None}, {"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))
