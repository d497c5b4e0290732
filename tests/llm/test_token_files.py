import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textwarden.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 200_001])
def test_image_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n % 2 else 49408, n).astype("<u4")
    sizes = [n // 3, n - n // 3]
    docs, back, got = token_files.unpack(token_files.pack([None, 5], sizes, ids, plane, block=4096))
    assert docs == [None, 5] and back == sizes and (got == ids).all()


def test_damage_is_found():
    image = bytearray(token_files.pack([1], [5000], np.arange(5000, dtype="<u4") * 7919, level=1))
    image[40] ^= 1
    with pytest.raises(Exception):
        token_files.unpack(bytes(image))


def test_table_against_library(spark, tmp_path):
    rows = [(5, "b b"), (3, None), (9, "hello <|endoftext|> world"), (3, ""), (7, "x" * 30_000), (None, "null id"), (9, "hello again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS image").repartition(3)
    token_files.write(df, PATH, str(tmp_path / "t"), image_ids=20)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    at = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert zlib.crc32(bytes(r.ids_le)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_files.export(spark, str(tmp_path / "t"), str(tmp_path))
    assert sum(token_files.read_index(p.read_bytes())["docs"].__len__() for p in tmp_path.glob("*.twp")) == len(rows)


def test_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "t"))
    assert token_files.read(spark, str(tmp_path / "t")).count() == 0


def test_pieces_are_whole_texts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["a<|endoftext|>b ́ ÉÉ İ's 12½", "ΑΣ Σ"]
    library = Tokenizer.from_file(PATH)
    ids, bounds = token_files.LibraryEncoder(bpe.read_vocabulary(PATH)).run(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]
