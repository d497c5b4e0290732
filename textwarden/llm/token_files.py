"""Token-id files: blocks of ids transposed into bit or byte planes, each plane compressed by zstandard.

A file image holds whole documents: a header, the compressed planes block by block, the documents'
ids and sizes, a chunk index (block sizes, plane lengths, checksums) and a trailer that points to
it. Images are rows of a Parquet table in a folder that Spark writes, so lost tasks leave no half
file and any store that Spark reaches will do; ``export`` puts images into plain files.

Order: the table is dealt by range of doc_id and sorted within each range, nulls first; a document's
``start`` counts the ids of all documents before it. Repeated doc_ids are ordered by text. Defined
results: null and empty texts hold the end id alone; an empty table has no image; texts of any
length are kept whole, a document larger than an image making its own; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from textwarden.llm import bpe
from textwarden.llm.common import slices, tidied

MAGIC = b"TWPLANE1"
BLOCK_IDS = 65_536
IMAGE_IDS = 1_000_000
SCHEMA = "part int, seq int, start_in_part long, n_docs long, n_tokens long, image binary"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The four byte planes or thirty-two bit planes of uint32 ids, least significant first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if plane == "byte":
        return [p.tobytes() for p in by_byte]
    bits = [np.packbits((p >> b) & 1, bitorder="little") for p in by_byte for b in range(8)]
    return [b.tobytes() for b in bits]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """Undoes to_planes; an empty plane stands for zeros."""
    out = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if not p:
            continue
        if plane == "byte":
            out[:, k] = np.frombuffer(p, np.uint8)
        else:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (k % 8)
    return out.reshape(-1).view("<u4")


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, plane: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """The file image of some documents' ids, end to end."""
    pressed = zstandard.ZstdCompressor(level=level)
    body, at, chunks = [MAGIC], len(MAGIC), []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        planes = [pressed.compress(p) if any(p) else b"" for p in to_planes(part, plane)]
        chunks.append({"at": at, "n": len(part), "planes": [len(p) for p in planes], "crc": zlib.crc32(part.astype("<u4").tobytes())})
        body += planes
        at += sum(map(len, planes))
    index = json.dumps({"plane": plane, "chunks": chunks, "docs": doc_ids, "sizes": sizes}).encode()
    index = pressed.compress(index)
    return b"".join([*body, index, struct.pack("<QQ", at, len(index)), MAGIC])


def read_index(image: bytes) -> dict:
    if image[: len(MAGIC)] != MAGIC or image[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a token file image")
    at, size = struct.unpack("<QQ", image[-len(MAGIC) - 16 : -len(MAGIC)])
    return json.loads(zstandard.ZstdDecompressor().decompress(image[at : at + size]))


def read_block(image: bytes, index: dict, k: int) -> np.ndarray:
    """Block k alone, by the chunk index."""
    chunk, unpress = index["chunks"][k], zstandard.ZstdDecompressor()
    at, planes = chunk["at"], []
    for n in chunk["planes"]:
        planes.append(unpress.decompress(image[at : at + n]) if n else b"")
        at += n
    ids = from_planes(planes, chunk["n"], index["plane"])
    if zlib.crc32(ids.tobytes()) != chunk["crc"]:
        raise ValueError(f"block {k} is damaged")
    return ids


def unpack(image: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    index = read_index(image)
    blocks = [read_block(image, index, k) for k in range(len(index["chunks"]))]
    return index["docs"], index["sizes"], np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


class LibraryEncoder:
    """The tokenizers library on the distinct pre-tokens of many texts.

    A vocabulary with word ends encodes each pre-token by itself and marks its last token, so new
    pre-tokens go to the library in one string and come apart at those marks. A text's ids are its
    pre-tokens' ids end to end; the tests hold this against the library on whole texts.
    """

    def __init__(self, data: str):
        self.library = Tokenizer.from_str(data)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(data)["model"]
        merges = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        # each pre-token comes once, so the library's own cache would only cost
        self.library.model = BPE(model["vocab"], merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        vocab = bpe.Vocabulary(data)
        self.last = np.array([t.endswith(model["end_of_word_suffix"]) for t in vocab.tokens])
        self.pieces = bpe.Pieces(vocab, self.encode)

    def encode(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.library.encode_batch_fast(["\n".join(pre_tokens)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pre_tokens):
            raise ValueError("the library cut the pre-tokens in another way")
        return ids, np.diff(ends, prepend=0)

    def run(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, the end id after each text's, and where each text's begin."""
        ids, bounds = self.pieces.ids(texts)
        return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


_encoders: dict[int, LibraryEncoder] = {}


def _encoder(data: str) -> LibraryEncoder:
    if hash(data) not in _encoders:
        _encoders.clear()
        _encoders[hash(data)] = LibraryEncoder(data)
    return _encoders[hash(data)]


def write(df: DataFrame, vocabulary: str, folder: str, end_id: int = 1, plane: str = "byte", image_ids: int = IMAGE_IDS) -> None:
    """Encodes all texts and writes their ids to folder, in ascending order of doc_id."""
    shared = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))
    end = struct.pack("<I", end_id)
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def images(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, start = _encoder(shared.value), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            nonlocal docs, sizes, held, seq, start
            n = sum(sizes)
            row = [part, seq, start, len(docs), n, pack(docs, sizes, np.concatenate(held), plane)]
            seq, start, docs, sizes, held = seq + 1, start + n, [], [], []
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in it:
            for a, b in slices(batch.column(1), bpe.SLICE_BYTES):
                ids, bounds = own.run(batch.column(1).slice(a, b - a), end_id)
                names, at = batch.column(0).slice(a, b - a).to_pylist(), 0
                while at < len(names):
                    # documents that still fit; one that does not makes an image of its own
                    room = image_ids - sum(sizes) + bounds[at]
                    to = int(np.searchsorted(bounds, room, "right")) - 1
                    if to <= at and docs:
                        yield image()
                        continue
                    to = max(to, at + 1)
                    docs += names[at:to]
                    sizes += np.diff(bounds[at : to + 1]).tolist()
                    held.append(ids[bounds[at] : bounds[to]])
                    at = to
        if docs:
            yield image()
        own.pieces.forget()  # workers live on; what they hold would add to later stages

    ordered.mapInArrow(tidied(images), SCHEMA).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_le (little-endian uint32)."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    # a row for each task of the writing job: as bounded as the driver's own list of its tasks
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    placed = files.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("start_in_part")).alias("start"), "image")

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, sizes, ids = unpack(image.as_py())
                at = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
                data = [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
                columns = [pa.array(docs, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_le"])

    return placed.mapInArrow(tidied(documents), "doc_id long, start long, n_tokens long, ids_le binary")


def export(spark: SparkSession, folder: str, local: str) -> None:
    """Streams the images to plain files of a local folder, one image in the driver at a time."""
    files = spark.read.schema(SCHEMA).parquet(folder).orderBy("part", "seq")
    for row in files.toLocalIterator():
        with open(f"{local}/{row.part:06d}-{row.seq:06d}.twp", "wb") as f:
            f.write(row.image)
