"""BPE encoding and decoding by a pair occurrence index over a partition's words.

The vocabulary file (a ``tokenizers`` JSON with byte-level BPE and word ends) is a parameter. Texts
are cut into blank-separated pieces, pieces into pre-tokens, and the distinct pre-tokens a slice of
a partition brings are encoded together: every adjacent pair is mapped to all its positions, active
ranks are applied in ascending order, and the index lists of the pairs a merge makes are updated.

Defined results: null texts count as empty; an empty text has no ids and decodes to the empty
string; special tokens written out in a text are taken as such; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty table; columns beside the
text and the ones kept are not read, so clashing names cannot matter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import slices, tidied

#: Pieces, and pre-tokens, whose ids a worker remembers.
MEMO_ENTRIES = 120_000
MEMO_WORD_CHARS = 64
#: Bytes of text that a worker encodes at a time.
SLICE_BYTES = 5_000_000

#: Fixed values of the vocabulary's file format: its pre-token pattern and byte alphabet.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the file says about texts, all of which is done here, and options of its model that are not.
READ_AS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "decoder": None,
}
NOT_READ = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
#: The same pattern where all is ASCII and in lower case.
ASCII_PRE_TOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+)"
MARK = "\u0100"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Unicode's white space has these four too, which the vocabulary's \s does not hold.
NOT_BLANK = r"[\x1c-\x1f]"
BLANKS = regex.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in PRINTABLE:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """A parsed vocabulary file: ids, tokens, merges as sorted pair codes, special tokens."""

    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or {k: spec.get(k) for k in READ_AS} != READ_AS or any(model.get(k) for k in NOT_READ) or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("needs a byte-level BPE vocabulary with word ends that cuts texts as this module does")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.final = np.array([ids[c + end] for c in alphabet], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        made = np.full(len(self.tokens), -1, np.int64)
        made[self.merged[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that only a later merge makes")
        codes = (left << 32) | right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.left, self.right, self.twin = left, right, left == right

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no such merge."""
        codes = (left << 32) | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], -1)


def encode_words(vocab: Vocabulary, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids end to end, and the number of ids of each word."""
    data = [w.encode() for w in words]
    size = np.array([len(d) for d in data], np.int64)
    if not len(size) or not size.sum():
        return np.zeros(0, np.int64), size
    flat = np.frombuffer(b"".join(data), np.uint8)
    n = len(flat)
    last = np.cumsum(size)[size > 0] - 1
    symbol = vocab.inner[flat]
    symbol[last] = vocab.final[flat[last]]
    following = np.arange(1, n + 1)
    following[last] = -1
    before = np.arange(-1, n - 1)
    before[np.concatenate(([0], last[:-1] + 1))] = -1
    alive = np.ones(n, bool)

    starts = np.flatnonzero(following >= 0)
    rank = vocab.ranks(symbol[starts], symbol[following[starts]])
    starts, rank = starts[rank >= 0], rank[rank >= 0]
    by_rank = np.argsort(rank, kind="stable")
    starts, rank = starts[by_rank], rank[by_rank]
    cuts = np.flatnonzero(np.diff(rank)) + 1
    index = {int(rank[a]): [starts[a:b]] for a, b in _runs(cuts, len(rank))}
    added: dict[int, list[int]] = {}
    active = list(index)
    heapq.heapify(active)

    while active:
        r = heapq.heappop(active)
        at = np.concatenate(index.pop(r, []) + [np.array(added.pop(r, []), np.int64)])
        at = at[alive[at] & (symbol[at] == vocab.left[r]) & (following[at] >= 0)]
        at = at[symbol[following[at]] == vocab.right[r]]
        if vocab.twin[r] and len(at) > 1:
            at = _leftmost(np.unique(at), following)
        if not len(at):
            continue
        gone = following[at]
        alive[gone] = False
        symbol[at] = vocab.merged[r]
        after = following[gone]
        following[at] = after
        tail = after >= 0
        before[after[tail]] = at[tail]
        head = before[at] >= 0
        near = np.concatenate((before[at[head]], at[tail]))
        if len(near):
            new = vocab.ranks(symbol[near], symbol[following[near]])
            kept = new >= 0
            for k, p in zip(new[kept].tolist(), near[kept].tolist()):
                if k in added:
                    added[k].append(p)
                else:
                    added[k] = [p]
                    if k not in index:
                        heapq.heappush(active, k)
    per_word = np.zeros(len(size), np.int64)
    full = np.flatnonzero(size > 0)
    per_word[full] = np.add.reduceat(alive, np.concatenate(([0], last[:-1] + 1)))
    return symbol[alive], per_word


def _runs(cuts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    if n:
        edges = [0, *cuts.tolist(), n]
        for a, b in zip(edges, edges[1:]):
            yield a, b


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a pair of equal symbols, those that a scan from the left takes."""
    taken, blocked = [], -1
    for p, q in zip(at.tolist(), following[at].tolist()):
        if p != blocked:
            taken.append(p)
            blocked = q
        else:
            blocked = -1
    return np.array(taken, np.int64)


def strings(array: pa.Array) -> list[str]:
    """to_pylist(), several times as fast."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Known:
    """Strings met so far, each a row of ids in one flat array."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: Sequence[str], flat: np.ndarray, count: np.ndarray) -> None:
        """count says how many of flat's ids each key has."""
        first = len(self.start)
        self.rows.update(zip(keys, range(first, first + len(keys))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat.astype(np.uint32)))

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The rows' ids end to end."""
        count = self.count[rows]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.start[rows] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """The ids of texts, by their blank-separated pieces; joined, the pieces' ids are the text's.

    Texts are cut and their distinct pieces found in Arrow; a piece met before has its ids in a memo,
    and encode gets the distinct new pre-tokens, giving their ids end to end and how many each has.
    """

    def __init__(self, vocab: Vocabulary, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.vocab, self.encode = vocab, encode
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.pieces, self.tokens = Known(), Known()
        self.pieces.add([""], np.zeros(0), np.zeros(1, np.int64))
        self.tokens.add(list(self.vocab.special), np.array(list(self.vocab.special.values())), np.ones(len(self.vocab.special), np.int64))

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut at blanks; empty pieces have no ids and do no harm."""
        odd = pc.invert(pc.string_is_ascii(texts))
        if pc.any(odd).as_py():
            normal = [t if unicodedata.is_normalized("NFC", t) or self.special.search(t) else unicodedata.normalize("NFC", t) for t in texts.filter(odd).to_pylist()]
            texts = pc.replace_with_mask(texts, odd, pa.array(normal, pa.string()))
            if pc.any(pc.match_substring_regex(texts, NOT_BLANK)).as_py():
                return pa.array([BLANKS.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
            return pc.utf8_split_whitespace(texts)
        return pc.ascii_split_whitespace(texts)

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece, after NFC and lower-casing; special tokens stay whole."""
        if self.special.search(piece):
            out, at = [], 0
            for m in self.special.finditer(piece):
                out += [*self._cut(piece[at : m.start()]), m[0]]
                at = m.end()
            return [*out, *self._cut(piece[at:])]
        return self._cut(piece)

    def _cut(self, piece: str) -> list[str]:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            low = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
        else:
            low = piece.lower()
        if low.isalpha():
            return [low]
        return self.pre_token.findall(low)

    def learn(self, new: pa.Array) -> None:
        """Encodes the pieces, all their distinct new pre-tokens together."""
        plain = pc.and_(pc.string_is_ascii(new), pc.invert(pc.match_substring_regex(new, self.special.pattern)) if self.vocab.special else True)
        word = pc.and_(plain, pc.ascii_is_alpha(new))
        words, mixed, odd = new.filter(word), new.filter(pc.and_not(plain, word)), strings(new.filter(pc.invert(plain)))
        # no plain piece holds the mark
        cut = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(mixed), pattern=ASCII_PRE_TOKEN, replacement=MARK + r"\1"), MARK)
        cut = pc.list_slice(cut, 1) if len(cut) else cut
        rest = [self.pre_tokens(p) for p in odd]
        tokens = pa.concat_arrays([pc.ascii_lower(words), cut.flatten(), pa.array([t for ts in rest for t in ts], pa.string())]).dictionary_encode()
        count = np.concatenate((np.ones(len(words), np.int64), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(ts) for ts in rest], np.int64)))
        distinct = strings(tokens.dictionary)
        fresh = [t for t in distinct if t not in self.tokens.rows]
        if fresh:
            self.tokens.add(fresh, *self.encode(fresh))
        rows = np.array([self.tokens.rows[t] for t in distinct], np.int64)[tokens.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        each = np.concatenate(([0], np.cumsum(self.tokens.count[rows])))
        ends = np.concatenate(([0], np.cumsum(count)))
        self.pieces.add([*strings(words), *strings(mixed), *odd], self.tokens.spread(rows), np.diff(each[ends]))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's begin, the end last."""
        if len(self.pieces.rows) > MEMO_ENTRIES or len(self.tokens.rows) > MEMO_ENTRIES:
            self.forget()
        cut = self.split(pc.fill_null(texts, ""))
        found = cut.flatten().dictionary_encode()
        distinct = strings(found.dictionary)
        new = [p for p in distinct if p not in self.pieces.rows]
        if new:
            self.learn(pa.array(new, pa.string()))
        rows = np.array([self.pieces.rows[p] for p in distinct], np.int64)[found.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        each = np.concatenate(([0], np.cumsum(self.pieces.count[rows])))
        bounds = each[np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))))]
        ids = self.pieces.spread(rows)
        if any(len(p) > MEMO_WORD_CHARS for p in new):
            for known in (self.pieces, self.tokens):
                for p in [p for p in known.rows if len(p) > MEMO_WORD_CHARS]:
                    del known.rows[p]
        return ids, bounds


class Codec:
    """Encodes and decodes texts with one vocabulary, remembering pieces it has met."""

    def __init__(self, data: str):
        self.vocab = Vocabulary(data)
        self.pieces = Pieces(self.vocab, lambda words: encode_words(self.vocab, words))
        self.numbers = pa.array(map(str, range(len(self.vocab.tokens))), pa.string())
        self.strings = pa.array(self.vocab.tokens, pa.string())

    def batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each text: its ids as decimals joined by spaces, the decoded text, the number of ids."""
        ids, bounds = self.pieces.ids(texts)
        offsets = pa.array(bounds, pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(ids))), " ") for names in (self.numbers, self.strings)]
        return *joined, pa.array(np.diff(bounds), pa.int64())

    def ids(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each text: the number of ids, and the ids."""
        ids, bounds = self.pieces.ids(texts)
        return pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))

    def run(self, texts: Sequence[str]) -> tuple[list[str], list[str], list[int]]:
        return tuple(x.to_pylist() for x in self.batch(pa.array(texts, pa.string())))


_codecs: dict[int, Codec] = {}


def codec(data: str) -> Codec:
    """The worker's codec of a vocabulary; workers outlive tasks, so later tasks find it loaded."""
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, vocabulary: str, text: str, keep: Sequence[str], made: dict[str, str], make: Callable[[Codec, pa.Array], Sequence[pa.Array]]) -> DataFrame:
    """The columns of keep, and those that make gives of each slice of texts, with their types."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in made.items()]).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in it:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts, SLICE_BYTES):
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *make(own, texts.slice(a, b - a))], names=[*keep, *made])
        own.pieces.forget()  # workers live on; what they hold would add to later stages

    return source.mapInArrow(tidied(batches), schema)


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_tokens and ids, an array<int>, of every text.

    vocabulary is the path of the file on the driver; its contents, of fixed size, are broadcast.
    """
    return _mapped(df, vocabulary, text, keep, {"n_tokens": "long", "ids": "array<int>"}, lambda own, texts: own.ids(texts))


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes every text.

    Returns the columns of keep, ids_text (decimal ids joined by spaces), decoded and n_tokens.
    """
    return _mapped(df, vocabulary, text, keep, {"ids_text": "string", "decoded": "string", "n_tokens": "long"}, lambda own, texts: own.batch(texts))
