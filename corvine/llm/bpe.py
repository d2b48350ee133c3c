"""Operator 5: byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at the strings of the added tokens, then by the byte-level split pattern. Each
piece starts as its bytes. A segment tree has one leaf for each adjacent pair, holding (rank,
position); its root is the leftmost pair of the lowest rank. Merging it changes at most three
leaves, each in logarithmic time, until the root holds no mergeable pair. Results of pieces are
remembered in a bounded table, as words repeat.

Cases: NULL and empty texts give no ids and decode to the empty text. Bytes that are not UTF-8
count as U+FFFD. Extra columns of the input are ignored. The vocabulary file is a parameter and
is read once in each Python worker.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import batches_of, sha256_hex

#: Fixed value: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers in each of two generations: a full table becomes the old one, from
#: which pieces that recur are taken over. Longer pieces than MEMO_CHARS are not remembered, so that
#: memory has a bound.
MEMO_PIECES = 500_000
MEMO_CHARS = 48
NO_PAIR = 1 << 62
assert array("I").itemsize == 4 and sys.byteorder == "little"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTree:
    """Minimum over (rank, position) keys of adjacent pairs, with point updates."""

    def __init__(self, keys: list[int]) -> None:
        size = 1
        while size < len(keys):
            size *= 2
        tree = [NO_PAIR] * (2 * size)
        tree[size : size + len(keys)] = keys
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree, self.size = tree, size

    def root(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        tree = self.tree
        i = at + self.size
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            least = key if key < other else other
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = key = least


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers JSON layout."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.table: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table.update({i: t.encode() for t, i in self.added.items()})
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        #: (left id, right id) packed into one number -> rank and merged id packed into another.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.split = regex.compile(SPLIT)
        own = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, own)) + ")") if own else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges.get
        found = [merges(ids[i] << 32 | ids[i + 1], -1) for i in range(n - 1)]
        tree = SegmentTree([(m >> 32) << 31 | i if m >= 0 else NO_PAIR for i, m in enumerate(found)])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while (key := tree.root()) != NO_PAIR:
            i = key & 0x7FFFFFFF
            j = right[i]
            ids[i] = found[i] & 0xFFFFFFFF
            ids[j] = -1
            k = right[i] = right[j]
            if j < n - 1:
                tree.put(j, NO_PAIR)
            if k < n:
                left[k] = i
                m = found[i] = merges(ids[i] << 32 | ids[k], -1)
                tree.put(i, (m >> 32) << 31 | i if m >= 0 else NO_PAIR)
            else:
                tree.put(i, NO_PAIR)
            h = left[i]
            if h >= 0:
                m = found[h] = merges(ids[h] << 32 | ids[i], -1)
                tree.put(h, (m >> 32) << 31 | h if m >= 0 else NO_PAIR)
        return [x for x in ids if x >= 0]

    def _missing(self, piece: str) -> bytes:
        out = self.older.get(piece) or array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        get, missing = self.memo.get, self._missing
        return b"".join([get(p) or missing(p) for p in self.split.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(
            np.array([self.added[p]], "<u4").tobytes() if i % 2 else self._plain(p)
            for i, p in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        get = self.table.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def tokenise(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Key, ids (array of int) and decoded text of every row, with its text if wanted."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches_of(batches, 1, 128):
            codes = [bpe.encode(_text(v)) for v in batch.column(1)]
            ids = np.frombuffer(b"".join(codes), "<i4")
            ends = np.cumsum([0, *(len(c) // 4 for c in codes)], dtype=np.int32)
            out = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                pa.array([bpe.decode(c) for c in codes], pa.string()),
            ]
            yield pa.record_batch([*out, *batch.columns[1 : 1 + keep_text]], ["doc_id", "ids", "decoded", "text"][: 3 + keep_text])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded string" + ", text string" * keep_text
    )


def _text(v: pa.Scalar) -> str:
    b = v.as_buffer()
    return "" if b is None else str(memoryview(b), "utf-8", "replace")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What the contract asks of every document, without moving ids or texts out of the worker."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches_of(batches, 1):
            n, ids, back = [], [], []
            for v in batch.column(1):
                code = bpe.encode(_text(v))
                n.append(len(code) // 4)
                ids.append(sha256_hex(code))
                back.append(sha256_hex(bpe.decode(code).encode()))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
