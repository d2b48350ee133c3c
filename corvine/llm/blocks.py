"""Blocks of documents, and the exchange of keys between blocks.

Operators that look for repeated content cut the corpus into blocks of about BLOCK_BYTES by a hash of
doc_id and text, so that rows which share an id (or have none) are spread, and handle a block as flat numpy
arrays. A block sends each different 64-bit key once to the bucket of that key, packed with the others for
that bucket; the bucket compares the keys of all blocks and answers every block. A key that a third of all
documents hold thus reaches its bucket once for each block, not for each document. What the blocks of one
task send to one bucket is one row before the shuffle (`pooled`), and so are a task's answers to one block, so
the rows of an exchange are tasks times buckets, not blocks times buckets. The text crosses one shuffle, which
every pass over the blocks reuses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import flat, pack, unpack

BLOCK_BYTES = 1 << 20
#: Bytes of text for each bucket of keys, and buckets at least.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 48
LEAST_ID = -(2**63)
U64 = np.uint64


class Blocks:
    """The documents with their block number, and the sizes that follow from the amount of text."""

    def __init__(
        self, docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, block_bytes: int | None = None, by_text: bool = True
    ) -> None:
        """by_text: deal by doc_id and text, not by doc_id alone."""
        content = F.coalesce(F.col(text), F.lit(""))
        size = docs.select(F.sum(F.octet_length(content)).alias("b")).first()["b"] or 0
        self.count = max(1, size // (block_bytes or BLOCK_BYTES))
        self.buckets = max(LEAST_BUCKETS, size // bucket_bytes)
        self.rows = docs.select(
            F.pmod(F.xxhash64(F.col(key).cast("bigint"), *[content] * by_text), F.lit(self.count)).alias("block"),
            F.col(key).cast("bigint").alias("doc_id"),
            content.alias("text"),
        )

    def map(self, f: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        """f over every block."""

        def run(table: pa.Table) -> pa.Table:
            return f(Block(table))

        return self.rows.groupBy("block").applyInArrow(run, schema)

    def map_with(self, answers: DataFrame, f: Callable[[Block, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f over every block and the rows of answers (a column block) meant for it."""

        def run(table: pa.Table, more: pa.Table) -> pa.Table:
            return f(Block(table), spread(more, "block"))

        return self.rows.groupBy("block").cogroup(pooled(answers, "block").groupBy("block")).applyInArrow(run, schema)


def pooled(rows: DataFrame, key: str) -> DataFrame:
    """key and rows: one row for each key with all of its rows in a list. A partial aggregate before the shuffle makes
    one of those that a task has."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("rows"))


def spread(table: pa.Table, key: str) -> pa.Table:
    """The rows that pooled() put together."""
    lists = table.column("rows").combine_chunks()
    inner = lists.flatten()
    keys = np.repeat(np.asarray(table.column(key)), np.asarray(lists.value_lengths())) if table.num_rows else np.zeros(0, np.int64)
    columns = [pa.array(keys, pa.int64()), *inner.flatten()]
    return pa.table(columns, [key, *[inner.type.field(i).name for i in range(inner.type.num_fields)]])


def by_bucket(sent: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over the rows of every bucket."""
    return pooled(sent, "bucket").groupBy("bucket").applyInArrow(lambda table: run(spread(table, "bucket")), schema)


class Block:
    """Documents of one block in order of doc_id, then of a digest of the text: ids, flat bytes, offsets. Rows
    equal in both are one document. The order is the same in every pass, so a document's number can name it."""

    def __init__(self, table: pa.Table) -> None:
        self.number = table.column("block")[0].as_py() if table.num_rows else 0
        ids = _ids(table.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        alike = np.flatnonzero(np.diff(ids[order]) == 0)
        fresh = np.ones(len(order), bool)
        if len(alike):
            text = table.column("text")
            tie = {int(k): hashlib.blake2b(text[int(k)].as_py().encode()).digest() for s in alike for k in order[s : s + 2]}
            order = np.array(sorted(order.tolist(), key=lambda k: (ids[k], tie.get(k, b""))))
            for s in alike.tolist():
                a, b = (int(k) for k in order[s : s + 2])
                fresh[s + 1] = tie[a] != tie[b]
        self.column = table.column("doc_id").take(pa.array(order)).combine_chunks()
        self.spot = np.cumsum(fresh) - 1
        table = table.take(pa.array(order[fresh]))
        self.ids = _ids(table.column("doc_id"))
        self.data, self.off = flat(table.column("text"))

    def result(self, columns: dict[str, pa.Array]) -> pa.Table:
        """A row for each row of the block from one for each document, the doc_id first."""
        table = pa.table(columns).take(pa.array(self.spot))
        return table.add_column(0, "doc_id", self.column)

    def owners(self, starts: np.ndarray) -> np.ndarray:
        """Index of the document that holds each byte position."""
        return np.searchsorted(self.off, starts, "right") - 1


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(LEAST_ID)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """The upper 48 bits of keys that only find candidates: a chance agreement of two keys costs a
    comparison, no result, and stays rare up to some 10**13 keys."""
    return (keys >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(U64)


def coarse(keys: np.ndarray) -> np.ndarray:
    """Keys as they are after packing."""
    return (keys >> U64(16)) << U64(16)


def deal_keys(number: int, keys: np.ndarray, buckets: int, count: bool = False) -> pa.Table:
    """Rows (bucket, block, keys) of the different coarse keys of a block; with count, also how often the
    block has each (many)."""
    keys, many = np.unique(coarse(keys), return_counts=True)
    to = ((keys >> U64(16)) % U64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order])) + 1
    first = np.concatenate(([0], cut)) if len(keys) else np.zeros(0, np.int64)
    packed = [pack_keys(part) for part in np.split(keys[order], cut)] if len(keys) else []
    columns = [pa.array(to[order][first], pa.int64()), pa.array(np.full(len(first), number), pa.int64()), pa.array(packed, pa.binary())]
    names = ["bucket", "block", "keys"]
    if count:
        many = np.minimum(many, 65535).astype(np.uint16)[order]
        columns.append(pa.array([pack(part) for part in np.split(many, cut)] if len(keys) else [], pa.binary()))
        names.append("many")
    return pa.table(columns, names)


def deal(number: int, keys: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """Rows (bucket, block, keys, ...) with the keys and their companions packed by bucket, in the
    order given."""
    to = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order])) + 1
    first = np.concatenate(([0], cut)) if len(keys) else np.zeros(0, np.int64)
    packed = [[pack(part) for part in np.split(a[order], cut)] if len(keys) else [] for a in (keys, *more)]
    names = ["bucket", "block", "keys", *(f"more{i}" for i in range(len(more)))]
    columns = [pa.array(to[order][first], pa.int64()), pa.array(np.full(len(first), number), pa.int64())]
    return pa.table([*columns, *(pa.array(p, pa.binary()) for p in packed)], names)


def gather(table: pa.Table, **kinds) -> tuple[np.ndarray, ...]:
    """Block of each key, then the unpacked columns, over the rows of one bucket. Rows come in order
    of their block."""
    table = table.sort_by("block")
    parts = {c: [unpack(v.as_py(), k) for v in table.column(c)] for c, k in kinds.items()}
    first = next(iter(kinds))
    block = np.repeat(np.asarray(table.column("block")), [len(p) for p in parts[first]])
    return block, *(np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items())


def answer(block: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (block, a0, a1, ...) with the columns packed by block."""
    order = np.argsort(block, kind="stable")
    cut = np.flatnonzero(np.diff(block[order])) + 1
    first = np.concatenate(([0], cut)) if len(block) else np.zeros(0, np.int64)
    packed = [[pack(part) for part in np.split(a[order], cut)] if len(block) else [] for a in columns]
    names = ["block", *(f"a{i}" for i in range(len(columns)))]
    return pa.table([pa.array(block[order][first], pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], names)


def told(more: pa.Table, *kinds) -> tuple[np.ndarray, ...]:
    """The unpacked columns of all answers for a block."""
    out = []
    for i, kind in enumerate(kinds):
        parts = [unpack(v.as_py(), kind) for v in more.column(f"a{i}") if v.is_valid]
        out.append(np.concatenate(parts) if parts else np.zeros(0, kind))
    return tuple(out)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def repeated_keys(sent: DataFrame, heavy: int | None = None) -> DataFrame:
    """Of rows (bucket, block, keys) by deal_keys: for every block, its keys that another block has too. With
    rows that count, also those of them (heavy) which the blocks have more than `heavy` times together."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_keys(v.as_py()) for v in table.column("keys")]
        keys = np.concatenate(parts) if parts else np.zeros(0, U64)
        block = np.repeat(np.asarray(table.column("block")), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        hit = order[np.repeat(size > 1, size)]
        often = np.zeros(len(k), bool)
        if heavy is not None and len(k):
            many = np.concatenate([unpack(v.as_py(), np.uint16) for v in table.column("many")]).astype(np.int64)
            often[order] = np.repeat(np.add.reduceat(many[order], first) > heavy, size)
        hit = hit[np.argsort(block[hit], kind="stable")]
        cut = np.flatnonzero(np.diff(block[hit])) + 1
        begin = np.concatenate(([0], cut)) if len(hit) else np.zeros(0, np.int64)
        pieces = np.split(hit, cut) if len(hit) else []
        columns = {"block": pa.array(block[hit][begin], pa.int64()), "keys": pa.array([pack_keys(keys[p]) for p in pieces], pa.binary())}
        if heavy is not None:
            columns["heavy"] = pa.array([pack_keys(keys[p[often[p]]]) for p in pieces], pa.binary())
        return pa.table(columns)

    return by_bucket(sent, run, "block bigint, keys binary" + ", heavy binary" * (heavy is not None))


def keys_told(more: pa.Table, column: str = "keys") -> np.ndarray:
    """The packed keys of all answers for a block, in order."""
    return np.sort(np.concatenate([np.zeros(0, U64), *(unpack_keys(v.as_py()) for v in more.column(column) if v.is_valid)]))


def repeats(block_keys: np.ndarray, more: pa.Table) -> np.ndarray:
    """Keys of a block that occur again, in it or by the answers of repeated_keys."""
    keys = coarse(block_keys)
    if not len(keys):
        return np.zeros(0, bool)
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    return (n[where] > 1) | is_in(keys, keys_told(more))


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values with two lanes: the index of the first of each different one, and the group of every one."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    where = np.empty(len(a), np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


def both_in(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Whether each value with two lanes is among the known ones."""
    n = len(known_a)
    first, where = groups(np.concatenate((known_a, a)), np.concatenate((known_b, b)))
    known = np.zeros(len(first), bool)
    known[where[:n]] = True
    return known[where[n:]]


def smaller_elsewhere(sent: DataFrame) -> DataFrame:
    """Of rows (bucket, block, keys, more0: second lane, more1: ids): for every block, the hashes for which
    another block has a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        block, a, b, ids = gather(table, keys=U64, more0=np.uint32, more1=np.int64)
        order = np.lexsort((b, a))
        a, b, ids, block = a[order], b[order], ids[order], block[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(a) else ids
        later = ids > least[group]
        return answer(block[later], a[later], b[later])

    return by_bucket(sent, run, "block bigint, a0 binary, a1 binary")


def digests(block: Block, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of at least `least` bytes, and both lanes of a digest of each one's text."""
    pick = np.flatnonzero(np.diff(block.off) >= least)
    raw = b"".join(hashlib.blake2b(block.data[block.off[i] : block.off[i + 1]], digest_size=16).digest() for i in pick)
    lanes = np.frombuffer(raw, U64).reshape(-1, 2)
    return pick, lanes[:, 0].copy(), (lanes[:, 1] >> U64(32)).astype(np.uint32)


def whole_copies(blocks: Blocks, least: int) -> DataFrame:
    """Answers to every block on texts that a document with a smaller doc_id elsewhere also has: columns
    copy0 and copy1. For use with copied()."""
    buckets = blocks.buckets

    def send(block: Block) -> pa.Table:
        pick, a, b = digests(block, least)
        first, _ = groups(a, b)
        first.sort()
        return deal(block.number, a[first], buckets, b[first], block.ids[pick[first]])

    found = smaller_elsewhere(blocks.map(send, "bucket bigint, block bigint, keys binary, more0 binary, more1 binary"))
    return found.withColumnsRenamed({"a0": "copy0", "a1": "copy1"})


def copied(block: Block, least: int, more: pa.Table) -> np.ndarray:
    """Documents of at least `least` bytes whose whole text one with a smaller doc_id also has, here or by
    the answers of whole_copies."""
    pick, a, b = digests(block, least)
    first, where = groups(a, b)
    out = np.zeros(len(block.ids), bool)
    known = told(more.select(["copy0", "copy1"]).rename_columns(["a0", "a1"]), U64, np.uint32)
    out[pick] = (block.ids[pick[first[where]]] < block.ids[pick]) | both_in(a, b, *known)
    return out


def cover(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """True where [s, s + length) of some start lies, over size places."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0
