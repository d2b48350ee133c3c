"""Operator 1: Lempel-Ziv phrase fingerprints.

A document is parsed into dictionary phrases: each phrase is the longest phrase seen so far plus
one character, and joins the dictionary. Every phrase is hashed; the phrase set is summarised by
a minimum-hash signature of BINS parts, each the smallest hash that falls in it (16 bits are kept).
The likeness of two signatures is the share of parts, among those not empty in both, that agree:
an estimate of the Jaccard likeness of the phrase sets, which follows how well one text compresses
with the other's dictionary.

Documents and their successors by ascending doc_id are brought together in one shuffle: rows go to
contiguous ranges of ids, and the first row of every range is sent to the range before it too.

Cases: NULL and empty texts have no phrase and the empty signature; two empty signatures have
likeness 1, an empty and another one 0. Equal texts have equal fingerprints. A single document is
its own successor. Rows that repeat a doc_id are kept, in order of the CRC-32 of their texts. A NULL
doc_id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import POWERS, batches_of, mix, sha256_hex, text_partitions

#: Parts of a signature; a power of two.
BINS = 128
EMPTY = 0xFFFF
#: Bytes of text of a range of ids, about; there are at least two ranges for each shuffle partition.
RANGE_BYTES = 512 << 20
U64 = np.uint64


class Parse:
    """Incremental Lempel-Ziv parse of one text; phrases as (start, end) of the text so far."""

    __slots__ = ("dictionary", "phrases")

    def __init__(self, dictionary: set[str] | None = None) -> None:
        self.dictionary = set() if dictionary is None else dictionary
        self.phrases: list[str] = []

    def feed(self, text: str, start: int = 0) -> int:
        """Parse from start; the rest that ends inside a known phrase is left. Returns its start."""
        known, add = self.dictionary, self.dictionary.add
        i, n, step = start, len(text), 3
        while i < n:
            j = i + step
            piece = text[i:j]
            if piece in known:  # known phrases are closed under prefixes: go on from here
                while piece in known:
                    if j >= n:
                        return i
                    j += 1
                    piece = text[i:j]
            else:
                if j > n:
                    j = n
                while j - i > 1 and text[i : j - 1] not in known:
                    j -= 1
                piece = text[i:j]
                if piece in known:
                    return i
            add(piece)
            i = j
        return i


def phrase_hashes(phrases: set[str], tail: str) -> np.ndarray:
    """64-bit hash of each phrase, the unfinished last one included."""
    pieces = list(phrases)
    if tail and tail not in phrases:
        pieces.append(tail)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    values = mix(codes.astype(U64) + U64(1))
    starts = np.cumsum(lens) - lens
    longest = int(lens.max())
    POWERS.need(longest + 1)
    at = np.arange(len(codes)) - np.repeat(starts, lens)
    return mix(np.add.reduceat(values * POWERS.up[0][at], starts))


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BINS, EMPTY, np.uint16)
    h = np.sort(hashes)
    part = (h >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    out[part[first]] = np.minimum((h[first] & U64(0xFFFF)).astype(np.uint16), EMPTY - 1)
    return out


def both_signatures(text: str, follower: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of the text with its last half replaced; the parse is shared."""
    n = len(text)
    if n == 0:
        blank = np.full(BINS, EMPTY, np.uint16)
        return blank, blank
    head = n - n // 2
    edited = text[:head] + follower[: n // 2]
    parse = Parse()
    # what is parsed up to here is the same for both, as no phrase crosses the cut
    cut = parse.feed(text[:head])
    fork = Parse(set(parse.dictionary))
    rest = parse.feed(text, cut)
    own = signature(phrase_hashes(parse.dictionary, text[rest:]))
    rest = fork.feed(edited, cut)
    return own, signature(phrase_hashes(fork.dictionary, edited[rest:]))


def one_signature(text: str) -> np.ndarray:
    if not text:
        return np.full(BINS, EMPTY, np.uint16)
    parse = Parse()
    rest = parse.feed(text)
    return signature(phrase_hashes(parse.dictionary, text[rest:]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    return float((a[used] == b[used]).sum() / n) if n else 1.0


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and fingerprint of every row; no shuffle."""

    def run(batches):
        for batch in batches_of(batches, 1):
            out = [to_text(one_signature(v or "")) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, fingerprint string"
    )


LEAST_ID = -(2**63)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(LEAST_ID)).astype(np.int64)


def id_ranges(docs: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of contiguous id ranges from quantiles; the first id of each range that has rows, in order; and
    the range before it (before the first: the last). At most `ranges` rows reach the driver."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"))
    probs = [i / ranges for i in range(1, ranges)]
    found = ids.approxQuantile("id", probs, 1 / (4 * ranges)) if probs else []
    bounds = np.array(sorted({int(b) for b in found if b is not None}), np.int64)

    def least(batches):
        for batch in batches:
            at = np.sort(_ids(batch.column(0)))
            piece = np.searchsorted(bounds, at, "right")
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            yield pa.record_batch([pa.array(piece[first].astype(np.int32)), pa.array(at[first])], ["piece", "id"])

    rows = ids.mapInArrow(least, "piece int, id bigint").groupBy("piece").agg(F.min("id").alias("id")).collect()
    rows.sort(key=lambda r: r["piece"])
    pieces = np.array([r["piece"] for r in rows], np.int32)
    return bounds, np.array([r["id"] for r in rows], np.int64), np.roll(pieces, 1)


def followed(docs: DataFrame) -> DataFrame:
    """The contract's row for every document: its fingerprint, its edited text's and likenesses."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = max(1, text_partitions(spark) * 2, -(-size // RANGE_BYTES))
    bounds, firsts, before = id_ranges(docs, ranges)

    def squeeze(batches):
        """Texts compressed, at about half of what the shuffle's own codec needs, with their range; the first
        row of each range also goes to the range before it (ahead = 1)."""
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches_of(batches, 1):
            packed = [press.compress((v or "").encode("utf-8", "surrogatepass")) for v in batch.column(1).to_pylist()]
            at = _ids(batch.column(0))
            piece = np.searchsorted(bounds, at, "right").astype(np.int32)
            k = np.minimum(np.searchsorted(firsts, at), len(firsts) - 1)
            lead = np.flatnonzero(firsts[k] == at)
            take = pa.array(np.concatenate([np.arange(len(at)), lead]))
            yield pa.record_batch(
                [
                    batch.column(0).take(take),
                    pa.array(packed, pa.binary()).take(take),
                    pa.array(np.concatenate([piece, before[k[lead]]])),
                    pa.array(np.repeat(np.array([0, 1], np.int32), [len(at), len(lead)])),
                    batch.column(2).take(take),
                ],
                ["doc_id", "packed", "piece", "ahead", "tie"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.crc32("text"))
    rows = rows.mapInArrow(squeeze, "doc_id bigint, packed binary, piece int, ahead int, tie bigint")
    dealt = rows.repartitionById(ranges, "piece").sortWithinPartitions("piece", "ahead", "doc_id", "tie", "packed").drop("tie")

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        last = waiting = None  # (piece, doc_id, text) before; a finished row but for near_next, and its signature
        for batch in batches_of(batches, 1, 256, 1 << 20):
            done = []
            for doc_id, packed, piece, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = str(unpress.decompress(packed), "utf-8", "surrogatepass") if packed else ""
                if last is not None and last[0] == piece:
                    before = last[2]
                    own, edited = both_signatures(before, text)
                    if waiting is not None:
                        done.append((*waiting[0], likeness(waiting[1], own)))
                    n = len(before)
                    changed = (before[: n - n // 2] + text[: n // 2]).encode("utf-8", "surrogatepass")
                    row = (last[1], n, sha256_hex(changed), to_text(own), to_text(edited), likeness(own, edited))
                    waiting = (row, own)
                    if ahead:
                        done.append((*row, likeness(own, one_signature(text))))
                        waiting = None
                last = None if ahead else (piece, doc_id, text)
            if done:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
