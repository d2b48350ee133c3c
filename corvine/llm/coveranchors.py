"""Operator 9: removal of repeated word passages by difference-cover anchors.

A window is LENGTH consecutive words. The places {0, 1, 3} modulo 7 form a difference cover: for any two
places i and j there is a shift below 7 that brings both onto the cover. So two equal windows always
share, at the same shift, an anchor of LENGTH - 6 words that starts at a cover place in both texts, and
only anchors at cover places are hashed and compared, three in seven.

Documents whose whole text is that of a document with a smaller doc_id lose all their words (if they have a
window) and send nothing; they are found first, by 96-bit digests.

1. every block sends its anchors to buckets and learns which of them another block has;
2. around anchors that repeat, in the block or elsewhere, the block extends to whole windows, and sends their
   hashes (96 bits) with the smallest doc_id it has for each; the bucket answers where another block has a
   smaller one;
3. the block extends the same anchors again and marks the words of windows that also start in a document
   with a smaller doc_id, by the answers or in the block. A window around no such anchor is never looked at.

Cases: NULL and empty texts have no words; with fewer than LENGTH words nothing is removed. Windows are
judged on the input. Rows that repeat a doc_id do not count as earlier than each other. A NULL doc_id
counts as smaller than any other. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvine.llm.blocks import (
    Block,
    Blocks,
    both_in,
    copied,
    cover,
    deal,
    deal_keys,
    groups,
    repeated_keys,
    repeats,
    smaller_elsewhere,
    told,
    whole_copies,
)
from corvine.llm.textkit import range_hashes, sha256_hex, word_hashes, words

LENGTH = 13
PERIOD = 7
COVER = (0, 1, 3)
U64 = np.uint64


class Passages:
    """Words of a block, its anchors and its windows."""

    def __init__(self, block: Block, length: int) -> None:
        self.block, self.length = block, length
        starts, ends, self.first = words(block.data, block.off)
        self.words = [word_hashes(block.data, starts, ends, k) for k in (0, 1)]
        n = len(starts)
        self.doc = np.repeat(np.arange(len(block.ids)), np.diff(self.first))
        self.place = np.arange(n) - self.first[:-1][self.doc] if n else np.zeros(0, np.int64)
        self.left = self.first[1:][self.doc] - np.arange(n) if n else np.zeros(0, np.int64)
        self.short = max(1, length - PERIOD + 1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of each anchor."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= self.short))
        return at, range_hashes(self.words[0], at, at + self.short)

    def around(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of these word indexes."""
        reach = self.length - self.short
        edge = np.zeros(len(self.place) + 1, np.int32)
        np.add.at(edge, at - np.minimum(reach, self.place[at]), 1)
        np.add.at(edge, at + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.length))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = range_hashes(self.words[0], at, at + self.length)
        b = range_hashes(self.words[1], at, at + self.length, 1)
        return a, (b >> U64(32)).astype(np.uint32)


def remove_passages(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    blocks = Blocks(docs, block_bytes=block_bytes)
    buckets, least = blocks.buckets, 2 * length - 1  # bytes of a document with a window

    def own_anchors(block: Block, more: pa.Table) -> tuple[Passages, np.ndarray, np.ndarray]:
        """Anchors of the documents that are no copies."""
        p = Passages(block, length)
        at, key = p.anchors()
        stay = ~copied(block, least, more)[p.doc[at]]
        return p, at[stay], key[stay]

    def send_anchors(block: Block, more: pa.Table) -> pa.Table:
        return deal_keys(block.number, own_anchors(block, more)[2], buckets)

    def repeated_windows(block: Block, more: pa.Table):
        """Starts, both lanes and documents of the windows around anchors that repeat."""
        p, at, key = own_anchors(block, more)
        start = p.around(at[repeats(key, more)])
        return p, start, *p.windows(start), p.doc[start]

    def extend(block: Block, more: pa.Table) -> pa.Table:
        _, _, a, b, doc = repeated_windows(block, more)
        first, _ = groups(a, b)
        first.sort()  # document order, for packing
        return deal(block.number, a[first], buckets, b[first], block.ids[doc[first]])

    def finish(block: Block, more: pa.Table) -> pa.Table:
        p, start, a, b, doc = repeated_windows(block, more)
        first, where = groups(a, b)
        again = block.ids[doc[first[where]]] < block.ids[doc]
        again |= both_in(a, b, *told(more, U64, np.uint32))
        long = np.diff(p.first) >= length
        gone = cover(start[again], length, len(p.place)) | (copied(block, least, more) & long)[p.doc]
        removed = np.add.reduceat(np.append(gone, False), p.first[:-1]) * (np.diff(p.first) > 0)
        digests, keep = [], ~gone
        raw, off, first = block.data, block.off.tolist(), p.first.tolist()
        for i in range(len(block.ids)):
            piece = raw[off[i] : off[i + 1]].tobytes().split()
            if removed[i]:
                piece = compress(piece, keep[first[i] : first[i + 1]].tolist())
            digests.append(sha256_hex(b" ".join(piece)))
        return block.result(
            {
                "n_words": pa.array(np.diff(p.first)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    copies = whole_copies(blocks, least)
    flagged = repeated_keys(blocks.map_with(copies, send_anchors, "bucket bigint, block bigint, keys binary"))
    both = flagged.unionByName(copies, allowMissingColumns=True)
    sent = blocks.map_with(both, extend, "bucket bigint, block bigint, keys binary, more0 binary, more1 binary")
    both = smaller_elsewhere(sent).unionByName(both, allowMissingColumns=True)
    return blocks.map_with(both, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
