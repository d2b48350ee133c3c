"""Operator 6: removal of repeated byte strings by a run-length Burrows-Wheeler index.

A string is LENGTH bytes of one document's UTF-8 text. Strings that can repeat are brought together first:
every string chooses the smallest hash among its PIECE-byte pieces, so equal strings choose equally, and a
stretch of neighbouring strings with one choice is one record. Choices that occur once in the corpus
drop out; the records of the others, which are short pieces of text from a repetitive corpus, go to the
bucket of their choice.

Documents whose whole text is that of a document with a smaller doc_id lose all their bytes and need no
record; they are found first, by 96-bit digests. Of records that are equal in a block only the earliest goes
on: the others repeat it as a whole, which the block knows itself.

A choice of more than HEAVY records, as the borders of a passage in a third of all documents make one, does
not go to one bucket. Its records are cut into their strings, block by block; strings whose hashes occur
once drop out, and the others go, once for each block, to the bucket of their own hash.

A bucket is judged in parts of about PART_BYTES, which hold whole choices. In a part the different records
are indexed: the Burrows-Wheeler transform is kept as runs, with the row to which LF takes each run's start.
Rows whose suffixes share LENGTH bytes are an interval; LF takes the intervals of a repeated passage
together from one to the next, as long as one run holds all rows, until the transform branches. Only the
ends of such chains are sampled: first row, number of rows, steps until the branch, and the earliest place.
Nothing that is kept is as long as the suffixes; a passage costs the same in two records as in a thousand.

All records stream through the index from right to left, many at a time: LF gives the row, a sample is looked
up where a chain begins, and its earliest place moves on with the steps. These are the matching statistics as
far as the task needs them: whether LENGTH bytes match elsewhere, and where they start first.

Cases: NULL and empty texts have no bytes; texts below LENGTH bytes lose nothing. Matches never cross
documents. Strings are judged on the input. Rows that repeat a doc_id count as one document: equal places
of them are not earlier than each other. A NULL doc_id counts as smaller than any other. Extra columns are
ignored. A single text is handled as a whole by one worker.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvine.llm.blocks import (
    Block,
    Blocks,
    answer,
    coarse,
    copied,
    deal_keys,
    groups,
    is_in,
    keys_told,
    repeated_keys,
    repeats,
    told,
    whole_copies,
)
from corvine.llm.textkit import BYTE_VALUE, chunks, pack, range_hashes, release, rolling_hashes, sha256_hex, spans, unpack

LENGTH = 100
#: Bytes of the pieces by whose hashes strings are brought together: long enough that pieces of unrelated
#: prose seldom agree, and less than half of LENGTH, so that records stay few.
PIECE = 48
#: Strings of one record at most; longer stretches become several records.
STRETCH = 53
#: Bytes of records that one index holds, unless one choice has more.
PART_BYTES = 1 << 18
#: Records of one choice, equal ones of a block counted once, from which the choice is cut into strings.
HEAVY = 4096
U64 = np.uint64
_NONE = np.zeros(0, np.int64)


def records(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Choice, first start and last start of each stretch of strings with one choice."""
    n = len(data)
    piece = min(PIECE, length)
    span = length - piece + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, U64), none, none
    least = rolling_hashes(BYTE_VALUE[0][data], piece)
    have = 1  # least[i] is the minimum of `have` hashes from i on
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    whole = off[:-1][np.diff(off) >= length]  # documents with a string, and the end of their starts
    if not len(whole):
        return np.zeros(0, U64), none, none
    stop = off[1:][np.diff(off) >= length] - length + 1
    new = np.empty(len(least), bool)
    new[0], new[1:] = True, least[1:] != least[:-1]
    new[whole] = True
    new[stop[stop < len(new)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(least)))
    if size.max() > STRETCH:
        parts = -(-size // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + nth * STRETCH
        size = np.diff(np.append(first, len(least)))
    doc = np.searchsorted(whole, first, "right") - 1
    inside = (doc >= 0) & (first < stop[np.maximum(doc, 0)])
    first, size = first[inside], size[inside]
    return least[first], first, first + size - 1


def repeats_inside(data: np.ndarray, choice: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Records whose choice occurs twice in them, as in periodic text, where strings can repeat inside."""
    if not len(choice):
        return np.zeros(0, bool)
    piece = min(PIECE, length)
    h = rolling_hashes(BYTE_VALUE[0][data], piece)
    size = last - first + 1 + length - piece
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(first - begin, size)
    return np.add.reduceat((h[at] == np.repeat(choice, size)).astype(np.int32), begin) > 1


class RunIndex:
    """Run-length BWT over many strings, each ended by its own separator; separators sort first, in order.

    starts, lf: first row of each run of equal symbols, and the row to which LF takes it. entry: of each string,
    the row where its stream begins. heads, rows, steps,
    samples: of each chain of intervals its first row, the number of rows, the LF steps that keep them
    together and the earliest place of its suffixes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int) -> None:
        count = len(off) - 1
        size = np.diff(off)
        n = len(data) + count
        ends = off[1:] + np.arange(count)  # places of the separators
        symbol, order, same = _sorted_suffixes(data, size, ends, length)
        last = np.where(order > 0, symbol[order - 1], 0)
        head = np.ones(n, bool)
        head[1:] = last[1:] != last[:-1]
        self.starts = np.flatnonzero(head).astype(np.int32)
        run_symbol = last[self.starts]
        run_size = np.diff(np.append(self.starts, n))
        by = np.argsort(run_symbol, kind="stable")
        self.lf = np.empty(len(by), np.int32)
        self.lf[by] = np.cumsum(run_size[by]) - run_size[by]
        self.size, self.ends, self.length = size, ends, length
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.entry = place[np.maximum(ends - length, 0)]  # of each string, the row of its last `length` bytes
        # intervals of several rows
        begin = np.flatnonzero(~same)
        tall = np.diff(np.append(begin, n))
        many = tall > 1
        begin_all, begin, tall = begin, begin[many], tall[many]
        if not len(begin):
            self.heads = self.rows = self.steps = self.samples = _NONE
            return
        earliest = np.minimum.reduceat(order, begin_all)[many]
        run = self.run(begin)
        to = self.lf[run] + begin - self.starts[run]
        at = np.minimum(np.searchsorted(begin, to), len(begin) - 1)
        together = (run == self.run(begin + tall - 1)) & (begin[at] == to) & (tall[at] == tall)
        follower = np.where(together, at, np.arange(len(begin)))
        steps = together.astype(np.int64)
        while True:  # chains by doubling
            further = steps + steps[follower]
            if (further == steps).all():
                break
            steps, follower = further, follower[follower]
        first = np.ones(len(begin), bool)
        first[at[together]] = False
        self.heads, self.rows, self.steps, self.samples = (x[first] for x in (begin, tall, steps, earliest))

    def run(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, rows, "right") - 1

    def step(self, rows: np.ndarray) -> np.ndarray:
        run = self.run(rows)
        return self.lf[run] + rows - self.starts[run]

    def stream(self):
        """Over the strings from their ends, yields (string numbers, places, earliest places of the same
        LENGTH bytes) for every place whose LENGTH bytes occur more than once."""
        live = np.argsort(-self.size, kind="stable")
        if not len(self.heads):
            return
        rows = self.entry[live].astype(np.int64)
        chain = np.full(len(live), -1)
        done_in = np.zeros(len(live), np.int64)
        for done in range(self.length, int(self.size.max(initial=0)) + 1):
            n = np.searchsorted(-self.size[live], -done, "right")
            live, chain, done_in, rows = live[:n], chain[:n], done_in[:n], rows[:n]
            if done > self.length:
                rows = self.step(rows)
            done_in += 1
            free = np.flatnonzero((chain < 0) | (done_in > self.steps[chain]))
            at = np.searchsorted(self.heads, rows[free], "right") - 1
            inside = (at >= 0) & (rows[free] < self.heads[at] + self.rows[at])
            chain[free], done_in[free] = np.where(inside, at, -1), 0
            k = np.flatnonzero(chain >= 0)
            yield live[k], self.ends[live[k]] - done, self.samples[chain[k]] - done_in[k]


def _sorted_suffixes(data: np.ndarray, size: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with separators (0), the order of all suffixes, and which rows share `length` bytes with the row
    before; by prefix doubling."""
    n = len(data) + len(size)
    symbol = np.zeros(n, np.int64)
    text = np.ones(n, bool)
    text[ends] = False
    used = np.bincount(data, minlength=256) > 0
    symbol[text] = np.cumsum(used)[data]  # from 1, in byte order
    left = np.repeat(ends, size + 1) - np.arange(n)  # bytes before the separator
    bits = max(1, int(used.sum()).bit_length())
    depth = 63 // bits  # symbols in the first sort key
    padded = np.append(symbol, np.zeros(max(depth, length), np.int64))
    rank = np.zeros(n, np.int64)
    for k in range(depth):
        rank <<= bits
        rank |= np.where(left >= k, padded[k : k + n], 0)
    rank = _dense(rank)
    half, exact = None, 0
    while True:
        if half is None and 2 * depth >= length:
            half, exact = rank, depth  # ranks of a depth between half the length and the length
        if depth > size.max(initial=0):
            break
        ahead = np.zeros(n, np.int64)
        ok = left >= depth
        ahead[ok] = rank[np.flatnonzero(ok) + depth]
        rank = _dense(rank * (n + 2) + ahead)
        depth *= 2
    order = np.argsort(rank * (n + 1) + np.arange(n))  # ties end in separators: by their order
    if exact > length:  # strings shorter than the first key: compare their own prefixes
        half, exact = _prefix_ranks(padded, left, n, length, bits), length
    long = left[order] >= length
    same = np.zeros(n, bool)
    shift = length - exact
    near = np.flatnonzero(long[1:] & long[:-1])
    a, b = order[near + 1], order[near]
    same[near + 1] = (half[a] == half[b]) & (half[a + shift] == half[b + shift])
    return symbol, order, same


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 of equal keys."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new)
    return out


def _prefix_ranks(padded: np.ndarray, left: np.ndarray, n: int, length: int, bits: int) -> np.ndarray:
    key = np.zeros(n, np.int64)
    for k in range(length):
        key = key << bits | np.where(left >= k, padded[k : k + n], 0)
    return _dense(key)


def earlier_places(data: np.ndarray, off: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For strings data[off[i]:off[i+1]] taken from place at[i] of document ids[i]: one flag for each byte,
    true where `length` bytes start that also start at an earlier (document, place)."""
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    size = np.diff(off)
    order = np.lexsort((at, ids))
    two = [np.empty(len(size), U64), np.empty(len(size), U64)]
    for a, b in chunks(off):
        piece, inner = data[off[a] : off[b]], off[a : b + 1] - off[a]
        for k in (0, 1):
            two[k][a:b] = range_hashes(BYTE_VALUE[k][piece], inner[:-1], inner[1:], k)
    seen = np.lexsort((np.argsort(order), two[1], two[0]))  # equal strings, earliest first
    new = np.ones(len(seen), bool)
    a, b = seen[1:], seen[:-1]
    new[1:] = (two[0][a] != two[0][b]) | (two[1][a] != two[1][b]) | (size[a] != size[b])
    first = seen[np.maximum.accumulate(np.where(new, np.arange(len(seen)), 0))]
    # a copy of an earlier record repeats it as a whole
    again = (ids[first] < ids[seen]) | ((ids[first] == ids[seen]) & (at[first] < at[seen]))
    edge = np.zeros(len(data) + 1, np.int32)
    edge[off[seen[again]]] += 1
    edge[off[seen[again] + 1] - length + 1] -= 1
    out |= np.cumsum(edge[:-1]) > 0
    kept = np.sort(np.argsort(order)[seen[new]])
    kept = order[kept]  # different records by (document, place)
    inner = np.concatenate(([0], np.cumsum(size[kept])))
    places = np.arange(inner[-1]) + np.repeat(off[kept] - inner[:-1], size[kept])
    index = RunIndex(data[places], inner, length)
    begin = inner[:-1] + np.arange(len(kept))
    for strings, place, earliest in index.stream():
        other = np.searchsorted(begin, earliest, "right") - 1
        here, there = kept[strings], kept[other]
        p, q = at[here] + place - begin[strings], at[there] + earliest - begin[other]
        hit = (ids[there] < ids[here]) | ((ids[there] == ids[here]) & (q < p))
        out[off[here[hit]] + (place - begin[strings])[hit]] = True
    # an equal record at the same place of the same document, from a repeated row, has the flags of the first
    twin = np.flatnonzero(~new & ~again)
    for a, b in chunks(np.concatenate(([0], np.cumsum(size[seen[twin]])))):
        to, source = seen[twin[a:b]], first[twin[a:b]]
        n = size[to]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(off[to], n) + within] = out[np.repeat(off[source], n) + within]
    return out


def combine(values: np.ndarray, lanes: tuple[np.ndarray, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple:
    """Of equal records, given their two lanes of hashes, document ids and places: a mask of those that go on (the
    earliest of each), a mask of those that repeat one at an earlier place, and for every record its earliest.
    What is in neither mask shares its place with its earliest, in a row that repeats the doc_id."""
    order = np.lexsort((at, ids))
    first, where = groups(lanes[0][order], lanes[1][order])
    origin = np.empty(len(values), np.int64)
    origin[order] = order[first[where]] if len(order) else order
    kept = origin == np.arange(len(values))
    again = (ids[origin] < ids) | ((ids[origin] == ids) & (at[origin] < at))
    return kept, again, origin


SENT = "bucket bigint, block bigint, records binary, done binary, twin binary"
JUDGED = "block bigint, a0 binary, a1 binary, a2 binary, twin binary"


#: Columns of packed records before their text.
RECORD = [("choice", np.uint32), ("ids", np.int64), ("row", np.int32), ("at", np.int32), ("size", np.int32)]


def ship(number: int, to: np.ndarray, home: int, choice, ids, row, at, first, size, data, done, twin) -> pa.Table:
    """Rows (SENT) with the records data[first:first + size], packed by bucket; and one in the bucket `home` with
    what the block knows itself: done, rows (document, place, strings) whose strings all repeat earlier ones,
    and twin, rows (document, place, strings, document that has the same strings at the same place)."""
    order = np.argsort(to, kind="stable")
    rows = []
    columns = [np.ascontiguousarray(c[order], k) for c, (_, k) in zip((choice >> U64(32), ids, row, at, size), RECORD, strict=True)]
    n, first, to = size[order].astype(np.int64), first[order], to[order]
    cut = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cut], [*cut, len(order)], strict=True) if len(order) else ():
        base = np.cumsum(n[a:b]) - n[a:b]
        text = data[np.arange(n[a:b].sum()) + np.repeat(first[a:b] - base, n[a:b])]
        raw = b"".join([np.int64(b - a).tobytes(), *(c[a:b].tobytes() for c in columns), text.tobytes()])
        rows.append((int(to[a]), number, zlib.compress(raw, 1), None, None))
    if len(done) or len(twin):
        rows.append((home, number, None, pack(done.astype(np.int64)), pack(twin.astype(np.int64))))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
    names = [c.split()[0] for c in SENT.split(", ")]
    out = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def opened(table: pa.Table) -> tuple[np.ndarray, ...]:
    """block, choice, ids, row, at, size and offsets of the records of SENT rows, and their text."""
    parts, blocks = [[] for _ in range(6)], []
    for number, packed in zip(table.column("block").to_pylist(), table.column("records"), strict=True):
        if not packed.is_valid:
            continue
        raw = zlib.decompress(packed.as_buffer())
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for part, (_, kind) in zip(parts, RECORD, strict=False):
            part.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts[5].append(np.frombuffer(raw, np.uint8, -1, at))
        blocks.append((number, n))
    kinds = [*(k for _, k in RECORD), np.uint8]
    choice, ids, row, at, size, text = (np.concatenate([np.zeros(0, k), *p]) for p, k in zip(parts, kinds, strict=True))
    block = np.repeat(np.array([b for b, _ in blocks], np.int64), [n for _, n in blocks])
    off = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    return block, choice, ids, row, at.astype(np.int64), size.astype(np.int64), off, text


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    blocks = Blocks(docs, block_bytes=block_bytes)
    buckets, heavy_from, part_bytes = blocks.buckets, HEAVY, PART_BYTES

    def own_records(block: Block, more: pa.Table) -> tuple:
        """Choice, first byte, number of strings, document and place of each record, and what combine says."""
        gone = copied(block, length, more)
        choice, first, last = records(block.data, block.off, length)
        doc = block.owners(first)
        stay = ~gone[doc]
        choice, first, n, doc = choice[stay], first[stay], (last - first + 1)[stay], doc[stay]
        at = first - block.off[doc]
        lanes = tuple(range_hashes(BYTE_VALUE[k][block.data], first, first + n + length - 1, k) for k in (0, 1))
        return choice, first, n, doc, at, combine(first, lanes, block.ids[doc], at)

    def send_choices(block: Block, more: pa.Table) -> pa.Table:
        choice, *_, (kept, _, _) = own_records(block, more)
        return deal_keys(block.number, choice[kept], buckets, count=True)

    def send_records(block: Block, more: pa.Table) -> pa.Table:
        choice, first, n, doc, at, (kept, again, origin) = own_records(block, more)
        same = np.flatnonzero(~kept & ~again)
        twin = np.stack((doc[same], at[same], n[same], doc[origin[same]]), 1)
        flag = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(flag, first[again], 1)
        np.add.at(flag, (first + n)[again], -1)
        start, end, _ = spans(np.cumsum(flag[:-1]) > 0, block.off)
        owner = block.owners(start)
        done = np.stack((owner, start - block.off[owner], end - start), 1)
        choice, first, n, doc, at = (x[kept] for x in (choice, first, n, doc, at))
        use = repeats(choice, more)
        rest = np.flatnonzero(~use)
        use[rest[repeats_inside(block.data, choice[rest], first[rest], (first + n - 1)[rest], length)]] = True
        choice, first, n, doc, at = (x[use] for x in (choice, first, n, doc, at))
        to = (choice % U64(buckets)).astype(np.int64)
        to[is_in(coarse(choice), keys_told(more, "heavy"))] = buckets + block.number
        home = block.number % buckets
        return ship(block.number, to, home, choice, block.ids[doc], doc, at, first, n + length - 1, block.data, done, twin)

    def heavy_strings(table: pa.Table) -> tuple:
        """Of a block's records of heavy choices: owner and first byte of each string, and its hash."""
        block, _, ids, row, at, size, off, text = opened(table)
        n = size - length + 1
        owner = np.repeat(np.arange(len(n)), n)
        first = np.arange(n.sum()) + np.repeat(off[:-1] - (np.cumsum(n) - n), n)
        values = range_hashes(BYTE_VALUE[0][text], first, first + length)
        return owner, first, values, ids[owner], row[owner], at[owner] + first - off[owner], text

    def send_strings(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        if number < buckets:
            return deal_keys(number, np.zeros(0, U64), buckets)
        return deal_keys(number, heavy_strings(table)[2], buckets)

    def cut(table: pa.Table, more: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py() if table.num_rows else 0
        if number < buckets:
            return ship(0, _NONE, 0, np.zeros(0, U64), _NONE, _NONE, _NONE, _NONE, _NONE, np.zeros(0, np.uint8), _NONE, _NONE)
        _, first, values, ids, row, at, text = heavy_strings(table)
        use = repeats(values, more)
        first, values, ids, row, at = (x[use] for x in (first, values, ids, row, at))
        second = range_hashes(BYTE_VALUE[1][text], first, first + length, 1)
        kept, again, origin = combine(first, (values, second), ids, at)
        same = np.flatnonzero(~kept & ~again)
        one = np.ones(len(first), np.int64)
        done = np.stack((row[again], at[again], one[again]), 1)
        twin = np.stack((row[same], at[same], one[same], row[origin[same]]), 1)
        first, values, ids, row, at = (x[kept] for x in (first, values, ids, row, at))
        to = ((values >> U64(16)) % U64(buckets)).astype(np.int64)
        size = np.full(len(first), length)
        block = number - buckets
        return ship(block, to, block % buckets, values, ids, row, at, first, size, text, done, twin)

    def judge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        known = [(b.as_py(), d, t) for b, d, t in zip(*(table.column(c) for c in ("block", "done", "twin")), strict=True) if d.is_valid]
        out = []
        for block, done, twin in known:
            row, at, n = unpack(done.as_py(), np.int64).reshape(-1, 3).T
            out.append((block, *map(pack, (row.astype(np.int32), at, n)), twin.as_py()))
        found = []
        if bucket < buckets:
            block, choice, ids, row, at, size, off, text = opened(table)
            order = np.argsort(choice, kind="stable")
            begin = np.flatnonzero(np.diff(choice[order], prepend=~choice[order[:1]]))
            ends = np.append(begin[1:], len(order))
            reach = np.cumsum(size[order])
            a = 0
            while a < len(begin):
                limit = (reach[begin[a] - 1] if begin[a] else 0) + part_bytes
                b = max(a + 1, int(np.searchsorted(reach[ends - 1], limit, "right")))
                part = np.sort(order[begin[a] : ends[b - 1]])
                inner = np.concatenate(([0], np.cumsum(size[part])))
                source = np.arange(inner[-1]) + np.repeat(off[part] - inner[:-1], size[part])
                flags = earlier_places(text[source], inner, ids[part], at[part], length)
                start, end, _ = spans(flags, inner)
                owner = np.searchsorted(inner, start, "right") - 1
                which = part[owner]
                found.append((block[which], row[which], at[which] + start - inner[owner], end - start))
                a = b
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [_NONE, np.zeros(0, np.int32), _NONE, _NONE]
        table = answer(*columns)
        table = table.append_column("twin", pa.nulls(table.num_rows, pa.binary()))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        own = list(zip(*out, strict=True)) or [[]] * 5
        more = pa.table([pa.array(c, k) for c, k in zip(own, kinds, strict=True)], table.column_names)
        release()
        return pa.concat_tables([table, more])

    def finish(block: Block, more: pa.Table) -> pa.Table:
        row, at, n = told(more, np.int32, np.int64, np.int64)
        edge = np.zeros(len(block.data) + 1, np.int32)
        begin = block.off[row] + at
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + n, -1)
        start = np.cumsum(edge[:-1]) > 0
        for v in more.column("twin"):
            for to, place, strings, source in unpack(v.as_py(), np.int64).reshape(-1, 4).tolist() if v.is_valid else ():
                a, b = int(block.off[to]) + place, int(block.off[source]) + place
                start[a : a + strings] |= start[b : b + strings]
        first, last, _ = spans(start, block.off)
        edge[:] = 0
        np.add.at(edge, first, 1)
        np.add.at(edge, last - 1 + length, -1)
        gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(copied(block, length, more), np.diff(block.off))
        _, _, runs = spans(gone, block.off)
        total = np.concatenate(([0], np.cumsum(gone)))[block.off]
        keep, off = ~gone, block.off.tolist()
        digests = []
        for i, lost in enumerate(np.diff(total).tolist()):
            piece = block.data[off[i] : off[i + 1]]
            digests.append(sha256_hex((piece[keep[off[i] : off[i + 1]]] if lost else piece).tobytes()))
        release()
        return block.result(
            {
                "n_bytes": pa.array(np.diff(block.off)),
                "n_removed": pa.array(np.diff(total)),
                "n_spans": pa.array(np.diff(runs)),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    copies = whole_copies(blocks, length)
    keys = "bucket bigint, block bigint, keys binary"
    flagged = repeated_keys(blocks.map_with(copies, send_choices, keys + ", many binary"), heavy_from)
    sent = blocks.map_with(flagged.unionByName(copies, allowMissingColumns=True), send_records, SENT)
    again = repeated_keys(sent.groupBy("bucket").applyInArrow(send_strings, keys)).withColumnRenamed("block", "bucket")
    strings = sent.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(cut, SENT)
    judged = [x.groupBy("bucket").applyInArrow(judge, JUDGED) for x in (sent, strings)]
    both = judged[0].unionByName(judged[1]).unionByName(copies, allowMissingColumns=True)
    return blocks.map_with(
        both, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
