"""Operator 11: periodic runs of words, by the runs theorem.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run has a Lyndon root
that is the longest Lyndon word from its place under an order of the words or under the reverse order. So:

1. The suffix array of the words gives, inverted, the rank of each suffix; the longest Lyndon word at i ends before
   the next place whose rank is smaller. Ranks under the reverse order come from the complemented words.
2. Each such root [i, j) is extended to the right by the longest common prefix of the suffixes at i and j, and to the
   left by that of the reversed text, both read as range minima of an LCP array through a sparse table over blocks.
3. What is long enough is a run with the root's length as its smallest period, once for each of its roots.

A run of `least` words and `exponent` periods repeats each of its grams of `gram_width` words inside the document, so
stretches of such grams hold every run that counts, and only they are indexed; in prose these are few. Grams are
compared by a hash that equal words share, so a collision adds work and drops nothing; the runs themselves are found
on the words as they are.

A document is handled by one task and nothing is shuffled. Memory follows the longest document: some 150 bytes a word
that lies in a repeating stretch.

Cases: NULL and empty texts have no words and no runs. Rows are judged one by one, so repeated rows and ids give
repeated results; a NULL doc_id stays. A table without rows gives none. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import batches_of, chunks, flat, mix, release, spans, word_hashes, words

LEAST = 24
EXPONENT = 3
U64 = np.uint64
#: Places of one block of an LCP array.
BLOCK = 32


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by prefix doubling; only suffixes that are still alike are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank, alike = np.empty(n, np.int64), _regroup(codes[order])
    rank[order] = alike[0]
    active, h = order[alike[1]], 1
    while len(active):
        key = rank[active] * (n + 1) + rank[active + h]  # the text ends in a code of its own, so it is not passed
        by = np.argsort(key)
        active, key = active[by], key[by]
        group, _ = _regroup(rank[active])
        part, more = _regroup(key)
        rank[active] += part - group
        active, h = active[more], 2 * h
    return rank


def _regroup(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: where each one's group starts, and whether it has others in it."""
    at = np.arange(len(values))
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    start = np.maximum.accumulate(np.where(new, at, 0))
    single = new & np.append(new[1:], True)
    return start, ~single


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place, the next one with a smaller rank, or the length."""
    r, n = rank.tolist(), len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, r[i]
        while j < n and r[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def common_prefixes(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array: what the suffix of each rank shares with the one before it."""
    n = len(codes)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    text, places, suffixes = codes.tolist(), rank.tolist(), suffix.tolist()
    out, h = [0] * n, 0
    for i, r in enumerate(places):
        if not r:
            h = 0
            continue
        j = suffixes[r - 1]
        while text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int32)


class Minima:
    """Range minima: a sparse table over the minima of blocks, and minima from both ends of each block."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = -(-len(values) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        square = padded.reshape(blocks, BLOCK)
        self.values = padded
        self.from_start = np.minimum.accumulate(square, 1).ravel()
        self.from_end = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [square.min(1)] if blocks else []
        step = 1
        while 2 * step <= blocks:
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of the ranges [a, b], both ends included."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.from_end[a], self.from_start[b])
        inside = np.flatnonzero(first == last)
        for i in range(0, len(inside), 1 << 16):
            rows = inside[i : i + (1 << 16)]
            at = a[rows, None] + np.arange(BLOCK)
            held = self.values[np.minimum(at, len(self.values) - 1)]
            out[rows] = np.where(at <= b[rows, None], held, held[:, :1]).min(1)
        width = last - first - 1  # whole blocks between
        level = np.frexp(np.maximum(width, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[width > 0]).tolist():
            rows = np.flatnonzero((width > 0) & (level == k))
            t = self.table[k]
            out[rows] = np.minimum(out[rows], np.minimum(t[first[rows] + 1], t[last[rows] - (1 << k)]))
        return out


class Extensions:
    """Longest common prefixes of any two suffixes."""

    def __init__(self, codes: np.ndarray, rank: np.ndarray | None = None) -> None:
        self.rank = suffix_ranks(codes) if rank is None else rank
        self.minima = Minima(common_prefixes(codes, self.rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def runs_of(codes: np.ndarray, separator: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of the runs between separators. codes: each separator has one of its own, below
    all others; there is one at either end."""
    n, found = len(codes), []
    rank = suffix_ranks(codes)
    right = Extensions(codes, rank)
    left = Extensions(codes[::-1].copy())
    top = int(codes.max())
    least_word = int(separator.sum())
    other = np.where(separator, codes, top + least_word - codes)  # the words in reverse order, the ends still first
    for r in (rank, suffix_ranks(other)):
        j = next_smaller(r)
        i = np.flatnonzero(~separator & (j < n))
        i = i[~separator[j[i]]]
        j = j[i]
        start = i - left(n - i, n - j)
        end = j + right(i, j)
        enough = (end - start >= least) & (end - start >= exponent * (j - i))
        found.append(np.stack([start[enough], end[enough], (j - i)[enough]], 1))
    return np.unique(np.concatenate(found), axis=0)


def gram_width(least: int, exponent: int) -> int:
    """Words of a gram such that a run holds each of its grams twice: there are as many words beyond two periods."""
    return max(1, min(8, least * (exponent - 2) // exponent + 1))


def repeating(codes: np.ndarray, first: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Word ranges that hold all runs: stretches of grams that occur twice in their document. codes: hashes of words,
    first: the words before each document."""
    width = gram_width(least, exponent)
    n = len(codes) - width + 1
    if n <= 0:
        return []
    gram = np.zeros(n, U64)
    for k in range(width):
        gram = mix(gram + codes[k : k + n])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gram = mix(gram ^ (doc[:n].astype(U64) * U64(0x9E3779B97F4A7C15)))
    whole = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(gram[at])]
    same = gram[order[1:]] == gram[order[:-1]]
    marked = np.zeros(len(codes), bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    starts, ends, _ = spans(marked, first)
    long = ends - starts >= least - width + 1
    return list(zip(starts[long].tolist(), (ends[long] + width - 1).tolist(), strict=True))


def _runs_in_chunk(pieces: list, ranges: list[tuple[int, int]], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) in numbers of the chunk's words. pieces: the words of each range."""
    k, code, place, ids = len(ranges) + 1, [0], [-1], {}
    for number, ((a, _), own) in enumerate(zip(ranges, pieces, strict=True)):
        code += [k + ids.setdefault(w, len(ids)) for w in own]
        place += range(a, a + len(own))
        code.append(number + 1)
        place.append(-1)
    codes, places = np.array(code, np.int64), np.array(place, np.int64)
    found = runs_of(codes, places < 0, least, exponent)
    start = places[found[:, 0]]
    return list(zip(start.tolist(), (start + found[:, 1] - found[:, 0]).tolist(), found[:, 2].tolist(), strict=True))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(
    docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, rearrange: Callable[[int | None, int], np.ndarray | None] | None = None
) -> DataFrame:
    """For every row doc_id, n_words, runs (start, length, period; by start, then period) of at least `least` words and
    `exponent` periods, best: the run with the greatest length / period (then the first), and collapsed: the words
    without those that a run holds after its first period, joined by one space. rearrange: for a doc_id and a number
    of words, which word of the text stands at each place, or None."""
    if exponent < 2 or least < 1:
        raise ValueError("runs have at least one word and two periods")

    def chunk_rows(ids: list, data: np.ndarray, off: np.ndarray) -> list[dict]:
        starts, ends, first = words(data, off)
        source = np.arange(len(starts))
        moved = np.zeros(len(ids), bool)
        bounds = first.tolist()
        for k, i in enumerate(ids):
            own = rearrange(i, bounds[k + 1] - bounds[k]) if rearrange else None
            if own is not None:
                source[bounds[k] : bounds[k + 1]] = bounds[k] + own
                moved[k] = True
        codes = word_hashes(data, starts, ends)[source]
        ranges = repeating(codes, first, least, exponent)
        raw, s, e, src = data.tobytes(), starts.tolist(), ends.tolist(), source.tolist()
        runs = [[] for _ in ids]
        if ranges:
            pieces = [[raw[s[w] : e[w]] for w in src[a:b]] for a, b in ranges]
            found = _runs_in_chunk(pieces, ranges, least, exponent)
            doc = np.searchsorted(first, [a for a, _, _ in found], "right") - 1
            for d, (a, b, period) in zip(doc.tolist(), found, strict=True):
                runs[d].append({"start": a - bounds[d], "length": b - a, "period": period})
        rows, limits = [], off.tolist()
        for k, i in enumerate(ids):
            a, n = bounds[k], bounds[k + 1] - bounds[k]
            own = raw[limits[k] : limits[k + 1]].split()
            if moved[k]:
                own = [own[w - a] for w in src[a : a + n]]
            listed = sorted(runs[k], key=lambda r: (r["start"], r["period"]))
            if listed:
                gone = np.zeros(n, bool)
                for r in listed:
                    gone[r["start"] + r["period"] : r["start"] + r["length"]] = True
                own = [own[w] for w in np.flatnonzero(~gone).tolist()]
            best = max(listed, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
            rows.append({"doc_id": i, "n_words": n, "runs": listed, "best": best, "collapsed": b" ".join(own).decode()})
        return rows

    def run(batches):
        for batch in batches_of(batches, 1):
            schema = pa.schema(
                [("doc_id", batch.column(0).type), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())]
            )
            data, off = flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in chunks(off):
                o = off[a : b + 1]
                yield pa.RecordBatch.from_pylist(chunk_rows(ids[a:b], data[o[0] : o[-1]], o - o[0]), schema)
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "struct<start:bigint,length:bigint,period:bigint>"
    out = f"doc_id {kind}, n_words bigint, runs array<{shape}>, best {shape}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, out)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """A repetition that is put into one document in ten, by its doc_id; none for a NULL one."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % (1 + (n - a) // (3 + g % 8)))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of the documents with planted repetitions, as numbers and digests."""
    found = find_runs(docs, rearrange=planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
