"""Many requests at once: document frequencies and scores of all of them, in one pass each over the rows of
postings.block_rows. With thousands of terms most postings are asked for, so a task takes its blocks as they are
stored, whole, and what it gives on is small: counts, and the rows that can be results.

Strings are compared as UTF-8 bytes, as Spark compares them. Parts of a score are added in the order of the query's
terms, by the same operations as scoring.bm25_term, so scores are bit for bit those of other searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions import scoring as S
from corvine.operators.ranking import PER_FILE

#: Bytes of words that are taken at once, by either pass; (block, term) cells; rows that are given on at once.
COUNTED, SCORED, CELLS, GIVEN = 2 << 20, 8 << 20, 1 << 25, 50_000


@dataclass
class Asked:
    """A request: its number, limit, lower-cased text, filter and terms by number."""

    request: int
    limit: int
    query: bytes
    filter: int
    terms: list[int]


def _bytes(column):
    import pyarrow as pa

    return column.cast(pa.binary())


def _true(column) -> np.ndarray:
    """A column of booleans, NULL as false."""
    import pyarrow.compute as pc

    return pc.fill_null(column, False).to_numpy(zero_copy_only=False)


def _pieces(batch, column: str, most: int, rows: int) -> Iterator:
    """The batch in parts of about `most` bytes of a column and at most `rows` rows."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _words(column):
    """The words of a column of words joined by spaces, and the row of each."""
    import pyarrow.compute as pc

    parts = pc.split_pattern(_bytes(column), pattern=" ")
    rows = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), rows[some.to_numpy(zero_copy_only=False)]


def _passes(batch, filters: list[tuple[list[str] | None, str | None]]) -> list[np.ndarray]:
    """For each filter of languages and a part of the path, which rows pass."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = []
    for languages, path in filters:
        passed = np.ones(batch.num_rows, bool)
        if languages is not None:
            passed &= _true(pc.is_in(_bytes(batch.column("language")), pa.array([x.encode() for x in languages if x is not None], pa.binary())))
            passed &= _true(batch.column("language").is_valid())
        if path is not None:
            passed &= _true(pc.match_substring(_bytes(batch.column("file_path")), path.encode()))
        out.append(passed)
    return out


class _Terms:
    """Finds terms inside words. The bytes from each place on, up to eight of them, are one number; longer terms are compared
    where their first eight bytes stand."""

    def __init__(self, terms: list[bytes]) -> None:
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[int, list[tuple[int, bytes]]] = {}
        by: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            by.setdefault(min(len(t), 8), []).append((int.from_bytes(t[:8], "big"), i if len(t) <= 8 else -1))
            if len(t) > 8:
                self.long.setdefault(int.from_bytes(t[:8], "big"), []).append((i, t))
        for k, own in by.items():
            keys = dict(sorted(own))  # a term of eight bytes follows longer ones that begin with it
            self.short[k] = np.fromiter(keys, np.uint64, len(keys)), np.fromiter(keys.values(), np.int64, len(keys))

    def of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Terms that words, an Arrow array of bytes, hold: how many each word has, and their numbers, word by word. A term that
        a word holds several times may be there as often."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        word, at = np.repeat(np.arange(n), sizes), np.arange(len(data))
        end = np.repeat(offsets[1:] - offsets[0], sizes)
        value, found = np.zeros(len(data), np.uint64), []
        for k in range(1, max(self.short, default=0) + 1):
            left = at + k <= end
            word, at, end, value = word[left], at[left], end[left], value[left]
            value = (value << np.uint64(8)) | data[at + k - 1]
            keys, numbers = self.short.get(k, (None, None))
            if keys is None or not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == value)
            some = numbers[place[hit]]
            found.append((word[hit][some >= 0], some[some >= 0]))
            if k == 8 and self.long:
                more = []
                for i in hit.tolist():
                    for number, term in self.long.get(int(value[i]), ()):
                        if at[i] + len(term) <= end[i] and data[at[i] : at[i] + len(term)].tobytes() == term:
                            more.append((word[i], number))
                found.append(tuple(np.array(more, np.int64).reshape(-1, 2).T))
        if not found:
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        of, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.bincount(of, minlength=n), numbers[np.argsort(of, kind="stable")]


def _held(batch, terms: _Terms, n: int) -> np.ndarray:
    """Whether each row holds each of n terms."""
    flat, rows = _words(batch.column("words"))
    coded = flat.dictionary_encode()
    sizes, numbers = terms.of(coded.dictionary)
    starts = np.cumsum(sizes) - sizes
    code = coded.indices.to_numpy()
    each = sizes[code]
    at = np.arange(each.sum()) + np.repeat(starts[code] - (np.cumsum(each) - each), each)
    out = np.zeros(batch.num_rows * n, bool)
    out[np.repeat(rows * n, each) + numbers[at]] = True
    return out.reshape(batch.num_rows, n)


def frequencies(blocks: DataFrame, terms: list[str], filters: list[tuple[list[str] | None, str | None]], own: list[list[int]]) -> DataFrame:
    """filter, term, df, by number: the blocks that pass a filter and hold one of its own terms."""
    encoded = [t.encode() for t in terms]

    def run(batches):
        import pyarrow as pa

        finder, wanted = _Terms(encoded), [np.array(o, np.int64) for o in own]
        totals = [np.zeros(len(o), np.int64) for o in own]
        for whole in batches:
            for batch in _pieces(whole, "words", COUNTED, max(1, CELLS // len(encoded))):
                held = _held(batch, finder, len(encoded))
                for total, passed, some in zip(totals, _passes(batch, filters), wanted, strict=True):
                    if passed.any():
                        total += held[:, some][passed].sum(axis=0)
        of = np.repeat(np.arange(len(own)), [len(o) for o in own])
        term, df = np.concatenate(wanted), np.concatenate(totals)
        met = df > 0
        arrays = [pa.array(of[met], pa.int32()), pa.array(term[met], pa.int32()), pa.array(df[met], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["filter", "term", "df"])

    found = blocks.select("language", "file_path", "words").mapInArrow(run, "filter int, term int, df bigint")
    return found.groupBy("filter", "term").agg(F.sum("df").alias("df"))


def _listed(hit: np.ndarray, score: np.ndarray, apart: np.ndarray, file: np.ndarray, start: np.ndarray, limit: int) -> np.ndarray:
    """Of a request's blocks, places of those that can be listed: all that meet others of their file, and of the rest the
    best of each file and of these the first `limit`. What lies apart neither goes nor makes another go when overlaps are
    removed, and a better one of its file that takes its place goes before what it went before."""
    free = np.flatnonzero(apart[hit])
    at, value = hit[free], score[free]
    order = np.lexsort((start[at], -value, file[at]))
    files = file[at][order]
    first = np.flatnonzero(np.r_[True, files[1:] != files[:-1]]) if len(files) else np.zeros(0, np.int64)
    place = np.arange(len(files)) - np.repeat(first, np.diff(np.r_[first, len(files)]))
    free, at, value = (x[order][place < PER_FILE] for x in (free, at, value))
    best = np.lexsort((start[at], file[at], -value))[: max(limit, 0)]
    return np.r_[np.flatnonzero(~apart[hit]), free[best]]


def scores(
    blocks: DataFrame, keep: list[str], terms: list[str], filters: list[tuple[list[str] | None, str | None]], averages: list[float], idfs: list[dict[int, float]],
    asked: list[Asked], meeting: np.ndarray | None, number: str,
) -> DataFrame:
    """request, limit, keep columns and score of the blocks that score above zero. averages, idfs: of each filter. meeting: numbers,
    sorted, of the blocks that meet others of their file; blocks besides these are given only if they can be listed.
    Without it all are given. number: type of request."""
    encoded = [t.encode() for t in terms]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = pa.array(encoded, pa.binary())
        for whole in batches:
            for batch in _pieces(whole, "terms", SCORED, 1 << 20):
                n, numbers = batch.num_rows, {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "same", "part", "of_kind", "__row")}
                flat, row = _words(batch.column("terms"))
                term = pc.fill_null(pc.index_in(flat, names), -1).to_numpy(zero_copy_only=False)
                tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
                met = np.flatnonzero((term >= 0) & (tf > 0))
                met = met[np.argsort(term[met], kind="stable")]
                row, tf = row[met], tf[met].astype(np.float64)
                bounds = np.searchsorted(term[met], np.arange(len(encoded) + 1))
                apart = np.zeros(n, bool) if meeting is None else ~np.isin(numbers["__row"], meeting)
                files = _bytes(batch.column("file_path")).dictionary_encode()
                kinds = files.dictionary.to_pylist()
                rank = np.empty(len(kinds) + 1, np.int64)
                rank[sorted(range(len(kinds)), key=kinds.__getitem__)] = np.arange(len(kinds))
                rank[-1] = -1  # no file: before the others
                file = rank[pc.fill_null(files.indices, -1).to_numpy(zero_copy_only=False)]
                start = pc.fill_null(batch.column("start_line"), 0).to_numpy(zero_copy_only=False)  # without one it is not apart
                passed = _passes(batch, filters)
                lower = _bytes(batch.column("lower"))
                longer = [S.K1 * (1 - S.B + S.B * numbers["length"] / a) for a in averages]
                parts: dict[tuple[int, int], np.ndarray] = {}
                given, many = [], 0
                for x in asked:
                    total = np.zeros(n)
                    for t in x.terms:
                        own = slice(bounds[t], bounds[t + 1])
                        if own.start == own.stop:
                            continue
                        part = parts.get((x.filter, t))
                        if part is None:
                            part = idfs[x.filter][t] * (tf[own] * (S.K1 + 1)) / (tf[own] + longer[x.filter][row[own]])
                            parts[x.filter, t] = part
                        total[row[own]] += part
                    hit = np.flatnonzero((total > 0) & passed[x.filter])
                    if not len(hit):
                        continue
                    of_name = np.where(_true(pc.match_substring(lower, x.query)), numbers["part"], 1.0)
                    of_name = np.where(_true(pc.equal(lower, pa.scalar(x.query, pa.binary()))), numbers["same"], of_name)
                    score = total[hit] * of_name[hit] * numbers["of_kind"][hit]
                    some = np.arange(len(hit)) if meeting is None else _listed(hit, score, apart, file, start, x.limit)
                    given.append((x, hit[some], score[some]))
                    many += len(some)
                    if many >= GIVEN:
                        yield _given(pa, batch, keep, kind, given)
                        given, many = [], 0
                if many:
                    yield _given(pa, batch, keep, kind, given)

    from pyspark.sql.pandas.types import to_arrow_type

    shape = blocks.select(*keep).schema
    of = [f"`{f.name}` {f.dataType.simpleString()}" for f in shape]
    kind = to_arrow_type(blocks.sparkSession.createDataFrame([], f"x {number}").schema["x"].dataType)
    one = F.lit("x")
    rows = blocks.select(
        *keep,
        F.concat_ws(" ", "words", "others").alias("terms"),
        "tfs",
        F.lower("name").alias("lower"),
        S.name_boost(one, F.col("kind"), one).alias("same"),
        S.name_boost(F.lit("xx"), F.col("kind"), one).alias("part"),
        S.kind_boost(F.col("kind")).alias("of_kind"),
    )
    return rows.mapInArrow(run, ", ".join([f"request {number}", "limit int", *of, "score double"]))


def _given(pa, batch, keep: list[str], kind, given: list[tuple[Asked, np.ndarray, np.ndarray]]):
    sizes = [len(rows) for _, rows, _ in given]
    taken = batch.select(keep).take(pa.array(np.concatenate([rows for _, rows, _ in given])))
    request = pa.array([x.request for x, _, _ in given], kind).take(pa.array(np.repeat(np.arange(len(given)), sizes)))
    limit = pa.array(np.repeat([x.limit for x, _, _ in given], sizes), pa.int32())
    score = pa.array(np.concatenate([s for _, _, s in given]))
    return pa.RecordBatch.from_arrays([request, limit, *taken.columns, score], ["request", "limit", *keep, "score"])
