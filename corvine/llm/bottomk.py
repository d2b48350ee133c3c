"""Operator 7: near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct shingles of WORDS words. Documents with equal sets
are one class, represented by its smallest doc_id. A sketch keeps the SKETCH smallest hashes of a set.

1. Inverted lists. Two sets as alike as asked share at least `least_overlap` retained values: for sets
   that are kept whole this is certain, else it fails for a pair at the threshold with a probability
   below LOSS. So in any common order of the values, the prefixes of both sketches that leave out
   least_overlap - 1 values share one. The order is by the number of sketches that hold a value, rare
   first, so that a passage which many documents share gives no list unless it is most of a document.
2. Gathering. A list is named by its smallest id; lists with one name, as a family of copies makes them,
   are united, so a set travels once for each name and not once for each list. A union of more than GROUP
   sets or PART_SHINGLES shingles is dealt as parts, each a task of bounded size, and a few of its sets (LEADERS,
   its smallest id among them) go to every part.
3. In a task, overlaps of the sketches filter pairs by what their union sketch can hold, exact Jaccard on
   full sets confirms, and a union-find skips pairs that are already connected. At most one link for
   each merge leaves the task, never all pairs. What a part connects with the smallest id is connected in the
   whole group; only the rest, sets that it does not connect, is compared with the sets of all other parts. A
   family of copies has little rest or none, so its work grows with its size; sets that share most of
   their values and are yet not alike are compared with all, as no link may be lost.
4. Components of these links, by alternating stars.

Cases: text that is NULL or has no word has an empty set, is its own component and is kept. With fewer
than WORDS words the whole sequence is one shingle. Rows that repeat a doc_id are one document: what is
linked with one of its texts is linked with it, and all its rows have one component. A NULL
doc_id is linked with nothing. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.blocks import LEAST_BUCKETS, Block, Blocks, answer, deal, gather, told
from corvine.llm.components import components
from corvine.llm.textkit import FOLD, batches_of, chunks, flat, mix, range_hashes, release, remove, scratch_dir, word_hashes, words

WORDS = 5
SKETCH = 64
#: Probability with which a pair exactly at the threshold may share fewer values than least_shared.
LOSS = 1e-10
#: Tasks over which the keys of one group are spread.
SALTS = 64
#: Classes in a block of sketches.
BLOCK_CLASSES = 4096
#: Sets and shingles of one part; a larger group is dealt as several. Leaders of a group, about.
GROUP = 1024
PART_SHINGLES = 1 << 20
LEADERS = 16
#: Shingles that one comparison of a set with others takes at once, and those of a bucket of small groups.
POOL = 1 << 20
BUCKET_SHINGLES = 1 << 20
U64 = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their bounds."""
    folded = FOLD[data]
    starts, ends, first = words(folded, off)
    h = word_hashes(folded, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    left = first[1:][doc] - np.arange(len(h))
    at = np.flatnonzero((left >= width) | ((left == n[doc]) & (n[doc] < width)))
    codes, doc = range_hashes(h, at, at + np.minimum(left[at], width)), doc[at]
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    return codes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_digests(codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that identify each set."""
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(codes + U64(salt)), dtype=U64)))
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
    return [r.tobytes() for r in np.stack(sums, 1)]


def least_shared(num: int, den: int) -> int:
    """Values that the sketches of two alike sets share at least, where the sets are not kept whole: the
    lower LOSS quantile of the binomial distribution, which lies below that of drawing without return."""
    t, total = num / den, 0.0
    for m in range(SKETCH + 1):
        total += math.comb(SKETCH, m) * t**m * (1 - t) ** (SKETCH - m)
        if total > LOSS:
            return max(m, 1)
    return SKETCH


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Retained values that the sketch of a set of n shares with that of an alike set."""
    whole = -(-num * n // den)  # both kept whole: |A & B| >= t * max(|A|, |B|)
    room = SKETCH - ((den - num) * n // num + 1)  # partner kept in part: the union is below n / t
    shared = least_shared(num, den)
    small = np.where(n * den >= num * SKETCH, np.minimum(whole, room), whole)
    # a larger set may meet one that is kept whole, too
    large = np.where(n * num <= SKETCH * den, np.minimum(shared, room), shared)
    return np.maximum(np.where(n > SKETCH, large, small), 1)


def _save(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its sketch; one pass, no shuffle."""

    def run(batches):
        for batch in batches_of(batches, 1):
            data, off = flat(batch.column(1))
            sizes, digests, kept = [], [], []
            for a, b in chunks(off):
                o = off[a : b + 1]
                codes, bounds = shingle_sets(data[o[0] : o[-1]], o - o[0], width)
                sizes.append(np.diff(bounds))
                digests += set_digests(codes, bounds)
                kept += [codes[s : min(e, s + SKETCH)].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary"
    )


def prefixes(classes: DataFrame, count: int, buckets: int, num: int, den: int) -> DataFrame:
    """Rows (value, id, n): entries of the inverted lists that prefixes of the sketches make."""

    def sketch_values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, off = flat(table.column("sketch"))
        return data.view(U64), np.repeat(np.arange(table.num_rows), np.diff(off) // 8)

    def send(table: pa.Table) -> pa.Table:
        values, n = np.unique(sketch_values(table)[0], return_counts=True)
        return deal(table.column("block")[0].as_py(), values, buckets, n.astype(np.uint32))

    def frequency(table: pa.Table) -> pa.Table:
        block, keys, n = gather(table, keys=U64, more0=np.uint32)
        known, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, n, len(known)).astype(np.uint32)[where]
        often = total > 1
        return answer(block[often], keys[often], total[often])

    def choose(table: pa.Table, more: pa.Table) -> pa.Table:
        keys, often = told(more, U64, np.uint32)
        order = np.argsort(keys)
        keys, often = keys[order], often[order]
        values, owner = sketch_values(table)
        df = np.ones(len(values), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            df = np.where(keys[at] == values, often[at], 1)
        size = np.asarray(table.column("n_shingles"))
        order = np.lexsort((values, df, owner))
        values, owner, df = values[order], owner[order], df[order]
        first = np.searchsorted(owner, np.arange(len(size)))
        rank = np.arange(len(values)) - first[owner]
        length = np.minimum(size, SKETCH) - least_overlap(size, num, den) + 1
        keep = (rank < length[owner]) & (df > 1)
        ids = np.asarray(table.column("id"))
        return pa.table(
            [pa.array(values[keep].view(np.int64)), pa.array(ids[owner[keep]]), pa.array(size[owner[keep]])],
            ["value", "id", "n"],
        )

    rows = classes.select(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block"), "id", "n_shingles", "sketch")
    sent = rows.groupBy("block").applyInArrow(send, "bucket bigint, block bigint, keys binary, more0 binary")
    told_back = sent.groupBy("bucket").applyInArrow(frequency, "block bigint, a0 binary, a1 binary")
    return (
        rows.groupBy("block").cogroup(told_back.groupBy("block")).applyInArrow(choose, "value bigint, id bigint, n bigint")
    )


def _salt():
    return F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int")


def with_group(rows: DataFrame, by: str) -> DataFrame:
    """rows: (by, id, n, ...). Adds of each group its smallest id (least), its number of rows (m) and their shingles
    (t). Rows meet by group and a salt of the id, so that a group that holds a third of all is spread; only
    the salts of a group, SALTS at most, meet in one task."""
    salted = rows.withColumn("salt", _salt())
    part = salted.groupBy(by, "salt").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    whole = part.groupBy(by).agg(F.min("least").alias("least"), F.sum("m").alias("m"), F.sum("t").alias("t"))
    return salted.join(part.select(by, "salt").join(whole, by), [by, "salt"]).drop("salt")


def _parts(sets, shingles):
    return F.greatest(F.ceil(sets / GROUP), F.ceil(shingles / PART_SHINGLES), F.lit(1)).cast("int")


def _part(parts, salt: str):
    return F.pmod(F.xxhash64("id", F.lit(salt)), parts).cast("int")


def first_tasks(asked: DataFrame) -> DataFrame:
    """asked: (name, id, n). Rows (name, i, j, side, id, n): each set in its part of its group (side 0), leaders in all
    others, too (side 1). j is -1 in a group of one part."""
    known = with_group(asked, "name").where("m > 1").withColumn("parts", _parts(F.col("m"), F.col("t")))
    known = known.withColumn("own", _part(F.col("parts"), "part"))
    every = F.ceil(F.col("m") / LEADERS)
    leads = (F.col("id") == F.col("name")) | (F.pmod(F.xxhash64("id", F.lit("leader")), every) == 0)
    goes = F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    return known.select("name", "id", "n", "own", "parts", F.explode(goes).alias("i")).select(
        "name",
        "i",
        F.when(F.col("parts") > 1, F.col("i")).otherwise(-1).alias("j"),
        F.when(F.col("i") == F.col("own"), 0).otherwise(1).alias("side"),
        "id",
        "n",
    )


def second_tasks(asked: DataFrame, rest: DataFrame) -> DataFrame:
    """rest: (name, id) of sets that their part did not connect. Rows as by first_tasks: side 0 a part of the rest,
    side 1 a part of all sets of the group."""
    left = with_group(asked.join(rest, ["name", "id"], "left_semi"), "name")
    few = left.groupBy("name").agg(_parts(F.max("m"), F.max("t")).alias("few"))
    every = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot group meets it by salts
    known = asked.withColumn("salt", _salt()).join(every, ["name", "salt"]).drop("salt")
    known = with_group(known, "name").withColumn("parts", _parts(F.col("m"), F.col("t")))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = known.join(rest, ["name", "id"], "left_semi").withColumn("i", _part(F.col("few"), "rest"))
    mine = mine.select("name", "i", span("parts").alias("j"), F.lit(0).alias("side"), "id", "n")
    theirs = known.withColumn("j", _part(F.col("parts"), "part"))
    return mine.unionByName(theirs.select("name", span("few").alias("i"), "j", F.lit(1).alias("side"), "id", "n"))


def gathered(blocks: Blocks, tasks: DataFrame, width: int) -> DataFrame:
    """tasks: (name, i, j, side, id). The same rows with the full set, 48 bits a shingle."""
    wanted = tasks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks.count)))

    def load(block: Block, lines: pa.Table) -> pa.Table:
        ids = np.asarray(lines.column("id"))
        need = np.unique(ids)
        low, high = np.searchsorted(block.ids, need), np.searchsorted(block.ids, need, "right")
        rows = np.concatenate([np.zeros(0, np.int64), *map(np.arange, low, high)]).astype(np.int64)
        off = np.concatenate(([0], np.cumsum(np.diff(block.off)[rows]))).astype(np.int64)
        held: list[bytes] = []
        for a, b in chunks(off):
            data = np.concatenate([block.data[block.off[k] : block.off[k + 1]] for k in rows[a:b]])
            codes, bounds = shingle_sets(data, off[a : b + 1] - off[a], width)
            raw = (codes >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            held += [raw[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        # one set for each id, more where rows repeat it with other texts
        sets: dict[int, list[bytes]] = {}
        for k, one in zip(rows, held, strict=True):
            if one and one not in sets.setdefault(int(block.ids[k]), []):
                sets[int(block.ids[k])].append(one)
        take = [i for i, x in enumerate(ids.tolist()) for _ in sets.get(x, ())]
        column = pa.array([one for x in ids.tolist() for one in sets.get(x, ())], pa.binary())
        return lines.select(["name", "i", "j", "side", "id"]).take(pa.array(take, pa.int64())).append_column("set", column)

    return blocks.map_with(wanted, load, "name bigint, i int, j int, side int, id bigint, set binary")


def linked(sets: DataFrame, buckets: int, num: int, den: int, across: bool = False) -> DataFrame:
    """Rows (a, b, name): links of alike sets, enough to connect what is connected inside each task's sets (with
    across: between its sides); and, b NULL, sets of side 0 in groups of several parts which the links of their
    task do not connect with the group's smallest id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        name, i, j, side, ids = (np.asarray(table.column(c)) for c in ("name", "i", "j", "side", "id"))
        data, off = flat(table.column("set"))
        off = off // 6
        new = (np.diff(name) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        cut = np.flatnonzero(new) + 1
        found, rest = [], []
        for a, b in zip([0, *cut], [*cut, len(name)], strict=True):
            wide = np.zeros((off[b] - off[a], 8), np.uint8)
            wide[:, :6] = data[6 * off[a] : 6 * off[b]].reshape(-1, 6)
            sides = side[a:b] if across else None
            pairs = alike(wide.reshape(-1).view(U64), off[a : b + 1] - off[a], num, den, sides)
            found += [(int(ids[a + x]), int(ids[a + y]), int(name[a])) for x, y in pairs]
            if j[a] >= 0 and not across:
                lone = apart(ids[a:b], pairs, name[a])
                rest += [(int(x), None, int(name[a])) for x in ids[a:b][lone & (side[a:b] == 0)]]
        release()
        columns = list(zip(*found, *rest, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b", "name"])

    keyed = sets.withColumn("bucket", F.pmod(F.xxhash64("name", "i", "j"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, name bigint")


def apart(ids: np.ndarray, pairs: list, name: int) -> np.ndarray:
    """Sets that the pairs do not connect with the set of id `name`."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        parent[root(x)] = root(y)
    main = {root(int(k)) for k in np.flatnonzero(ids == name)}
    return np.array([root(k) not in main for k in range(len(ids))])


def alike(codes: np.ndarray, off: np.ndarray, num: int, den: int, side: np.ndarray | None = None, step: int = 256) -> list:
    """Pairs of sets as alike as asked, sorted sets given one after the other; pairs that earlier ones
    connect are left out, and so are pairs on one side."""
    n, size = len(off) - 1, np.diff(off)
    order = np.argsort(size, kind="stable")
    kept = np.minimum(size, SKETCH)
    owner = np.repeat(np.arange(n), kept)
    head = codes[np.arange(len(owner)) + np.repeat(off[:-1] - (np.cumsum(kept) - kept), kept)]
    known, column, often = np.unique(head, return_inverse=True, return_counts=True)
    use = often[column] > 1  # values of one set only overlap with nothing
    column = (np.cumsum(often > 1) - 1)[column[use]]
    owner, columns = owner[use], int((often > 1).sum())
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.argsort(place[owner], kind="stable")
    owner_at, column = place[owner][by], column[by]
    first = np.searchsorted(owner_at, np.arange(n + 1))
    size_at, kept_at = size[order], kept[order]
    floor = least_shared(num, den) / SKETCH
    label = np.arange(n)  # component of each set in size order
    out = []
    for a in range(0, n, step):
        b = min(a + step, n)
        stop = int(np.searchsorted(size_at * num, size_at[b - 1] * den, "right"))
        product = np.zeros((b - a, stop - a), np.float32)
        for c in range(0, columns, 4096):
            left, right = np.zeros((b - a, 4096), np.float32), np.zeros((stop - a, 4096), np.float32)
            lo, hi = first[a], first[stop]
            inside = (column[lo:hi] >= c) & (column[lo:hi] < c + 4096)
            rows, cols = owner_at[lo:hi][inside] - a, column[lo:hi][inside] - c
            right[rows, cols] = 1
            left[:] = right[: b - a]
            product += left @ right.T
        need = np.maximum(1, np.maximum(kept_at[a:b, None], kept_at[None, a:stop]) * floor)
        passes = product >= need
        for i in range(a, b):
            js = np.flatnonzero(passes[i - a, i + 1 - a :]) + i + 1
            js = js[size_at[js] * num <= size_at[i] * den]
            if side is not None:
                js = js[side[order[js]] != side[order[i]]]
            js = js[label[js] != label[i]]
            own = codes[off[order[i]] : off[order[i] + 1]]
            reach = np.cumsum(size[order[js]])
            while len(js):
                take = max(1, int(np.searchsorted(reach, POOL, "right")))
                near, js = js[:take], js[take:]
                reach = reach[take:] - reach[take - 1]
                near = near[label[near] != label[i]]
                if not len(near):
                    continue
                at = order[near]
                total = size[at]
                begin = np.cumsum(total) - total
                pool = codes[np.arange(total.sum()) + np.repeat(off[at] - begin, total)]
                hit = own[np.minimum(np.searchsorted(own, pool), len(own) - 1)] == pool
                shared = np.add.reduceat(hit.astype(np.int64), begin)
                link = den * shared >= num * (len(own) + total - shared)
                for x in near[link]:
                    if label[x] != label[i]:
                        out.append((int(order[i]), int(order[x])))
                        label[label == label[x]] = label[i]
    return out


def group_near_copies(docs: DataFrame, num: int = 85, den: int = 100, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; num / den is the least Jaccard likeness."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/bottomk-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = _save(sketches(docs, width), folder, "sketches")
    real = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = _save(
        real.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id"), F.any_value("sketch").alias("sketch")),
        folder,
        "classes",
    )
    total = classes.count()
    count = max(1, total // BLOCK_CLASSES)
    buckets = max(LEAST_BUCKETS, total * SKETCH // 500_000)
    lists = _save(prefixes(classes, count, buckets, num, den), folder, "lists")
    named = with_group(lists, "value").where("m > 1")
    asked = _save(named.select(F.col("least").alias("name"), "id", "n").distinct(), folder, "asked")
    blocks = Blocks(docs.where("doc_id IS NOT NULL"), by_text=False)

    def links_of(tasks: DataFrame, name: str, across: bool) -> DataFrame:
        tasks = _save(tasks, folder, f"{name}-tasks")
        many = max(LEAST_BUCKETS, (tasks.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES)
        return _save(linked(gathered(blocks, tasks.drop("n"), width), many, num, den, across), folder, name)

    found = links_of(first_tasks(asked), "links", False)
    rest = found.where("b IS NULL").select("name", F.col("a").alias("id"))
    links = found.where("b IS NOT NULL").select("a", "b")
    if not rest.isEmpty():
        links = links.union(links_of(second_tasks(asked, rest), "across", True).select("a", "b"))
    for done in ("lists", "asked", "links-tasks", "across-tasks"):  # what the links were made from is not read again
        remove(spark, f"{folder}/{done}")
    # rows that repeat a doc_id with other texts tie their classes together
    again = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    same = real.select("doc_id", "digest", "n_shingles").join(again, "doc_id", "left_semi")
    same = same.join(classes.select("digest", "n_shingles", "id"), ["digest", "n_shingles"])
    groups = components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    ids = classes.select("digest", "n_shingles", "id").join(groups, F.col("id") == F.col("node"), "left")
    ids = ids.select("digest", "n_shingles", F.coalesce("component", "id").alias("component"))
    return with_class(known.select("doc_id", "n_shingles", "digest"), ids).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def with_class(known: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with the component of their class; empty sets and NULL ids have none."""
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined = known.where(real).join(ids, ["digest", "n_shingles"]).select("doc_id", "n_shingles", "component")
    return joined.unionByName(known.where(~real).select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component")))
