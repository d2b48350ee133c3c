"""Operator 2: quality by co-training of a text-content view and a page-metadata view.

The text view is logistic regression on hashed byte trigrams (square roots of counts, unit length), the
metadata view on hashed source, language and length class. Both start from the labelled sample. In each
round either view scores every document without a label and, where its calibrated probability is beyond
CONFIDENT, hands the HANDED most certain ones of all (of each class, more with every round) to the other view as
pseudo-labels. At the end both views are calibrated on held labels and a logistic curve over their log-odds
combines them to score all documents.

Labels are a bounded, hashed sample of about LABELLED rows. Rounds and scoring read every whole text: a task
keeps its most certain documents of each view and class, and a window over these finds the corpus's.

Cases: NULL and empty texts have no trigram and are scored by their metadata and the model's constant;
NULL metadata is a value of its own. Labels that repeat a doc_id count by their mean. Without both label
values all scores are the share of good labels (0.5 without any). Rows may repeat; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.textkit import batches_of, chunks, crc_mod, flat, release

LABELLED = 3000
ROUNDS = 3
#: Calibrated probability, of either class, from which a pseudo-label is handed over; and how many of each class
#: the first round hands over, the most certain ones (the second twice as many, and so on).
CONFIDENT = 0.97
HANDED = 300
TEXT_DIMS = 2048
META_DIMS = 512
#: Trigrams at which a text counts half.
SHORT = 60


def trigram_vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a document: trigrams in a unit vector and, in column 0, a constant, both scaled down for short
    texts, so that a few words are little evidence for either class."""
    n = len(off) - 1
    out = np.zeros((n, TEXT_DIMS), np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - TEXT_DIMS.bit_length() + 1)
        for i in range(n):
            a, b = off[i], off[i + 1] - 2
            if b > a:
                out[i] = np.bincount(code[a:b], minlength=TEXT_DIMS)
    np.sqrt(out, out=out)
    pieces = np.maximum(np.diff(off) - 2, 0)[:, None]
    scale = (pieces / (pieces + SHORT)).astype(np.float32)
    out *= scale / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    out[:, :1] = scale
    return out


def meta_columns() -> list:
    """Three hashed features of a document's metadata."""
    length = F.floor(F.log2(F.coalesce(F.col("n_chars"), F.lit(0)) + 1) * 2).cast("string")
    parts = (("s", F.col("source")), ("l", F.col("lang")), ("n", length))
    return [
        F.pmod(F.xxhash64(F.lit(k), F.coalesce(c.cast("string"), F.lit("\0"))), F.lit(META_DIMS)).cast("int").alias(f"m{k}")
        for k, c in parts
    ]


def meta_vectors(features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), META_DIMS), np.float32)
    for k in range(features.shape[1]):
        out[np.arange(len(features)), features[:, k]] += 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, l2: float, steps: int = 150, start: tuple[np.ndarray, float] | None = None, constant: bool = True
) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean logistic loss; classes weigh alike. constant: fit one."""
    y = y.astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    w, b = start or (np.zeros(x.shape[1], np.float32), 0.0)
    vw, vb = w.copy(), b
    rate = 4.0 / (max(1.0, float((x * x).sum(1).max())) + 1.0 + 4 * l2)
    for t in range(steps):
        g = weight * (_sigmoid(x @ vw + np.float32(vb)) - y)
        nw, nb = vw - np.float32(rate) * (g @ x / np.float32(len(y)) + np.float32(l2) * vw), vb - rate * float(g.mean()) * constant
        m = t / (t + 3)
        vw, vb = nw + np.float32(m) * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w.astype(np.float32), float(b)


def fit_curve(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic curve over the columns of z by Newton's method, with a ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-9])
    for _ in range(40):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


@dataclass
class CoTrained:
    """Two calibrated views and their combination."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    text_curve: tuple[np.ndarray, float]
    meta_curve: tuple[np.ndarray, float]
    both: tuple[np.ndarray, float]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt = (text @ self.text[0] + self.text[1]) * self.text_curve[0][0] + self.text_curve[1]
        zm = (meta @ self.meta[0] + self.meta[1]) * self.meta_curve[0][0] + self.meta_curve[1]
        return _sigmoid(np.column_stack([zt, zm]) @ self.both[0] + self.both[1]), _sigmoid(zt), _sigmoid(zm)


#: For the view that gives: features, for the other view, of the documents it is sure of, and their labels.
Handed = list[tuple[np.ndarray, np.ndarray]]


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, hand: Callable[[list, list, int], Handed]) -> CoTrained:
    """views: features of the labelled rows, for text and for metadata; held: labelled rows kept for calibration;
    hand: for both views' models and curves, the documents that either is surest of, a number of each class."""
    extra: Handed = [(np.zeros((0, x.shape[1]), np.float32), np.zeros(0)) for x in views]
    l2 = (1e-4, 1e-2)
    models: list = [None, None]
    curves: list = [None, None]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            x = np.concatenate([views[v][~held], extra[v][0]])
            models[v] = fit_logistic(x, np.concatenate([y[~held], extra[v][1]]), l2[v], 60 if turn else 150, models[v], v == 1)
            raw = views[v][held] @ models[v][0] + models[v][1]
            curves[v] = fit_curve(raw[:, None], y[held])
        if turn < ROUNDS:
            extra = hand(models, curves, HANDED * (turn + 1))[::-1]  # each view learns from the other
    z = np.column_stack([(views[v][held] @ models[v][0] + models[v][1]) * curves[v][0][0] + curves[v][1] for v in (0, 1)])
    return CoTrained(models[0], models[1], curves[0], curves[1], fit_curve(z, y[held]))


def confident() -> float:
    """CONFIDENT as log-odds."""
    return float(np.log(CONFIDENT / (1 - CONFIDENT)))


def surest(z: np.ndarray, most: int, limit: float) -> list[np.ndarray]:
    """Of log-odds, the places beyond the limit: at most so many good ones and bad ones, the surest first."""
    picked = [np.argsort(-z, kind="stable")[:most], np.argsort(z, kind="stable")[:most]]
    return [picked[0][z[picked[0]] >= limit], picked[1][z[picked[1]] <= -limit]]


def from_arrays(pool: list[np.ndarray]) -> Callable[[list, list, int], Handed]:
    """hand() over features in memory."""

    def hand(models: list, curves: list, most: int) -> Handed:
        out = []
        for v in (0, 1):
            good, bad = surest((pool[v] @ models[v][0] + models[v][1]) * curves[v][0][0] + curves[v][1], most, confident())
            out.append((pool[1 - v][np.concatenate([good, bad])], np.repeat([1.0, 0.0], [len(good), len(bad)])))
        return out

    return hand


def from_table(rows: DataFrame) -> Callable[[list, list, int], Handed]:
    """hand() over a table of any size: doc_id, ms, ml, mn, text. A first pass finds who is surest, by small rows; a
    second one makes the features of those, at most four times `most` rows, for the driver."""
    spark = rows.sparkSession
    rows = rows.withColumn("mark", F.xxhash64("ms", "ml", "mn", "text"))  # with the doc_id it names a document
    names = ["view", "label", "sure", "doc_id", "mark"]

    def hand(models: list, curves: list, most: int) -> Handed:
        shared, limit = spark.sparkContext.broadcast((models, curves)), confident()  # a few thousand weights

        def run(batches):
            models, curves = shared.value
            kept: dict[tuple[int, int], list[tuple]] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
            floor = dict.fromkeys(kept, limit)  # below it a document is not among the task's surest
            for batch in batches_of(batches, 5):
                data, off = flat(batch.column(5))
                ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                numbers = np.stack([np.asarray(batch.column(k)) for k in (2, 3, 4)], 1)
                for s in range(0, len(off) - 1, 128):
                    e = min(s + 128, len(off) - 1)
                    x = [trigram_vectors(data[off[s] : off[e]], off[s : e + 1] - off[s]), meta_vectors(numbers[s:e])]
                    for v in (0, 1):
                        z = (x[v] @ models[v][0] + models[v][1]) * curves[v][0][0] + curves[v][1]
                        for c in (0, 1):
                            sure, own = z if c else -z, kept[v, c]
                            own += [(float(sure[k]), ids[s + k], marks[s + k]) for k in np.flatnonzero(sure >= floor[v, c]).tolist()]
                            if len(own) > 2 * most:
                                own.sort(key=_surest_first)
                                del own[most:]
                                floor[v, c] = own[-1][0]
            out = [(v, c, *row) for (v, c), own in kept.items() for row in sorted(own, key=_surest_first)[:most]]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            release()
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

        scored = rows.select("doc_id", "mark", "ms", "ml", "mn", "text").mapInArrow(run, "view int, label int, sure double, doc_id bigint, mark bigint")
        order = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "doc_id", "mark")
        found = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).collect()
        chosen = spark.createDataFrame([tuple(r) for r in {(r["doc_id"], r["mark"]) for r in found}], "id bigint, m bigint")
        met = rows.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left_semi")
        shared.unpersist()
        features = {(r["doc_id"], r["mark"]): r for r in _features(met.select("doc_id", "mark", "ms", "ml", "mn", "text")).collect()}
        out = []
        for v in (0, 1):
            own = sorted((r for r in found if r["view"] == v), key=lambda r: (-r["label"], r["n"]))
            docs = [features[r["doc_id"], r["mark"]] for r in own]
            x = _dense(docs) if v == 1 else meta_vectors(np.array([[r["ms"], r["ml"], r["mn"]] for r in docs], np.int64).reshape(-1, 3))
            out.append((x, np.array([float(r["label"]) for r in own])))
        return out

    return hand


def _surest_first(row: tuple) -> tuple:
    return -row[0], row[1] is not None, row[1] or 0, row[2]


def _features(rows: DataFrame) -> DataFrame:
    """Sparse trigram vectors of a bounded sample, as packed indexes and values."""

    def run(batches):
        for batch in batches_of(batches, -1):
            data, off = flat(batch.column(batch.num_columns - 1))
            index, value = [], []
            for a, b in chunks(off):
                o = off[a : b + 1]
                for s in range(a, b, 256):
                    e = min(s + 256, b)
                    for row in trigram_vectors(data[off[s] : off[e]], off[s : e + 1] - off[s]):
                        k = np.flatnonzero(row)
                        index.append(k.astype(np.uint16).tobytes())
                        value.append(row[k].astype(np.float16).tobytes())
            yield pa.record_batch([*batch.columns[:-1], pa.array(index, pa.binary()), pa.array(value, pa.binary())], names)
        release()

    names = [*rows.columns[:-1], "index", "value"]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names[:-2]) + ", index binary, value binary")


def _dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), TEXT_DIMS), np.float32)
    for i, r in enumerate(rows):
        out[i, np.frombuffer(bytes(r["index"]), np.uint16)] = np.frombuffer(bytes(r["value"]), np.float16)
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", held_out: int | None = 0) -> CoTrained | float:
    """The model, or a constant where a label value is missing. Broadcast: the sample's ids."""
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        marks = marks.where(crc_mod("doc_id", 5) != held_out)
    marks = marks.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return sum(k * n for k, n in counts.items()) / sum(counts.values()) if counts else 0.5
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    marked = sum(counts.values())
    chosen = F.broadcast(marks.where(place < LABELLED / marked))
    base = docs.select("doc_id", *meta_columns(), F.coalesce("text", F.lit("")).alias("text"))
    known = base.join(chosen, "doc_id").select("doc_id", "label", crc_mod("doc_id", 5).cast("int").alias("fold"), "ms", "ml", "mn", "text")
    known = sorted(_features(known).collect(), key=lambda r: (r["doc_id"], bytes(r["index"])))
    free = base if held_out is None else base.where(crc_mod("doc_id", 5) != held_out)
    free = free.join(chosen.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").cast("bigint"), "ms", "ml", "mn", "text")
    y = np.array([r["label"] for r in known], float)
    held = np.array([r["fold"] == 4 for r in known], bool)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 4 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            return counts[1] / marked
    meta = meta_vectors(np.array([[r["ms"], r["ml"], r["mn"]] for r in known], np.int64).reshape(-1, 3))
    return co_train([_dense(known), meta], y, held, from_table(free))


def score(docs: DataFrame, model: CoTrained | float) -> DataFrame:
    """doc_id, score, text_score, page_score and kept (score >= 0.5) of every row; one pass, no shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *meta_columns(), "text")
    if isinstance(model, float | int):
        c = F.lit(float(model))
        return rows.select("doc_id", c.alias("score"), c.alias("text_score"), c.alias("page_score"), F.lit(bool(model >= 0.5)).alias("kept"))
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches):
        m = shared.value
        for batch in batches_of(batches, 4):
            data, off = flat(batch.column(4))
            meta = meta_vectors(np.stack([np.asarray(batch.column(k)) for k in (1, 2, 3)], 1))
            out = [np.zeros((3, 0))]
            for s in range(0, len(off) - 1, 128):
                e = min(s + 128, len(off) - 1)
                out.append(np.stack(m.score(trigram_vectors(data[off[s] : off[e]], off[s : e + 1] - off[s]), meta[s:e])))
            both, text, page = np.concatenate(out, 1)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(v, pa.float64()) for v in (both, text, page)), pa.array(both >= 0.5)],
                ["doc_id", "score", "text_score", "page_score", "kept"],
            )
        release()

    return rows.mapInArrow(run, "doc_id bigint, score double, text_score double, page_score double, kept boolean")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 5 is 0: no label of it was used) and the scores."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "text_score", "page_score", "kept"
    )
