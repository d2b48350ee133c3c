"""Operator 3: language identification by a byte convolutional network.

The input of the network is a window of WINDOW bytes. Filters of widths 2, 3 and 4 slide over the
bytes (a filter is a table of weights by offset and byte value), each filter's largest response in
the window passes a rectifier, and a softmax layer reads these maxima. Training is plain numpy with
Adam on windows drawn from labelled rows; the gradient of a maximum reaches one position only.

A text is scored whole: all its windows, batched, give probabilities, and their mean decides. For
scoring, the tables of two adjacent offsets are summed once for every byte pair.

The sample for training is bounded: about DOCS_PER_LANGUAGE rows of each language, found by a hash
of the doc_id, and WINDOWS_PER_DOC windows of each at hashed places.

Cases: NULL text, empty text and text without a letter give `und` and score 0. Without labelled rows
every text is `und`. Rows may repeat. Only text is read when predicting; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import batches_of, chunks, crc_mod, flat

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DOCS_PER_LANGUAGE = 1200
WINDOWS_PER_DOC = 2
EPOCHS = 6
UNKNOWN = "und"
_PAD = max(WIDTHS) - 1
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteNet:
    """Multi-width byte convolution, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [*self.tables, self.out, self.bias]

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> None:
        """windows: (n, WINDOW) bytes; target: class numbers."""
        rng = np.random.default_rng(11)
        weight = 1.0 / np.maximum(np.bincount(target, minlength=len(self.labels)), 1)
        weight = (weight / weight[target].mean()).astype(np.float32)
        first = [np.zeros_like(p) for p in self._params()]
        second = [np.zeros_like(p) for p in self._params()]
        step, total = 0, max(1, epochs * ((len(target) + batch - 1) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                grads = self._gradients(windows[pick], target[pick], weight)
                step += 1
                lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self._params(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= lr * m / (np.sqrt(v) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(y)
        padded = np.pad(x, ((0, 0), (0, _PAD)))
        best, where = [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            conv = table[0][padded[:, :WINDOW]]
            for o in range(1, w):
                conv = conv + table[o][padded[:, o : o + WINDOW]]
            at = conv.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(best, 1)
        hidden = np.maximum(raw, 0)
        prob = _softmax(hidden @ self.out + self.bias)
        prob[np.arange(n), y] -= 1
        delta = prob * (weight[y] / n)[:, None]
        back = (delta @ self.out.T) * (raw > 0)
        grads = []
        column = np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        row = np.arange(n)[:, None]
        for k, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
            g = np.zeros_like(self.tables[k])
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(w):
                np.add.at(g[o], (padded[row, at + o], column), part)
            grads.append(g)
        return [*grads, hidden.T @ delta, delta.sum(0)]

    def frozen(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """The trained network with its byte-pair tables, built lazily in each worker."""

    def __init__(self, net: ByteNet) -> None:
        self.labels, self.tables, self.out, self.bias = net.labels, net.tables, net.out, net.bias
        self.pairs: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}

    def _ready(self) -> tuple:
        if self.pairs is None:
            two, three, four = self.tables
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            head = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
            self.pairs = (np.ascontiguousarray(head), pair(four[2], four[3]), three[2])
        return self.pairs

    def windows(self, x: np.ndarray, step: int = 96) -> np.ndarray:
        """Probabilities (n, classes) of windows (n, WINDOW)."""
        head, tail, third = self._ready()
        out = np.empty((len(x), len(self.labels)), np.float32)
        f = FILTERS
        for a in range(0, len(x), step):
            b = np.pad(x[a : a + step], ((0, 0), (0, _PAD))).astype(np.int32)
            code = b[:, :-1] * 256 + b[:, 1:]
            conv = head.take(code[:, :WINDOW], axis=0)
            conv[:, :, f : 2 * f] += third.take(b[:, 2 : 2 + WINDOW], axis=0)
            conv[:, :, 2 * f :] += tail.take(code[:, 2 : 2 + WINDOW], axis=0)
            out[a : a + step] = _softmax(np.maximum(conv.max(1), 0) @ self.out + self.bias)
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number (-1: no letter) and probability of each text in a flat buffer."""
        n = len(off) - 1
        pred, score = np.full(n, -1, np.int64), np.zeros(n)
        for a, b in chunks(off):
            o = off[a : b + 1]
            lens = np.diff(o)
            per = -(-lens // WINDOW)
            base = np.cumsum(per) - per
            total = int(per.sum())
            if not total:
                continue
            owner = np.repeat(np.arange(b - a), per)
            start = o[:-1][owner] + (np.arange(total) - base[owner]) * WINDOW
            idx = start[:, None] + np.arange(WINDOW)
            inside = idx < o[1:][owner][:, None]
            x = np.where(inside, data[np.minimum(idx, len(data) - 1)], 0).astype(np.uint8)
            prob = self.windows(x)
            full = np.flatnonzero(per)
            mean = np.add.reduceat(prob.astype(np.float64), base[full], axis=0) / per[full][:, None]
            letters = np.add.reduceat(_ASCII_LETTER[x].any(1), base[full])
            best = mean.argmax(1)
            for k, i in enumerate(full):
                if letters[k] or _has_letter(data[o[i] : o[i + 1]]):
                    pred[a + i], score[a + i] = best[k], mean[k, best[k]]
        return pred, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _has_letter(piece: np.ndarray) -> bool:
    return any(map(str.isalpha, piece.tobytes().decode("utf-8", "replace")))


def training_windows(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, windows and class numbers from a bounded, hashed sample of the labelled rows."""
    docs = docs.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    content = F.col("text").cast("binary")
    room = F.greatest(F.octet_length(content) - WINDOW + 1, F.lit(1))
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1 for k in range(WINDOWS_PER_DOC)]
    found = (
        docs.where((place < F.element_at(share, F.col("lang"))) & F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "lang", F.array(*[F.substring(content, s, F.lit(WINDOW)) for s in starts]).alias("cuts"))
        .collect()
    )
    found.sort(key=lambda r: (r["lang"], r["doc_id"] or 0, bytes(r["cuts"][0])))
    labels = sorted({r["lang"] for r in found})
    number = {v: i for i, v in enumerate(labels)}
    rows = [(bytes(c), number[r["lang"]]) for r in found for c in dict.fromkeys(map(bytes, r["cuts"]))]
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (c, _) in enumerate(rows):
        x[i, : len(c)] = np.frombuffer(c, np.uint8)
    return labels, x, np.array([y for _, y in rows], np.int64)


def train(docs: DataFrame) -> Scorer:
    labels, x, y = training_windows(docs)
    net = ByteNet(labels or [UNKNOWN])
    if len(labels) > 1:
        net.fit(x, y)
    return net.frozen()


def identify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of docs with lang_pred and score; one pass, no shuffle. A column of docs that has
    one of these two names is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer)  # a few hundred kB whatever the input
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = keep.index("text")

    def run(batches):
        net = shared.value
        names = np.array([*net.labels, UNKNOWN], object)
        for batch in batches_of(batches, at):
            pred, score = net.texts(*flat(batch.column(at)))
            pred = np.where(names[pred] == UNKNOWN, -1, pred)
            yield pa.record_batch(
                [*batch.columns, pa.array(names[pred], pa.string()), pa.array(np.where(pred < 0, 0.0, score), pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return base.mapInArrow(run, schema)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """The contract's rows: learn where crc32(doc_id) mod 3 is not 1, predict all."""
    docs = docs.select("doc_id", "text", "lang")
    scorer = train(docs.where(crc_mod("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), scorer).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )
