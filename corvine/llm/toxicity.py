"""Operator 10: toxicity from class-conditional Kneser-Ney models.

Two bigram models over words, one of toxic and one of ordinary texts, give every text two log-likelihoods. Counts n
are texts that hold a word or a pair, so that a text which repeats itself counts once:

    P_c(w | v) = X_c(vw) / n_c(v.)  +  L_c(v) Q_c(w | v),        Q_c(w | v) = S(w | v) R_c(w) / Z_c(v)
    R_c(w) = P_c(w) / S(w),      P_c(w) = X_c(w) / N_c  +  L_c S(w)

S is the Kneser-Ney model of both classes together: pair counts less SHARED_DISCOUNT back off to continuation counts
(different words before w), and these to a uniform share that unknown words get, too. X_c is a class's count less a
discount, L_c the mass which that takes away, 1 where a class has not seen v, and Z_c(v) what makes Q_c a distribution;
so each P_c(. | v) sums to one over the known words and the unknown one. The discount is what the shared counts let
one expect of the class, E, and D_c + DEVIATIONS sqrt(E) more; for a pair E comes from Q_c, so that it counts beyond its
words only. An expression which a class holds about as often as the shared counts say, or in few texts, thus has the
shared probability, and ordinary words cancel in a comparison. D_c is D times the class's share of the counts.

A text's evidence is the difference of its log-likelihoods for each word (their length-normalised comparison). A
logistic curve of it, learned on labelled rows that gave no counts, is the score; D is the one of DISCOUNTS with the
least logistic loss on these rows.

Words are runs of letters (ASCII letters and multi-byte characters), with A-Z lower-cased. Learning uses a
bounded sample, by a hash of the doc_id: of each label value about DOCS_PER_CLASS rows and BYTES_PER_CLASS
bytes of whole texts; one fold of four is for calibration, with weights that restore the true share of the
classes. Scoring reads every whole text.

Cases: NULL and empty texts, and texts without words, have evidence zero and log-likelihoods 0. Rows of
labels that repeat a doc_id count as toxic if any is; NULL labels are left out. With no labelled row of one
class all scores are the share of toxic labels, 0 if there are none. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.textkit import BYTE_VALUE, FOLD, IS_LETTER, batches_of, chunks, crc_mod, flat, mix, range_hashes, release, spans

DOCS_PER_CLASS = 3000
BYTES_PER_CLASS = 16 << 20
SHARED_DISCOUNT = 0.75
#: Discounts of the class counts to choose from, in texts of the smaller class, and standard deviations on top.
DISCOUNTS = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0)
DEVIATIONS = 2.0
U64 = np.uint64


def letter_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words before each document."""
    folded = FOLD[data]
    starts, ends, first = spans(IS_LETTER[folded], off)
    return range_hashes(BYTE_VALUE[0][folded], starts, ends), first


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0x9E3779B97F4A7C15) + right)


def _find(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code among the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at, known[at] == codes


def _texts_with(values: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """How many of the sets of values hold each known one."""
    out = np.zeros(len(known), np.float32)
    v, n = np.unique(np.concatenate([*values, np.zeros(0, U64)]), return_counts=True)
    out[np.searchsorted(known, v)] = n
    return out


@dataclass
class Counts:
    """What the models are made of: words, pairs with the places of their words, and for each class the
    number of texts that hold them."""

    words: np.ndarray
    pairs: np.ndarray
    left: np.ndarray
    right: np.ndarray
    of_words: list[np.ndarray]
    of_pairs: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[list[np.ndarray]]) -> "Counts":
        """texts: for the ordinary and the toxic class, the word hashes of each of its texts."""
        none = np.zeros(0, U64)
        words = np.unique(np.concatenate([none, *(np.unique(x) for t in texts for x in t)]))
        codes, lefts, rights = [], [], []
        for t in texts:
            own = []
            for x in t:
                code, first = np.unique(pair_hash(x[:-1], x[1:]), return_index=True)
                own.append(code)
                lefts.append(x[:-1][first])
                rights.append(x[1:][first])
            codes.append(own)
        pairs, first = np.unique(np.concatenate([none, *(c for own in codes for c in own)]), return_index=True)
        left, right = (np.searchsorted(words, np.concatenate([none, *side])[first]).astype(np.int32) for side in (lefts, rights))
        return cls(
            words,
            pairs,
            left,
            right,
            [_texts_with([np.unique(x) for x in t], words) for t in texts],
            [_texts_with(own, pairs) for own in codes],
        )


def _discounted(n: np.ndarray, cut: float, group: np.ndarray | None = None, groups: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the counts less the cut in their groups, and the mass that each group gives up."""
    taken = np.minimum(n, cut)
    group = np.zeros(len(n), np.int64) if group is None else group
    total = np.bincount(group, n, groups)
    left = np.where(total > 0, np.bincount(group, taken, groups) / np.maximum(total, 1), 1.0)
    return (n - taken) / np.maximum(total, 1)[group], left


def _excess(n: np.ndarray, expected: np.ndarray, discount: float) -> np.ndarray:
    return np.maximum(n - expected - discount - DEVIATIONS * np.sqrt(expected), 0)


@dataclass
class KneserNey:
    """Log-probabilities of both classes, ready for lookup: row 0 ordinary, row 1 toxic."""

    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray  # log P_c(w) with nothing before it: Q_c of the continuation shares
    room: np.ndarray  # what a pair that is not known adds to that
    pair: np.ndarray  # log P_c(w | v)
    unknown: np.ndarray  # as word, for a word that is not known
    curve: np.ndarray | None = None  # weight of the evidence, and offset

    @classmethod
    def learn(cls, counts: Counts, discount: float) -> "KneserNey":
        c, size = counts, len(counts.words)
        release()
        before = np.bincount(c.right, minlength=size).astype(float)  # different words before each word
        types = max(len(c.pairs), 1)
        floor = max(SHARED_DISCOUNT * (before > 0).sum(), SHARED_DISCOUNT) / types / (size + 1)
        shared = np.maximum(before - SHARED_DISCOUNT, 0) / types + floor
        both, spare = _discounted(sum(c.of_pairs), SHARED_DISCOUNT, c.left, size)
        base, back = _discounted(sum(c.of_words), SHARED_DISCOUNT)
        base = base + back * shared  # S(w) of single words
        totals = [max(n.sum(), 1) for n in c.of_words], [max(m.sum(), 1) for m in c.of_pairs]
        word, room, pair, unknown = [], [], [], []
        for n, m, of_words, of_pairs in zip(c.of_words, c.of_pairs, *totals, strict=True):
            own = _excess(n, of_words * base, discount * of_words / min(totals[0])) / of_words
            left = 1 - own.sum()
            own = own / base + left  # R_c
            one = (shared * own).sum() + floor * left
            norm = np.bincount(c.left, both * own[c.right], size) + spare * one  # Z_c
            q = (both + spare[c.left] * shared[c.right]) * own[c.right] / norm[c.left]
            seen = np.maximum(np.bincount(c.left, m, size), 1)
            more = _excess(m, np.bincount(c.left, m, size)[c.left] * q, discount * of_pairs / min(totals[1])) / seen[c.left]
            rest = 1 - np.bincount(c.left, more, size)
            word.append(np.log(shared * own / one).astype(np.float32))
            room.append(np.log(rest * spare * one / norm).astype(np.float32))
            pair.append(np.log(more + rest[c.left] * q).astype(np.float32))
            unknown.append(np.log(floor * left / one))
        return cls(c.words, c.pairs, *map(np.stack, (word, room, pair)), np.array(unknown, np.float32))

    def places(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of every word in both classes, given the word before it in its text."""
        n = len(tokens)
        at, known = _find(self.words, tokens)
        out = np.where(known, self.word[:, at] if len(self.words) else 0, self.unknown[:, None])
        inner = np.ones(n, bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        k = np.flatnonzero(inner)
        spot, hit = _find(self.pairs, pair_hash(tokens[k - 1], tokens[k]))
        seen = known[k - 1]
        out[:, k[seen]] += self.room[:, at[k[seen] - 1]]
        out[:, k[hit]] = self.pair[:, spot[hit]]
        return out

    def likelihoods(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Both log-likelihoods of each document, a word."""
        lens = np.diff(first)
        if not len(tokens):
            return np.zeros((2, len(lens)))
        total = np.concatenate((np.zeros((2, 1)), np.cumsum(self.places(tokens, first), axis=1, dtype=np.float64)), axis=1)
        return (total[:, first[1:]] - total[:, first[:-1]]) / np.maximum(lens, 1)

    def score(self, mean: np.ndarray) -> np.ndarray:
        weight, offset = self.curve
        return 1 / (1 + np.exp(-np.clip(weight * (mean[1] - mean[0]) + offset, -40, 40)))

    def calibrate(self, mean: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
        """Weighted logistic curve by Newton's method, with a small ridge; returns its loss."""
        x = mean[1] - mean[0]
        scale = max(x.std(), 1e-6)
        x = np.stack([x / scale, np.ones(len(x))], 1)
        beta, ridge = np.zeros(2), np.array([1e-3, 1e-9])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
            g = x.T @ (weight * (toxic - p)) - ridge * beta
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, g)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -40, 40))), 1e-9, 1 - 1e-9)
        self.curve = beta / np.array([scale, 1])
        return float(-(weight * np.where(toxic == 1, np.log(p), np.log(1 - p))).sum())


def within(rows: list, most: int) -> list:
    """Of (doc_id, label, place, size), in order of place, those of each label whose sizes fit into `most` bytes;
    one that does not fit is passed over."""
    out, used = [], {}
    for doc_id, label, _, size in sorted(rows, key=lambda r: (r[2], r[0])):
        if used.get(label, 0) + size <= most:
            used[label] = used.get(label, 0) + size
            out.append((doc_id, label))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str) -> tuple[list, dict[int, int]]:
    """Rows (label, fold, word hashes) of a bounded sample, and the number of labelled rows of each class.

    First the sizes of about DOCS_PER_CLASS documents of each class reach the driver, then the words of those
    that fit into BYTES_PER_CLASS. What is broadcast are their doc_ids."""
    spark = docs.sparkSession
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max(column) > 0).cast("int").alias("label")
    )
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(DOCS_PER_CLASS / max(counts.get(1, 1), 1))).otherwise(
        F.lit(DOCS_PER_CLASS / max(counts.get(0, 1), 1))
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1_000_000)) / 1_000_000
    chosen = F.broadcast(marks.withColumn("place", place).where(F.col("place") < share))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(chosen, "doc_id").groupBy("doc_id", "label", "place").agg(F.sum(F.octet_length("text")).alias("size"))
    kept = within([tuple(r) for r in sizes.collect()], BYTES_PER_CLASS)
    if not kept:
        return [], counts

    def run(batches):
        for batch in batches_of(batches, 3):
            data, off = flat(batch.column(3))
            out = []
            for a, b in chunks(off):
                o = off[a : b + 1]
                tokens, first = letter_words(data[o[0] : o[-1]], o - o[0])
                out += [tokens[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "label", "fold", "words"])

    ids = F.broadcast(spark.createDataFrame(kept, "doc_id long, label int"))
    rows = (
        texts.join(ids, "doc_id")
        .select("doc_id", "label", crc_mod("doc_id", 5).cast("int").alias("fold"), "text")
        .mapInArrow(run, "doc_id bigint, label int, fold int, words binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
    return [(r["label"], r["fold"], np.frombuffer(bytes(r["words"]), U64)) for r in rows], counts


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", held_out: int | None = 0) -> KneserNey | float:
    """The model, or a constant score where one of the classes has no rows."""
    if held_out is not None:
        labels = labels.where(crc_mod("doc_id", 5) != held_out)
    rows, counts = labelled_sample(docs, labels, column)
    if {r[0] for r in rows} != {0, 1}:
        return counts.get(1, 0) / max(sum(counts.values()), 1) if rows else 0.0
    fit = [[w for label, fold, w in rows if label == c and fold != 4] for c in (0, 1)]
    check = [r for r in rows if r[1] == 4]
    if not all(fit) or {r[0] for r in check} != {0, 1}:
        fit, check = [[w for label, _, w in rows if label == c] for c in (0, 1)], rows
    toxic = np.array([r[0] for r in check], float)
    drawn = {c: sum(r[0] == c for r in rows) for c in (0, 1)}
    weight = np.where(toxic == 1, counts[1] / drawn[1], counts[0] / drawn[0])
    found, best, least = Counts.of(fit), None, np.inf
    for d in DISCOUNTS:
        model = KneserNey.learn(found, d)
        loss = model.calibrate(_likelihoods_of(model, [r[2] for r in check]), toxic, weight / weight.mean())
        if loss < least:
            best, least = model, loss
    return best


def _likelihoods_of(model: KneserNey, texts: list[np.ndarray], step: int = 64) -> np.ndarray:
    found = []
    for a in range(0, len(texts), step):
        part = texts[a : a + step]
        found.append(model.likelihoods(np.concatenate(part), np.concatenate(([0], np.cumsum([len(x) for x in part])))))
    return np.concatenate(found, axis=1)


def score(docs: DataFrame, model: KneserNey | float) -> DataFrame:
    """doc_id, score, predicted and both log-likelihoods a word of every row; one pass, no shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if isinstance(model, float | int):
        zero = F.lit(0.0)
        return rows.select(
            "doc_id",
            F.lit(float(model)).alias("score"),
            F.lit(int(model >= 0.5)).alias("predicted"),
            zero.alias("toxic_log"),
            zero.alias("plain_log"),
        )
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        for batch in batches_of(batches, 1):
            data, off = flat(batch.column(1))
            out, logs = np.zeros(len(off) - 1), np.zeros((2, len(off) - 1))
            for a, b in chunks(off):
                o = off[a : b + 1]
                logs[:, a:b] = m.likelihoods(*letter_words(data[o[0] : o[-1]], o - o[0]))
                out[a:b] = m.score(logs[:, a:b])
            yield pa.record_batch(
                [batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(logs[1]), pa.array(logs[0])],
                ["doc_id", "score", "predicted", "toxic_log", "plain_log"],
            )

    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int, toxic_log double, plain_log double")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learn where crc32(doc_id) mod 5 is not 0, score all."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "toxic_log", "plain_log"
    )
