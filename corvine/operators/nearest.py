"""Nearest vectors for many requests in one pass.

A task multiplies the requests' matrix with the vectors of an Arrow batch and keeps for each request what can be among
its nearest: by the products, which may round in another order, with a margin for that; the scores that decide and
that are returned are sums in the order of the components, as for a single request. A task gives at most k rows for
each request, which are merged by a window, so nothing grows with the corpus but the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.schema import KEY

#: Beyond what sums of products of unit vectors can differ by in any order.
MARGIN = 1e-9
#: Products of one multiplication.
PRODUCTS = 1 << 22


@dataclass(frozen=True)
class Asked:
    """One request: its number, vector, the path that a file has to contain, and how many rows it wants."""

    request: int
    vector: list[float]
    path: str | None
    k: int


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of rows, added one component after the other."""
    return np.cumsum(x * q, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def nearest(blocks: DataFrame, vectors: DataFrame, asked: list[Asked]) -> DataFrame:
    """request, key, cosine: for each request its k nearest of the keys that have a block, ties in order of the key.
    The requests are broadcast with the function; they are given by the caller, one by one."""
    wanted = [a for a in asked if a.k > 0]
    shape = "request int, file_path string, start_line int, end_line int, cosine double, k int"
    known = vectors.select(*KEY, "embedding").join(blocks.select(*KEY), KEY, "left_semi")
    if not wanted:
        return known.sparkSession.createDataFrame([], shape).drop("k")

    def run(batches):
        import pandas as pd

        width = max(len(a.vector) for a in wanted)
        matrix = np.zeros((len(wanted), width))
        for i, a in enumerate(wanted):
            matrix[i, : len(a.vector)] = a.vector
        best: list[list[tuple]] = [[] for _ in wanted]  # (-cosine, path, start, -end)
        floor = np.full(len(wanted), -np.inf)
        rows_at_once = max(1, PRODUCTS // max(len(wanted), width))
        for pdf in batches:
            for at in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[at : at + rows_at_once]
                x = np.zeros((len(part), width))
                for i, v in enumerate(part["embedding"]):
                    n = min(len(v), width)
                    x[i, :n] = v[:n]
                keys = list(zip(part["file_path"], part["start_line"].tolist(), part["end_line"].tolist(), strict=True))
                fits = {p: np.array([p in k[0] for k in keys]) for p in {a.path for a in wanted} - {None}}
                products = x @ matrix.T
                for i, a in enumerate(wanted):
                    column = products[:, i]
                    may = column >= floor[i] - MARGIN
                    if a.path is not None:
                        may &= fits[a.path]
                    at_all = np.flatnonzero(may)
                    if len(at_all) > a.k:  # all that are as near as the k-th of these, or nearly
                        least = np.partition(column[at_all], -a.k)[-a.k]
                        at_all = at_all[column[at_all] >= least - MARGIN]
                    if not len(at_all):
                        continue
                    # a shorter vector counts over the common length
                    scores = exact(x[at_all], matrix[i])
                    own = [(-s, keys[j][0], keys[j][1], -keys[j][2]) for s, j in zip(scores.tolist(), at_all.tolist(), strict=True)]
                    best[i] = sorted(best[i] + own)[: a.k]
                    if len(best[i]) == a.k:
                        floor[i] = -best[i][-1][0]
        out = [(wanted[i].request, p, s, -e, -c, wanted[i].k) for i, own in enumerate(best) for c, p, s, e in own]
        yield pd.DataFrame(out, columns=["request", *KEY, "cosine", "k"])

    order = Window.partitionBy("request").orderBy(F.desc("cosine"), "file_path", "start_line", F.desc("end_line"))
    found = known.mapInPandas(run, shape).withColumn("__n", F.row_number().over(order))
    return found.where("__n <= k").drop("__n", "k")
