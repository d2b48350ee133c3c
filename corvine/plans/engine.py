"""The engine: searches over a table of blocks, with or without vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators import ranking as R
from corvine.operators.nearest import Asked, nearest
from corvine.operators.postings import Lists, request_table
from corvine.schema import Request

#: How many times the limit each side of a hybrid search fetches.
BM25_FETCH, VECTOR_FETCH = 3, 9
NO_HIT = "No matching block."


class Engine:
    """blocks: the block columns (more are kept). vectors: key and embedding, or None. embed: text to vector,
    or None; both are needed for the hybrid mode. lists: posting lists of the blocks, which keyword searches then
    read in place of the texts."""

    def __init__(
        self,
        blocks: DataFrame,
        vectors: DataFrame | None = None,
        embed: Callable[[str], list[float]] | None = None,
        lists: Lists | None = None,
    ) -> None:
        self.blocks, self.vectors, self.embed, self.lists = blocks, vectors, embed, lists

    def search(self, request: Request, overlap: str = "outer") -> DataFrame:
        """Ranked blocks with their score. Keyword statistics are of the rows that pass path and language; the
        vector side heeds the path only. Without vectors, or if embedding fails, scores are plain BM25."""
        blocks = R.keep_path(self.blocks, request.path)
        best = self._keyword(blocks, request, request.limit * BM25_FETCH, overlap)
        if self.vectors is None or self.embed is None:
            return R.top(best, request.limit)
        try:
            wanted = self.embed(request.query)
        except Exception:  # a model that fails degrades the search, it does not end it
            return R.top(best, request.limit)
        near = R.vector_top(R.vector_scores(blocks, self.vectors, wanted), request.limit * VECTOR_FETCH)
        both = R.fuse(best, near, blocks, limit=request.limit * (BM25_FETCH + VECTOR_FETCH))
        return R.diversify(both, request.limit, overlap)

    def _keyword(self, blocks: DataFrame, request: Request, limit: int, overlap: str) -> DataFrame:
        if self.lists is None:
            return R.bm25_search(blocks, request.query, request.languages, limit, overlap)
        asked = request_table(blocks.sparkSession, [replace(request, limit=limit)])
        found = self.lists.search(asked, overlap).drop("request", "ordinal")
        return R.top(R.whole_rows(blocks, found, limit), limit)

    def search_many(self, requests: list[Request]) -> DataFrame:
        """search() for a set of requests in one plan: their rows with the number of the request and ordinals. A
        request whose text cannot be embedded gets plain BM25."""
        asked, failed = [], set()
        for i, r in enumerate(requests if self.vectors is not None and self.embed is not None else []):
            try:
                asked.append(Asked(i, list(self.embed(r.query)), r.path, r.limit * VECTOR_FETCH))
            except Exception:  # as in search
                failed.add(i)
        if not asked:
            return self._keyword_many(requests)
        hybrid = {a.request for a in asked}
        both = [replace(r, limit=r.limit * BM25_FETCH) if i in hybrid else r for i, r in enumerate(requests)]
        words = self._keyword_many(both)
        near = nearest(self.blocks, self.vectors, asked)
        most = sum(r.limit for r in requests) * (BM25_FETCH + VECTOR_FETCH)
        fused = R.fuse(words.where(~F.col("request").isin(failed)) if failed else words, near, self.blocks, limit=most, by=("request",))
        limits = request_table(self.blocks.sparkSession, requests).select("request", F.col("limit").alias("__limit"))
        best = R.cap_per_file(R.without_overlap(fused, "outer", ("request",)), by=("request",)).join(F.broadcast(limits), "request")
        best = R.listed(best, "request", F.col("__limit"))
        columns = words.columns
        return best.select(*columns).unionByName(words.where(F.col("request").isin(failed))) if failed else best.select(*columns)

    def _keyword_many(self, requests: list[Request]) -> DataFrame:
        if self.lists is None:
            return R.bm25_many(self.blocks, requests)
        found = self.lists.search(request_table(self.blocks.sparkSession, requests))
        return R.whole_rows(self.blocks, found, sum(r.limit for r in requests), ("request",))

    def results(self, request: Request) -> DataFrame:
        """search() with ordinal and snippet; the number of rows is at most the limit."""
        found = self.search(request)
        n = request.context_lines
        terms = request.query.lower().split()
        shown = F.col("content")
        if n is not None and terms:
            shown = X.snippet("content", F.array(*map(F.lit, terms)), n)
        by = Window.orderBy(*R.total_order())
        return found.select(F.row_number().over(by).cast("bigint").alias("ordinal"), "*", shown.alias("snippet"))

    def render(self, request: Request) -> str:
        """The results as text."""
        rows = self.results(request).orderBy("ordinal").collect()
        return "".join(render_row(r) for r in rows) or NO_HIT


def two_decimals(score: float) -> str:
    """Exact value of the binary number, half to even."""
    return str(Decimal(score).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def render_row(r) -> str:
    out = [
        f"--- Result {r['ordinal']} (score: {two_decimals(r['score'])}) ---",
        f"File: {r['file_path']}  Lines: {r['start_line']}-{r['end_line']}",
        f"Kind: {r['kind']}  Name: {r['name']}",
    ]
    if r["parent"] is not None:
        out.append(f"Parent: {r['parent']}")
    if r["signature"] is not None:
        out.append(f"Signature: {r['signature']}")
    if r["annotations"]:
        out.append(f"Annotations: {', '.join(r['annotations'])}")
    return "\n".join([*out, "```", r["snippet"], "```", "", ""])
