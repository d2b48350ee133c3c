"""Posting lists: keyword search for a table of requests that reads the lists of its terms, not the texts.

Postings writes four tables once, and every search reads them:

* blocks: a row for each block, with what a score asks of it, its number, and its terms with their frequencies;
* postings: a row for each block and term: the block's number and the term's frequency. Partitioned by a hash of the
  term and sorted by term in the files, so a search opens the buckets of its terms and skips row groups within them.
  A task sorts the blocks it reads, so nothing is shuffled and a file holds the lists of some blocks;
* words: the different words of the contents and names. Document frequencies are by substring, and a term holds no
  separator, so the blocks that hold it are those of the words that do. Of frequent terms these are most lists; the
  words of the blocks, read in one pass without a shuffle, then say the same;
* sizes: blocks and their tokens by file and language, the sums from which the statistics of any filter follow.

An index that is brought up to date by file keeps Lists of other tables: postings with the block's columns, and grams,
the 1-, 2- and 3-grams of each word, by which the words that hold a term are found.

Requests are rows. Each distinct filter has statistics of its own; scores are sums over (request, block), whose
parts are added in the order of the query's terms, so equal blocks have equal scores on any cluster. Results are
those of ranking.bm25_search for every request.

Cases: blocks with a NULL content or name count as empty there. Requests without a term give no rows. A NULL lang
or path filters nothing; a block with a NULL language or file passes no filter on it. Equal blocks are counted
each, and ranked once."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.functions import scoring as S
from corvine.functions import text as X
from corvine.operators import passes
from corvine.operators import ranking as R
from corvine.schema import KEY, Request

#: What a posting says of its block; __row tells blocks of a file apart that are otherwise alike.
BLOCK = ["__row", *KEY, "kind", "name", "__mark", "language", "length"]
#: Terms or words up to which a search names them in its filters; more are joined by shuffle.
LISTED = 5_000
#: Terms of all requests up to which their weights are sent to every task.
WEIGHED = 50_000
#: Bytes of text for a task at least, and at most where the texts are dealt anew.
TASK_BYTES, SPREAD_BYTES = 2 << 20, 128 << 20
#: Terms of all requests above which a search of written lists reads the blocks whole, WEIGHED terms at a time.
NAMED = 1_000
#: Blocks that meet others of their file, up to which their numbers are sent to every task.
MEETING = 1_000_000
#: Terms that are tried on every word; more are looked up among its pieces.
TRIED = 64
#: Bytes of text for each bucket of new lists, and buckets at least. Every task that writes has a file in each.
BUCKET_BYTES = 1 << 30
LEAST_BUCKETS = 16

_BLOCK = "__row bigint, file_path string, start_line bigint, end_line bigint, kind string, name string, __mark bigint, language string, length int"
POSTING = f"{_BLOCK}, term string, tf int, held boolean"
GRAM, SIZE = "gram string, word string", "language string, file_path string, n bigint, total bigint"
_SCHEMAS = {
    "blocks": f"{_BLOCK}, words string, others string, tfs array<int>",
    "postings": "term string, __row bigint, tf int, held boolean, bucket int",
    "words": "word string",
    "sizes": SIZE,
}
REQUEST = "request int, query string, lang string, limit int, path string"


#: A term's marked words in a row, in a text of marked words.
_RUN = r"([^ \t]++)\t++(?: \1\t++)*+"


def term_runs(tokens: Column, held: Column) -> Column:
    """Array of one string for each term, from which run_counts reads its frequency. Words hold no white space: those of
    `tokens` end in a tab, those of `held`, which are distinct, in two, so that a sort puts a term's words together, the
    held one last. Sort and search are Spark's own functions on strings; expressions of lambdas take several times as long."""
    marked = F.concat(F.transform(tokens, lambda t: F.concat(t, F.lit("\t"))), F.transform(held, lambda w: F.concat(w, F.lit("\t\t"))))
    return F.regexp_extract_all(F.array_join(F.sort_array(marked), " "), F.lit(_RUN), F.lit(0))


def run_counts(run: Column) -> tuple[Column, Column, Column]:
    """term, tf, held of a string of term_runs."""
    term, held = F.substring_index(run, "\t", 1), F.endswith(run, F.lit("\t\t"))
    extra = held.cast("int")
    # a word takes its bytes, a tab and a space; the held one has another tab, the last no space
    words = F.floor((F.octet_length(run) + 1 - extra) / (F.octet_length(term) + 2)).cast("int")
    return term.alias("term"), (words - extra).alias("tf"), held.alias("held")


def term_counts(tokens: Column, held: Column) -> Column:
    """Array of (term, tf, held): how often each is among the tokens, and whether it is among the words of `held`,
    which are distinct."""
    return F.transform(term_runs(tokens, held), lambda r: F.struct(*run_counts(r)))


def _with_runs(blocks: DataFrame) -> DataFrame:
    """The columns of BLOCK and the strings of term_runs."""
    words = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), X.SEPARATORS), "")
    held = F.array_distinct(F.concat(words(F.col("content")), words(F.col("name"))))
    wide = [F.col(c).cast("bigint").alias(c) for c in KEY[1:]]  # lines
    return R.with_tokens(blocks).select(
        F.monotonically_increasing_id().alias("__row"),
        KEY[0],
        *wide,
        *["kind", "name", R.block_mark(), "language", "length"],
        term_runs(F.col("tokens"), held).alias("__runs"),
    )


def postings(blocks: DataFrame) -> DataFrame:
    """A row for each block and term: the columns of BLOCK, term, tf, held."""
    # exploded by a select of its own: in that of _with_runs every run would get a number of its own
    return _with_runs(blocks).select(*BLOCK, F.explode("__runs").alias("__run")).select(*BLOCK, *run_counts(F.col("__run")))


def block_rows(blocks: DataFrame) -> DataFrame:
    """A row for each block: the columns of BLOCK; words: those of its content and name, joined by spaces; others: what
    else is among its tokens; tfs: how often each of both is among its tokens."""
    held = lambda r: F.endswith(r, F.lit("\t\t"))
    rows = _with_runs(blocks).select(*BLOCK, F.filter("__runs", held).alias("__held"), F.filter("__runs", lambda r: ~held(r)).alias("__others"))
    joined = lambda runs: F.array_join(F.transform(runs, lambda r: F.substring_index(r, "\t", 1)), " ")
    tfs = F.transform(F.concat("__held", "__others"), lambda r: run_counts(r)[1]).alias("tfs")
    return rows.select(*BLOCK, joined("__held").alias("words"), joined("__others").alias("others"), tfs)


def list_rows(rows: DataFrame) -> DataFrame:
    """Of rows of block_rows, one for each of their terms: term, __row, tf, held."""
    parts = lambda c: F.array_remove(F.split(c, " "), "")
    own = rows.select("__row", "tfs", parts(F.concat_ws(" ", "words", "others")).alias("__terms"), F.size(parts("words")).alias("__n"))
    each = own.select("__row", "tfs", "__n", F.posexplode("__terms").alias("__at", "term"))
    return each.select("term", "__row", F.get("tfs", "__at").alias("tf"), (F.col("__at") < F.col("__n")).alias("held"))


def sizes_of(blocks: DataFrame) -> DataFrame:
    """language, file_path, n blocks and their total tokens."""
    return R.with_tokens(blocks).groupBy("language", "file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))


def gram_rows(rows: DataFrame, *by: str) -> DataFrame:
    """gram, word of the words that posting rows hold, within the columns `by`."""
    words = rows.where("held").select(*by, "term").distinct()
    return words.select(*by, F.explode(grams_of(F.col("term"))).alias("gram"), F.col("term").alias("word"))


def grams_of(word: Column, least: int = 1) -> Column:
    """Distinct grams of a word: of each length from `least` to 3 that it has."""
    # a term asks for its longest grams only
    return F.array_distinct(F.concat(*[_pieces(word, k) for k in range(least, 4)]))


def asked_grams(term: Column) -> Column:
    """The grams by which the words that hold a term are found."""
    return F.when(F.length(term) >= 3, grams_of(term, 3)).otherwise(F.array(term))


def request_table(spark: SparkSession, requests: list[Request]) -> DataFrame:
    """Requests as rows, numbered from 0."""
    return spark.createDataFrame([(i, r.query, r.lang, r.limit, r.path) for i, r in enumerate(requests)], REQUEST)


class Lists:
    """Searches over tables of lists. rows: posting rows; by_file: sizes; grams: gram and word. Each part of a corpus has
    its grams. buckets: the number of hash buckets of the terms, where rows have a column bucket."""

    buckets: int | None = None

    def __init__(self, rows: DataFrame, by_file: DataFrame, grams: DataFrame) -> None:
        self.rows, self.by_file, self.grams = rows, by_file, grams

    def _lists(self, rows: DataFrame, key: str, keys: DataFrame, value: str) -> tuple[DataFrame, bool]:
        """The lists of the values in keys, and whether these were few enough to be named: then only their buckets
        and row groups are read, and what is joined to the lists may be broadcast."""
        spark = rows.sparkSession
        few = [r[0] for r in keys.select(value).distinct().limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return rows, False
        named = rows.where(F.col(key).isin(few))
        if self.buckets is None:
            return named, True
        parts = spark.createDataFrame([(w,) for w in few], "w string").select(_bucket(F.col("w"), self.buckets)).distinct().collect() if few else []
        return named.where(F.col("bucket").isin([r[0] for r in parts])).drop("bucket"), True

    def words_of(self, terms: DataFrame) -> DataFrame:
        """term, word: the indexed words that hold each term. terms: term, distinct."""
        asked = terms.select("term", F.explode(asked_grams(F.col("term"))).alias("gram"))
        lists, few = self._lists(self.grams, "gram", asked, "gram")
        # candidates by the rarest gram of a term alone; whether a word holds the term is then seen on the word itself
        sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
        known = asked.join(F.broadcast(sizes) if few else sizes, "gram", "left")
        rarest = known.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("size", F.lit(0)), "gram")).alias("gram"))
        met = lists.join(F.broadcast(rarest) if few else rarest, "gram")
        return met.where(F.contains("word", "term")).select("term", "word").distinct()

    def document_frequencies(self, wanted: DataFrame) -> DataFrame:
        """wanted: filter, term, languages, path. filter, term, df: the blocks that pass the filter and hold the term."""
        words = self.words_of(wanted.select("term").distinct())
        lists, few = self._lists(self.rows, "term", words, "word")
        words = words.withColumnRenamed("term", "asked")
        met = lists.where("held").join(F.broadcast(words) if few else words, F.col("term") == F.col("word"))
        once = met.groupBy(F.col("asked").alias("term"), "file_path", "__row").agg(F.first("language").alias("language"))
        passed = once.join(wanted, "term").where(_passes())
        return passed.groupBy("filter", "term").agg(F.count(F.lit(1)).alias("df"))

    def sizes(self, filters: DataFrame) -> DataFrame:
        """filters: filter, languages, path. filter, n, average: of the blocks that pass."""
        every = F.lit("*")  # stands for any language where a filter names none
        by = self.by_file.select(F.explode(F.array_compact(F.array(F.concat(F.lit("l"), "language"), every))).alias("l"), "file_path", "n", "total")
        named = F.transform("languages", lambda x: F.concat(F.lit("l"), x))
        asked = filters.select("filter", "path", F.explode(F.coalesce(named, F.array(every))).alias("l"))
        passed = by.join(asked, "l").where(_path_passes())
        return passed.groupBy("filter").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("average"))

    def scores(self, requests: DataFrame) -> DataFrame:
        """request, limit, the columns of BLOCK, score: of each request, the blocks that score above zero."""
        asked = _with_filters(requests)
        terms = asked.select("*", F.posexplode(X.tokens(F.col("query"))).alias("at", "term"))
        wanted = terms.select("filter", "term", "languages", "path").distinct()
        df = self.document_frequencies(wanted)
        sizes = self.sizes(terms.select("filter", "languages", "path").distinct())
        weighed = (
            terms.join(sizes, "filter")
            .join(df, ["filter", "term"], "left")
            .withColumn("idf", S.idf(F.col("n"), F.coalesce("df", F.lit(0))))
            .select("request", "query", "limit", "languages", "path", "at", "term", "idf", "average")
        )
        lists, few = self._lists(self.rows, "term", terms, "term")
        # few terms of few requests: a row for each term of a request
        small = few and terms.limit(WEIGHED + 1).count() <= WEIGHED
        own, block = self._with_blocks(lists.where("tf > 0"), small)
        weights = weighed.drop("query", "limit")
        met = own.join(F.broadcast(weights) if small else weights, "term").where(_passes())
        part = S.bm25_term(F.col("tf").cast("double"), F.col("idf"), F.col("length"), F.col("average"))
        parts = F.array_sort(F.collect_list(F.struct("at", part.alias("part"))))  # as many as the query has terms
        total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x.part)
        # sums are made of numbers alone; the rest of a block and of a request is added to them
        sums = met.groupBy("request", "__block").agg(total.alias("total"))
        given = requests.select("request", "query", "limit")
        full = sums.join(block, "__block").join(F.broadcast(given) if small else given, "request")
        score = F.col("total") * S.name_boost(F.col("name"), F.col("kind"), F.col("query")) * S.kind_boost(F.col("kind"))
        return full.select("request", "limit", *BLOCK, score.alias("score")).where((F.col("score") > 0) & ~F.isnan("score"))

    def _with_blocks(self, lists: DataFrame, dealt: bool) -> tuple[DataFrame, DataFrame]:
        """Posting rows with what filters and weights ask of their block, and the blocks: both by __block. dealt: the
        former by block; what is asked of a block then meets before the requests, whose sums need no shuffle."""
        # one key, whose NULL files are equal, so that sums and blocks are dealt alike
        rows = lists.withColumn("__block", F.struct("file_path", "__row"))
        own = rows.select("__block", "file_path", "language", "length", "term", "tf")
        block = rows.groupBy("__block").agg(F.first(F.struct(*BLOCK)).alias("b")).select("__block", "b.*")
        return (own.repartition("__block") if dealt else own), block

    def _candidates(self, requests: DataFrame) -> DataFrame:
        """scores(), at least of the blocks that search() can list and of those that make them go."""
        return self.scores(requests)

    def search(self, requests: DataFrame, overlap: str = "outer") -> DataFrame:
        """requests: the columns of REQUEST. Their results after overlap removal and the cap of a file, best first:
        request, ordinal (from 1), the block's key, kind and name, __mark, score. ranking.whole_rows adds the rest."""
        scored = self._candidates(requests).drop("__row", "language", "length")
        best = R.cap_per_file(R.without_overlap(scored, overlap, ("request",)), by=("request",))
        return R.listed(best, "request", F.col("limit")).select("request", "ordinal", *KEY, "kind", "name", "__mark", "score")


class Postings(Lists):
    """Lists in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @property
    def rows(self) -> DataFrame:
        return self._table("postings")

    @property
    def words(self) -> DataFrame:
        return self._table("words")

    @property
    def by_file(self) -> DataFrame:
        return self._table("sizes")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.root}/buckets").first()["buckets"]

    def write(self, blocks: DataFrame, buckets: int | None = None) -> None:
        """Lists of these blocks alone, in the place of any that are there. The texts are cut into terms once; the lists
        are made of the rows that are written then, as only those fix the numbers of the blocks."""
        by_task = blocks.groupBy(F.spark_partition_id().alias("p")).agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b"))
        sizes = [r["b"] for r in by_task.collect()]
        if buckets is None:
            buckets = max(LEAST_BUCKETS, -(-sum(sizes) // BUCKET_BYTES))
        blocks = _spread(blocks, sizes)
        self._put("buckets", self.spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1))
        self._put("blocks", block_rows(blocks))
        lists = list_rows(self.blocks).withColumn("bucket", _bucket(F.col("term"), buckets))
        self._put("postings", lists.sortWithinPartitions("bucket", "term", "__row"), "bucket")
        self._put("words", self.rows.where("held").select(F.col("term").alias("word")).distinct())
        self._put("sizes", self.blocks.groupBy("language", "file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")))

    def _put(self, name: str, rows: DataFrame, *by: str) -> None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
        out.partitionBy(*by).parquet(f"{self.root}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def words_of(self, terms: DataFrame) -> DataFrame:
        asked = terms.select("term")
        if asked.limit(TRIED + 1).count() <= TRIED:
            return self.words.join(F.broadcast(asked), F.contains("word", "term")).select("term", "word")
        lengths = [r[0] for r in asked.select(F.length("term")).distinct().collect()]
        pieces = F.array_distinct(F.concat(*[_pieces(F.col("word"), k) for k in sorted(lengths)]))
        return self.words.select("word", F.explode(pieces).alias("term")).join(asked, "term").select("term", "word")

    def document_frequencies(self, wanted: DataFrame) -> DataFrame:
        found = self.words_of(wanted.select("term").distinct()).limit(LISTED + 1).collect()
        if len(found) > LISTED:
            met = self.blocks.select("language", "file_path", "words").join(F.broadcast(wanted), F.contains("words", "term") & _passes())
        else:
            words = self.spark.createDataFrame(found, "asked string, word string")
            lists, _ = self._lists(self.rows, "term", words, "word")
            once = lists.where("held").join(F.broadcast(words), F.col("term") == F.col("word")).select("__row", F.col("asked").alias("term")).distinct()
            met = once.join(self.blocks.select("__row", "language", "file_path"), "__row").join(F.broadcast(wanted), "term").where(_passes())
        return met.groupBy("filter", "term").agg(F.count(F.lit(1)).alias("df"))

    def _with_blocks(self, lists: DataFrame, dealt: bool) -> tuple[DataFrame, DataFrame]:
        own = lists.select(F.col("__row").alias("__block"), "term", "tf")
        block = self.blocks.select(F.col("__row").alias("__block"), *BLOCK)
        of = block.select("__block", "file_path", "language", "length")
        return (own.repartition("__block") if dealt else own).join(of, "__block"), block


    def scores(self, requests: DataFrame) -> DataFrame:
        return self._scored(requests, False)

    def _candidates(self, requests: DataFrame) -> DataFrame:
        return self._scored(requests, True)

    def _scored(self, requests: DataFrame, listed: bool) -> DataFrame:
        """Few terms by their lists; more in passes over the blocks, WEIGHED terms of requests in each or so."""
        many = requests.agg(F.sum(F.size(X.tokens(F.col("query")))).alias("n")).first()["n"] or 0
        if many <= NAMED:
            return super().scores(requests)
        parts = -(-many // WEIGHED)
        meeting = self._meeting() if listed else None
        own = F.pmod(F.xxhash64("request"), F.lit(parts))
        return functools.reduce(DataFrame.unionByName, [self._pass(requests.where(own == i), meeting) for i in range(parts)])

    def _meeting(self) -> np.ndarray | None:
        """Numbers of the blocks whose lines hold those of another block of their file, or are held; None if there are many."""
        by = Window.partitionBy("file_path")
        down = by.orderBy("start_line", F.desc("end_line"), "__row").rowsBetween(Window.unboundedPreceding, -1)
        up = by.orderBy(F.desc("start_line"), "end_line", F.desc("__row")).rowsBetween(Window.unboundedPreceding, -1)
        met = (F.max("end_line").over(down) >= F.col("end_line")) | (F.min("end_line").over(up) <= F.col("end_line"))
        rows = self.blocks.select("__row", (met | F.col("start_line").isNull() | F.col("end_line").isNull()).alias("met")).where("met")
        found = rows.select("__row").limit(MEETING + 1).toArrow()["__row"].to_numpy()
        return np.sort(found) if len(found) <= MEETING else None

    def _pass(self, requests: DataFrame, meeting: np.ndarray | None) -> DataFrame:
        """scores() of requests whose terms the driver and every task can hold. meeting: as passes.scores takes it."""
        spark, asked = self.spark, _with_filters(requests)
        stats = {r["filter"]: r for r in self.sizes(asked.select("filter", "languages", "path").distinct()).collect()}
        rows = asked.select("*", X.tokens(F.col("query")).alias("terms"), F.lower("query").alias("lower")).collect()
        rows = [r for r in rows if r["terms"] and r["filter"] in stats]  # without a block, no results
        at, of = ({v: i for i, v in enumerate(dict.fromkeys(x))} for x in ((t for r in rows for t in r["terms"]), (r["filter"] for r in rows)))
        filters, own = [None] * len(of), [{} for _ in of]
        for r in rows:
            filters[of[r["filter"]]] = (r["languages"], r["path"])
            own[of[r["filter"]]] |= dict.fromkeys(at[t] for t in r["terms"])
        number = requests.schema["request"].dataType.simpleString()
        idfs: list[dict[int, float]] = [{} for _ in of]
        if rows:
            wanted = spark.createDataFrame([(i, t, stats[f]["n"]) for f, i in of.items() for t in own[i]], "filter int, term int, n bigint")
            df = passes.frequencies(self.blocks, list(at), filters, [list(o) for o in own])
            met = wanted.join(df, ["filter", "term"], "left").select("filter", "term", S.idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
            for r in met.collect():
                idfs[r["filter"]][r["term"]] = r["idf"]
        each = [passes.Asked(r["request"], r["limit"] or 0, r["lower"].encode(), of[r["filter"]], [at[t] for t in r["terms"]]) for r in rows]
        return passes.scores(self.blocks, BLOCK, list(at), filters, [stats[f]["average"] for f in of], idfs, each, meeting, number)


def _with_filters(requests: DataFrame) -> DataFrame:
    """request, query, limit, path, languages, filter: requests of one filter have the same."""
    return requests.select(
        "request",
        "query",
        "limit",
        "path",
        F.array_distinct(F.transform(F.split("lang", ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).alias("languages"),
        F.to_json(F.struct("lang", "path")).alias("filter"),
    )


def _spread(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """The blocks, dealt anew only where few tasks would read most of the texts, as of a file that Spark cannot split. sizes:
    bytes of text by task."""
    total, cores = sum(sizes), blocks.sparkSession.sparkContext.defaultParallelism
    if max(sizes, default=0) <= 2 * max(total // cores, TASK_BYTES):
        return blocks
    return blocks.repartition(min(-(-total // TASK_BYTES), max(cores, -(-total // SPREAD_BYTES))))


def _pieces(word: Column, k: int) -> Column:
    """The parts of a word that have k letters."""
    n = F.length(word)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array())


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _path_passes() -> Column:
    return F.col("path").isNull() | F.coalesce(F.contains("file_path", "path"), F.lit(False))


def _passes() -> Column:
    return (F.col("languages").isNull() | F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False))) & _path_passes()
