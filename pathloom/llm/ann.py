"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, nearest first: its permutation. Each pivot has an inverted file; a vector
is posted in the files of its POSTED nearest pivots, and a query is sent to the files of its own nearest pivots only. In
a file the postings are ranked by footrule distance between permutations, the best of them are reranked by their exact
inner product, and a query's results of all its files are merged. So vectors are dealt POSTED times, and queries once
for each file they ask; nothing else grows with the index.

How many files a query must ask, and how much of them is to be reranked, depends on the data: little where vectors have
structure, much where they are spread evenly over many dimensions. It is measured: for a bounded sample of the queries
the true neighbours are found by a scan of the index, and as many files are asked, and postings reranked, as hold them.

Permutations tell of angles only. So that nearness by angle is nearness by inner product, vectors get one more component
in the index, which brings all to the length M of the longest: sqrt(M^2 - |v|^2). Queries have 0 there.

Equal vectors are one entry with its smallest ids, so that copies cost neither time nor candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pathloom.llm.common import Scratch, deal, heavy_limit, spread_join, tidy

#: Pivots that permutations are made of, at most: a place among them fits a byte.
RANKED = 127
#: Pivots that have inverted files: FILES times the root of the number of vectors, and PIVOTS at most.
FILES, PIVOTS = 0.6, 4096
#: Files that a vector is posted in.
POSTED = 2
#: Postings of a file, and queries to it, that meet in one task, about; of more, each part meets each part.
BLOCK, QUERY_BLOCK = 65_536, 16_384
#: Postings of a file that are reranked, at least.
LEAST = 40
#: Queries that tell how many files to ask and how much of them to rerank, at most, and the share of their neighbours
#: that the files must hold, and of these the reranked postings.
SAMPLE, HELD = 64, 0.97
#: Pairs of a query and a posting that a task ranks, about; and tasks, at most.
PAIRS_A_TASK, TASKS = 4_000_000, 100_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null or zero, no component null or not finite, of the usual length.

    The usual length is the commonest one, the smaller of equally common ones. Of rows that repeat an id, the one with
    the smallest vector counts. Components stay floats if they are, else they are doubles.
    """
    kind = vectors.schema[vector_col].dataType
    v = F.col(vector_col) if kind == ArrayType(FloatType(), kind.containsNull) else F.col(vector_col).cast("array<double>")
    good = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    good = good.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    lengths = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1)
    common = F.broadcast(lengths.select("n"))  # one row
    return good.join(common, F.size("v") == F.col("n")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows, scaled so that none is longer than 1, with the component that makes each as long as 1."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))])


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the pivots, nearest first, for each row; ties to the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")


def _places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in each row's permutation; a row for each pivot."""
    order = _order(x, pivots)
    out = np.empty(order.shape[::-1], np.int8)
    out[order, np.arange(len(x))[:, None]] = np.arange(len(pivots), dtype=np.int8)
    return out


def footrule(places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum over the pivots of how far their places in each column are from those in own."""
    out = np.empty(places.shape[1], np.int16)
    for at in range(0, places.shape[1], 4096):  # what is compared at once stays in the processor's cache
        np.abs(places[:, at : at + 4096] - own[:, None]).sum(axis=0, dtype=np.int16, out=out[at : at + 4096])
    return out


_FOUND = "h1 long, h2 long, best array<struct<less:double,id:long>>"
_FOUND_TYPE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("best", pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())])))])


def _search_file(queries: pa.Table, postings: pa.Table, ranked: np.ndarray, longest: float, k: int, share: float) -> pa.Table:
    """For each query the k best ids of a file, by (less, id); less is the inner product below zero."""
    if not len(queries) or not len(postings):
        return _FOUND_TYPE.empty_table()
    postings = postings.sort_by([("h1", "ascending"), ("h2", "ascending")])  # however they came, ties fall alike
    x, q = _matrix(postings["v"]), _matrix(queries["v"])
    ids = postings["ids"].combine_chunks()
    starts, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
    n = len(x)
    c = min(n, max(LEAST, k, math.ceil(share * n)))
    places = _places(_lengthened(x, longest), ranked)
    asked = _places(q / longest, ranked[:, :-1])
    sizes, less, found = [], [], []
    for j in range(len(q)):
        best = np.arange(n)
        if c < n:
            near = footrule(places, asked[:, j]).astype(np.int64) * n + best
            best = np.sort(np.argpartition(near, c - 1)[:c])
        score = -(x[best] * q[j]).sum(axis=1)  # each row on its own, so equal vectors score equal
        top = np.lexsort((flat[starts[best]], score))[:k]  # an entry before which k others begin has none of the k best
        count = starts[best[top] + 1] - starts[best[top]]
        own = flat[np.repeat(starts[best[top]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        value = np.repeat(score[top], count)
        first = np.lexsort((own, value))[:k]
        sizes.append(len(first))
        less.append(value[first])
        found.append(own[first])
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(less)), pa.array(np.concatenate(found))], ["less", "id"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pairs)
    return pa.Table.from_arrays([queries["h1"].combine_chunks(), queries["h2"].combine_chunks(), lists], schema=_FOUND_TYPE)


def _count(rows: DataFrame, column: str) -> dict[int, int]:
    """How many rows name each file; at most a row for each pivot reaches the driver."""
    return {r["file"]: r["n"] for r in rows.select(F.explode(column).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}


class _Index:
    """The stored index of a table of vectors: entries (h1, h2, ids, v, files), the pivots, and what a search needs to know."""

    def __init__(self, entries: DataFrame, pivots: np.ndarray, files: int, longest: float, scratch: Scratch):
        self.entries, self.files, self.longest, self.scratch = entries, files, longest, scratch
        self.sizes: dict[int, int] | None = None
        self.sent = entries.sparkSession.sparkContext.broadcast(pivots)

    def measure(self, asked: DataFrame, k: int) -> tuple[int, float]:
        """(ask, share): the files, nearest first, to send a query to, and the share of their postings to rerank.

        They hold the share HELD of the true neighbours of a sample of the queries. Two scans of the index with at most
        SAMPLE queries: the first finds the neighbours, the second how many postings of the file that has a neighbour are
        as near by footrule. Of each task k rows a query are sent on, and k a query reach the driver.
        """
        sample = asked.orderBy("h1", "h2").limit(SAMPLE).collect()  # bounded by the parameter
        if not sample:
            return 1, 1.0
        keys = np.array([(r["h1"], r["h2"]) for r in sample], np.int64)
        q = np.array([list(r["v"]) for r in sample], np.float64)
        sent, files, longest, n = self.sent, self.files, self.longest, len(sample)
        row = np.arange(n)[:, None]

        def footrules(x: np.ndarray) -> np.ndarray:
            places, own = _places(_lengthened(x, longest), sent.value[:RANKED]), _places(q / longest, sent.value[:RANKED, :-1])
            return np.stack([footrule(places, own[:, j]) for j in range(n)])

        def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = _order(q / longest, sent.value[:files, :-1])
            place = np.empty_like(order)
            place[row, order] = np.arange(files)
            best = {"score": np.full((n, k), -np.inf), "need": np.zeros((n, k), np.int64), "foot": np.zeros((n, k), np.int64)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, posted = _matrix(batch.column(2)), batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = q @ x.T
                score[(keys[:, :1] == batch.column(0).to_numpy()) & (keys[:, 1:] == batch.column(1).to_numpy())] = -np.inf
                top = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, :k]
                new = {"score": score[row, top], "need": place[row[:, :, None], posted[top]].min(axis=2), "foot": footrules(x)[row, top]}
                best = {c: np.hstack([best[c], new[c]]) for c in best}
                order_now = np.argsort(-best["score"], axis=1, kind="stable")[:, :k]
                best = {c: v[row, order_now] for c, v in best.items()}
            j, i = np.nonzero(np.isfinite(best["score"]))
            file = order[j, best["need"][j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (j, best["score"][j, i], best["need"][j, i], best["foot"][j, i], file)], ["j", "score", "need", "foot", "file"])

        columns = self.entries.select("h1", "h2", "v", "files")
        near = columns.mapInArrow(tidy(neighbours), "j long, score double, need long, foot long, file long")
        near = near.withColumn("r", F.expr("row_number() OVER (PARTITION BY j ORDER BY score DESC, need, foot)")).where(F.col("r") <= k).collect()
        if not near:
            return 1, 1.0
        upto = lambda values: sorted(values)[math.ceil(HELD * len(values)) - 1]
        ask = 1 + upto([r["need"] for r in near])
        foot, file = np.full((n, k), -1, np.int64), np.full((n, k), -1, np.int64)
        for r in near:
            if r["need"] < ask:
                foot[r["j"], r["r"] - 1], file[r["j"], r["r"] - 1] = r["foot"], r["file"]

        def as_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros((n, k), np.int64)
            for batch in batches:
                if batch.num_rows:
                    posted = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
                    for j, own in enumerate(footrules(_matrix(batch.column(2)))):
                        there = (posted[None, :, :] == file[j][:, None, None]).any(axis=1)
                        count[j] += (there & (own[None, :] <= foot[j][:, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * k)), pa.array(count.ravel())], ["at", "n"])

        ranks = columns.mapInArrow(tidy(as_near), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # k a query
        held = self.held()
        shares = [r["n"] / held[f] for r in ranks if (f := int(file.ravel()[r["at"]])) >= 0]
        return ask, upto(shares)

    def held(self) -> dict[int, int]:
        """The number of postings of each file: at most a row for each pivot."""
        if self.sizes is None:
            self.sizes = _count(self.entries, "files")
        return self.sizes

    def search(self, asked: DataFrame, ask: int, k: int, share: float, block: int, query_block: int) -> DataFrame:
        """(h1, h2, best): for each of the queries (h1, h2, v) the k best that its ask nearest files give, stored."""
        spark, sent, files, longest, scratch = asked.sparkSession, self.sent, self.files, self.longest, self.scratch

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = _order(_matrix(batch.column(2)) / longest, sent.value[:files, :-1])[:, :ask] if batch.num_rows else np.empty((0, ask), np.int64)
                ends = pa.array(np.arange(0, order.size + 1, ask), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(order.ravel().astype(np.int32)))], ["h1", "h2", "v", "asks"])

        kind = asked.schema["v"].dataType.simpleString()
        asked = scratch.save(asked.select("h1", "h2", "v").mapInArrow(tidy(nearest), f"h1 long, h2 long, v {kind}, asks array<int>"), "asked")
        held, wanted = self.held(), _count(asked, "asks")
        cells = [(f, math.ceil(n / block), math.ceil(wanted[f] / query_block)) for f, n in sorted(held.items()) if f in wanted]
        if not cells:
            return spark.createDataFrame([], _FOUND)
        pairs = sum(held[f] * wanted[f] for f, _, _ in cells)
        tasks = min(TASKS, sum(a * b for _, a, b in cells), math.ceil(pairs / PAIRS_A_TASK))
        sizes = F.broadcast(spark.createDataFrame(cells, "file int, parts int, query_parts int"))  # a row a file
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("h1", "h2"), F.col(c)).cast("int")
        at = ["file", "part", "query_part"]
        posted = self.entries.select("h1", "h2", "ids", "v", F.explode("files").alias("file")).join(sizes, "file").select("h1", "h2", "ids", "v", "file", own("parts").alias("part"), every("query_parts").alias("query_part"))
        sought = asked.select("h1", "h2", "v", F.explode("asks").alias("file")).join(sizes, "file").select("h1", "h2", "v", "file", own("query_parts").alias("query_part"), every("parts").alias("part"))

        def cell(queries: pa.Table, postings: pa.Table) -> pa.Table:
            return _search_file(queries, postings, sent.value[:RANKED], longest, k, share)

        got = sought.repartition(tasks, *at).groupBy(*at).cogroup(posted.repartition(tasks, *at).groupBy(*at)).applyInArrow(cell, _FOUND)
        merged = got.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("all"))  # k a file
        once = F.filter("all", lambda x, i: (i == 0) | (F.element_at("all", F.greatest(i, F.lit(1)).cast("int"))["id"] != x["id"]))
        return scratch.save(merged.select("h1", "h2", F.slice(once, 1, k).alias("best")), "found")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, reranked: float | None = None, ask: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which is_query holds, the k other rows of largest inner product found.

    is_query is a condition on the column id. rank counts from 1, ties go to the smaller id, and all other rows are
    listed if they are fewer than k. usable() tells which rows take part. Scores are inner products in double precision.
    Pivots are the vectors of smallest hash, at most as many as stated. ask is the number of files that a query is sent
    to, reranked the share of their postings that is reranked; they are measured if they are not stated. A query that
    finds fewer than k in its files is sent to all of them.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = usable(vectors, id_col, vector_col).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))  # no negative zeros
    good = scratch.save(good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit("\x01second"))}), "vectors")
    n = good.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # k + 1 ids of equal vectors: one may be the query's own; what is beyond them is dropped before rows are dealt
    few = good.withColumn("r", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY id)")).where(F.col("r") <= k + 1)
    few = scratch.save(few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "entries")
    n_entries = few.count()
    # the largest component first, so that no square overflows or vanishes
    unit = few.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()[0] or 1.0
    longest = unit * math.sqrt(few.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))).first()[0] or 1.0)
    files = max(1, min(pivots, math.ceil(FILES * math.sqrt(n_entries))))
    sample = few.orderBy("h1", "h2").limit(max(files, RANKED)).select("v").collect()  # bounded by the parameter
    chosen = _lengthened(np.array([list(r["v"]) for r in sample], np.float64), longest)
    files = min(files, len(chosen))
    index = _Index(few, chosen, files, longest, scratch)
    sent, posted, kind = index.sent, min(POSTED, files), few.schema["v"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = _order(_lengthened(_matrix(batch.column(3)), longest), sent.value[:files])[:, :posted] if batch.num_rows else np.empty((0, posted), np.int64)
            ends = pa.array(np.arange(0, order.size + 1, posted), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(order.ravel().astype(np.int32)))], ["h1", "h2", "ids", "v", "files"])

    index.entries = scratch.save(few.select("h1", "h2", "ids", "v").mapInArrow(tidy(post), f"h1 long, h2 long, ids array<long>, v {kind}, files array<int>"), "index")
    scratch.drop(few)
    queries = good.where(is_query)
    counts = queries.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    asked = scratch.save(counts, "queries")
    if ask is None or reranked is None:
        measured = index.measure(asked, k)
        ask, reranked = ask or measured[0], reranked or measured[1]
    ask = min(files, ask)
    found = index.search(asked, ask, k + 1, reranked, block, query_block)
    enough = found.where(F.size("best") >= min(k + 1, n))
    if ask < files:
        short = scratch.save(asked.join(enough, ["h1", "h2"], "left_anti"), "short")
        if not short.isEmpty():
            found = enough.unionByName(index.search(short, files, k + 1, reranked, block, query_block))
    each = queries.select("id", "h1", "h2")
    heavy = deal(asked, ["h1", "h2"], heavy_limit(asked.agg(F.sum("n")).first()[0] or 0))  # queries of one vector
    best = spread_join(each, found, ["h1", "h2"], heavy).select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return best.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def exact(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same by brute force, to measure recall against."""
    return search(vectors, is_query, k, id_col, vector_col, pivots=1, reranked=1.0, ask=1)
