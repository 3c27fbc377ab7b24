"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of half-bands are hashed for each document, and a table key is made of one half-band from each:
m half-bands a side give m * m tables for 2 * m half-bands' worth of minhashes. Every candidate is confirmed on the
full shingle sets. Documents of equal sets are one class throughout, so groups of copies cost one row each.

Within a bucket only links to its smallest member are tried at first, so that work grows with the bucket, not with its
square. What these leave apart is finished exactly: documents that share a bucket but not a component meet again by a
prefix filter on their rarest shingles, which misses no pair at or above the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, by_ids, deal, heavy_keys, heavy_limit, spread_join, tidy
from pathloom.llm.components import components
from pathloom.llm.shingles import U, WordHashes, mix, shingle_set

#: Minhashes in a half-band.
HALF = 3
#: Share of pairs right at the threshold that the tables may miss.
MISS = 5e-4
#: Rows of table keys that a task makes, about; and tasks that make them, at most.
KEYS_A_TASK, KEY_TASKS = 1_000_000, 100_000
#: One class in so many, by hash, tells which table keys are common; these take another way to the same rows.
PROBE = 32


def half_bands(percent: int, half: int = HALF, miss: float = MISS) -> int:
    """Half-bands a side, so that a pair at the threshold shares none on one side or the other with chance miss."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** half))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, n, dtype=U) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=U)


def signatures(docs: DataFrame, words: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, bands): of each row its set's size, a 128-bit hash of its set, and 2 * m half-bands."""
    a, b = _coefficients(2 * m * HALF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        order = np.arange(2 * m, dtype=U)
        for batch in batches:
            sizes, c1, c2, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(memo.of((text.as_py() or "").encode("utf-8", "replace").lower().split()), words)
                sizes.append(len(s))
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                c1.append((whole >> 64) - (1 << 63))
                c2.append((whole & (1 << 64) - 1) - (1 << 63))
                if not len(s):
                    bands.append(np.empty(0, np.int64))
                    continue
                low = np.full(2 * m * HALF, U(2**64 - 1))
                for at in range(0, len(s), 4096):  # a long text's hashes never stand in memory together
                    np.minimum(low, (a[:, None] * s[None, at : at + 4096] + b[:, None]).min(1), out=low)
                got = order.copy()
                for k in range(HALF):
                    got = mix(got + low.reshape(2 * m, HALF)[:, k])
                bands.append(got.view(np.int64))
            ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the sorted hashes of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets = [shingle_set(memo.of((t.as_py() or "").encode("utf-8", "replace").lower().split()), words).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), stored, whose sets have 100 * intersection >= percent * union. A document of many pairs is dealt to several tasks."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    with_a = spread_join(pairs, left, ["a"], heavy_keys(pairs, ["a"]))
    met = spread_join(with_a, right, ["b"], heavy_keys(pairs, ["b"])).where(100 * small >= percent * large)
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _members(classes: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """(key, rep, a, n) for each class and table key that several classes have: a is the smallest of these, n their number.

    Keys are dealt by hash once. A common key would send its classes to one task, so such keys are told beforehand, by
    one class in PROBE, and go by an aggregation that shrinks before it is dealt and a join with a table of at most
    HEAVY_KEYS rows. A common key that the probe misses only makes its task longer.
    """
    n_classes = classes.count()
    # each class becomes m * m rows: not in the few tasks that read so small a table
    tasks = min(KEY_TASKS, math.ceil((n_classes + 1) * m * m / KEYS_A_TASK))
    tables = F.expr(f"transform(sequence(0, {m * m - 1}), t -> xxhash64(t, bands[CAST(t DIV {m} AS int)], bands[CAST({m} + t % {m} AS int)]))")
    every = lambda of: of.select("rep", F.explode(tables).alias("key"))
    probed = every(classes.where(F.pmod(F.xxhash64("rep", F.lit("probe")), F.lit(PROBE)) == 0))
    often = heavy_limit(n_classes * m * m) // PROBE + 1
    heavy = scratch.save(probed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("key"), "common")
    keys = every(classes.repartition(tasks, "rep"))
    some = not heavy.isEmpty()
    dealt = keys.join(F.broadcast(heavy), "key", "left_anti") if some else keys
    over = "OVER (PARTITION BY key)"
    members = dealt.select("key", "rep", F.expr(f"min(rep) {over}").alias("a"), F.expr(f"count(1) {over}").alias("n")).where("n > 1")
    if some:
        common = keys.join(F.broadcast(heavy), "key")
        sizes = common.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")  # at most a row for each of heavy
        members = members.unionByName(common.join(F.broadcast(sizes), "key").select("key", "rep", "a", "n"))
    return scratch.save(members, "members")


def _left_apart(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Pairs of documents that share a bucket but no component, by a prefix filter; None if there are none.

    members: those of the buckets with more than two documents. The shingles of the documents concerned are ordered
    from rare to common among these documents. A pair at the threshold shares one of the first n - ceil(t * n) + 1.
    """
    labelled = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    torn = scratch.save(labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.first("n").alias("n")).where("x <> y").select("key", "n"), "torn")
    if torn.isEmpty():
        return None
    limit = heavy_limit(members.count())
    heavy = deal(torn, ["key"], limit)
    apart = scratch.save(spread_join(labelled, torn.select("key"), ["key"], heavy, "left_semi").select("rep", "component").distinct(), "apart")
    held = apart.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    each = scratch.save(held.select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "each")
    often = scratch.save(each.groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("x"), F.max("component").alias("y")), "often")
    limit = heavy_limit(each.count())
    heavy = deal(often, ["s"], limit, "often")
    ranked = spread_join(each, often, ["s"], heavy).groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s", (F.col("x") != F.col("y")).alias("torn")))).alias("order"))
    t = Fraction(percent, 100)
    prefix = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator - 1e-9) + 1
    first = ranked.select("rep", "component", "n", F.posexplode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("i", "o")).where("o.torn").select("rep", "component", "n", "i", "o.s")
    first = scratch.save(first, "prefix")
    scratch.drop(each, often)
    a, b = (first.select(F.col("s"), *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "component", "n", "i"))) for k in "ab")
    # the first shingle that a pair shares, and those after it, bound what it can share in all
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    near = enough & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("rep_a") < F.col("rep_b"))
    return spread_join(a, b, ["s"], heavy_keys(first, ["s"])).where(near).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are separated by ASCII white space and A-Z count as a-z. A document is the set of its runs of that many words
    (of fewer words, the whole sequence). Documents are linked when 100 * intersection >= percent * union. component_id
    is the smallest doc_id reachable, kept tells whether that is the document itself.

    A null, empty or blank text has no shingles and no links. Rows that repeat a doc_id count as one document with
    several texts. A null doc_id takes no part: component_id is null and kept true. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch, m = Scratch(spark, "neardup"), half_bands(percent)
    sig = scratch.save(signatures(docs, words, m), "signatures")
    takes_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = scratch.save(sig.where(takes_part).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "classes")
    sig_of = sig.select("doc_id", "n_shingles", "c1", "c2")
    limit = heavy_limit(sig.count())
    heavy = deal(classes, ["c1", "c2"], limit)

    members = _members(classes, m, scratch)
    pairs = scratch.save(members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = scratch.save(shingle_sets(by_ids(docs.select(F.col("doc_id").cast("long"), "text"), ids, "left_semi"), words), "sets")
    # rows that repeat a doc_id link its classes
    repeated = sig_of.where(takes_part).groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("x"), F.max(F.struct("c1", "c2")).alias("y")).where("x <> y").select("doc_id")
    same = sig_of.where(takes_part).join(repeated, "doc_id", "left_semi").select("doc_id", "c1", "c2").distinct().join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    links = scratch.save(_confirmed(pairs, sets, percent).union(same), "links")
    scratch.drop(pairs, ids)
    labels = components(links, scratch)
    if (more := _left_apart(members.where("n > 2"), labels, sets, percent, scratch)) is not None:
        more = scratch.save(more, "more")
        fresh = scratch.save(_confirmed(more, sets, percent), "fresh")
        if not fresh.isEmpty():
            scratch.drop(labels)
            labels = components(links.union(fresh), scratch)
        scratch.drop(more, fresh)
    scratch.drop(members, sets, links)
    by_class = scratch.save(classes.select("c1", "c2", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")), "found")
    scratch.drop(labels)
    found = spread_join(sig_of.where(takes_part), by_class, ["c1", "c2"], heavy).select("doc_id", "n_shingles", "component")
    alone = sig_of.where(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return found.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that a smaller doc_id of their group stands for; other columns pass through."""
    scratch = Scratch(docs.sparkSession, "copies")
    gone = scratch.save(near_duplicates(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct(), "ids")
    return by_ids(docs, gone, "left_anti")
