"""Exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of the runs of ANCHOR words in any window, the one of smallest hash. A passage of a
window's length that stands in two documents selects the same anchor in both, so a window can repeat only where its
anchor does: documents are joined on their anchors. Around a shared anchor a match is extended to both sides, as far as
the windows reach that select the anchor; further on the next anchor takes over. The extension of an anchor to so many
words left and right is equal in two documents if the hashes of the windows there are, so the documents of a group are
extended all together, by hash, and not pair by pair, which would cost the square of the group. The union of the windows
that an earlier document has is the set of maximal repeats. A passage in n documents costs n rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, deal, heavy_limit, spread_join, tidy
from pathloom.llm.shingles import SECOND, WordHashes, runs

#: Words in a window, and in an anchor.
WINDOW, ANCHOR = 13, 5
#: Windows of a shared anchor that meet in one group, about; more are dealt to several groups first, by document.
GROUP = 2_000


def _selected(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The hash of the anchor that each window selects: the smallest of its runs of that many words."""
    low, width, have = runs(h, anchor), window - anchor + 1, 1
    while have < width:  # low holds the minima of so many runs each
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _words(text) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "replace").split()


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, doc_id, places): the distinct anchors of each row of docs (doc_id, text), and how many windows select each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found, ids, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for doc, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), strict=True):
                words = _words(text)
                if len(words) >= window:
                    got, n = np.unique(_selected(memo.of(words), window, anchor), return_counts=True)
                    found.append(got.view(np.int64))
                    ids.append(np.full(len(got), doc, np.int64))
                    places.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, ids, places)], ["anchor", "doc_id", "places"])

    return docs.mapInArrow(tidy(run), "anchor long, doc_id long, places int")


def _extensions(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Of docs (doc_id, text, shared, part): (anchor, part, doc_id, windows) for each shared anchor of each row.

    part is what shared and part, two lists, say of the anchor. windows holds the hashes of the windows that select the
    anchor, each once however often the text repeats it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            cols: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]]
            hashes, sizes = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
            for doc, text, shared, part in zip(batch.column(0).to_numpy(zero_copy_only=False), *(batch.column(k) for k in range(1, 4)), strict=True):
                words = _words(text)
                if len(words) < window:
                    continue
                h = memo.of(words)
                known, parts = shared.values.to_numpy(), part.values.to_numpy()
                order = np.argsort(known, kind="stable")
                known, parts = known[order], parts[order]
                seed = _selected(h, window, anchor).view(np.int64)
                use = known[np.minimum(np.searchsorted(known, seed), len(known) - 1)] == seed
                seed, w = seed[use], runs(h, window, SECOND).view(np.int64)[use]
                if not len(seed):
                    continue
                order = np.lexsort((w, seed))
                seed, w = seed[order], w[order]
                fresh = np.concatenate(([True], (seed[1:] != seed[:-1]) | (w[1:] != w[:-1])))
                seed, w = seed[fresh], w[fresh]
                begin = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
                hashes.append(w)
                sizes.append(np.diff(np.append(begin, len(seed))))
                cols[0].append(seed[begin])
                cols[1].append(parts[np.searchsorted(known, seed[begin])])
                cols[2].append(np.full(len(begin), doc, np.int64))
            windows = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), windows], ["anchor", "part", "doc_id", "windows"])

    return docs.mapInArrow(tidy(run), "anchor long, part int, doc_id long, windows array<long>")


def _repeats(extensions: DataFrame) -> DataFrame:
    """(doc_id, w): the windows of each document that an earlier document has too.

    Windows meet in groups of an anchor's part. What has an earlier document there is decided. What has not, and belongs
    to an anchor of several parts, meets once more by window: one document of each part at most, however many have it.
    """

    def met(rows: DataFrame) -> DataFrame:
        each = rows.repartition("anchor", "part").select("anchor", "part", "doc_id", F.explode("windows").alias("w"))
        return each.withColumn("first", F.expr("min(doc_id) OVER (PARTITION BY anchor, part, w)"))

    decided = met(extensions).where("first < doc_id").select("doc_id", "w")
    undecided = met(extensions.where("part >= 0")).where("first = doc_id").drop("first")
    later = undecided.withColumn("first", F.expr("min(doc_id) OVER (PARTITION BY anchor, w)")).where("first < doc_id")
    return decided.unionByName(later.select("doc_id", "w"))


def _cut(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Removes the words that the windows in docs (doc_id, text, repeats) cover."""
    fresh = [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), *([("kept_text", "string"), ("spans", "array<struct<first:int,last:int>>")] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n_words, n_removed, digest, texts, spans = [], [], [], [], []
            for text, repeats in zip(batch.column(1), batch.column(2), strict=True):
                words = _words(text)
                n_words.append(len(words))
                gone = np.zeros(len(words) + 1, np.int32)
                if repeats.is_valid and len(words) >= window:
                    found = np.sort(repeats.values.to_numpy())
                    w = runs(memo.of(words), window, SECOND).view(np.int64)
                    hit = found[np.minimum(np.searchsorted(found, w), len(found) - 1)] == w
                    gone[: len(w)] += hit
                    gone[window : window + len(w)] -= hit
                covered = np.cumsum(gone[:-1]) > 0
                lost = int(covered.sum())
                n_removed.append(lost)
                kept = b" ".join(words if not lost else [w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                    spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)])
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                cols += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [f[0] for f in fresh])

    return docs.mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in fresh))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text and spans) for each row of docs.

    Words are separated by ASCII white space. A word goes when a window over it also starts in a row of smaller doc_id;
    windows are judged on the input. spans lists the maximal runs of words that went. Rows that repeat a doc_id are
    judged each by its own text, against smaller ids only. A row whose doc_id is null is returned whole and matches
    nothing. A null or empty text has no words. Other columns are ignored.
    window must be from anchor to anchor + 30.
    """
    if not anchor <= window <= anchor + 30:
        raise ValueError("window must be from anchor to anchor + 30")
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known, unknown = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    seeds = scratch.save(anchors(known, window, anchor), "anchors")
    # a document's windows of an anchor stay together, so groups are dealt by document
    shared = scratch.save(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("p")).where("n > 1"), "several")
    heavy = deal(shared, ["anchor"], heavy_limit(seeds.count()))
    part = F.when(F.col("p") <= group, -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("p") / group))).cast("int")
    of_doc = spread_join(seeds.drop("places"), shared.select("anchor", "p"), ["anchor"], heavy).groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"), F.collect_list(part).alias("part"))
    of_doc = scratch.save(of_doc, "shared")
    scratch.drop(seeds, shared)
    scratch.release()
    extensions = scratch.save(_extensions(known.join(of_doc, "doc_id").select("doc_id", "text", "shared", "part"), window, anchor), "extensions")
    scratch.drop(of_doc)
    scratch.release()
    repeats = scratch.save(_repeats(extensions).groupBy("doc_id").agg(F.collect_list("w").alias("repeats")), "repeats")
    scratch.drop(extensions)
    scratch.release()
    whole = known.join(repeats, "doc_id", "left").select("doc_id", "text", "repeats")
    return _cut(whole.unionByName(unknown.select("doc_id", "text", F.lit(None).cast("array<long>").alias("repeats"))), window, keep_text)
