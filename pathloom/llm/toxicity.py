"""Toxicity as cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold[k] - w . x): one weight vector serves all grades, and the thresholds are ordered. The
features of a text are its words and the words' first bytes, so that inflected forms of a stem share evidence. Only
features that a screening test finds related to the grade carry weight, so that long clean texts gather no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ALNUM, Scratch, extended, tidy

#: Size of the hashed feature space.
DIMS = 1 << 20
#: Lengths in bytes of the beginnings of words that are features.
STEMS = (3, 4, 5, 6, 7, 8)
#: Labelled rows that the model is fitted on, at most; those of smallest hash of doc_id are taken.
MAX_TRAIN = 8_000
#: Screening: a feature carries weight if graded rows have it this many times as often as clean ones, by this z-score,
#: and if so many graded rows have it, and such a share of them.
MIN_LIFT, MIN_Z, MIN_ROWS, MIN_SHARE = 8.0, 4.0, 4, 0.015
#: Words a task remembers.
MEMO_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters, as bytes."""
    return (text or "").encode("utf-8", "replace").translate(ALNUM).split()


def features_of(word: bytes) -> list[int]:
    return [xxhash.xxh32_intdigest(word) & DIMS - 1, *(xxhash.xxh32_intdigest(word[:k], k) & DIMS - 1 for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the screened features, and thresholds[k] between grades k and k + 1."""

    index: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) in column k, from w . x."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.atleast_1d(score)[:, None], -50, 50)))
        return np.diff(np.hstack([np.zeros((len(upto), 1)), upto, np.ones((len(upto), 1))]), axis=1)


def fit(rows: list[np.ndarray], grades: np.ndarray, l2: float = 1e-3, steps: int = 400) -> OrdinalModel:
    """Fits the model to rows of distinct feature numbers and their grades 0, 1, ...; gradient ascent with momentum.

    Where only one grade occurs, nothing can be told apart: no feature carries weight, and the thresholds give that grade.
    """
    top = max(int(grades.max(initial=0)), 1)
    n, toxic = len(rows), grades > 0
    n1, n0 = int(toxic.sum()), n - int(toxic.sum())
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n), [len(r) for r in rows]) if rows else np.empty(0, int)
    share = [(float((grades <= k).sum()) + 0.5) / (n + 1) for k in range(top)]
    start = np.maximum.accumulate(np.log(share) - np.log1p(-np.array(share)))
    if not n1 or not n0:
        return OrdinalModel(np.empty(0, np.int32), np.empty(0), start + 1e-3 * np.arange(top))
    in_toxic = np.bincount(flat[toxic[owner]], minlength=DIMS)
    in_all = np.bincount(flat, minlength=DIMS)
    p1, p0, p = in_toxic / n1, (in_all - in_toxic) / n0, in_all / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(in_all > 0, (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 0)
    # a feature of less lift would tell of length or topic, one of fewer rows of chance
    index = np.flatnonzero((z >= MIN_Z) & (in_toxic >= max(MIN_ROWS, MIN_SHARE * n1)) & (p1 >= MIN_LIFT * p0)).astype(np.int32)
    place = np.full(DIMS, -1, np.int32)
    place[index] = np.arange(len(index))
    keep = place[flat] >= 0
    col, row = place[flat[keep]], owner[keep]
    balance = np.where(toxic, 0.5 * n / n1, 0.5 * n / n0)
    balance /= balance.sum()
    w, cut = np.zeros(len(index)), np.concatenate([[1.0], np.zeros(top - 1)])  # cut[0]; then logs of the gaps
    state = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for t in range(1, steps + 1):
        x = np.bincount(row, w[col], n)
        theta = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        bounds = np.hstack([np.full((n, 1), -50.0), np.clip(theta[None, :] - x[:, None], -50, 50), np.full((n, 1), 50.0)])
        up, low = (1 / (1 + np.exp(-bounds[np.arange(n), grades + k])) for k in (1, 0))
        prob = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / prob * balance, low * (1 - low) / prob * balance
        by_theta = np.zeros(top)
        for k in range(top):
            by_theta[k] = d_up[grades == k].sum() - d_low[grades == k + 1].sum()
        by_cut = np.concatenate([[by_theta.sum()], [by_theta[k + 1 :].sum() * np.exp(cut[k + 1]) for k in range(top - 1)]])
        gradient = np.concatenate([np.bincount(col, (d_low - d_up)[row], len(w)) - l2 * w, by_cut])
        state = 0.9 * state[0] + 0.1 * gradient, 0.99 * state[1] + 0.01 * gradient**2
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, cut = w + step[: len(w)], cut + step[len(w) :]
    return OrdinalModel(index, w, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))]))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct features and the 0/1 mark of at most max_train labelled rows, without features that screening drops anyway.

    A doc_id that is labelled twice counts as toxic if either label says so; null ids, labels and texts are left out.
    What reaches the driver does not grow with the texts' lengths: features that many clean rows have stay behind.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # max_train rows of two numbers: broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array([f for w in set(words_of(t.as_py())) for f in features_of(w)], np.int32)) for t in batch.column(2)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "toxic", "features"])

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "toxic", "text")
    found = scratch.save(texts.mapInArrow(tidy(run), "doc_id long, toxic int, features array<int>").dropDuplicates(["doc_id"]), "rows")
    n1 = found.where("toxic > 0").count()
    n0 = found.count() - n1
    seen = found.select(F.explode("features").alias("f"), F.col("toxic").alias("t")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t") > 0).cast("long")).alias("in_toxic"))
    # a little wider than the screening in fit(), which decides
    enough = (F.col("in_toxic") >= MIN_ROWS) & (F.col("in_toxic") * (n0 or 1) * (1 + 1e-9) >= MIN_LIFT * (n1 or 1) * (F.col("n") - F.col("in_toxic")))
    known = scratch.save(seen.where(enough).select("f"), "features")
    held = found.select("doc_id", F.explode("features").alias("f")).join(known, "f").groupBy("doc_id").agg(F.sort_array(F.collect_list("f")).alias("features"))
    got = sorted((r["doc_id"], r["toxic"], r["features"] or ()) for r in found.select("doc_id", "toxic").join(held, "doc_id", "left").toLocalIterator())
    scratch.drop(found, known)
    return [np.array(f, np.int32) for _, _, f in got], np.array([t for _, t, _ in got], int)


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity grades from 0/1 marks: 0 is clean; toxic rows are 1, 2 or 3 by how much of the toxic vocabulary they use.

    The vocabulary are the features that a first, two-grade fit gives weight; the grades' borders are the terciles of
    their number among toxic rows.
    """
    if not toxic.any() or toxic.all():
        return toxic
    known = np.zeros(DIMS, bool)
    known[fit(rows, toxic, steps=1).index] = True
    hits = np.array([known[r].sum() for r in rows])
    borders = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    raw = np.where(toxic == 1, 1 + (hits > borders[0]) + (hits > borders[1]), 0)
    return np.searchsorted(np.unique(raw), raw)  # without gaps


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    rows, toxic = training_rows(docs, labels, max_train)
    return fit(rows, grade(rows, toxic))


_FRESH = [("n_words", "long", pa.int64()), ("expected_severity", "double", pa.float64()), ("grade", "int", pa.int32()), ("toxic_probability", "double", pa.float64()), ("is_toxic", "boolean", pa.bool_())]


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs plus n_words, expected_severity, grade (the likeliest), toxic_probability and is_toxic, for every row.

    A text's features are those of its distinct words, each counted once; the whole text is read. A null or empty text
    has no words and is never toxic. Other columns pass through; columns of docs that bear the new names are replaced.
    Nothing is shuffled; the model, at most DIMS numbers, goes to every task.
    """
    docs = docs.drop(*(n for n, _, _ in _FRESH))
    at, names, schema = docs.columns.index("text"), [*docs.columns, *(n for n, _, _ in _FRESH)], extended(docs, _FRESH)
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*sent.value)
        weight = np.zeros(DIMS)
        weight[own.index] = own.weights
        memo: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                sizes.append(len(words))
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                hits: set[int] = set()
                for w in set(words):
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = tuple(f for f in features_of(w) if weight[f])
                    if got:
                        hits.update(got)
                sums.append(sum(weight[f] for f in sorted(hits)))
            p = own.probabilities(np.array(sums, float)) if sums else np.zeros((0, len(own.thresholds) + 1))
            some = np.array(sizes) > 0
            toxic = np.where(some, 1 - p[:, 0], 0.0)
            severity = np.where(some, p @ np.arange(p.shape[1]), 0.0)
            cols = [sizes, severity, np.where(some, p.argmax(1), 0), toxic, toxic > 0.5]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, _, t) in zip(cols, _FRESH, strict=True))], names)

    return docs.mapInArrow(tidy(run), schema)
