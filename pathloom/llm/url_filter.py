"""URL filtering: rules first, then a classifier over words.

The labels of a host are segmented into words by a unigram Viterbi: the words and their counts come from the text of all
pages. A multinomial naive Bayes model over the words of host and path, trained on all urls that a rule decides, judges
the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, heavy_keys, spread_join, wide_hash

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Letters of the longest words that the unigram model knows.
MAX_WORD = 24
#: Buckets that tokens are hashed into: the model is this many numbers whatever the corpus.
BUCKETS = 1 << 16
_HIDDEN = re.compile(r"<(script|style)\b", re.I)
_HIDDEN_END = {kind: re.compile(rf"</{kind}\s*>", re.I) for kind in ("script", "style")}
_WORD = re.compile(r"[^\W\d_]+")


def parts(url: str = "url"):
    """Host and path of a url, as columns; both empty if it is null or has no "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages plus host, path, rule and by_rule: the longest rule that fits, and its verdict; null if none fits.

    A rule fits its host and all subdomains where the url's path starts with the rule's.
    """
    host, path = parts(url_col)
    out = pages.withColumns({"host": host, "path": path})
    best = F.lit(None).cast("struct<rule:string,by_rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("by_rule"))).otherwise(best)
    return out.withColumn("rule", best).withColumns({"rule": F.col("rule.rule"), "by_rule": F.col("rule.by_rule")})


def visible(html: str) -> str:
    """html with a space for each tag, and for each script or style with all it holds. Takes time in proportion to html.

    A script or style that isn't closed is a tag like others; a "<" without any ">" after it is text.
    """
    out, at, ends = [], 0, {kind: 0 for kind in _HIDDEN_END}  # where the next end is searched for; -1: there is none
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        at = -1
        if (hidden := _HIDDEN.match(html, start)) and ends[kind := hidden[1].lower()] >= 0:
            end = _HIDDEN_END[kind].search(html, hidden.end())
            ends[kind] = at = end.end() if end else -1
        if at < 0 and (at := html.find(">", start) + 1) <= 0:
            out.append(html[start:])
            return " ".join(out)
    out.append(html[at:])
    return " ".join(out)


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): how often each word of at most MAX_WORD letters stands in the text of all pages, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for html in batch.column(0):
                seen.update(_WORD.findall(visible(html.as_py() or "").lower()))
            short = {w: n for w, n in seen.items() if len(w) <= MAX_WORD}
            yield pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], ["word", "n"])

    return pages.select(html_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest split of label into words: known maps (start, end) to a count, total is the count of all words.

    A stretch that is no known word counts as 1 / 10 ** length of an occurrence. Of equally likely splits, the one whose
    last word is longer wins.
    """
    n = len(label)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - MAX_WORD), end):
            count = known.get((start, end))
            p = math.log(count / total) if count else -math.log(total) - (end - start) * math.log(10)
            if best[start] + p > best[end] + 1e-12:
                best[end], back[end] = best[start] + p, start
    words: list[str] = []
    while n:
        words.append(label[back[n] : n])
        n = back[n]
    return words[::-1]


def segment_labels(labels: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, words) for each label: its stretches are joined with the words, and only those found go to the Viterbi.

    Stretches that many labels have, such as single letters, are dealt to several tasks.
    """
    total = float(words.agg(F.sum("n")).first()[0] or 0) + 1.0

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for begin in range(0, len(label), 4096):
                    found = [(s, label[s:e]) for s in range(begin, min(begin + 4096, len(label))) for e in range(s + 1, min(s + MAX_WORD, len(label)) + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([h1] * len(found), pa.int64()), pa.array([h2] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())], ["h1", "h2", "at", "word"])

    hashed = labels.select(*(h.alias(n) for h, n in zip(wide_hash("label"), ("h1", "h2"), strict=True)), "label")
    each = scratch.save(hashed.mapInArrow(stretches, "h1 long, h2 long, at int, word string"), "stretches")
    found = spread_join(each, words, ["word"], heavy_keys(each, ["word"])).groupBy("h1", "h2").agg(F.collect_list(F.struct("at", F.length("word").alias("k"), "n")).alias("found"))
    held = hashed.join(found, ["h1", "h2"], "left").select("label", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(segment(label, {(f["at"], f["at"] + f["k"]): float(f["n"]) for f in known or ()}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    split = scratch.save(held.mapInArrow(run, "label string, words array<string>"), "split")
    scratch.drop(each)
    return split


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, words, block_score) for each row of pages.

    words are those of the segmented host and of the path; digits count as "0". block_score is the log odds of blocking
    by naive Bayes with add-one smoothing; the words that the rules themselves name are left out of it, for they decide
    nothing where no rule fits. verdict is the rule's, else "block" where the score is above 0, else "allow". Rows keep
    their number whatever repeats; null urls have empty parts and no words, null html has no words. Without any ruled
    url of one kind the score is 0.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    urls = ruled(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), rules, "url").drop("url")
    words = scratch.save(word_counts(pages, html_col), "words")
    hosts = scratch.save(urls.select("host").distinct(), "hosts")
    labels = hosts.select(F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit(r"[^.:@\-_]+"), F.lit(0)))).alias("label")).distinct()
    labels = scratch.save(labels, "labels")
    split = segment_labels(labels, words, scratch)
    scratch.drop(words, labels)
    of_host = scratch.save(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"[^.:@\-_]+"), F.lit(0))).alias("at", "label")), "host_labels")
    of_host = spread_join(of_host, split, ["label"], heavy_keys(of_host, ["label"]))
    of_host = scratch.save(of_host.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words")), "host_words")
    path_words = F.filter(F.split(F.regexp_replace(F.lower("path"), r"\d+", "0"), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    tokens = spread_join(urls, of_host, ["host"], heavy_keys(urls, ["host"]), "left").withColumn("words", F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words)).drop("host_words")
    tokens = scratch.save(tokens, "tokens")
    scratch.drop(hosts, split, of_host)
    named = sorted({w for _, h, p in rules for w in re.findall(r"[^\W_]+", h + p)})
    telling = F.filter("words", lambda w: ~w.isin(named))
    buckets = F.transform(telling, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    weights, prior = _fit(tokens.where("by_rule IS NOT NULL").select("by_rule", F.explode(buckets).alias("bucket")), tokens)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            score = [prior + float(w[np.asarray(b, np.int64)].sum()) if b else prior for b in batch.column(6).to_pylist()]
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(batch.column(4).to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(verdict, pa.string()), batch.column(5), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "words", "block_score"])

    kind = tokens.schema["page_id"].dataType.simpleString()
    return tokens.select("page_id", "host", "path", "rule", "by_rule", "words", buckets.alias("b")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>, block_score double")


def _fit(words: DataFrame, urls: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of each bucket, and of the classes; at most two numbers a bucket reach the driver."""
    classes = {r["by_rule"]: r["n"] for r in urls.where("by_rule IS NOT NULL").groupBy("by_rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not classes.get("block") or not classes.get("allow"):
        return np.zeros(BUCKETS), 0.0
    count = {"block": np.ones(BUCKETS), "allow": np.ones(BUCKETS)}
    for r in words.groupBy("bucket", "by_rule").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        count[r["by_rule"]][r["bucket"]] += r["n"]
    odds = np.log(count["block"] / count["block"].sum()) - np.log(count["allow"] / count["allow"].sum())
    return odds, math.log(classes["block"] / classes["allow"])
