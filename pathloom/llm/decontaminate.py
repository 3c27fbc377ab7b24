"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; what is left of a run of words is its template. Templates of the
benchmark's windows are hash-joined with those of the documents. A match counts only if its slots are consistent: a
value of the item always stands for one value of the document. That catches questions with new numbers and names, and
leaves alone texts that merely share a pattern.

Windows are joined by their lower-cased words too, placeholders or not. That catches word for word what has few plain
words, or what is capitalised or punctuated so that the document's template is another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, by_ids, heavy_keys, spread_join, tidy
from pathloom.llm.shingles import SECOND, U, mix, runs

#: Words in a template window; an item of fewer words is one window of its own length.
WINDOW = 8
#: A template window must hold this many words that are no placeholders, or half its words if it is shorter.
MIN_PLAIN = 4
#: Windows of an item that must match (all, if it has fewer).
MIN_MATCHED = 3
#: Bits of the filter of benchmark windows that goes to every task.
FILTER_BITS = 1 << 24
MEMO_WORDS = 250_000
UNITS = frozenset("%|°|°c|°f|$|€|£|cm|mm|km|m|meters|metres|meter|metre|miles|mile|feet|foot|ft|inches|inch|in.|yards|yard|kg|g|mg|grams|gram|kilograms|kilogram|lbs|lb|pounds|pound|ounces|ounce|oz|tons|ton|l|ml|liters|litres|liter|litre|gallons|gallon|s|sec|seconds|second|min|minutes|minute|h|hours|hour|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|usd|eur|percent|degrees|degree|mph|kmh|km/h|hz|khz|mhz|ghz|kb|mb|gb|tb|watts|volts|joules".split("|"))
_NUMBER = re.compile(r"[$€£#+-]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th|[a-z]{1,3})?")
_SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_EDGE = re.compile(r"^[^\w$€£#%°+-]+|[^\w%°]+$")
_HASH = {kind: xxhash.xxh3_64_intdigest(f"\x00{kind}") for kind in ("number", "unit", "name")}
#: Multipliers of a window's second hash, by place.
_POWERS = np.cumprod(np.full(WINDOW, SECOND, U))
PLAIN, NUMBER, UNIT, CAPITAL, EMPTY = range(5)


def _classify(word: str) -> tuple[int, int, int, bool]:
    """(kind, template hash, hash of the word itself, whether a sentence ends with it) of a word as it stands."""
    if word.isalpha():  # most words, and quick to tell
        core, ends = word, False
    else:
        core, ends = _EDGE.sub("", word), word[-1] in ".!?:" or word[-2:] in ('."', '!"', '?"', ".)")
    low = core.lower()
    if not core:
        return EMPTY, 0, 0, ends
    own = xxhash.xxh3_64_intdigest(low)
    if low in _SPELLED or not core.isalpha() and _NUMBER.fullmatch(low):
        return NUMBER, _HASH["number"], own, ends
    if low in UNITS:
        return UNIT, _HASH["unit"], own, ends
    capital = core[0].isupper() and (len(core) == 1 or not core.isupper())
    return CAPITAL if capital else PLAIN, own, own, ends


class Templates(dict):
    """Texts as template hashes; one for each task, for it remembers words: word -> its place in the columns below."""

    def __init__(self) -> None:
        super().__init__()
        self._room(1 << 16)

    def _room(self, n: int) -> None:
        self.clear()
        self.kinds, self.hashes, self.owns, self.ends = np.zeros(n, np.int8), np.zeros(n, U), np.zeros(n, U), np.zeros(n, bool)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.kinds):
            self.kinds, self.hashes, self.owns, self.ends = (np.concatenate([c, np.zeros_like(c)]) for c in (self.kinds, self.hashes, self.owns, self.ends))
        self.kinds[i], self.hashes[i], self.owns[i], self.ends[i] = _classify(word)
        self[word] = i
        return i

    def of(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, bool]:
        """(words, template hash, own hash of each, whether each is plain, whether the first might be a name or a word).

        A capitalised word is a name unless it begins a sentence; a word in capitals throughout is plain. Words without
        letters, digits or signs are left out.
        """
        words = (text or "").split()
        if len(self) > MEMO_WORDS:
            self._room(1 << 16)
        n = len(words)
        seen = np.fromiter(map(self.__getitem__, words), np.int64, n)
        kind, h, own, ends = self.kinds[seen], self.hashes[seen], self.owns[seen], self.ends[seen]
        begins = np.concatenate(([True], ends[:-1])) if n else np.empty(0, bool)
        capital = kind == CAPITAL
        h[capital & ~begins] = U(_HASH["name"])
        plain = (kind == PLAIN) | (capital & begins)
        if (blank := kind == EMPTY).any():
            stay = np.flatnonzero(~blank)
            words, h, own, plain, capital = [words[i] for i in stay.tolist()], h[stay], own[stay], plain[stay], capital[stay]
        return words, h, own, plain, bool(len(words)) and bool(capital[0])


def _windows(h: np.ndarray, size: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first hash, second hash) of the windows of that size; with seen, those in the filter."""
    if len(h) < size or not size:
        return np.empty(0, int), np.empty(0, U), np.empty(0, U)
    h1 = runs(h, size)
    if seen is None:
        at = np.arange(len(h1))
    else:
        at = np.flatnonzero(seen[_probes(h1)[0]])
        at = at[seen[_probes(h1[at])[1]]]
    second = (h[at[:, None] + np.arange(size)] * _POWERS[:size]).sum(1, dtype=U)
    return at, h1[at], mix(second + U(size))


def _counts(plain: np.ndarray, size: int) -> np.ndarray:
    """How many plain words each window has."""
    total = np.concatenate(([0], np.cumsum(plain)))
    return total[size:] - total[: len(total) - size]


def _slots(words: list[str], plain: np.ndarray, start: int, size: int) -> list[str]:
    return [_EDGE.sub("", words[i]).lower() for i in range(start, start + size) if not plain[i]]


_WINDOW_ROWS = "id long, size int, start int, h1 long, h2 long, slots array<string>"


def _template_rows(words: list[str], h: np.ndarray, plain: np.ndarray, size: int, seen: np.ndarray | None) -> Iterator[tuple]:
    """(start, h1, h2, slots) of the windows that hold placeholders."""
    if len(words) < size or plain.all():
        return
    n_plain = _counts(plain, size)
    for a, x, y in zip(*(c.tolist() for c in _signed(*_windows(h, size, seen))), strict=True):
        if n_plain[a] < size:
            yield a, x, y, _slots(words, plain, a, size)


def _signed(at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at, h1.view(np.int64), h2.view(np.int64)


def _doc_rows(templates: Templates, text: str | None, sizes: tuple[int, ...], seen: np.ndarray) -> Iterator[tuple]:
    """(size, start, h1, h2, slots) of a document's windows in the filter; slots is null for windows of the words themselves."""
    words, h, own, plain, _ = templates.of(text)
    for size in sizes:
        for a, x, y in zip(*(c.tolist() for c in _signed(*_windows(own, size, seen))), strict=True):
            yield size, a, x, y, None
        for row in _template_rows(words, h, plain, size, seen):
            yield size, *row


def _class(words: list[str], h: np.ndarray, plain: np.ndarray) -> tuple[int, int]:
    """128 bits that items share whose templates are the same throughout, with equal values in the same places.

    What such items match by their templates is the same, whatever their values are.
    """
    slots = _slots(words, plain, 0, len(words))
    first: dict[str, int] = {}
    pattern = np.array([first.setdefault(v, k) for k, v in enumerate(slots)], np.int64)
    whole = xxhash.xxh3_128_intdigest(h.tobytes() + pattern.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _item_rows(templates: Templates, text: str | None) -> Iterator[tuple]:
    """(size, start, h1, h2, slots, first, template, c1, c2) of an item's windows; c1 and c2 tell its class (see _class).

    A window stands as its words (slots null) and, with placeholders but enough plain words, as its template. What stands
    before an item in a document decides whether its capitalised first word is read as a name there, so the first window
    is made under both readings; first is the word that must then be the document's first slot. template tells whether
    the window at start has enough plain words.
    """
    words, h, own, plain, either = templates.of(text)
    if not (size := min(WINDOW, len(words))):
        return
    enough = _counts(plain, size) >= min(MIN_PLAIN, (size + 1) // 2)
    if either and not plain[0]:
        enough[0] |= plain[1:size].sum() + 1 >= min(MIN_PLAIN, (size + 1) // 2)
    kind = _class(words, h, plain)
    for a, x, y in zip(*(c.tolist() for c in _signed(*_windows(own, size, None))), strict=True):
        yield size, a, x, y, None, None, bool(enough[a]), *kind
    need = min(MIN_PLAIN, (size + 1) // 2)
    n_plain = _counts(plain, size)
    for a, *row in _template_rows(words, h, plain, size, None):
        if n_plain[a] >= need:
            yield size, a, *row, None, True, *kind
    if either and enough[0]:
        h, other = h[:size].copy(), plain[:size].copy()
        h[0], other[0] = (U(_HASH["name"]), False) if plain[0] else (own[0], True)
        for row in _template_rows(words[:size], h, other, size, None):
            # the first word, if a name now, is told by first and is no slot
            yield size, *row[:3], row[3][1:] if plain[0] else row[3], _slots(words, other, 0, 1)[0] if plain[0] else None, True, *kind


def _window_rows(texts: DataFrame, rows, schema: str, kinds: tuple, bits=None) -> DataFrame:
    """What rows(templates, text, filter) gives for texts (id, text), after the id."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        seen = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool) if bits is not None else None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for ident, text in zip(batch.column(0).to_numpy(zero_copy_only=False).tolist(), batch.column(1), strict=True):
                for row in rows(templates, text.as_py(), seen):
                    for col, v in zip(out, (ident, *row), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return texts.mapInArrow(tidy(run), schema)


_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))


def _probes(h: np.ndarray) -> list[np.ndarray]:
    return [(h & U(FILTER_BITS - 1)).view(np.int64), (h >> U(40)).view(np.int64) & FILTER_BITS - 1]


def _filter(items: DataFrame) -> bytes:
    """A Bloom filter of FILTER_BITS bits of the items' windows; it reaches the driver in pieces of 4 KB, 2 MB in all."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    bit = items.select(F.explode(F.array(F.col("h1").bitwiseAND(mask), F.shiftrightunsigned("h1", 40).bitwiseAND(mask))).alias("bit")).withColumn("bit", F.col("bit") + 1)
    pieces = bit.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in pieces.collect():
        out[(r["piece"] - 1) * len(r["bits"]) : r["piece"] * len(r["bits"])] = r["bits"]
    return bytes(out)


def leaks(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, overlap, kind) for each document that holds an item of the benchmark.

    docs has doc_id and text, benchmark item_id and text. n_matched of the item's n_windows windows stand in the
    document word for word or with consistent slots; overlap is their share. Of an item's windows with enough plain words
    min_matched must match, or all if it has fewer; or as many of all its windows. kind is "exact" if all slots are
    equal, else "variant". Items of equal text are one, that of smallest item_id. Of items that differ in the values of
    their placeholders only, that of smallest item_id stands for all where a document is matched by template; word for
    word each is matched. So a template that many items share costs no row for each of them. Windows without enough plain
    words match word for word only. Null, empty and blank texts match nothing; null ids take no part. Rows that repeat a
    doc_id count as one document; other columns are ignored. Windows are joined by 128 bits of hash; those that many
    documents have are dealt to several tasks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    texts = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("item_id").cast("long").alias("id")).select("id", "text")
    items = scratch.save(_window_rows(texts, lambda t, text, _: _item_rows(t, text), f"{_WINDOW_ROWS}, first string, template boolean, c1 long, c2 long", (*_KINDS, pa.string(), pa.bool_(), pa.int64(), pa.int64())), "every")
    stands = items.where("slots IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("stands"))
    items = scratch.save(items.join(stands, ["c1", "c2"], "left").where("slots IS NULL OR id = stands").drop("c1", "c2", "stands"), "items")
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))  # WINDOW and less
    bits = spark.sparkContext.broadcast(_filter(items))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = scratch.save(_window_rows(known, lambda t, text, seen: _doc_rows(t, text, sizes, seen), _WINDOW_ROWS, _KINDS, bits), "found").withColumnsRenamed({"id": "doc_id", "start": "at", "slots": "doc_slots"})
    on = ["h1", "h2", "size"]
    met = spread_join(found, items.withColumnsRenamed({"id": "item_id", "slots": "item_slots"}), on, heavy_keys(found, on))
    met = met.where("first IS NULL OR doc_slots[0] = first").withColumn("doc_slots", F.expr("IF(first IS NULL, doc_slots, slice(doc_slots, 2, size(doc_slots)))"))
    # an item and a document may meet in several places; each offset is one place
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    plain_start = F.expr("IF(template, start, NULL)")
    place = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("start")).alias("offset")).agg(F.collect_set("start").alias("starts"), F.collect_set(plain_start).alias("template_starts"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    values = lambda k: F.array_distinct(F.transform("slots", lambda s: s[k]))
    place = place.where(F.size(values("i")) == F.size("slots")).withColumn("exact", ~F.exists("slots", lambda s: s["i"] != s["d"]))
    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    whole = place.groupBy("doc_id", "item_id").agg(several("starts").alias("n_matched"), several("template_starts").alias("n_template"), F.bool_and("exact").alias("exact"))
    counts = items.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("start").alias("n_windows"), F.count_distinct(plain_start).alias("of_template"))
    told = whole.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, "item_id")
    told = told.where((F.col("n_matched") >= F.least(F.lit(min_matched), "n_windows")) | (F.col("of_template") > 0) & (F.col("n_template") >= F.least(F.lit(min_matched), "of_template")))
    return told.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("overlap"), F.when(F.col("exact"), "exact").otherwise("variant").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED) -> DataFrame:
    """docs without the documents that hold a benchmark item; other columns pass through."""
    scratch = Scratch(docs.sparkSession, "leaking")
    bad = scratch.save(leaks(docs, benchmark, min_matched).select("doc_id").distinct(), "ids")
    return by_ids(docs, bad, "left_anti")
