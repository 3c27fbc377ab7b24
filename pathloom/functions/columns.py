"""JsonPath: a compiled query, and the columns it makes of a column of JSON text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.automaton import Automaton, check_supported, names_required
from pathloom.errors import JsonPathRuntimeError
from pathloom.lang import Parser
from pathloom.lang.ast import Index, Path, Slice
from pathloom.operators.bulk import select_many, texts_of
from pathloom.operators.scanner import Scan
from pathloom.operators.tree import Evaluator

SPAN = "array<struct<start_idx:bigint,end_idx:bigint>>"
NODE = "array<struct<seq:int,start_idx:bigint,end_idx:bigint,kind:string,value:string>>"
_BLANK = " \t\n\r"


#: Matches of an array of documents: how many each has, which have null, and all starts and ends in their order.
_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _lists(counts: np.ndarray, values: pa.Array, nulls: np.ndarray) -> pa.Array:
    ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    if nulls.any():
        return pa.ListArray.from_arrays(ends, values, mask=pa.array(nulls))
    return pa.ListArray.from_arrays(ends, values)


def _one_by_one(documents: pa.Array, spans_of: Callable) -> _Found:
    found = [None if (t := d.as_py()) is None else spans_of(t.encode("utf-8", "surrogatepass")) for d in documents]
    counts, nulls = np.array([len(s or ()) for s in found], np.int64), np.array([s is None for s in found], bool)
    return counts, nulls, *(np.array([x[k] for s in found for x in s or ()], np.int64) for k in (0, 1))


class JsonPath:
    """A query that is ready to run on any column of JSON text, one document per row.

    mode "compat" executes root, names, wildcards, indices from the start and forward slices, as child and descendant
    steps, and raises UnsupportedFeatureError for the rest of the language; mode "rfc" executes all of it. keys "raw"
    compares names with the bytes of keys as they are written, "decoded" (mode "rfc" only) with what they spell.

    A null document gives null. errors "raise" fails the job on a document that can't be read; "null" gives null for it,
    and error() tells why. The result mode decides what is computed: count() makes no texts.
    """

    def __init__(self, path: Path, mode: str = "compat", keys: str = "raw", errors: str = "raise"):
        if mode not in ("compat", "rfc") or keys not in ("raw", "decoded") or errors not in ("raise", "null"):
            raise ValueError("mode is compat or rfc, keys raw or decoded, errors raise or null")
        if keys == "decoded" and mode != "rfc":
            raise ValueError("keys='decoded' needs mode='rfc'")
        self.path, self.mode, self.keys, self.errors = path, mode, keys, errors
        if mode == "compat":
            check_supported(path)
            self.automaton = Automaton(path)
            self.automaton.check_size()
        else:
            plain = all(not s.is_filter and not (isinstance(s, Index) and s.index < 0) and not (isinstance(s, Slice) and (s.step < 0 or (s.start or 0) < 0 or (s.end or 0) < 0)) for g in path.segments for s in g.selectors)
            self.automaton = Automaton(path) if plain and keys == "raw" and len(path.segments) < 256 else None

    @classmethod
    def compile(cls, query: str | Path, mode: str = "compat", keys: str = "raw", errors: str = "raise", **parser) -> JsonPath:
        """From query text or a built path; further options are those of lang.Parser."""
        return cls(query if isinstance(query, Path) else Parser(**parser).parse(query), mode, keys, errors)

    def __reduce__(self):
        return JsonPath, (self.path, self.mode, self.keys, self.errors)

    def __str__(self) -> str:
        return str(self.path)

    def to_dot(self) -> str:
        if self.automaton is None:
            raise ValueError("this query has no automaton")
        return self.automaton.to_dot()

    # on the driver or in a task

    def spans_of(self, document: str | bytes) -> list[tuple[int, int]]:
        """(start, end) in bytes of each match in one document."""
        raw = document.encode("utf-8", "surrogatepass") if isinstance(document, str) else document
        run = Scan(self.automaton) if self.automaton is not None else Evaluator(self.path, self.keys == "decoded")
        return run.spans(raw)

    # columns

    @property
    def is_root(self) -> bool:
        return self.path.is_root

    @property
    def is_empty(self) -> bool:
        return self.automaton is not None and self.automaton.is_empty

    def prefilter(self, doc: Column | str) -> Column | None:
        """A condition that every document with a match meets, for the reader to skip others; None if there is none.

        Sound because raw keys are compared bytewise: each name stands in the text as it is compared.
        """
        doc = F.col(doc) if isinstance(doc, str) else doc
        if self.keys != "raw":
            return None
        out = None
        for quoted in dict.fromkeys(names_required(self.path)):
            has = F.contains(doc, F.lit(quoted.decode()))
            out = has if out is None else out & has
        return out

    def _over(self, doc: Column | str, kind: str, build: Callable[[pa.Array, _Found], pa.Array], null: Column) -> Column:
        """A column computed by build from documents and their matches."""
        path, mode, keys, strict = self.path, self.mode, self.keys, self.errors == "raise"
        many = self.automaton is None and keys == "raw"
        compiled: list = []

        def spans_of(raw: bytes) -> list[tuple[int, int]] | None:
            if not compiled:
                q = JsonPath(path, mode, keys)
                compiled.append((Scan(q.automaton) if q.automaton is not None else Evaluator(path, keys == "decoded")).spans)
            try:
                return compiled[0](raw)
            except JsonPathRuntimeError:
                if strict:
                    raise
                return None

        @F.arrow_udf(kind)
        def run(documents: pa.Array) -> pa.Array:
            return build(documents, select_many(documents, path, spans_of) if many else _one_by_one(documents, spans_of))

        doc = F.col(doc) if isinstance(doc, str) else doc
        must = self.prefilter(doc) if strict else None
        # documents without the names aren't sent: the function gets a null in their place
        return run(doc) if must is None else F.when(doc.isNotNull() & ~must, null).otherwise(run(F.when(must, doc)))

    def count(self, doc: Column | str) -> Column:
        """bigint: the number of matches."""
        doc = F.col(doc) if isinstance(doc, str) else doc
        if self.is_empty:
            return F.when(doc.isNotNull(), F.lit(0).cast("bigint"))
        if self.is_root:
            return (F.length(F.trim(doc, F.lit(_BLANK))) > 0).cast("bigint")

        def build(documents: pa.Array, found: _Found) -> pa.Array:
            counts, nulls, _, _ = found
            return pa.array(counts, pa.int64(), mask=nulls)

        return self._over(doc, "bigint", build, F.lit(0).cast("bigint"))

    def indices(self, doc: Column | str) -> Column:
        """array<bigint>: where each match starts, in bytes from 0."""
        doc = F.col(doc) if isinstance(doc, str) else doc
        if self.is_root or self.is_empty:
            return F.transform(self.spans(doc), lambda s: s["start_idx"])

        def build(documents: pa.Array, found: _Found) -> pa.Array:
            counts, nulls, start, _ = found
            return _lists(counts, pa.array(start, pa.int64()), nulls)

        return self._over(doc, "array<bigint>", build, F.array().cast("array<bigint>"))

    def spans(self, doc: Column | str) -> Column:
        """array<struct<start_idx, end_idx>>: each match's bytes, the end exclusive."""
        doc = F.col(doc) if isinstance(doc, str) else doc
        none = F.array().cast(SPAN)
        if self.is_empty:
            return F.when(doc.isNotNull(), none)
        if self.is_root:
            start = (F.octet_length(doc) - F.octet_length(F.ltrim(doc, F.lit(_BLANK)))).cast("bigint")
            end = F.octet_length(F.rtrim(doc, F.lit(_BLANK))).cast("bigint")
            return F.when(F.length(F.trim(doc, F.lit(_BLANK))) > 0, F.array(F.struct(start.alias("start_idx"), end.alias("end_idx")))).when(doc.isNotNull(), none)

        def build(documents: pa.Array, found: _Found) -> pa.Array:
            counts, nulls, start, end = found
            flat = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start_idx", "end_idx"])
            return _lists(counts, flat, nulls)

        return self._over(doc, SPAN, build, none)

    approximate_spans = spans  # an exact span is a valid approximate one

    def nodes(self, doc: Column | str) -> Column:
        """array<struct<seq, start_idx, end_idx, kind, value>>: the matches; value is the text as it stands."""
        doc = F.col(doc) if isinstance(doc, str) else doc
        none = F.array().cast(NODE)
        if self.is_root or self.is_empty:
            text = F.trim(doc, F.lit(_BLANK))
            kind = F.when(F.substring(text, 1, 1).isin("{", "["), "complex").otherwise("atomic")
            return F.transform(self.spans(doc), lambda s: F.struct(F.lit(0).alias("seq"), s["start_idx"].alias("start_idx"), s["end_idx"].alias("end_idx"), kind.alias("kind"), text.alias("value")))

        def build(documents: pa.Array, found: _Found) -> pa.Array:
            counts, nulls, start, end = found
            seq = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
            kinds, value = texts_of(documents, counts, start, end)
            cols = [pa.array(seq.astype(np.int32)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), kinds, value]
            return _lists(counts, pa.StructArray.from_arrays(cols, ["seq", "start_idx", "end_idx", "kind", "value"]), nulls)

        return self._over(doc, NODE, build, none)

    def error(self, doc: Column | str) -> Column:
        """string: why a document can't be read; null for one that can."""
        path, mode, keys = self.path, self.mode, self.keys

        @F.arrow_udf("string")
        def run(documents: pa.Array) -> pa.Array:
            q, out = JsonPath(path, mode, keys), []
            for d in documents:
                try:
                    if d.is_valid:
                        q.spans_of(d.as_py())
                    out.append(None)
                except JsonPathRuntimeError as e:
                    out.append(str(e))
            return pa.array(out, pa.string())

        return run(doc)


def jsonpath_count(doc: Column | str, query: str, **options) -> Column:
    return JsonPath.compile(query, **options).count(doc)


def jsonpath_indices(doc: Column | str, query: str, **options) -> Column:
    return JsonPath.compile(query, **options).indices(doc)


def jsonpath_spans(doc: Column | str, query: str, **options) -> Column:
    return JsonPath.compile(query, **options).spans(doc)


def jsonpath_nodes(doc: Column | str, query: str, **options) -> Column:
    return JsonPath.compile(query, **options).nodes(doc)


def jsonpath_many(doc: Column | str, queries: dict[str, str], what: str = "count", **options) -> Column:
    """One struct with a field for each named query; what is count, indices or spans. Documents cross to Python once."""
    if what not in ("count", "indices", "spans"):
        raise ValueError("what is count, indices or spans")
    compiled = {name: JsonPath.compile(q, **options) for name, q in queries.items()}
    one, arrow = {"count": ("bigint", pa.int64()), "indices": ("array<bigint>", pa.list_(pa.int64())), "spans": (SPAN, pa.list_(pa.struct([("start_idx", pa.int64()), ("end_idx", pa.int64())])))}[what]
    strict = all(q.errors == "raise" for q in compiled.values())
    doc = F.col(doc) if isinstance(doc, str) else doc
    # a document that lacks the names of every query matches none, and isn't sent
    conditions = [q.prefilter(doc) for q in compiled.values()]
    must = reduce(or_, conditions) if strict and all(c is not None for c in conditions) else None

    @F.arrow_udf("struct<" + ",".join(f"`{n}`:{one}" for n in compiled) + ">")
    def run(documents: pa.Array) -> pa.Array:
        cols: dict[str, list] = {n: [] for n in compiled}
        for d in documents:
            raw = None if not d.is_valid else d.as_py().encode("utf-8", "surrogatepass")
            for n, q in compiled.items():
                try:
                    s = None if raw is None else q.spans_of(raw)
                except JsonPathRuntimeError:
                    if strict:
                        raise
                    s = None
                cols[n].append(None if s is None else len(s) if what == "count" else [a for a, _ in s] if what == "indices" else [{"start_idx": a, "end_idx": b} for a, b in s])
        return pa.StructArray.from_arrays([pa.array(c, arrow) for c in cols.values()], list(cols))

    if must is None:
        return run(doc)
    none = F.struct(*((F.lit(0) if what == "count" else F.array()).cast(one).alias(n) for n in compiled))
    return F.when(doc.isNotNull() & ~must, none).otherwise(run(F.when(must, doc)))
