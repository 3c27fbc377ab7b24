"""Documents that are shredded many at once, against the scanner and the evaluator, which take one at a time."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from pathloom.errors import JsonPathRuntimeError
from pathloom.functions import JsonPath
from pathloom.lang import parse
from pathloom.operators import bulk
from pathloom.operators.nodes import _columns
from pathloom.operators.scanner import shred
from pathloom.operators.tree import Evaluator

ORDER = '{"o":7,"c":20,"lines":[{"n":1,"p":3},{"n":2,"p":70},{"n":3,"p":7},{"n":4,"p":25}]}'


def _value(r: random.Random, depth: int):
    kind = r.random() if depth else 1
    if kind < 0.35:
        return {r.choice("abpé"): _value(r, depth - 1) for _ in range(r.randint(0, 4))}
    if kind < 0.65:
        return [_value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([0, 1, -3, 4.5, 1e30, True, None, "a", "x y", "{", ",", '"', "\\", "", 12345678901234567890])


def _texts(seed: int, n: int = 300) -> list[str | None]:
    """Documents, of which some are broken, deep, blank, no object or list, or null."""
    r, out = random.Random(seed), [None, "", " ", "3", '"a"', "}", 'x{"a":1}', '{"a":1} x', '{"a":1,2}', '[1:2]', '{"a":[1}]', '{"a":1,"a":2}', "[1 2]", "[1,]", "[" * 252 + "]" * 252, "[" * 256 + "]" * 256]
    while len(out) < n:
        text = json.dumps(_value(r, 5), ensure_ascii=r.random() < 0.2, indent=r.choice([None, None, 1]), separators=r.choice([None, (",", ":"), (" , ", " : ")]))
        if r.random() < 0.3:
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(["", *'{}[],:" 1a\n\\']) + text[at + r.randint(0, 1) :]
        out.append(text)
    r.shuffle(out)
    return out


def _one(path):
    run = Evaluator(path)

    def one(raw: bytes):
        try:
            return run.spans(raw)
        except JsonPathRuntimeError:
            return None

    return one


def _spans(texts, query, one=None):
    """Spans of each document, None of such as have no result."""
    path = parse(query)
    counts, nulls, start, end = bulk.select_many(pa.array(texts, pa.string()), path, one or _one(path))
    bounds = np.append(0, np.cumsum(counts))
    return [None if nulls[i] else list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def _never(raw: bytes):
    raise AssertionError(f"{raw} was taken alone")


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_documents_are_shredded_as_by_the_scanner(monkeypatch, size):
    monkeypatch.setattr(bulk, "BYTES", size)
    texts, seen = _texts(size), 0
    for first, data, bounds in bulk.chunks(pa.array(texts, pa.string())):
        nodes, plain = bulk.shred_many(data, bounds)
        got: dict[int, list] = {}
        if nodes is not None:
            for d, *row in zip(nodes.doc.tolist(), *(c.to_pylist() for c in _columns(nodes, bounds)), strict=True):
                got.setdefault(d, []).append(tuple(row))
        for d in np.flatnonzero(plain):
            raw = texts[first + d].encode()
            assert got[d] == [(*r[:3], r[3] and r[3].decode(), *r[4:], raw[r[6] : r[7]].decode() if r[5] == "atomic" else None) for r in shred(raw)]
            seen += 1
    assert seen > 40


@pytest.mark.parametrize("query", ["$[-1].p", "$..[-1]", "$..[-3:-1]", "$..[3:0:-2]", "$..['a','b',0,-1,::2]", "$..[?@]", "$[?1==1]", "$..[?@==1]", "$..[?@.a==@.zz]", "$..a[?@.*]..b"])
def test_masks_select_what_the_evaluator_does(query):
    texts = _texts(5, 150)
    one = _one(parse(query))
    assert _spans(texts, query) == [None if t is None else one(t.encode()) for t in texts]


def test_results_keep_their_documents_in_every_mode(spark):
    texts = _texts(11, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, json string").repartition(2)
    q = JsonPath.compile("$..[?@.a || @[0] >= 1]", mode="rfc", errors="null")
    one = _one(q.path)
    for r in docs.select("id", "json", q.count("json").alias("n"), q.indices("json").alias("i"), q.spans("json").alias("s"), q.nodes("json").alias("m")).collect():
        want = None if r.json is None else one(r.json.encode())
        assert r.n == (None if want is None else len(want))
        assert r.i == (None if want is None else [a for a, _ in want])
        assert (None if r.s is None else [tuple(x) for x in r.s]) == want
        raw = (r.json or "").encode()
        assert (None if r.m is None else [tuple(x) for x in r.m]) == (None if want is None else [(k, a, b, "complex" if raw[a] in b"{[" else "atomic", raw[a:b].decode()) for k, (a, b) in enumerate(want)])


@pytest.mark.parametrize(
    "query",
    [
        "$.lines[?@.n == 2 || !(@.p != 7 && @.p >= 50)].p",
        "$[?@[?@.n == 4]][*].p",
        "$.lines[?@.p > 100 || @.p > 10 && @.n <= 3].p",
        "$.lines[-1].p",
        "$.lines[?$.lines[3]].p",
        "$.lines[3:0:-2].n",
        "$.lines[?@.p < $.c].p",
    ],
)
def test_plain_documents_are_not_taken_alone(query):
    want = Evaluator(parse(query)).spans(ORDER.encode())
    assert want and _spans([ORDER, None, ORDER], query, _never) == [want, None, want]
