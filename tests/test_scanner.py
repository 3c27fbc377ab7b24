import json
import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.automaton import Automaton
from pathloom.errors import DepthAboveLimitError, DepthBelowZeroError, JsonPathRuntimeError, MalformedStringQuotesError, MissingClosingCharacterError, QueryTooComplexError, UnsupportedFeatureError
from pathloom.functions import JsonPath
from pathloom.lang import parse
from pathloom.operators.scanner import Scan, shred
from tests.naive import select


def run(query: str, text: str, **options) -> list[str]:
    raw = text.encode()
    return [raw[a:b].decode() for a, b in JsonPath.compile(query, **options).spans_of(raw)]


SHOP = '{ "shop" : {"name":"Ünïcode \\" }] shop", "items":[ {"id": 1, "tags":[]}, {"id":2.50,"tags":["a","b", "c"]} , null, [ [7] ,8] ], "id":true } }'


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("$", [SHOP]),
        ("$.shop.id", ["true"]),
        ("$.shop.items[0]", ['{"id": 1, "tags":[]}']),
        ("$.shop.items[*].id", ["1", "2.50"]),
        ("$..id", ["1", "2.50", "true"]),
        ("$..tags[1:]", ['"b"', '"c"']),
        ("$..tags[::2]", ['"a"', '"c"']),
        ("$.shop.items[3][0][0]", ["7"]),
        ("$..[0]", ['{"id": 1, "tags":[]}', '"a"', "[7]", "7"]),
        ("$..[0]..*", ["1", "[]", "7"]),
        ("$.shop.items[9]", []),
        ("$.shop[0]", []),
        ("$.shop.items.id", []),
        ("$..items..[1]", ['{"id":2.50,"tags":["a","b", "c"]}', '"b"', "8"]),
        ("$.shop.items[2:2]", []),
        ("$.shop.items[::0]", []),
        ("$.*.*[3].*", ["[7]", "8"]),
        ("$..nothing", []),
        ("$['shop']..['name']", ['"Ünïcode \\" }] shop"']),
    ],
)
def test_selects(query, found):
    assert run(query, SHOP) == found
    small = json.dumps(json.loads(SHOP), separators=(",", ":"), ensure_ascii=False).replace("2.5", "2.50")
    assert [json.loads(x) for x in run(query, small)] == [json.loads(x) for x in found]  # white space changes nothing


def test_nodes_are_reported_once_and_in_document_order():
    assert run("$..x..x", '{"x":{"x":{"x":42}}}') == ['{"x":42}', "42"]
    assert run("$..*..*", "[[[1]]]") == ["[1]", "1"]
    assert run("$..[3::][3]", "[0,1,2,[0,1,2,[0,1,2,7]]]") == ["[0,1,2,7]", "7"]


@pytest.mark.parametrize(("text", "found"), [("", []), (" \n\t\r", []), ("  12 \n", ["12"]), ("\n null", ["null"]), ('""', ['""'])])
def test_root_of_atoms_and_blanks(text, found):
    assert run("$", text) == found
    assert run("$..*", text) == []
    assert run("$.a", text) == []


def test_offsets_are_bytes():
    assert JsonPath.compile("$.b").spans_of('{"é😀":1,"b":2}') == [(16, 17)]


def test_keys_are_compared_as_written():
    text = '{"\\u0041":1,"A":2,"q\\"uote":3,"uote":4}'
    assert run("$.A", text) == ["2"]
    assert run("$.A", text, mode="rfc", keys="decoded") == ["1", "2"]
    assert run("$..uote", text) == ["4"]
    assert run("$['q\"uote']", text) == []
    assert run("$['q\"uote']", text, mode="rfc", keys="decoded") == ["3"]
    assert run("$..uote", '{"a\\"uote": {"uote":1}}') == ["1"]


def test_repeated_keys():
    text = '{"a":1,"a":{"b":2},"a":{"b":3}}'
    assert run("$.a", text) == ["1"]
    assert run("$.a.b", text) == ["2"]  # an atomic value can't lead on, so the next is tried
    assert run("$..b", text) == ["2", "3"]
    assert run("$.*", text) == ["1", '{"b":2}', '{"b":3}']


def test_lenient_reading():
    assert run("$[*]", "[1,2,]") == ["1", "2"]
    assert run("$.b", '{"a":"x" , "b" :\n3,}') == ["3"]
    assert run("$..b", '{"a":1} {"b":2}') == ["2"]  # a find by name goes on after the first document
    assert run("$.*", '{"a":1} {"b":2}') == ["1"]


@pytest.mark.parametrize(
    ("query", "text", "error"),
    [("$.a.*", '{"a":[1,2', MissingClosingCharacterError), ("$.*", '{"a":"x', MalformedStringQuotesError), ("$.*", "]", DepthBelowZeroError), ("$..*", "[" * 300 + "]" * 300, DepthAboveLimitError)],
)
def test_errors_of_documents(query, text, error):
    with pytest.raises(error):
        run(query, text)


def test_depth_counts_what_is_entered_only():
    deep = "[" * 300 + "]" * 300
    assert run("$.a", f'{{"x":{deep},"a":1}}') == ["1"]
    assert len(run("$..*", "[" * 255 + "]" * 255)) == 254


@pytest.mark.parametrize("query", ["$['a','b']", "$[-1]", "$[-2:]", "$[:-1]", "$[::-1]", "$[?@.a]"])
def test_compat_mode_refuses_what_only_rfc_mode_executes(query):
    with pytest.raises(UnsupportedFeatureError):
        JsonPath.compile(query)
    JsonPath.compile(query, mode="rfc")


def test_limits_of_size():
    with pytest.raises(QueryTooComplexError):
        JsonPath.compile("$" + ".a" * 256)
    JsonPath.compile("$" + ".a" * 254)
    with pytest.raises(QueryTooComplexError):
        JsonPath.compile("$..a" + ".*" * 10)


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("$.shop.items[-1][-1]", ["8"]),
        ("$.shop.items[1].tags[::-1]", ['"a"', '"b"', '"c"']),
        ("$.shop.items[1].tags[-2:]", ['"b"', '"c"']),
        ("$.shop['id','name','id']", ['"Ünïcode \\" }] shop"', "true"]),
        ("$.shop.items[?@.id]", ['{"id": 1, "tags":[]}', '{"id":2.50,"tags":["a","b", "c"]}']),
        ("$.shop.items[?@.id > 1].id", ["2.50"]),
        ("$.shop.items[?@.id == 1.0].id", ["1"]),
        ("$.shop.items[?@.absent == @.other].id", ["1", "2.50"]),
        ("$.shop.items[?@.id < 'a']", []),
        ("$.shop.items[?@ == null]", ["null"]),
        ("$.shop.items[?$.shop.id == true && !@.id]", ["null", "[ [7] ,8]"]),
        ("$.shop.items[?@[?@[?@ == 7]]]", ["[ [7] ,8]"]),
        ("$..[?@ == 'b' || @ == 8]", ['"b"', "8"]),
        ("$.shop.items[?@.tags == @.tags]", ['{"id": 1, "tags":[]}', '{"id":2.50,"tags":["a","b", "c"]}', "null", "[ [7] ,8]"]),
    ],
)
def test_rfc_mode(query, found):
    assert run(query, SHOP, mode="rfc") == found


keys = st.sampled_from(["a", "b", "c"])
values = st.recursive(st.sampled_from(["1", '"s]"', "null", "true", '"\\"a\\":"']), lambda v: st.one_of(st.lists(v, max_size=5).map(lambda x: "[" + " , ".join(x) + "]"), st.dictionaries(keys, v, max_size=3).map(lambda d: "{" + ",".join(f'"{k}" :{x}' for k, x in d.items()) + "}")), max_leaves=12)
steps = st.one_of(
    keys.map(lambda k: (f"['{k}']", lambda kind, x, k=k: kind == "key" and x == k)),
    st.just(("[*]", lambda kind, x: True)),
    st.integers(0, 3).map(lambda i: (f"[{i}]", lambda kind, x, i=i: kind == "item" and x == i)),
    st.tuples(st.integers(0, 3), st.none() | st.integers(0, 5), st.integers(0, 3)).map(lambda s: (f"[{s[0]}:{'' if s[1] is None else s[1]}:{s[2]}]", lambda kind, x, s=s: kind == "item" and s[2] > 0 and x >= s[0] and (s[1] is None or x < s[1]) and (x - s[0]) % s[2] == 0)),
)


@settings(max_examples=800, deadline=None)
@given(values, st.lists(st.tuples(st.booleans(), steps), max_size=4))
def test_agrees_with_the_naive_evaluator(text, chosen):
    query = "$" + "".join(".." * d + s for d, (s, _) in chosen)
    raw = text.encode()
    every = shred(raw)
    want = [every[i][6:8] for i in select(text, [(d, test) for d, (_, test) in chosen])]
    assert JsonPath.compile(query).spans_of(raw) == want
    assert JsonPath(parse(query), mode="rfc", keys="decoded").spans_of(raw) == want  # by the tree
    assert Scan(pickle.loads(pickle.dumps(Automaton(parse(query))))).count(raw) == len(want)


@settings(max_examples=500, deadline=None)
@given(st.text('{}[]:,"\\ ab1\n', max_size=30), st.sampled_from(["$..*", "$.a", "$..a", "$[1:]..b"]))
def test_any_text_ends(text, query):
    try:
        JsonPath.compile(query).spans_of(text)
    except JsonPathRuntimeError as e:
        assert str(e)


def test_storage_and_dot():
    a = Automaton(parse("$..a[1:3].b"))
    assert Automaton.from_bytes(a.to_bytes()).path == a.path
    dot = a.to_dot()
    assert dot.startswith("digraph") and "doublecircle" in dot and '"[1]"' in dot
    assert Automaton(parse("$.a[3:1]")).is_empty and Automaton(parse("$")).is_root
    assert Automaton(parse("$.a.b")).is_unitary(Automaton.START) and not Automaton(parse("$..a")).is_unitary(Automaton.START)
