import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.lang import MAX_INT, And, Comparison, Filter, Index, Name, Not, Or, ParseError, Path, PathBuilder, RecursionLimitError, Segment, Slice, SliceBuilder, SyntaxErrorKind, Test, Wildcard, escape, from_json, parse, to_json
from pathloom.lang import builder as b
from pathloom.lang.ast import Literal, Operand, SingularPath

K = SyntaxErrorKind


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("$", "$"),
        ("$ .a", "$['a']"),
        ("$.été_1", "$['été_1']"),
        ('$["a\\"b"]', "$['a\"b']"),
        ("$['it\\'s']", "$['it\\'s']"),
        ("$['\\u0041\\uD83D\\uDE00\\/']", "$['A😀/']"),
        ("$..*", "$..[*]"),
        ("$[ 0 , -1 ]", "$[0, -1]"),
        ("$[ 1 : 5 : 2 ]", "$[1:5:2]"),
        ("$[0:]", "$[:]"),
        ("$[::-1]", "$[::-1]"),
        ("$[-1::-1]", "$[::-1]"),
        ("$[:2:0]", "$[:2:0]"),
        ("$[?@.a]", "$[?@['a']]"),
        ("$[? ( @.a || @.b ) && !$.c ]", "$[?(@['a'] || @['b']) && !$['c']]"),
        ("$[?@.a<=1.50]", "$[?@['a'] <= 1.5]"),
        ("$[?1e2==@[0]]", "$[?100 == @[0]]"),
        ("$[?@.a == -0]", "$[?@['a'] == 0]"),
        ("$[?!(@.a == null)]", "$[?!(@['a'] == null)]"),
        ("$[?@[?@.b], 'x']", "$[?@[?@['b']], 'x']"),
        ("$[?@.a||@.b||@.c]", "$[?@['a'] || @['b'] || @['c']]"),
    ],
)
def test_parses_to_canonical_text(text, canonical):
    path = parse(text)
    assert str(path) == canonical
    assert parse(canonical) == path
    assert pickle.loads(pickle.dumps(path)) == path


@pytest.mark.parametrize(
    ("text", "kind", "pos", "length"),
    [
        (" $", K.DISALLOWED_LEADING_WHITESPACE, 0, 1),
        ("$.a ", K.DISALLOWED_TRAILING_WHITESPACE, 3, 1),
        (".a", K.MISSING_ROOT_IDENTIFIER, 0, 1),
        ("$['\n']", K.INVALID_UNESCAPED_CHARACTER, 3, 1),
        ("$['\\x']", K.INVALID_ESCAPE_SEQUENCE, 3, 2),
        ("$['\\\"']", K.INVALID_ESCAPE_SEQUENCE, 3, 2),
        ("$['\\uD800']", K.UNPAIRED_HIGH_SURROGATE, 3, 6),
        ("$['\\uDC00']", K.UNPAIRED_LOW_SURROGATE, 3, 6),
        ("$['\\u00g0']", K.INVALID_HEX_DIGIT_IN_UNICODE_ESCAPE, 7, 1),
        ("$['a", K.MISSING_CLOSING_SINGLE_QUOTE, 4, 1),
        ('$["a', K.MISSING_CLOSING_DOUBLE_QUOTE, 4, 1),
        ("$a", K.INVALID_SEGMENT_START, 1, 1),
        ("$..1", K.INVALID_SEGMENT_AFTER_TWO_PERIODS, 3, 1),
        ("$[]", K.EMPTY_SELECTOR, 1, 2),
        ("$[a]", K.INVALID_SELECTOR, 2, 1),
        ("$[1 2]", K.MISSING_SELECTOR_SEPARATOR, 4, 1),
        ("$[1", K.MISSING_CLOSING_BRACKET, 3, 1),
        ("$.1", K.INVALID_NAME_SHORTHAND_AFTER_ONE_PERIOD, 2, 1),
        ("$[-0]", K.NEGATIVE_ZERO_INTEGER, 2, 2),
        ("$[007]", K.LEADING_ZEROS, 2, 3),
        ("$[?@.a == 1e999]", K.NUMBER_PARSE_ERROR, 10, 5),
        (f"$[{MAX_INT + 1}]", K.INDEX_PARSE_ERROR, 2, 16),
        (f"$[{MAX_INT + 1}:]", K.SLICE_START_PARSE_ERROR, 2, 16),
        (f"$[:{MAX_INT + 1}]", K.SLICE_END_PARSE_ERROR, 3, 16),
        (f"$[::{MAX_INT + 1}]", K.SLICE_STEP_PARSE_ERROR, 4, 16),
        ("$[?(@.a]", K.MISSING_CLOSING_PARENTHESIS, 7, 1),
        ("$[?!@.a==1]", K.INVALID_NEGATION, 3, 1),
        ("$[?1]", K.MISSING_COMPARISON_OPERATOR, 4, 1),
        ("$[?1 = @.a]", K.INVALID_COMPARISON_OPERATOR, 5, 5),
        ("$[?@.a == ]", K.INVALID_COMPARABLE, 10, 1),
        ("$[?@.* == 1]", K.NON_SINGULAR_QUERY_IN_COMPARISON, 3, 4),
        ("$[?x]", K.INVALID_FILTER, 3, 1),
        ("$['é', x]", K.INVALID_SELECTOR, 8, 1),
    ],
)
def test_errors_tell_kind_and_bytes(text, kind, pos, length):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (kind, pos, length) in [(x.kind, x.pos, x.length) for x in e.value.errors]
    assert "^" in str(e.value)


def test_all_errors_are_told_at_once_and_mended_where_that_is_plain():
    with pytest.raises(ParseError) as e:
        parse("$[01].a[x]['\\q']")
    assert [x.kind for x in e.value.errors] == [K.LEADING_ZEROS, K.INVALID_SELECTOR, K.INVALID_ESCAPE_SEQUENCE]
    with pytest.raises(ParseError) as e:
        parse(" .a[01")
    assert e.value.suggestion() == "$.a[1]"
    assert "did you mean `$.a[1]`?" in str(e.value)


def test_long_queries_are_cut_around_the_error():
    with pytest.raises(ParseError) as e:
        parse("$" + ".abc" * 100 + "[x]" + ".abc" * 100)
    assert max(map(len, e.value.pretty(width=60).splitlines())) < 80


def test_options():
    assert parse(" $.a\n", allow_surrounding_whitespace=True) == parse("$.a")
    deep = "$" + "[?@" * 130 + "]" * 130
    with pytest.raises(RecursionLimitError):
        parse(deep)
    assert parse(deep, recursion_limit=None)


def test_function_extensions_are_no_part_of_the_language():
    with pytest.raises(ParseError):
        parse("$[?length(@.a) == 1]")


def test_builders_make_what_the_parser_makes():
    built = PathBuilder().child_name("a").descendant_wildcard().child_index(2).child(lambda s: s.name("x").slice(1, 5, 2).wildcard()).descendant_filter(b.and_(b.equal_to(b.query_relative("p", 0), b.literal(1)), b.not_(b.test_absolute(parse("$.q"))))).to_query()
    assert built == parse("$.a..*[2]['x', 1:5:2, *]..[?@.p[0] == 1 && !$.q]")
    assert SliceBuilder().with_end(3).with_step(-1).to_slice() == Slice(None, 3, -1)
    path = parse("$.a[-1][::-2]")
    assert path.segments[0].is_child and path.segments[0].only.is_name
    assert path.segments[1].only.is_end_based and path.segments[2].only.is_backward


@pytest.mark.parametrize("bad", [lambda: Index(MAX_INT + 1), lambda: Slice(step=-MAX_INT - 1), lambda: Segment(()), lambda: Comparison(Literal(1), "=", Literal(1))])
def test_nodes_check_their_values(bad):
    with pytest.raises(ValueError):
        bad()


names = st.text(st.characters(exclude_categories=("Cs",)), max_size=6)
ints = st.integers(-MAX_INT, MAX_INT)
operands = st.one_of(st.builds(Literal, st.one_of(names, ints, st.booleans(), st.none(), st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: not x.is_integer()))), st.builds(Operand, st.builds(SingularPath, st.lists(st.one_of(st.builds(Name, names), st.builds(Index, ints)), max_size=2).map(tuple)), st.booleans()))
plain = st.one_of(st.builds(Name, names), st.just(Wildcard()), st.builds(Index, ints), st.builds(Slice, st.none() | ints, st.none() | ints, ints))


def paths_of(selectors):
    return st.builds(Path, st.lists(st.builds(Segment, st.lists(selectors, min_size=1, max_size=3).map(tuple), st.booleans()), max_size=3).map(tuple))


exprs = st.recursive(
    st.one_of(st.builds(Comparison, operands, st.sampled_from(["==", "!=", "<", ">", "<=", ">="]), operands), st.builds(Test, paths_of(plain), st.booleans())),
    lambda e: st.one_of(st.builds(Or, e, e), st.builds(And, e, e), st.builds(Not, e), st.builds(Test, paths_of(st.builds(Filter, e)), st.booleans())),
    max_leaves=6,
)


def meaning(e, v):
    return meaning(e.left, v) or meaning(e.right, v) if isinstance(e, Or) else meaning(e.left, v) and meaning(e.right, v) if isinstance(e, And) else not meaning(e.expr, v) if isinstance(e, Not) else v[str(e)]


def leaves(e):
    return leaves(e.left) | leaves(e.right) if isinstance(e, (Or, And)) else leaves(e.expr) if isinstance(e, Not) else {str(e)}


@settings(max_examples=300, deadline=None)
@given(paths_of(plain))
def test_text_of_plain_paths_parses_back(path):
    assert parse(str(path)) == path


@settings(max_examples=300, deadline=None)
@given(exprs, st.randoms())
def test_text_of_filters_parses_back_to_the_same_meaning(e, rnd):
    path = Path((Segment((Filter(e),)),))
    again = parse(str(path))
    assert str(again) == str(path)
    found = again.segments[0].selectors[0].expr
    truth = {x: rnd.random() < 0.5 for x in sorted(leaves(e))}
    assert leaves(found) == leaves(e)
    assert meaning(found, truth) == meaning(e, truth)


@settings(max_examples=300, deadline=None)
@given(paths_of(plain), exprs)
def test_json_of_queries_reads_back(path, e):
    for p in (path, Path((Segment((Filter(e),)),)), Path((*path.segments, Segment((Filter(e), *(path.segments[0].selectors if path.segments else ())), True)))):
        assert from_json(to_json(p)) == p


@pytest.mark.parametrize("text", ["{}", "[]", "7", '{"version":2,"segments":[]}', '{"version":1,"segments":[{"descendant":false,"selectors":[]}]}', '{"version":1,"segments":[{"descendant":false,"selectors":[{"index":"a"}]}]}', '{"version":1,"segments":[{"descendant":false,"selectors":[{"name":1}]}]}', "nothing"])
def test_json_that_is_no_query(text):
    with pytest.raises(ValueError):
        from_json(text)


@settings(max_examples=500, deadline=None)
@given(st.text("$.[]*?@'\"\\ua01-:,()!&|=<> é", max_size=20))
def test_any_text_parses_or_raises(text):
    try:
        parse("$" + text)
    except (ParseError, RecursionLimitError) as e:
        assert str(e)


def test_escape():
    assert escape("a'b\"\\\n\x01") == "a\\'b\"\\\\\\n\\u0001"
    assert escape('a"', '"') == 'a\\"'
