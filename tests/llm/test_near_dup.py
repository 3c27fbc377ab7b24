import random
from collections import defaultdict

import pytest

from pathloom.llm import near_dup as N
from pathloom.llm.common import Scratch
from pathloom.llm.components import components
from tests.llm.rows import DOCS, documents


def brute(rows, words, percent):
    """(n_shingles per row, component per doc_id) by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j])
            if rows[k][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])))
                parent[b] = a
    return [len(s) for s in sets], {i: find(i) for i in parent}


def check(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = N.near_duplicates(df, words, percent).collect()
    sizes, comp = brute(rows, words, percent)
    want = sorted(((i, n, comp.get(i), i is None or comp[i] == i) for (i, _), n in zip(rows, sizes, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    return comp


def text(rnd, n):
    return [f"w{rnd.randint(0, 5000)}" for _ in range(n)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_families_of_edited_copies(spark, words, percent):
    rnd, rows = random.Random(words), []
    for family in range(12):
        base = text(rnd, rnd.choice([6, 40, 150]))
        for _ in range(rnd.choice([1, 2, 25])):
            copy = base[:]
            for _ in range(rnd.randint(0, max(1, len(base) // 18))):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 9999)}"
            rows.append((len(rows) * 7 % 997, " ".join(copy) if family % 2 else "  ".join(copy).upper()))
    comp = check(spark, rows, words, percent)
    assert 12 <= len(set(comp.values())) < len(comp)


def test_a_chain_of_links_is_one_component(spark):
    rnd = random.Random(4)
    at, rows = text(rnd, 120), []
    for i in range(40):
        rows.append(((i * 17) % 41, " ".join(at)))
        at = [*at[3:], *text(rnd, 3)]
    assert len(set(check(spark, rows, 3, 85).values())) == 1


def test_a_group_of_near_misses_is_not_linked(spark):
    rnd = random.Random(9)
    base, rows = text(rnd, 100), []
    for i in range(60):
        copy = base[:]
        for k in rnd.sample(range(100), 8):
            copy[k] = f"e{rnd.randint(0, 99999)}"
        rows.append((i, " ".join(copy)))
    check(spark, rows, 3, 85)


def test_documents_that_no_table_leader_links_are_found_all_the_same(spark):
    """Of the buckets' members only links to the smallest are tried at first; here those are the wrong ones."""
    rnd = random.Random(12)
    base, rows = text(rnd, 150), []
    for i in range(30):
        copy = base[:]
        for k in rnd.sample(range(150), 9 if i < 10 else 2):
            copy[k] = f"e{rnd.randint(0, 99999)}"
        rows.append((i, " ".join(copy)))
    comp = check(spark, rows, 3, 85)
    assert len({comp[i] for i in range(10, 30)}) == 1


def test_odd_rows(spark):
    df = documents(spark)
    got = {}
    for r in N.near_duplicates(df, 3, 85).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[0] == [(12, 0, True)] and got[6] == [(12, 0, False)] * 2
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[9][0][1:] == (5, False)  # the long text with one word more
    assert sorted(x[1:] for x in got[None]) == [(None, True)] * 2
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 5, 7, 8, 8, None, None], key=repr)
    assert N.near_duplicates(df.limit(0)).collect() == []
    assert len(DOCS) == N.near_duplicates(df).count()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}


def test_tables_follow_the_threshold():
    for percent in (80, 85, 95):
        m = N.half_bands(percent)
        assert 2 * (1 - (percent / 100) ** N.HALF) ** m <= N.MISS


@pytest.mark.parametrize("limit", [0, 10])
def test_rows_by_ids_either_way(spark, limit):
    from pathloom.llm.common import by_ids

    df, ids = documents(spark), spark.createDataFrame([(6,), (8,), (77,)], "doc_id long")
    assert sorted(r.doc_id for r in by_ids(df, ids, "left_semi", limit).collect()) == [6, 6, 8, 8]
    assert by_ids(df, ids, "left_anti", limit).count() == len(DOCS) - 4
    assert by_ids(df, ids, "left_anti", limit).columns == df.columns


def test_common_keys_and_hot_groups_give_the_same_rows(spark, monkeypatch):
    from pathloom.llm import common

    monkeypatch.setattr(common, "KEY_ROWS", 4)  # so that groups of this size count as hot
    monkeypatch.setattr(N, "PROBE", 2)
    rnd, rows = random.Random(31), []
    base = text(rnd, 90)
    for _ in range(60):  # each differs from all others, and not all are alike enough
        copy = base[:]
        for _ in range(rnd.randint(0, 9)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 9999)}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(100 + i, " ".join(base)) for i in range(30)] + [(200 + i, " ".join(text(rnd, 30))) for i in range(30)] + [(300 + i, None) for i in range(20)]
    comp = check(spark, rows, 3, 85)
    assert 32 < len(set(comp.values())) < len(comp)


def test_spread_join_loses_and_repeats_nothing(spark, monkeypatch):
    from pathloom.llm import common

    monkeypatch.setattr(common, "KEY_ROWS", 3)
    scratch = Scratch(spark, "spread")
    many = scratch.save(spark.createDataFrame([(k % 7 if k % 3 else 0, k % 50) for k in range(300)] + [(None, 1), (99, 2)], "k int, v int"))
    one = spark.createDataFrame([(k, c) for k in (0, 1, 2, 3, 50) for c in "ab"], "k int, c string")
    heavy = common.heavy_keys(many.where("k IS NOT NULL"), ["k"])
    assert heavy.count() > 3
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, many.join(one, "k", how).collect()), key=repr)
        assert sorted(map(tuple, common.spread_join(many, one, ["k"], heavy, how).collect()), key=repr) == want
