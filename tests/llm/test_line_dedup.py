import pytest

from pathloom.llm import common
from pathloom.llm.line_dedup import boilerplate, drop_lines
from tests.llm.rows import DOCS, documents


def brute(rows, max_ratio, min_pages):
    totals, seen = {}, {}
    for host, text in rows:
        totals[host or ""] = totals.get(host or "", 0) + 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] = seen.get((host or "", line), 0) + 1
    bad = {k for k, n in seen.items() if n >= min_pages and n > max_ratio * totals[k[0]]}
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host or "", x.strip(" \t\r\x0b\x0c")) not in bad]
        out.append((None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr), bad


def pages():
    out = [(f"h{i % 3}" if i % 3 else None, f"page {i}\nMenu\n\n  Imprint \r\nMenu\nbody of {i % 40}") for i in range(120)]
    return [*out, *[("h1", "Menu")] * 5, ("h1", None), ("h2", ""), ("h2", "\n\n"), ("lone", "Menu\nImprint")]


@pytest.mark.parametrize("rows_to_broadcast", [50_000, 0])
def test_equals_brute_force_either_way(spark, rows_to_broadcast):
    rows = pages()
    df = spark.createDataFrame(rows, "source string, text string").repartition(5)
    got = sorted(((r.text, r.n_lines, r.n_removed) for r in drop_lines(df, broadcast_rows=rows_to_broadcast).collect()), key=repr)
    want, bad = brute(rows, 0.08, 5)
    assert got == want
    assert {(r.host, r.n_pages > 0) for r in boilerplate(df).collect()} == {(h, True) for h, _ in bad}
    assert ("h1", "Menu") in bad and ("lone", "Menu") not in bad


@pytest.mark.parametrize("rows_to_broadcast", [50_000, 0])
def test_odd_rows_pass(spark, rows_to_broadcast):
    df = documents(spark)
    out = drop_lines(df, broadcast_rows=rows_to_broadcast)
    assert out.columns == [*(c for c in df.columns if c != "n_removed"), "n_lines", "n_removed"]
    assert {(r.page, r.bad, r.lines, r.n_removed) for r in out.collect()} == {("p", "b", 3, 0)}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(DOCS, key=repr)
    assert drop_lines(df.limit(0), broadcast_rows=rows_to_broadcast).collect() == []


def test_no_python_runs(spark):
    plan = drop_lines(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_lines_and_equal_pages_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 6)
    rows = pages() + [("h1", "Menu\nthe same page\nagain")] * 60 + [("h2", f"Menu\nl{i % 7}\nm{i % 11}\nn{i % 13}") for i in range(150)]
    df = spark.createDataFrame(rows, "source string, text string").repartition(5)
    for broadcast in (0, 50_000):
        assert sorted(((r.text, r.n_lines, r.n_removed) for r in drop_lines(df, broadcast_rows=broadcast).collect()), key=repr) == brute(rows, 0.08, 5)[0]
    plan = drop_lines(df, broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
