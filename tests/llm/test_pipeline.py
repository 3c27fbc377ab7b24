"""The pipeline against a plain Python version of its stages, and the queries of this package against their SQL."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as C
from pathloom.llm.queries import ORACLES, QUERIES
from tests.compare import rows_of_duckdb, rows_of_spark, tables
from tests.llm.rows import documents
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duckdb(tables(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_url_filter", "op4_ann", "op9_decontamination"}))
def test_queries_give_a_row_for_each_document(spark, name):
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert Counter(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids


def test_stages_one_by_one(spark, tmp_path):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        before = [tuple(r) for r in docs.select([c for c in COLUMNS if c in docs.columns]).collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [tuple(r) for r in docs.select([c for c in COLUMNS if c in docs.columns]).collect()]
        kept[name] = len(after)
        if name != "bpe":
            assert docs.columns == COLUMNS
        if name == "toxicity":
            assert set(after) < set(before)
        elif name == "line_dedup":
            want, _ = brute_lines([(r[3], r[1]) for r in before], 0.08, 5)
            assert Counter(r[1] for r in after) == Counter(t for t, _, _ in want)
            assert all(r[4] == len(r[1]) for r in after if r not in set(before))
        elif name == "near_dedup":
            _, group = brute_groups([(r[0], r[1]) for r in before], 5, 80)
            assert sorted(after) == sorted(r for r in before if group[r[0]] == r[0])
        elif name == "decontamination":
            gone = set(before) - set(after)
            assert set(after) < set(before)
            windows = {tuple(t.lower().split()[k : k + 10]) for t in items for k in range(max(1, len(t.split()) - 9))}
            holds = lambda t: any(tuple(w[k : k + 10]) in windows for w in [t.lower().split()] for k in range(len(w)))
            assert all(not holds(r[1]) for r in after)
            assert all(holds(r[1]) for r in gone)
        else:
            texts = {r[0]: r[1] for r in before}
            for r in docs.collect():
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
                assert r.n_tokens == len(r.token_ids)
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
    assert kept["bpe"] == kept["decontamination"] > 50
    assert C.run(spark, SF).count() == kept["bpe"]


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows_and_empty_tables(spark, k):
    name, stage = C.STAGES[k]
    df = documents(spark)
    out = stage(spark, df, SF)
    assert (out.columns == df.columns) == (name != "bpe")
    rows = out.collect()
    assert len(rows) == df.count() - (3 if name == "near_dedup" else 0)
    if name != "bpe":
        assert set(map(tuple, rows)) <= set(map(tuple, df.collect()))  # values under clashing names are the input's
    assert stage(spark, df.limit(0), SF).collect() == []
