import hashlib
import random

import pytest

from pathloom.llm.substring_dedup import remove_repeats
from tests.llm.rows import DOCS, documents


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "anchor", "group"), [(13, 5, 100_000), (13, 5, 3), (6, 6, 100_000), (20, 4, 2)])
def test_equals_brute_force(spark, window, anchor, group):
    rnd = random.Random(window * anchor)
    word = lambda: rnd.choice(["a", "b", "the", "of", f"w{rnd.randint(0, 300)}", "É"])
    passages = [[word() for _ in range(rnd.randint(window - 1, 3 * window))] for _ in range(12)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(0, 40))]
        rows.append((i * 13 % 251, rnd.choice([" ", "\n", "  "]).join(words)))
    rows += [(300, "a " * 200), (301, "a " * 100), (5, rows[3][1]), (5, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = remove_repeats(df, window, anchor, group)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, window)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_removed
    assert any(r.n_removed for r in got)


def test_odd_rows(spark):
    df = documents(spark)
    got = remove_repeats(df, keep_text=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(DOCS, 13)
    assert remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="window"):
        remove_repeats(df, 40, 5)
