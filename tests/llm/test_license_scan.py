import time
import random
import re

import pytest

from pathloom.llm.license_scan import BASE, Scanner, evaluate, parse_expression, scan
from tests.llm.rows import DOCS, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for k in range(len(words)) for p, label in BASE.items() if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_brute_force():
    rnd, scanner = random.Random(2), Scanner()
    parts = ["MIT", "license", "License", "apache", "General", "public", "mit license", "x", "é", "-", "\n", "mitlicense", "GNU General Public License"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "  ", "-", "\t", "", "\x7f"]) for _ in range(rnd.randint(0, 12)))
        got = scanner.scan(text)
        assert got[:5] == brute(text), text
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
        assert 0 <= got[6] <= 1


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("mit", ["id", "mit"]),
        ("mit or apache-2.0 and bsd", ["or", ["id", "mit"], ["and", ["id", "apache-2.0"], ["id", "bsd"]]]),
        ("( mit or isc ) and gpl-2.0 with classpath", ["and", ["or", ["id", "mit"], ["id", "isc"]], ["with", ["id", "gpl-2.0"], ["id", "classpath"]]]),
        ("a and b or c", ["or", ["and", ["id", "a"], ["id", "b"]], ["id", "c"]]),
        ("mit and", ["id", "mit"]),
        ("mit ) x", ["id", "mit"]),
        ("( mit", None),
        ("or", None),
        ("", None),
    ],
)
def test_expressions(text, tree):
    assert parse_expression(text.split())[0] == tree


def test_evaluation_and_tags():
    assert evaluate(parse_expression("mit or unheard-of".split())[0]) == ({"mit", "unheard-of"}, 1.0)
    assert evaluate(parse_expression("mit and unheard-of".split())[0])[1] == 0.5
    got = Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode")
    assert (got[5], got[6]) == ("apache-2.0,gpl-2.0-only,mit", 1.0)
    assert Scanner().scan("Permission is hereby granted, free of charge, to any person")[5] == "mit"
    assert Scanner().scan("the licence of a mitten")[5:] == ("", 0.0)


def test_long_expressions_and_several_tags_on_a_line():
    names = [f"licenseref-{i:05d}" for i in range(5000)]
    got = Scanner().scan("SPDX-License-Identifier: " + " OR ".join([*names, "GPL-3.0"]) + "\nx")
    assert (set(got[5].split(",")), got[6]) == ({*names, "gpl-3.0"}, 1.0)
    line = "/* SPDX-License-Identifier: MIT */ some code /* SPDX-License-Identifier: GPL-2.0-only OR SPDX-License-Identifier: Zlib"
    assert Scanner().scan(line)[5] == "gpl-2.0-only,mit,zlib"
    assert Scanner().scan("SPDX-License-Identifier: " + "(" * 20000 + "MIT" + ")" * 20000)[5] == "mit"


def test_table(spark):
    df = documents(spark)
    out = scan(df)
    assert len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text)
    assert scan(df.limit(0)).collect() == []


def test_expressions_take_time_in_proportion_to_their_length():
    names = [f"licenseref-{i}" for i in range(100_000)]
    texts = [" or ".join(names), "(" * 50_000 + " or (".join(names[:50_000]) + ")" * 99_999]
    for text, n in zip(texts, (100_000, 50_000), strict=True):
        began = time.process_time()
        got = Scanner().scan("SPDX-License-Identifier: " + text)
        assert len(got[5].split(",")) == n
        assert time.process_time() - began < 5
