import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import common
from pathloom.llm import decontaminate as D
from tests.llm.rows import documents

ITEM = "Yesterday our neighbour Maria bought 12 apples for 3 dollars and then Maria sold 5 apples to Peter for 4 dollars each"
PLAIN = "which of the following rivers flows through more countries than any other river on the same old continent today"
SHORT = "how many legs does a spider have"


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(spark, texts, items=((1, ITEM), (2, PLAIN), (3, SHORT))):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.kind) for r in D.leaks(df, bench(spark, list(items))).collect()}


FILL = "Some words of no matter stand here and go on for a while. "


def test_exact_and_reparameterised_questions(spark):
    variant = ITEM.replace("Maria", "Joanna").replace("12", "40").replace("3 dollars", "9 euros").replace("4 dollars", "7 euros").replace("Peter", "Ahmed").replace("5", "8")
    mixed = ITEM.replace("Maria bought", "Joanna bought")  # one name stands for two
    got = found(spark, [FILL + ITEM + ". " + FILL, FILL + variant + ".", FILL + PLAIN.upper() + "!", FILL, FILL + SHORT + "? " + FILL, "is it so that " + mixed])
    assert got[0, 1][2] == "exact" and got[0, 1][0] >= got[0, 1][1] - 1
    assert got[1, 1][2] == "variant"
    assert got[2, 2][2] == "exact"
    assert got[4, 3] == (1, 1, "exact")
    assert not any(d == 3 for d, _ in got)
    assert (5, 1) not in got


def test_values_must_be_told_apart_consistently(spark):
    item = "take 7 stones from the left heap and put 9 stones on the right heap so that 7 stones are gone"
    good = item.replace("7", "20").replace("9", "31")
    bad = "take 20 stones from the left heap and put 31 stones on the right heap so that 44 stones are gone"
    got = found(spark, [good, bad], [(1, item)])
    assert got == {(0, 1): (got[0, 1][0], got[0, 1][1], "variant")}


def test_punctuation_and_white_space_do_not_hide_a_passage(spark):
    assert (0, 2) in found(spark, [FILL + " | ".join(PLAIN.split()).replace("rivers", '"rivers",\n')])


def test_what_stands_before_an_item_does_not_hide_it(spark):
    item, steps = "What is the capital of France?", "Take 12 apples and then divide them among your friends"
    before = ["Quiz 3\n", "- ", "* ", "1) ", "he asked ", "End. "]
    got = found(spark, [b + x for x in (item, item.replace("France", "Ghana"), steps) for b in before], [(1, item), (2, steps)])
    assert got == {(6 * i + k, j): (n, n, kind) for i, (j, n, kind) in enumerate([(1, 1, "exact"), (1, 1, "variant"), (2, 3, "exact")]) for k in range(6)}
    assert found(spark, ["so Abuja is the capital of Nigeria"], [(1, item)]) == {}


def test_windows_of_placeholders_match_word_for_word(spark):
    items = [(1, "Compute 12 + 7 - 3 * 4"), (2, "Anna Bob Carla Dora Emil Fritz Gustav Hanna Ida Jonas Karl Lena"), (3, "The Old Man And The Sea")]
    docs = [f"{FILL} so {t} and more" for _, t in items] + [f"{FILL} so {t}" for t in ("Compute 11 + 6 - 2 * 5", "Olga Bob Carla Dora Uwe Fritz Gustav Hanna Ida Paul Karl Lena", "The Young Man And The Tree")]
    assert found(spark, docs, items) == {(0, 1): (1, 1, "exact"), (1, 2): (5, 5, "exact"), (2, 3): (1, 1, "exact")}


def test_equals_brute_force_on_plain_words(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", f"w{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 25))}"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.5:
            it = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(it) - 1)
            words[3:3] = it[a : a + rnd.randint(1, 30)]
        docs.append((i, " ".join(words)))
    want, firsts = {}, {}
    for i, t in items:
        firsts[t] = min(i, firsts.get(t, i))
    for d, t in docs:
        w = t.split()
        for it, i in firsts.items():
            x = it.split()
            n = min(8, len(x))
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            hits = sum(tuple(x[k : k + n]) in own for k in range(len(x) - n + 1))
            if hits >= min(D.MIN_MATCHED, len(x) - n + 1):
                want[d, i] = hits
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.n_matched for r in D.leaks(df, bench(spark, items)).collect()}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("items", [[], [(1, None), (None, PLAIN), (2, "")], [(1, PLAIN), (0, PLAIN), (1, ITEM)]])
def test_odd_rows(spark, items):
    df = documents(spark)
    out = D.leaks(df, bench(spark, items))
    assert out.collect() == []
    assert D.drop_leaks(df, bench(spark, items)).count() == df.count()
    assert D.leaks(df.limit(0), bench(spark, items)).collect() == []


def test_dropping_keeps_clean_rows_and_columns(spark):
    df = documents(spark).withColumn("text", F.lit(FILL + PLAIN))
    out = D.drop_leaks(df, bench(spark, [(1, PLAIN)]))
    assert out.columns == df.columns
    assert [r.doc_id for r in out.collect()] == [None, None]  # what has no id is never dropped


def _kind(w):
    return "number" if w.isdigit() else "unit" if w in ("km", "dollars") else "name" if w.istitle() else None


def _leaks(docs, items):
    """What leaks() must give, by comparing every window of every item with every window of every document.

    For texts that begin with a plain word and hold no punctuation, so that capitals are names throughout.
    """
    out, standing = {}, {}
    for i, t in items:
        w = t.split()
        values = [x for x in w if _kind(x)]
        standing.setdefault((tuple(_kind(x) or x for x in w), tuple(values.index(v) for v in values)), i)
    for d, text in docs:
        doc = text.split()
        for i, t in items:
            w = t.split()
            n = min(8, len(w))
            values = [x for x in w if _kind(x)]
            stands = standing[tuple(_kind(x) or x for x in w), tuple(values.index(v) for v in values)] == i
            enough = [sum(not _kind(x) for x in w[a : a + n]) >= min(4, (n + 1) // 2) for a in range(len(w) - n + 1)]
            places = {}
            for a in range(len(w) - n + 1):
                for b in range(len(doc) - n + 1):
                    x, y = w[a : a + n], doc[b : b + n]
                    starts, pairs = places.setdefault(b - a, (set(), set()))
                    if [v.lower() for v in x] == [v.lower() for v in y]:
                        starts.add(a)
                    slots = [(u, v) for u, v in zip(x, y, strict=True) if _kind(u)]
                    if stands and slots and enough[a] and [_kind(v) or v for v in x] == [_kind(v) or v for v in y]:
                        starts.add(a)
                        pairs.update(slots)
            good = [(s, p) for s, p in places.values() if s and len({u for u, _ in p}) == len(p)]
            matched = {a for s, _ in good for a in s}
            if not matched:
                continue
            of_template, by_template = sum(enough), sum(enough[a] for a in matched)
            if len(matched) >= min(3, len(enough)) or of_template and by_template >= min(3, of_template):
                out[d, i] = (len(matched), len(enough), "exact" if all(u == v for _, p in good for u, v in p) else "variant")
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force_with_placeholders(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "KEY_ROWS", 5)
    rnd = random.Random(21)
    names, plain = ["Anna", "Bob", "Carl", "Dora", "Emil"], ["takes", "gives", "away", "from", "the", "heap", "and", "then", "walks", "home"]
    word = lambda: rnd.choice([rnd.choice(plain), rnd.choice(plain), str(rnd.randint(2, 30)), rnd.choice(names), rnd.choice(["km", "dollars"])])

    def vary(words, share):
        to = {}
        for w in words:
            to.setdefault(w, {"number": str(rnd.randint(2, 30)), "name": rnd.choice(names), "unit": w}.get(_kind(w)) if _kind(w) else w)
        return [to[w] if rnd.random() < share else w for w in words]

    items = [(i, " ".join(["so", *(word() for _ in range(rnd.randint(0, 22)))])) for i in range(25)]
    items += [(30 + i, " ".join(vary(items[i % 5][1].split(), 1.0))) for i in range(25)]  # the same question with other values
    items = list({t: (i, t) for i, t in reversed(items)}.values())
    items.sort()
    docs = []
    for i in range(150):
        words = ["and", *(word() for _ in range(rnd.randint(0, 25)))]
        if rnd.random() < 0.8:
            got = vary(rnd.choice(items)[1].split(), rnd.choice([0, 0.5, 1, 1]))
            at = rnd.randint(1, len(words))
            words[at:at] = got[: rnd.randint(1, 30)]
        docs.append((i, " ".join(words)))
    want = _leaks(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.kind) for r in D.leaks(df, bench(spark, items)).collect()}
    assert got == want
    assert len(want) > 60 and {k for _, _, k in want.values()} == {"exact", "variant"}


def test_a_template_of_many_items_costs_no_row_for_each(spark):
    ask = lambda n: f"if there are {n} red balls in {n + 1} big boxes and {n + 2} blue balls in {n + 3} small boxes how many fit in {n + 4}"
    items = [(i, ask(1000 + 10 * i)) for i in range(400)]
    got = found(spark, [FILL + ask(77), FILL + ask(1090), FILL + ask(1000)], items)
    assert {k: v[2] for k, v in got.items()} == {(0, 0): "variant", (1, 0): "variant", (1, 9): "exact", (2, 0): "exact"}
