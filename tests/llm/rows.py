"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeated rows and clashing columns."""

LONG = " ".join(f"word{i % 911} and line{i}" for i in range(20_000))
DOCS = [
    (0, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "x"),
    (5, LONG),
    (6, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (6, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, None),
    (7, "été ÉTÉ 😀 naïve ｗｉｄｅ"),
    (8, "\x00\x01 a\x7fb"),
    (8, "the same id with another text, which is longer than the first one by far"),
    (9, LONG + " tail"),
]


def documents(spark):
    """(doc_id, text, lang, source, n_chars) and columns whose names an operator may want for itself."""
    clash = {"n_words": 1, "row": 2, "rep": 3, "component_id": 4, "host": "h", "labels": "l", "score": 0.5, "is_toxic": True, "kept": False, "n_tokens": 7, "_lines": "u", "slot": 9, "page": "p", "bad": "b", "lines": 3, "n_removed": 4, "grade": 5, "others": "o"}
    rows = [(i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else "src0", None if t is None else len(t), *clash.values()) for k, (i, t) in enumerate(DOCS)]
    kinds = {int: "int", str: "string", float: "double", bool: "boolean"}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {kinds[type(v)]}" for n, v in clash.items())).repartition(3)
