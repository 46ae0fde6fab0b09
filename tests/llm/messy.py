"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _tokens int, toxic_score string, _found int, _masked int, "
    "row string, block string, epoch string, rid int, u int, node int, label int, sig string, rest int, rank int, n int, terms string, next string, _b int, _p int"
)
EXTRA = (1, "x", 2, 3, "r", "b", "e", 4, 5, 6, 7, "s", 8, 9, 10, "t", "n", 11, 12)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (3, ""), (4, " \n\t "), (5, LONG),
    (6, "One TWO three four five six seven eight"), (7, "x"), (8, "x y"), (9, "Ünïcode ÉTÉ été 😀 naïve"), (None, "no id at all here"), (None, None),
    (10, LONG + " tail"), (2, "a second text of one id"), (11, "12345 67890 !!"), (12, "a\x1cb\x85c\xa0d <|endoftext|> don't"),
]


def documents(spark, texts=TEXTS):
    rows = [
        (i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 3}", None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
