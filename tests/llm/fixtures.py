"""Small tables with what the operators must stand: nulls, blanks, long texts, ties, repeated rows, clashing columns."""

import random

LOREM = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all".split()


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + str(r.randrange(50)) for _ in range(n))


A, B = text(300, 1), text(120, 2)
ROWS = [
    (0, A, "en", "src0"),
    (1, A, "en", "src1"),  # exact copy
    (2, A.replace("1", "one", 2), "en", "src1"),  # near copy
    (3, B + " " + text(50, 3), "en", None),
    (4, text(50, 4) + " \t\n" + B, None, "src2"),  # shares a passage
    (5, None, "en", "src0"),
    (6, "", None, None),
    (7, " \n\t ", "de", "src0"),
    (8, "one two", "fr", "src0"),
    (9, "x" * 5000, "en", "src3"),
    (10, text(6000, 5), "en", "src3"),  # very long
    (11, "same words here " * 60, "en", "src3"),
    (11, "same words here " * 60, "en", "src3"),  # repeated row
    (None, text(80, 6), "en", "src3"),
    (100, "É à ß Σ 日本語 <|endoftext|> don't   x́ \U0001f600", "fr", "src4"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    """With columns whose names the operators might use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS size", "'x' AS run", "2 AS length", "3 AS rank", "4 AS shard", "'k' AS key", "5 AS fp", "6 AS a", "7 AS n", "8 AS t1", "9 AS spans", "10 AS pull", "11 AS _id", "12 AS _row", "13 AS _host", "14 AS _score", "15 AS _m", "16 AS root")


def local(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def empty(spark):
    return docs(spark, [])
