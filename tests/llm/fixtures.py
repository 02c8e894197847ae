"""Small tables with the odd rows that every operator must stand."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c string, n long, sketch string, count long"


def odd_docs(spark, texts):
    """documents from texts, with nulls, a repeated row and further columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "x", i, "y", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], DOC_SCHEMA)


TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    None,
    "",
    " \n\t ",
    "a b",
    "same line\nsame line\n" * 4,
    "word " * 4000,
    "naïve café – “quotes” 漢字 😀 password = 'hunter2hunter2' <|endoftext|> don't",
    "one two three four five six seven eight nine ten eleven twelve",
]


def empty(df):
    return df.filter(F.lit(False))
