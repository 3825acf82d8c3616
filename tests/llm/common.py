"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, clashing columns."""

LONG = "\n".join(f"Line {k} of a long text that goes on and on, with word{k % 97} and more." for k in range(4000))
COLUMNS = "doc_id long, text string, id string, size long, bits string, score string, key string, spans string, component_id string, pos string, shard string, n_tokens string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text here. It is the same."), (5, "Same text here. It is the same."), (6, "Same text here. It is the same."), (7, "ß😀é"), (None, "A text without an id."), (None, None)]
    return spark.createDataFrame([(i, t, *["clash", 7, *["clash"] * 8]) for i, t in rows], COLUMNS)


def no_rows(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
