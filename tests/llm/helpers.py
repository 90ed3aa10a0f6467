import re

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns whose names the operators use inside.
CLASH = ["fp", "sha", "norm", "n", "key", "rank", "chunk", "score", "kept", "copies", "node", "line", "band", "size", "rid"]


def docs(spark, rows, clash=False):
    """Documents from (doc_id, text, source)."""
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)
