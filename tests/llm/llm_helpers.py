SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=SCHEMA):
    """Documents of (id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], schema)


def empty(spark):
    return make(spark, [])
