SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, block string"
ODD = [None, "", " \t\n", "a", "Same text here", "same  TEXT\nhere", "Same text here", "naïve café ñandú 日本語 🙂 <|endoftext|> x"]


def table(spark, texts, ids=None, sources=None):
    """Documents with columns that clash with names the operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, 0, False, 9.0, "b") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


