"""Small tables of documents, with columns whose names clash with those that operators add."""


def documents(spark, rows, lang="en", source="s"):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, lang, source)[:2] + tuple(r[2:4] if len(r) > 2 else (lang, source)) for r in rows]
    data = [(i, t, g, s, len(t) if t is not None else None, "x", 1.5, "b", 7) for i, t, g, s in full]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words double, blob string, fp int")
