DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, hash string, owner int, fp long, key string, w string, n int"


def docs(spark, rows):
    """A documents table with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, *(list(r) + ["en", "s0"][len(r):]), None if t is None else len(t), "x", "h", 1, 2, "k", "w", 3) for i, t, *r in rows], DOCS)


LONG = " ".join(f"word{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "One two"), (5, "one TWO"), (6, LONG), (7, LONG), (7, LONG), (None, "one two"), (8, "Ünï çödé 漢字 😀"), (9, "ÜNÏ ÇÖDÉ 漢字 😀")]
