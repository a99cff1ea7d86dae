"""Rows that every corpus operator must cope with."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept_sha256 string, taken long"


def awkward() -> list[tuple]:
    long_text = " ".join(f"w{i % 911}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "two words", "The plain text of a document. It has two sentences.\nAnd a line.", long_text, "é ü ñ 漢字 😀 text", "same text here", "same text here"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, "x", 1) for i, t in enumerate(texts)]
    rows.append((5, texts[5], None, None, None, None, None, None))  # a repeated row
    rows.append((None, "a row without an id", None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def frames(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    return docs, spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
