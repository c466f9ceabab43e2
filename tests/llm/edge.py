"""A small table of awkward documents, shared by the operator tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, _n string, media string"

EDGE_TEXTS = [None, "", " ", "\n\n\n", "a", "ünïcödé 漢字 🎈", "one two three four five six", "one two three four five six", "x" * 70_000, "word " * 30_000, "<|endoftext|> <b>", "\x00\x01\x7f"]


def edge_docs(spark, texts=EDGE_TEXTS):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "p", None, "m") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
