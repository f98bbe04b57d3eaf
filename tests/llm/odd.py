"""Small tables with the odd cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, shard int, _text string, h long"

PROSE = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))


def documents(spark, texts, ids=None, sources=None, langs=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "clash", 1, "clash", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


#: null, empty, blank, one word, non-ASCII, a long text, one long word, and repeats of each other
ODD = [None, "", " \t\n ", "one", "Éa ñ b   \x1c z", PROSE, PROSE, PROSE + "\n" + PROSE, "x" * 20_000, "a b\nc\n\na b\nc # | $", None]
