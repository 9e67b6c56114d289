"""Tables with everything that operators must bear."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, score double, size int, target string, h string, root int"


def odd_docs(spark):
    long = " ".join(f"word{i % 997}" for i in range(30_000)) + "\n" + "x" * 50_000
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "en", "a"), (2, "The cat sat on the mat and looked at the dog.", "en", "a"), (2, "The cat sat on the mat and looked at the dog.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "fr", ""), (None, "no id here at all", "en", "b"), (None, "no id here at all", "en", "b"), (None, None, None, None),
        (6, long, "de", "b"), (7, "12 34 !!", "de", "b"), (8, "é́ 日本語 \U0001f600 ␛ </s>", "es", "c"), (9, "a", "es", "c"),
    ]
    return spark.createDataFrame([(*r, None, 7, 0.5, 3, "t", "h", 1) for r in rows], DOCS)


#: Names that operators of this folder give to columns of their own.
NAMES = ["id", "th", "own", "own_id", "nth", "of", "n", "m", "copy", "h", "fp", "root", "key", "size", "sim", "lanes", "line", "h_", "removed_lines", "has_lines", "layout", "__text", "__id"]


def clashing(spark):
    """Two documents that share a line, with columns of all these names."""
    rows = [(1, "one line that is long enough to count", "en", "a"), (2, "One line  that is long enough to count\nanother one", "en", "a")]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in NAMES)) for r in rows], schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
