"""Small document tables with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ban", "dor", "fil", "gut", "hem", "jin", "kol")]


def sentence(rng, n=8):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(rng, n=12):
    return " ".join(sentence(rng) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    base, passage = text(rng), text(rng, 9)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("a", "a ", 1), None, None, None), (4, base + " Extra kaban.", "en", "a", 2),
        (5, None, None, None, None), (6, "", "fr", "b", 0), (7, " \t\n ", "fr", "b", 4), (8, "Ein Wort", "de", "b", 8), (9, "EIN  wort", "de", "b", 9),
        (None, "no id here", "en", "a", 10), (None, None, None, None, None), (10, text(rng, 1500), "en", "c", 5),
        (11, "x " + passage + "\n" + text(rng, 2), "en", "a", 1), (12, text(rng, 2) + "\n" + passage + " " + text(rng, 2), "en", "a", 1),
        (13, "tail kaban lodor " + text(rng), "fr", "a", 1), (13, "tail kaban lodor " + text(rng), "fr", "a", 1), (14, "日本語 🙂 ñandú 'll don't we've 12³", "es", "d", 3), (15, "12345 !!! ???", "es", "d", 3),
        (16, "a" * 3000, "es", "d", 3), (17, "A\u00a0b\u3000c", "es", "d", 3),
    ]
    rows += [(100 + i, text(rng), ("en", "fr")[i % 2], "a", 1) for i in range(20)]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The same table with columns of names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("value", "n", "rep", "row", "features", "copy_no", "text_sha256", "key", "pos", "word", "uid", "media", "a", "b", "component", "n_spans", "known", "learn"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def ids(df, *columns):
    """Rows as sorted tuples, with nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
