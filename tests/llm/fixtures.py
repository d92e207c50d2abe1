"""Small documents with every awkward case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60):
    """Prose, copies, near copies, repeats, very long words, nulls, empties and repeated rows."""
    rnd = random.Random(seed)
    vocab = ["the", "of", "être", "naïve", "größe", "word", "a", "it's", "x|y", "#tag", "日本", "end.", "𝛼β", "12", "3.5"] + [f"w{i}" for i in range(400)]

    def prose(k):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(k))

    rows = []
    for i in range(n):
        text = prose(rnd.choice([0, 1, 3, 12, 60, 200, 400]))
        if i % 7 == 3 and rows:
            text = rows[rnd.randrange(len(rows))][1]
        if i % 7 == 5 and rows:
            words = (rows[rnd.randrange(len(rows))][1] or "").split(" ")
            words[rnd.randrange(len(words))] = "edited"
            text = " ".join(words)
        rows.append((i * 3, text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "é", None]), None if text is None else len(text)))
    rows += [(100500, None, None, None, None), (100501, "", "en", "s1", 0), (100502, "x" * 3000, "en", "s1", 3000), (100503, "ab " * 2000, "en", "s2", 6000), (100504, " \n\t ", "en", "s2", 4)]
    rows += [rows[2], rows[-1], (None, "no id here " * 5, "en", "s1", 55)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(spark, rows=None):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "row", "block", "rank", "copies", "target", "key", "node", "ids", "kept", "part", "n", "pos", "place", "times", "rate", "text_key", "row_id", "digest", "component_id", "rep", "band"]
    return frame(spark, rows).select("*", *[F.lit("clash").alias(c) for c in names])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
