"""Small tables and brute-force versions."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "é", "ß", "ing", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] if not texts or not isinstance(texts[0], tuple) else [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", extra) if extra else df
