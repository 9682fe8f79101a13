"""Rows that every operator has to bear, and texts with copied passages."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """NULLs, empty and blank texts, repeated rows, one long text, one very long word."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
    return [
        (1, None, "en", "s1", None),
        (2, "", "en", "s1", 0),
        (3, " \t\n\x0b\x0c\r ", None, None, 7),
        (4, "one", "en", "s2", 3),
        (4, "one", "en", "s2", 3),
        (None, "a text without an id " * 20, "en", None, 1),
        (None, "a text without an id " * 20, "en", None, 1),
        (7, "é" * 5000, "fr", "s3", 5000),
        (8, long, "en", "s3", len(long)),
        (9, "", None, "s1", 0),
    ]


def copied_rows(seed=0, count=60):
    """Texts of few words that share passages, with exact and near copies."""
    rng = random.Random(seed)
    vocabulary = ["la", "öl", "the", "Ab", "x.", "re-do", "café,", "zu", "\U0001f600", "#tag"]
    vocabulary += [f"v{k}" for k in range(200)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 140))) for _ in range(5)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(passages))
            elif kind < 0.5:
                parts.append(" ".join(["la la zu"] * rng.randint(1, 60)))
            else:
                parts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))))
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    for _ in range(count // 4):
        words = rng.choice(texts).split(" ")
        if rng.random() < 0.6 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    ids = rng.sample(range(10, 10 + 3 * len(texts)), len(texts))
    return [(i, t, "en", f"s{k % 4}", len(t)) for k, (i, t) in enumerate(zip(ids, texts))]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:  # names that operators use themselves
        for name in ("key", "fp", "kept", "n_words", "_text", "owner", "copies", "size", "label"):
            df = df.withColumn(name, F.lit("mine"))
    return df


def words(text):
    """Runs of characters other than 0x20 and 0x09 to 0x0D."""
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
