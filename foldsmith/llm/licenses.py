"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A block is a run of lines that are not blank, its line ends taken as spaces, so that wrapped
and comment-prefixed notices are whole. Within a block, windows of ``WIDTH`` times the words
of a template are compared with it: a notice is a window with at least ``CONFIRM`` of the
template's two-grams; of overlapping ones the best counts, cut to its first and last
two-gram. A logistic regression over word one- and two-grams (elastic net, so most weights
are zero) then gives the notice's licence family or ``unknown``; margins are divided by a
temperature fitted on held-out rows, and a family counts only above a probability that at
most ``FALSE_RATE`` of the held-out unknown rows reach. A notice is confirmed if that family
is the template's. What is not near a template can never be confirmed and is not scored.
``n_paragraphs`` counts lines that are not blank, ``n_license_paragraphs`` notices.

The classifier is fitted on at most ``NEGATIVES`` corpus paragraphs (first lines of the rows with
the smallest digests of their ids) and ``VARIANTS`` altered copies of each template.

Native: column functions and Spark ML only. Defined results: NULL or empty text has no
paragraph; repeated rows get the same result (rows are matched by id and text digest); an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.llm.text import NOT_SPACE
from foldsmith.session import materialize

UNKNOWN = "unknown"
NEGATIVES = 1_000
VARIANTS = 40
FALSE_RATE = 0.01
CONFIRM = 0.8
WIDTH = 2
SEED = 42

# Notices and opening sentences of common licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy"
        " of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
        " International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related"
        " rights to this work.",
    ),
}
WORD = r"[\p{L}\p{N}]+"
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*+\n)++"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def pairs_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


TEMPLATE_PAIRS = sorted({p for texts in TEMPLATES.values() for t in texts for p in pairs_of(t)})
VOCABULARY = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)}) + TEMPLATE_PAIRS


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs(w: Column) -> Column:
    """Neighbouring words joined by a space; the words are made once, not per pair."""
    made = F.transform(
        F.array(w),
        lambda v: F.transform(
            F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
            lambda x, i: F.concat(x, F.lit(" "), F.get(v, i + 1)),
        ),
    )
    return F.get(made, F.lit(0))


@dataclass(frozen=True)
class Classifier:
    vectorizer: CountVectorizerModel
    model: LogisticRegressionModel
    families: tuple[str, ...]
    temperature: float
    threshold: float

    def predict(self, rows: DataFrame, text: str) -> DataFrame:
        """Add ``family`` and ``probability``: calibrated, unknown below the threshold."""
        df = self.model.transform(featured(rows, text, self.vectorizer))
        margins = vector_to_array("rawPrediction")
        raised = F.transform(margins, lambda m: F.exp((m - F.array_max(margins)) / self.temperature))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        known = F.col("_p") >= self.threshold
        return (
            df.withColumn("_p", F.array_max(raised) / total)
            .withColumn("family", F.get(literal(list(self.families)), F.col("prediction").cast("int")))
            .withColumn("family", F.when(known, F.col("family")).otherwise(UNKNOWN))
            .withColumnRenamed("_p", "probability")
            .drop("_t", "_g", "_x", "rawPrediction", "prediction", "_all")
        )


def featured(rows: DataFrame, text: str, vectorizer: CountVectorizerModel) -> DataFrame:
    df = rows.withColumn("_t", tokens(F.col(text)))
    df = df.withColumn("_g", F.concat("_t", pairs(F.col("_t"))))
    return vectorizer.transform(df)


def altered(text: str, rng: random.Random, context: list[str]) -> str:
    """A copy with some words lost or changed, inside words of the corpus."""
    kept = [w for w in text.split() if rng.random() > 0.05]
    before = [rng.choice(context) for _ in range(rng.randint(0, 30))] if context else []
    after = [rng.choice(context) for _ in range(rng.randint(0, 30))] if context else []
    return " ".join(before + kept + after)


def training_rows(negatives: list[str], seed: int = SEED) -> list[tuple[str, str, bool]]:
    """(text, family, held out): bounded by the templates, VARIANTS and NEGATIVES."""
    rng = random.Random(seed)
    context = [w for t in negatives for w in t.split()[:50]]
    single = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
    rows = [(t, UNKNOWN) for t in negatives]
    for family, texts in TEMPLATES.items():
        rows += [(altered(t, rng, context), family) for t in texts for _ in range(VARIANTS)]
    # Words of licences out of their order, alone or among others, are no licence.
    for _ in range(10 * VARIANTS):
        mixed = [rng.choice(single) for _ in range(rng.randint(1, 12))]
        mixed += [rng.choice(context) for _ in range(rng.randint(0, 30))] if context else []
        rng.shuffle(mixed)
        rows.append((" ".join(mixed), UNKNOWN))
    rng.shuffle(rows)
    return [(t, f, i % 4 == 0) for i, (t, f) in enumerate(rows)]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    spark = docs.sparkSession
    whole = docs.where(F.col(text).rlike(NOT_SPACE)).select(
        F.xxhash64(doc_id).alias("h"), F.xxhash64(text).alias("h2"), F.col(text).alias("whole")
    )
    sample = (
        whole.orderBy("h", "h2")
        .limit(NEGATIVES)
        .select(F.filter(F.split("whole", "\n"), lambda x: x.rlike(NOT_SPACE))[0].alias("line"))
        .where(~F.arrays_overlap(pairs(tokens(F.col("line"))), literal(TEMPLATE_PAIRS)))
    )
    rows = training_rows([r["line"] for r in sample.collect()])
    families = (UNKNOWN, *TEMPLATES)
    labelled = spark.createDataFrame(
        [(t, float(families.index(f)), h) for t, f, h in rows], "text string, label double, held boolean"
    ).repartition(4)
    vectorizer = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="_g", outputCol="_x")
    vectorizer = vectorizer.setBinary(True)
    table_ = featured(labelled, "text", vectorizer).select("label", "held", "_x").cache()
    regression = LogisticRegression(
        featuresCol="_x", labelCol="label", probabilityCol="_all", family="multinomial",
        regParam=0.001, elasticNetParam=0.5, maxIter=60,
    )
    model = regression.fit(table_.where(~F.col("held")))
    held = [
        (int(r["label"]), list(r["m"]))
        for r in model.transform(table_.where("held")).select("label", vector_to_array("rawPrediction").alias("m")).collect()
    ]
    table_.unpersist()
    temperature = min((0.25 * k for k in range(1, 17)), key=lambda t: log_loss(held, t))
    false = sorted(max(p[1:]) for label, m in held if label == 0 for p in [softmax(m, temperature)])
    at = min(len(false) - 1, math.ceil((1 - FALSE_RATE) * len(false))) if false else -1
    threshold = max(0.5, min(false[at], 0.9)) if false else 0.5
    return Classifier(vectorizer, model, families, temperature, threshold)


def softmax(margins: list[float], temperature: float) -> list[float]:
    top = max(margins)
    raised = [math.exp((m - top) / temperature) for m in margins]
    return [x / sum(raised) for x in raised]


def log_loss(held: list[tuple[int, list[float]]], temperature: float) -> float:
    return -sum(math.log(max(softmax(m, temperature)[label], 1e-12)) for label, m in held)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def templates() -> Column:
    """Structs (family, pairs, words, needed): ``needed`` of the two-grams confirm."""
    return F.array(
        *[
            F.struct(
                F.lit(family).alias("family"),
                literal(pairs_of(t)).alias("pairs"),
                F.lit(len(words_of(t))).alias("words"),
                F.lit(math.ceil(CONFIRM * len(pairs_of(t)) - 1e-9)).alias("needed"),
            )
            for family, texts in TEMPLATES.items()
            for t in texts
        ]
    )


def contained(own: Column) -> Column:
    """The templates of which these two-grams hold enough to confirm."""
    few = F.array_intersect(own, literal(TEMPLATE_PAIRS))
    return bound(
        few, lambda k: F.filter(templates(), lambda t: F.size(F.array_intersect(k, t["pairs"])) >= t["needed"])
    )


def notices(own: Column, template: Column) -> Column:
    """Structs (start, end, n): the best of each run of overlapping windows that confirm.

    ``start`` and ``end`` are the places of the first and last two-gram of the template in
    the window, ``n`` how many different ones it holds.
    """
    reach = WIDTH * template["words"] - 1  # two-grams of a window
    hits = F.filter(
        F.transform(own, lambda x, i: F.struct(i.alias("at"), x.alias("pair"))),
        lambda h: F.array_contains(template["pairs"], h["pair"]),
    )

    def window(hits: Column, h: Column, i: Column) -> Column:
        inside = F.filter(F.slice(hits, i + 1, reach), lambda x: x["at"] < h["at"] + reach)
        return bound(
            inside,
            lambda v: F.struct(
                h["at"].alias("start"),
                F.element_at(v, -1)["at"].alias("end"),
                F.size(F.array_distinct(F.transform(v, lambda x: x["pair"]))).alias("n"),
            ),
        )

    whole = F.filter(
        bound(hits, lambda v: F.transform(v, lambda h, i: window(v, h, i))),
        lambda w: w["n"] >= template["needed"],
    )
    none = F.array().cast("array<struct<start:int,end:int,n:int>>")

    def best(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when((F.size(done) == 0) | (w["start"] > last["end"]), F.concat(done, F.array(w)))
            .when(w["n"] > last["n"], F.concat(before, F.array(w)))
            .otherwise(done)
        )

    return F.aggregate(whole, none, best)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classifier: Classifier | None = None
) -> tuple[DataFrame, DataFrame]:
    """Per row: id, digest, number of paragraphs; per confirmed notice: place and family."""
    classifier = classifier or fit(docs, doc_id, text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_t", tokens(F.col("_text")))
    blocks = F.transform(F.split("_text", BLANK), lambda x, i: F.struct(i.alias("block"), tokens(x).alias("w")))
    rows = rows.select(
        "_id",
        F.xxhash64("_text").alias("_digest"),
        F.size(F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE))).cast("long").alias("n_paragraphs"),
        # What a window of a block holds, the two-grams of the whole text hold.
        F.when(F.size(contained(pairs(F.col("_t")))) > 0, blocks).alias("_blocks"),
    )
    found = materialize(rows, "paragraphs")
    candidates = found.where(F.size("_blocks") > 0).select("_id", "_digest", F.explode("_blocks").alias("b"))
    words = F.struct("b.w", pairs(F.col("b.w")).alias("own"))
    candidates = candidates.select("_id", "_digest", "b.block", F.explode(F.array(words)).alias("b"))
    candidates = candidates.select("_id", "_digest", "block", "b", F.explode(contained(F.col("b.own"))).alias("t"))
    candidates = candidates.select(
        "_id", "_digest", "block", "b", "t", F.explode(notices(F.col("b.own"), F.col("t"))).alias("n")
    )
    candidates = candidates.select(
        "_id",
        "_digest",
        "block",
        F.col("n.start").alias("start"),
        F.col("n.end").alias("end"),
        F.col("t.family").alias("_template"),
        (F.col("n.n") / F.size("t.pairs")).alias("containment"),
        F.array_join(F.slice("b.w", F.col("n.start") + 1, F.col("n.end") - F.col("n.start") + 2), " ").alias("text"),
    ).distinct()
    scored = classifier.predict(candidates, "text")
    return found, scored.where(F.col("family") == F.col("_template")).drop("_template")


def separate() -> Column:
    """Number of notices of a group; overlapping ones of one family are one."""
    spans = F.array_sort(F.collect_list(F.struct("block", "family", "start", "end")))

    def next_(acc: Column, s: Column) -> Column:
        same = (acc["block"] == s["block"]) & (acc["family"] == s["family"]) & (s["start"] <= acc["end"])
        return F.struct(
            (acc["n"] + F.when(same, 0).otherwise(1)).alias("n"),
            s["block"].alias("block"),
            s["family"].alias("family"),
            F.when(same, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
        )

    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("block"), F.lit("").alias("family"), F.lit(-1).alias("end"))
    return F.aggregate(spans, none, next_, lambda acc: acc["n"])


def by_document(found: DataFrame, licences: DataFrame) -> DataFrame:
    """One row per input row: the family of its most probable confirmed notice."""
    place = [F.negative("block").alias("b"), F.negative("start").alias("s")]
    best = F.max(F.struct("probability", "containment", *place, "family"))
    grouped = licences.groupBy("_id", "_digest").agg(
        best.alias("b"), separate().alias("n"), F.array_sort(F.collect_set("family")).alias("families")
    )
    same = [F.col("f._id").eqNullSafe(F.col("g._id")), F.col("f._digest") == F.col("g._digest")]
    return found.alias("f").join(grouped.alias("g"), same, "left").select(
        F.col("f._id").alias("doc_id"),
        "n_paragraphs",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"),
        F.coalesce("b.family", F.lit(UNKNOWN)).alias("license"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.round(F.coalesce("b.probability", F.lit(0.0)), 4).alias("probability"),
    )


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return by_document(*scan(docs))
