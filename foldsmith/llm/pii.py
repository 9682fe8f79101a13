"""Personal data: patterns, and terms that give a protected value away.

Base spans are pattern matches. Every matched value is a protected entity; the corpus says
how strongly a word reveals it. With document counts over whole texts, the pointwise mutual
information of word and entity is ``log2(n_et * N / (n_e * n_t))`` and the information of
the entity ``log2(N / n_e)``. A word discloses the entity when it carries at least
``DISCLOSURE`` of that information and is supported by ``MIN_TEXTS`` different texts. Such
words become spans of kind ``term`` wherever they stand, also in documents without the
entity, and are generalised to a placeholder like the base spans. Words are runs of letters
and numbers outside of base spans, of ``MIN_TERM`` characters or more.

Native: column functions, joins and counts only. Defined results: NULL text has no spans;
repeated rows get the same spans; rows are matched by id and text digest, so an id may
repeat; an empty table gives an empty result. Other columns are not read; ``stage`` gives
them back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.joins import looked_up
from foldsmith.llm.registry import query, table
from foldsmith.session import broadcast_if_small, materialize

# Kinds in the order of the result, and their patterns. The patterns are
# possessive and begin only where a run of their characters begins (or the last match
# ended), which changes no match and keeps long runs linear and free of recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these has no match of the kind.
NEEDED = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?<![0-9])(?:[0-9][\x20-]?){15}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]",
}
TERM = r"[\p{L}\p{N}]++"

RESULT = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans")
MIN_TERM = 2  # characters of a term
MIN_TEXTS = 3  # different texts that hold both
DISCLOSURE = 0.9
ROW_BYTES = 100


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points.

    Only those whose value is to be kept.

    What lies between the matches comes from splitting by the same pattern, so positions
    are running sums of lengths.
    """
    rx = F.lit(pattern)
    sizes = F.zip_with(
        F.regexp_extract_all(text, rx, F.lit(0)),
        F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap")),
    )
    found = F.aggregate(
        F.filter(sizes, lambda x: x["value"].isNotNull()),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,end:int,value:string>>").alias("all"),
        ),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.when(
                keep(x["value"]),
                F.concat(
                    acc["all"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"),
                            x["value"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(acc["all"])
            .alias("all"),
        ),
    )
    return found["all"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass: from the right every second one doubled, digits summed."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int"))
        .when(d.cast("int") > 4, 2 * d.cast("int") - 9)
        .otherwise(2 * d.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(
            F.split(value, r"\."),
            lambda part: F.length(F.ltrim(part, F.lit("0")))
            > F.when(F.ltrim(part, F.lit("0")) <= "255", F.lit(3)).otherwise(F.lit(2)),
        )
    if kind == "card":
        number = digits(value)
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def checked(k: int, kind: str) -> Column:
    """The accepted matches of a kind, as structs that carry its number."""
    return F.transform(
        F.filter(f"_{kind}", lambda x: accepted(kind, x["value"])),
        lambda x: F.struct(F.lit(k).alias("kind"), x["start"], x["end"], x["value"]),
    )


def of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_base``: structs (kind, start, end, value) by kind as listed, then start."""
    whole = F.col("_text")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = {
        kind: F.when(whole.rlike(NEEDED[kind]), matches(whole, PATTERNS[kind]))
        for kind in KINDS
    }
    df = df.withColumns({f"_{kind}": column for kind, column in found.items()})
    kept = {f"_{kind}": checked(k, kind) for k, kind in enumerate(KINDS)}
    df = df.withColumns(kept)
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return df.withColumn(
        "_base", F.concat(*[F.coalesce(F.col(f"_{kind}"), none) for kind in KINDS])
    ).drop(*[f"_{kind}" for kind in KINDS])


def entity(span: Column) -> Column:
    """A protected value, the same for all its spellings."""
    return F.concat(
        span["kind"].cast("string"),
        F.lit(":"),
        F.when(span["kind"] >= 2, digits(span["value"])).otherwise(F.lower(span["value"])),
    )


def blanked() -> Column:
    """The text with spaces in the place of its base spans."""
    text = F.col("_text")
    state = F.aggregate(
        F.sort_array(F.transform("_base", lambda s: F.struct(s["start"], s["end"]))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["parts"],
                F.array(
                    F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                    F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))),
                ),
            ).alias("parts"),
        ),
        lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size("_base") > 0, state).otherwise(text)


def words() -> Column:
    """The different words of a text outside of its base spans."""
    long = F.filter(
        F.array_distinct(F.regexp_extract_all(blanked(), F.lit(TERM), F.lit(0))),
        lambda w: F.length(w) >= MIN_TERM,
    )
    return F.array_distinct(F.transform(long, F.lower))


def disclosing(found: DataFrame) -> DataFrame:
    """Pairs (entity, term) where the term gives the entity away, by corpus counts.

    As ``n_et <= n_e``, a term of an entity is in at most ``n_e * (total / n_e) ** (1 -
    DISCLOSURE)`` documents; other pairs are not made.
    """
    total = found.count()
    texts = found.where(F.size("_base") > 0).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("docs"), F.first("_base").alias("_base"), F.first("_words").alias("_words")
    )
    texts = texts.withColumn("entities", F.array_distinct(F.transform("_base", entity)))
    texts = materialize(texts.drop("_base"), "texts")
    named = texts.select("_digest", "docs", F.explode("entities").alias("entity"))
    most = F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - DISCLOSURE)) * F.lit(1 + 1e-9)
    entities = (
        named.groupBy("entity")
        .agg(F.sum("docs").alias("n_e"), F.count(F.lit(1)).alias("texts"))
        .where((F.col("texts") >= MIN_TEXTS) & (F.col("n_e") < total))
        .select("entity", "n_e", most.alias("most"))
    )
    entities = materialize(entities, "entities")
    n, highest = entities.agg(F.count(F.lit(1)), F.max("most")).first()
    named = materialize(named.join(broadcast_if_small(entities, n * ROW_BYTES), "entity"), "named")
    holders = texts.join(named.select("_digest").distinct(), "_digest", "left_semi")
    held = holders.select("_digest", F.explode("_words").alias("term"))
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= MIN_TEXTS)
    terms = materialize(terms.select("term"), "terms")
    small = broadcast_if_small(terms, terms.count() * ROW_BYTES)
    said = found.select(F.explode("_words").alias("term")).join(small, "term", "left_semi")
    counts = said.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = materialize(counts.where(F.col("n_t") <= F.lit(highest)), "counts")
    held = held.join(broadcast_if_small(counts, counts.count() * ROW_BYTES), "term")
    pmi = F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    known = F.log2(F.lit(float(total)) / F.col("n_e"))
    rare = (F.col("e._digest") == F.col("h._digest")) & (F.col("n_t") <= F.col("most"))
    return (
        named.alias("e")
        .join(held.alias("h"), rare)
        .groupBy("entity", "term", "n_e", "n_t")
        .agg(F.sum("docs").alias("n_et"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= MIN_TEXTS)
        .where(pmi >= DISCLOSURE * known)
        .select("entity", "term")
    )


def digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_digest`` and ``_spans`` (kind, start, end) of each row, terms included."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    spanned = base_spans(rows, "_text")
    found = materialize(
        spanned.select("_id", F.xxhash64("_text").alias("_digest"), "_base", words().alias("_words")), "pii"
    )
    given = materialize(disclosing(found).select("term").distinct(), "disclosing")
    hits = (
        found.select("_id", "_digest", F.explode("_words").alias("term"))
        .join(broadcast_if_small(given, given.count() * ROW_BYTES), "term")
        .groupBy("_id", "_digest")
        .agg(F.collect_set("term").alias("_hits"))
    )
    hits = materialize(hits, "hits")
    marked = looked_up(rows.withColumn("_digest", digest("_text")), hits, ["_id", "_digest"], "inner")
    places = matches(blanked(), TERM, lambda value: F.array_contains("_hits", F.lower(value)))
    terms = (
        base_spans(marked, "_text")
        .select(
            "_id",
            "_digest",
            F.transform(places, lambda w: F.struct(F.lit(len(KINDS)).alias("kind"), w["start"], w["end"])).alias("_terms"),
        )
        .dropDuplicates(["_id", "_digest"])
    )
    base = F.transform("_base", lambda b: F.struct(b["kind"], b["start"], b["end"]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    same = [F.col("f._id").eqNullSafe(F.col("t._id")), F.col("f._digest") == F.col("t._digest")]
    # Ids, digests and spans only; always by sorting, whatever the size.
    return (
        found.select("_id", "_digest", base.alias("_base"))
        .alias("f")
        .join(terms.hint("merge").alias("t"), same, "left")
        .select(
            "f._id",
            "f._digest",
            "_base",
            F.concat("_base", F.sort_array(F.coalesce("_terms", none))).alias("_spans"),
        )
    )


def rendered(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def sanitised(text: Column, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; overlaps are one span."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    order = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"].alias("kind")))
    )
    state = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["parts"],
                    F.array(
                        F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                        F.get(marks, s["kind"]),
                    ),
                ),
            )
            .otherwise(acc["parts"])
            .alias("parts"),
        ),
        lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, state).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their spans replaced; texts move only where spans were found.

    The columns of ``docs`` are carried in one struct, so they may have any names.
    """
    spans = detect(docs).where(F.size("_spans") > 0).select("_id", "_digest", "_spans")
    spans = materialize(spans.dropDuplicates(["_id", "_digest"]), "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col("doc_id").alias("_id"), digest("text").alias("_digest"), row.alias("_row"))
    joined = looked_up(keyed, spans, ["_id", "_digest"])
    text = sanitised(F.col("_row.text"), "_spans").alias("text")
    return joined.select(*[text if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [
        F.size(of_kind("_spans", k)).cast("long").alias(f"n_{kind}")
        for k, kind in enumerate((*KINDS, "term"))
    ]
    return detect(docs).select(
        F.col("_id").alias("doc_id"),
        *counts,
        F.sha2(rendered("_base"), 256).alias("base_sha256"),
        rendered("_spans").alias("spans"),
    )
