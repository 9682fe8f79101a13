import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.llm import importance, mixture, vector_codes
from tests.llm.cases import copied_rows, edge_rows, frame, words

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=0, count=400, width=8):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(width)], rng.choice([0, 1, 1, None])) for k in range(count)]
    rows += [(1000 + k, list(rows[k][1]), 2) for k in range(20)]  # ties
    rows += [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [math.nan] * 8, 1), (2003, [-math.inf] * 8, 1)]
    return rows + [(3000, [0.5] * 8, None), (3000, [0.5] * 8, None), (None, [0.25] * 8, 0)]


def coded(rows, entries=256, rounds=4, parts=4):
    """Lloyd's rounds in plain Python integers, every entry compared."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    as_int = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in good]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))
    w = len(as_int[0]) // parts
    books = [[as_int[k][p * w : p * w + w] for k in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in as_int:
                held[near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            for e, some in held.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    out = []
    for r, v in zip(good, as_int):
        found = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return Counter(out), books


@pytest.mark.parametrize("entries, scale", [(16, 1.0), (256, 1.0), (16, 1e12)])
def test_codes_against_plain_integers(spark, entries, scale):
    rows = vector_rows()
    if scale != 1:  # squares beyond what doubles hold
        rows = [(i, None if v is None else [None if x is None else x * scale for x in v], c) for i, v, c in rows]
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("code", F.lit("mine")).withColumn("n", F.lit(1))
    kept = vector_codes.kept(df, "vec_id", "embedding", "label")
    books, width = vector_codes.train(kept, entries=entries)
    wanted, plain = coded(rows, entries)
    assert [[list(map(int, e)) for e in b] for b in books] == plain
    got = vector_codes.encode(kept, books, width).collect()
    limit = vector_codes.LONGEST
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(
        {(i, c, min(e, limit)): n for (i, c, e), n in wanted.items()}
    )


def test_search_looks_at_less_than_all_entries():
    """Sums that spread out: most entries are beyond the bound, and none that matters is left out."""
    rng = np.random.default_rng(3)
    parts = np.floor(rng.normal(0, 400, (4000, 16)) + rng.normal(0, 4000, (4000, 1)))
    book = parts[rng.choice(4000, 256, replace=False)]
    index, error, looked = vector_codes.nearest(parts, book)
    far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (error == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()
    assert looked < 0.5 * far.size


def test_vectors_of_other_lengths_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [], 0), (3, [1.0, 2.0, 3.0, 4.0, 5.0], None)]
    kept = vector_codes.kept(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    books, width = vector_codes.train(kept)
    assert width == 8 and [b.shape for b in books] == [(3, 2)] * 4
    assert {r.vec_id: r.error for r in vector_codes.encode(kept, books, width).collect()} == {1: 0, 2: 0, 3: 0}
    for none in (kept.where("false"), kept.where("vec_id = 2")):
        books, width = vector_codes.train(none)
        assert vector_codes.encode(none, books, width).count() == none.count()


def importance_words(text):
    out, at = [], ""
    for c in (text or "") + " ":
        if ord(c) > 0x7F or c.isascii() and c.isalnum():
            at += c.lower() if c.isascii() else c
        elif at:
            out.append(at)
            at = ""
    return out


def runs_of(text, run):
    w = importance_words(text)
    return w, [" ".join(w[k : k + n]).encode() for n in range(1, run + 1) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("run, piece", [(1, 1 << 20), (3, 64)])
def test_prefix_crcs_are_crcs_of_the_runs(monkeypatch, run, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [r[1] for r in edge_rows() + copied_rows(2)] + ["A\x00B{c}É-é 9", "x" * 5000 + " y"]
    for text in texts:
        w, runs = runs_of(text, run)
        n, found = importance.buckets((text or "").encode(), run, 10_000)
        assert n == len(w) and Counter(found.tolist()) == Counter(zlib.crc32(r) % 10_000 for r in runs)


@pytest.mark.parametrize("run, count", [(1, 10_000), (2, 300)])
def test_importance_against_brute_force(spark, run, count):
    rows = edge_rows() + copied_rows(4)
    target = [(1, "La öl, the passage v3 v4"), (2, None), (3, "v5 v5")]
    df = frame(spark, rows, extra=True).withColumn("weight", F.lit("mine")).withColumn("buckets", F.lit("mine"))
    benchmark = spark.createDataFrame(target, "item_id long, text string").withColumn("item", F.lit("mine"))
    got = importance.resample(df, benchmark, run=run, count=count, percent=30).collect()
    bags = [(r[0], *runs_of(r[1], run)) for r in rows]
    s = Counter(zlib.crc32(g) % count for _, _, runs in bags for g in runs)
    t = Counter(zlib.crc32(g) % count for _, text in target for g in runs_of(text, run)[1])
    ss, tt = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (ss + count) / ((s[b] + 1) * (tt + count))))

    scored = []
    for doc, w, runs in bags:
        weight = sum(gain(zlib.crc32(g) % count) for g in runs)
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc, len(w), len(runs), weight, weight + noise))
    able = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[: len(able) * 30 // 100]
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(scored)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(x[0], x[4]) for x in drawn]


def test_importance_of_empty_tables(spark):
    none = frame(spark, edge_rows()).where("false")
    some = frame(spark, edge_rows())
    target = some.select(F.col("doc_id").alias("item_id"), "text")
    assert importance.resample(none, target).count() == 0
    assert all(r.weight <= 0 or r.n_words for r in importance.resample(some, target.where("false")).collect())


def filled(sizes, cycle=(1, 2, 3), percent=100, epochs=3):
    """Clamp, share the rest anew, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    budget, clamped = sum(sizes.values()) * percent // 100, set()
    while True:
        rest = budget - sum(epochs * sizes[s] for s in clamped)
        total = sum(weight[s] for s in sizes if s not in clamped)
        share = {s: rest * weight[s] / total if s not in clamped else epochs * sizes[s] for s in sizes}
        above = {s for s in sizes if s not in clamped and epochs * sizes[s] * total < rest * weight[s]}
        if not above or above | clamped == set(sizes):
            return {s: epochs * sizes[s] if s in above else share[s] for s in sizes}
        clamped |= above


def mixture_rows():
    rows = copied_rows(7, 200)
    rows = [(i, t, l, "hot" if k % 2 else f"s{k % 9}", n) for k, (i, t, l, _, n) in enumerate(rows)]
    return rows + edge_rows() + [(5000, "a b c", "en", "tiny", 0), (5001, "only one " * 7, "en", "\U0001f600", 0)]


@pytest.mark.parametrize("percent", [100, 170, 400])
def test_mixture_reaches_its_targets(spark, percent):
    rows = mixture_rows()
    df = frame(spark, rows, extra=True)
    sizes = mixture.sized(df, "doc_id", "source", "text")
    found = mixture.decisions(sizes, percent=percent)
    got = mixture.decided(sizes, found, "source").withColumn("times", mixture.repetitions("doc_id")).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    per = Counter()
    for r in rows:
        per[r[3]] += len(words(r[1]))
    wanted = filled(dict(per), percent=percent)
    for source, target in wanted.items():
        own = [r for r in got if r.source == source]
        assert all(math.isclose(r.target, target, rel_tol=1e-12) and r.source_size == per[source] for r in own)
        assert all(0 <= r.times <= 3 for r in own)
        same = Counter()  # rows of one id are taken together
        for r in own:
            same[r.doc_id] += r["size"]
        assert abs(sum(r["size"] * r.times for r in own) - target) <= max(same.values()) / 2 + 1e-6
    again = mixture.decided(sizes.repartition(7), mixture.decisions(sizes.repartition(2), percent=percent), "source")
    times = Counter((r.doc_id, r.source, r["size"], r.times) for r in got)
    assert Counter((r.doc_id, r.source, r["size"], r.times) for r in again.withColumn("times", mixture.repetitions("doc_id")).collect()) == times
    if percent == 100:
        out = mixture.repeated(df)
        assert out.columns == df.columns
        copies = Counter(tuple(r) for r in out.select("doc_id", "source").collect())
        each = Counter()
        for (doc, source, size, n), rows_of in times.items():
            each[doc, source] += n * rows_of
        assert copies == +each
        assert {r.fp for r in out.select("fp").distinct().collect()} == {"mine"}


def test_mixture_of_nothing(spark):
    none = frame(spark, edge_rows()).where("false")
    assert mixture.repeated(none).count() == 0
    blank = frame(spark, [r for r in edge_rows() if not words(r[1])])
    sizes = mixture.sized(blank, "doc_id", "source", "text")
    rows = mixture.decided(sizes, mixture.decisions(sizes), "source").collect()
    assert len(rows) == blank.count() and {(r["size"], r.target) for r in rows} == {(0, 0.0)}


@pytest.mark.parametrize("module, name", [(mixture, "op13_mixture")])
def test_native_operators_have_no_python_in_their_plans(spark, module, name):
    df = frame(spark, mixture_rows())
    plan = module.repeated(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
