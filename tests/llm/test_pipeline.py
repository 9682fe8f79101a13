"""The stages in a chain, each held against the brute-force version of its operator."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from foldsmith.llm import decontam, packing, quality
from foldsmith.session import WRITTEN, materialize
from tests.llm.cases import copied_rows, edge_rows, frame, words
from tests.llm.test_decontam import plain_tiles
from tests.llm.test_repeats import groups_by_distance
from tests.llm.test_text_operators import base

# Names that the stages use themselves.
NAMES = ["_id", "_digest", "_spans", "_hash", "_row", "_w", "_h", "_s", "_p", "_l", "_host", "_n", "_text", "__at",
         "__may", "kept", "n_words", "fp", "rows", "component_id", "base_failed", "row", "key", "n_email"]


def with_names(df):
    return df.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("source"), F.lit("?"))).alias(n) for n in NAMES])


def documents():
    rows = [r for r in copied_rows(11, 40)]
    people = [f"Anna writes to anna{k % 3}@mail.example or +1 386 555 3733 {k}" for k in range(12)]
    rows = [(i, f"{t} {people[k % 40]}" if k % 40 < 12 else t, *rest) for k, (i, t, *rest) in enumerate(rows)]
    item = " ".join(f"bench{k}" for k in range(30))
    filler = " ".join(random.Random(3).sample([f"z{k}" for k in range(500)], 120))
    rows += [(5000, f"{filler} {item}", "en", "s1", 0), (5001, f"{item[:40]} {filler}", "en", "s1", 0)]
    rows += [(6000 + k, filler + " " + " ".join(f"u{k}x{j}" for j in range(60)), "fr", None, 0) for k in range(3)]
    return rows + rows[:2] + edge_rows(), [(1, item), (2, None), (3, "")]


def plain(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "source", *NAMES).collect())


def test_the_chain_of_stages(spark):
    rows, items = documents()
    docs = materialize(with_names(frame(spark, rows)), "docs")
    wanted = Counter(tuple(r) for r in docs.select("doc_id", "text", "source", *NAMES).collect())
    sf = materialize(spark.createDataFrame(items, "item_id long, text string"), "folder").inputFiles()[0]
    folder = sf.rsplit("/", 2)[0]
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def staged(name):
        nonlocal docs
        columns = docs.columns
        docs = materialize(stages[name](spark, docs, folder), name)
        assert name == "packing" or docs.columns == columns
        return plain(docs) if name != "packing" else None

    # Quality: the SQL's verdicts, per row.
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    keyed = list(wanted.elements())
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, r[1], r[2]) for k, r in enumerate(keyed)])
    cursor = duck.execute(quality.SQL)
    names = [d[0] for d in cursor.description]
    keep = {r[names.index("doc_id")] for r in cursor.fetchall() if r[names.index("kept")]}
    wanted = Counter(r for k, r in enumerate(keyed) if k in keep)
    assert staged("quality_rules") == wanted and 20 < wanted.total() < len(rows)

    # Near-duplicates: the smallest id of each group, one row of it; rows without an id stay.
    groups = groups_by_distance(list(wanted.elements()))
    smallest = {c for (_, _, c) in groups if c is not None}
    got = staged("simhash_near_dedup")
    assert sorted(r[0] for r in got.elements() if r[0] is not None) == sorted(smallest)
    assert not got - wanted and Counter({r: n for r, n in wanted.items() if r[0] is None}) <= got
    wanted = got

    # Benchmark: tiles by their definition.
    def held(text):
        for _, item in items:
            w = decontam.words(item)
            if len(w) >= decontam.MIN_TILE:
                tiles = plain_tiles(w, decontam.words(text), decontam.MIN_TILE)
                if sum(t[2] for t in tiles) >= decontam.COVERAGE * len(w):
                    return True
        return False

    wanted = Counter({r: n for r, n in wanted.items() if len(decontam.words(r[1])) > 2000 or not held(r[1])})
    got = staged("benchmark_decontamination")
    assert got == wanted and 5000 not in {r[0] for r in got} and 5001 in {r[0] for r in got}

    # Personal data: rows and other columns as they were, texts changed where spans are.
    before = defaultdict(list)
    for r in got.elements():
        before[r[0], *r[2:]].append(r[1])
    after = staged("pii")
    assert after.total() == got.total()
    marked = 0
    for r in after.elements():
        old = before[r[0], *r[2:]]
        assert any(r[1] == t if not base(t) and "[TERM]" not in (r[1] or "") else r[1] != t for t in old)
        assert not base(r[1])
        marked += "[EMAIL]" in (r[1] or "")
    assert marked

    # Packing: every id of every text once, gapless in its document and its sequence.
    staged("packing")
    model = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    sizes = Counter((r[0], len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in after.elements())
    pieces = docs.collect()
    assert sum(n * k for (_, n), k in sizes.items()) == sum(p["length"] for p in pieces)
    per = defaultdict(list)
    for p in pieces:
        per[p["sequence_id"]].append((p["offset"], p["length"]))
    for some in per.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    starts = Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert starts == sizes


@pytest.mark.parametrize("some", [True, False])
def test_the_whole_pipeline_and_what_it_leaves(spark, tmp_path, some):
    rows, items = documents()
    docs = frame(spark, rows) if some else frame(spark, [])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items if some else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = len(WRITTEN)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() > 0) == some
    assert len(WRITTEN) == before + 1 and "packing" in WRITTEN[-1]
    assert words("a") == ["a"]
