"""SimHash near-duplicates by pigeonring filtering.

The 64 bits are cut into ``SEGMENTS`` segments on a ring. Of two fingerprints that differ in
at most d bits, some chain of segments starts where the differences summed over its first l
segments never exceed ``l * d / SEGMENTS``. While that budget is below one, the segments are
equal, so the first ones of the chain are the join key; the longer sums then prune before
the full count of differing bits. With d = 2 and 7 segments the key is 3 segments (27 bits).

Equal fingerprints are one row before any join. Rows meet sorted by key, and a key gives
links to the smallest fingerprint of each connected group in it, not all its pairs. A key
with more than ``GROUP`` fingerprints is split: the bits it does not fix are cut into d + 1
blocks, of which a pair within d bits shares one, and so on until groups are small or few
bits are left. Nothing is dropped. Links become components by stars.

Defined results: NULL or empty text has fingerprint zero, linked like any other; repeated
rows are members of the same group; a NULL id is a row like others, and never the smallest
id; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsmith.llm.components import components
from foldsmith.llm.joins import looked_up
from foldsmith.llm.registry import query, table
from foldsmith.session import broadcast_if_small, materialize, small_batches

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 7
SEED = 42
BITS = 64
GROUP = 2048
ID_BYTES = 16
BLOCK_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of all shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(begins, stops)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK_ROWS):
        ones += np.unpackbits(bits[at : at + BLOCK_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [fingerprint(t, shingle) for t in frame["text"]]
            fps = np.array(made, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fps})

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInPandas(_fingerprints(shingle), "doc_id long, fp long")


def segments(count: int) -> list[int]:
    """Masks of the segments, from the highest bits; sizes differ by one at most."""
    edges = [round(k * BITS / count) for k in range(count + 1)]
    return [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(edges, edges[1:])]


def chains(count: int, distance: int) -> list[list[tuple[int, int]]]:
    """Per start: (mask of the first l segments, differences allowed there), l from 1."""
    masks = segments(count)
    found = []
    for start in range(count):
        chain, mask = [], 0
        for size in range(1, count + 1):
            mask |= masks[(start + size - 1) % count]
            chain.append((mask, size * distance // count))
        found.append(chain)
    return found


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def split(mask: int, parts: int) -> list[int]:
    """The mask joined by each of ``parts`` blocks of the bits it leaves free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cut = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cut, cut[1:])]


def _links(distance: int, rings: list[list[tuple[int, int]]]):
    def link(keys: np.ndarray, fps: np.ndarray, start: np.ndarray) -> pd.DataFrame:
        """Links of rows sorted by key: each to the smallest of its group within its key."""
        n = len(fps)
        change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        run_end = np.repeat(np.append(change, n), np.diff(np.concatenate([[0], change, [n]])))
        label = np.arange(n)
        at, step = np.arange(n), 0
        while True:
            step += 1
            at = at[at + step < run_end[at]]
            if not len(at):
                break
            differ = fps[at] ^ fps[at + step]
            near = np.bitwise_count(differ) <= distance
            # The chain from the key's start, before the full count decides.
            for size in range(len(rings[0])):
                masks = np.array([r[size][0] for r in rings], np.uint64)[start[at]]
                near &= np.bitwise_count(differ & masks) <= rings[0][size][1]
            i = at[near]
            j = i + step
            while len(i):
                a, b = label[i], label[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = label[label]
                    if np.array_equal(up, label):
                        break
                    label = up
        linked = fps != fps[label]
        return pd.DataFrame(
            {"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)}
        ).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = frame[["start", "mask", "bits"]].to_numpy(np.int64)
            cut = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            rest = frame.iloc[cut:]
            if cut:
                done = frame.iloc[:cut]
                yield link(keys[:cut], done["fp"].to_numpy(np.int64).view(np.uint64), keys[:cut, 0])
        if rest is not None and len(rest):
            keys = rest[["start", "mask", "bits"]].to_numpy(np.int64)
            yield link(keys, rest["fp"].to_numpy(np.int64).view(np.uint64), keys[:, 0])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between different fingerprints, enough to connect all within distance."""
    rings = chains(count, distance)
    # The chain's first segments are equal as long as their budget is below one.
    equal = max(l for l in range(1, count + 1) if l * distance // count == 0)
    level = [(s, ring[equal - 1][0]) for s, ring in enumerate(rings)]
    keyed = keys(fps, level)
    done = []
    while True:
        keyed = materialize(keyed, "keys")
        sizes = keyed.groupBy("start", "mask", "bits").agg(F.count(F.lit(1)).alias("n"))
        hot = materialize(sizes.where(F.col("n") > GROUP).drop("n"), "hot")
        n_hot = hot.count()
        key = ["start", "mask", "bits"]
        if not n_hot:
            done.append(keyed)
            break
        small = broadcast_if_small(hot, n_hot * 3 * ID_BYTES)
        done.append(keyed.join(small, key, "left_anti"))
        large = keyed.join(small, key, "left_semi")
        masks = hot.select("start", "mask").distinct().collect()  # bounded by the levels
        parts = [
            (r["start"], signed(r["mask"] % (1 << BITS)), signed(m))
            for r in masks
            for m in split(r["mask"] % (1 << BITS), distance + 1)
            # Groups of so few free bits are small.
            if bin(r["mask"] % (1 << BITS)).count("1") < BITS - 1 - GROUP.bit_length()
        ]
        finer = F.broadcast(
            fps.sparkSession.createDataFrame(parts, "start int, mask long, finer long")
        )
        done.append(large.join(finer.select("start", "mask").distinct(), ["start", "mask"], "left_anti"))
        keyed = large.join(finer, ["start", "mask"]).select(
            "start", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("bits"), "fp"
        )
        if not parts:
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition("start", "mask", "bits").sortWithinPartitions("start", "mask", "bits", "fp")
    return rows.mapInPandas(_links(distance, rings), "a long, b long")


def keys(fps: DataFrame, level: list[tuple[int, int]]) -> DataFrame:
    """Each fingerprint under each (start, mask) with its bits there."""
    made = [
        F.struct(
            F.lit(s).cast("int").alias("start"),
            F.lit(signed(m)).alias("mask"),
            F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"),
        )
        for s, m in level
    ]
    return fps.select("fp", F.explode(F.array(*made)).alias("k")).select("k.start", "k.mask", "k.bits", "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, count: int = SEGMENTS
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id that can be reached)."""
    with small_batches(docs.sparkSession):
        made = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(links(distinct.select("fp"), distance, count))
    labelled = distinct.join(stars, F.col("fp") == F.col("a"), "left").select(
        "fp", "first", F.coalesce("b", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "label").select("fp", "component_id")
    return made.join(classes, "fp").select("doc_id", "fp", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without an id stay.

    Of the rows kept under one id one stays, by the digest of its text, then of the whole row.
    Only rows whose id goes or repeats are moved. The columns of ``docs`` are carried in one
    struct, so they may have any names.
    """
    found = materialize(near_duplicates(docs), "groups").where("doc_id IS NOT NULL")
    first = F.sum((F.col("doc_id") == F.col("component_id")).cast("long"))
    ids = found.groupBy("doc_id").agg(first.alias("kept"), F.count(F.lit(1)).alias("rows"))
    odd = ids.where("kept <> 1 OR rows <> 1").withColumnRenamed("doc_id", "_id")
    odd = materialize(odd, "odd_ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), row.alias("_row"))
    marked = looked_up(rows, odd, ["_id"], weight="rows")
    stay = marked.where("kept IS NULL").select("_row")
    order = Window.partitionBy("_id").orderBy(F.xxhash64("_text"), F.xxhash64(F.to_json("_row")), F.to_json("_row"))
    repeated = marked.where("kept > 0").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row")
    return stay.unionByName(repeated).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
