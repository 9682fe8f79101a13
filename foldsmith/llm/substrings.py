"""Exact substring dedup over suffix arrays built by induced sorting.

Every byte that is covered by a ``WINDOW``-byte string which also starts elsewhere, in the
same text or another, is removed. Texts that occur more than once are settled as a whole.
Of the others (one row of each) the windows are told apart by their anchors
(``foldsmith.llm.anchors``): fragments that repeat as a whole are settled by counting, and
fragments whose gram repeats but whose content does not, with one copy of each they have to
be compared with, go to shards by their gram. A shard's fragments are laid end to end; its
suffix array is sorted by induction, and neighbours that share a window's length by the
permuted common prefixes are repeats. A gram with more than ``HOT`` different fragments is
split further, by the content of each window, and settled by counting.

Texts are UTF-8 bytes and matches never cross them. Defined results: NULL text is empty;
repeated rows are copies of each other; rows are matched by id and digest, so ids may repeat
or be NULL; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm import anchors
from foldsmith.llm.induced import permuted_prefixes, suffix_array
from foldsmith.llm.joins import balanced
from foldsmith.llm.registry import query, table
from foldsmith.session import materialize

WINDOW = 200
GRAM = 40
SHARD_BYTES = 1 << 20
HOT = 4096
ROW = "doc_id long, key long, low long, high long"
PARTS = "fp long, alone boolean, doc_id long, key long, low long, part binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the fragments (struct fp, alone, low, high) out of each text."""
    for batch in batches:
        for doc, key, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            rows = [
                (c["fp"], c["alone"], doc, key, c["low"], data[c["low"] : c["high"] + WINDOW])
                for c in cuts
            ]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in PARTS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names
            )


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """Per part the starts of windows that start elsewhere in these parts as well."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no byte of UTF-8
    symbols, s = np.unique(joined, return_inverse=True)
    array = suffix_array(s, len(symbols))
    common = permuted_prefixes(s, array, WINDOW)
    long = common >= WINDOW
    twice = long.copy()
    twice[array[:-1]] |= long[array[1:]]
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # A window that reaches into the next part holds a stop.
    return [
        np.flatnonzero(twice[b : b + n - WINDOW + 1]) if n >= WINDOW else np.zeros(0, np.int64)
        for b, n in zip(begins.tolist(), sizes.tolist())
    ]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(starts)]]) - 1
    return list(zip(starts[first].tolist(), starts[last].tolist()))


def _shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by gram, taken in lots of about ``SHARD_BYTES`` that part no gram."""

    def settle(lot: pd.DataFrame) -> pd.DataFrame:
        out = []
        starts = repeated_starts(lot["part"].tolist())
        for alone, doc, key, low, found in zip(lot["alone"], lot["doc_id"], lot["key"], lot["low"], starts):
            if alone:
                doc = None if pd.isna(doc) else int(doc)
                out += [(doc, key, low + a, low + b) for a, b in runs(found)]
        frame = pd.DataFrame(out, columns=["doc_id", "key", "low", "high"])
        return frame.astype({"doc_id": "Int64"})

    for lot in anchors.lots(frames, SHARD_BYTES):
        yield settle(lot)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A 128-bit digest of each window of each part."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            n = len(row.part) - WINDOW + 1
            made = b"".join([xxhash.xxh3_128_digest(row.part[k : k + WINDOW]) for k in range(n)])
            both = np.frombuffer(made, "<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "fp": row.fp,
                    "w1": both[:, 0],
                    "w2": both[:, 1],
                    "alone": row.alone,
                    "doc_id": pd.array([row.doc_id] * n, "Int64"),
                    "key": row.key,
                    "low": row.low + np.arange(n),
                }
            )


def repeats(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Per text the ranges of window starts that are repeated: doc_id, key, low, high."""
    shared = anchors.fragments(rows, groups, anchors.byte_units, WINDOW, GRAM)
    kinds = shared.groupBy("fp", "fd").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "key", "place")]
    )
    kinds = materialize(kinds, "kinds")
    whole = balanced(shared, kinds.where("n > 1").select("fp", "fd", "n"), ["fp", "fd"], "n", "left_semi")
    whole = whole.select("doc_id", "key", *anchors.start_range())
    # Fragments that stand alone in a gram with others, and what they are compared with.
    grams = kinds.groupBy("fp").agg(
        F.count(F.lit(1)).alias("different"), F.max(F.col("n") == 1).alias("any_alone")
    )
    grams = materialize(grams.where("different > 1 AND any_alone"), "grams")
    close = balanced(kinds, grams, ["fp"], "different").select(
        "doc_id",
        "key",
        "fp",
        (F.col("n") == 1).alias("alone"),
        (F.col("different") > HOT).alias("hot"),
        *anchors.start_range(),
    )
    close = materialize(close, "close")
    total = close.agg(F.sum(F.col("high") - F.col("low") + WINDOW)).first()[0] or 0
    if not total:
        return whole

    def parts(some: DataFrame) -> DataFrame:
        cuts = some.groupBy("doc_id", "key").agg(
            F.collect_list(F.struct("fp", "alone", "low", "high")).alias("cuts")
        )
        texts = anchors.on_text(rows.select("doc_id", "key", "text"), materialize(cuts, "cuts"), "inner")
        return texts.select("doc_id", "key", "text", "cuts").mapInArrow(_parts, PARTS)

    shards = parts(close.where("NOT hot")).repartition(max(1, -(-total // SHARD_BYTES)), "fp")
    found = whole.unionByName(shards.sortWithinPartitions("fp").mapInPandas(_shard, ROW))
    if close.where("hot").limit(1).count():
        names = "fp long, w1 long, w2 long, alone boolean, doc_id long, key long, low long"
        each = materialize(parts(close.where("hot")).mapInPandas(_windows, names), "windows")
        often = each.groupBy("fp", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        often = materialize(often, "often")
        again = balanced(each.where("alone"), often, ["fp", "w1", "w2"], "n", "left_semi")
        found = found.unionByName(again.select("doc_id", "key", "low", F.col("low").alias("high")))
    return found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, copies, found in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            if copies and len(data) >= WINDOW:
                spans = [(0, len(data))]
            else:
                spans = merged(sorted((c["low"], c["high"] + WINDOW) for c in found or ()))
            kept, at = [], 0
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            spans = [{"start": a, "end": b} for a, b in spans]
            out.append((doc, len(data), spans, b"".join(kept)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), span, pa.binary()]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, removed spans, and the bytes that are kept."""
    rows = anchors.keyed(docs)
    groups = anchors.copies(rows)
    found = repeats(rows, groups).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("low", "high")).alias("found")
    )
    joined = anchors.on_text(anchors.with_copies(rows, groups), materialize(found, "repeats"), "left")
    return joined.select("doc_id", "text", "copies", "found").mapInArrow(
        _remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


@query("op7_substrings")
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
