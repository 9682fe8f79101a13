"""Exact dedup of word windows over prefix-partitioned suffix trees.

A word is removed when it is covered by a window of ``WINDOW`` words whose sequence also
starts in a document with a smaller id. Equal texts are settled as a whole. Of the others
(one row of each) the windows are told apart by their anchors (``foldsmith.llm.anchors``):
the occurrences of a fragment that has a smaller owner are settled by counting, and
fragments whose gram has other fragments with smaller owners go, with those, to shards by
their gram. That gram is the first prefix that splits the suffixes. Inside a shard longer
prefixes, as long as each needs, split them into groups of at most ``SUFFIXES``; a group's
suffixes are sorted to a subtree of depth ``WINDOW``, and its internal nodes at that depth
are the repeats. A gram with more than ``HOT`` different fragments is split by whole windows
and settled by counting.

Words are runs without white space, compared unchanged. Defined results: NULL text has no
words; a NULL id is larger than any other and no smaller than itself; repeated rows are
copies with the same id, so neither removes the other; rows are matched by id and digest; an
empty table gives an empty result; columns besides id and text are not read.
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
from foldsmith.llm.joins import balanced
from foldsmith.llm.registry import query, table
from foldsmith.llm.substrings import merged, runs
from foldsmith.session import materialize

WINDOW = 50
GRAM = 10
SHARD_BYTES = 4 << 20
SUFFIXES = 1 << 14
HOT = 4096
LAST = (1 << 63) - 1
PARTS = "fp long, fd long, owner long, asks boolean, part binary"
FOUND = "fp long, fd long, owner long, first long, last long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the fragments out of each text, words joined by one space."""
    for batch in batches:
        for text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            rows = [
                (c["fp"], c["fd"], c["owner"], c["asks"], b" ".join(words[c["low"] : c["high"] + WINDOW]))
                for c in cuts
            ]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = [c.split()[0] for c in PARTS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names
            )


def groups_by_prefix(words: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes in groups of at most ``limit`` and the length of prefix their group shares.

    A prefix that too many suffixes share is made longer by a word; prefixes of few suffixes
    are grouped with their neighbours. Beyond ``limit`` only equal windows stay together.
    """
    waiting = [(starts, 0)]
    while waiting:
        some, depth = waiting.pop()
        if len(some) <= limit or depth == WINDOW:
            yield some, depth
            continue
        word = words[some + depth]
        order = np.argsort(word, kind="stable")
        some, word = some[order], word[order]
        cuts = np.flatnonzero(np.diff(word)) + 1
        held: list[np.ndarray] = []
        size = 0
        for part in np.split(some, cuts):
            if len(part) > limit:
                waiting.append((part, depth + 1))
            elif len(part) > 1:  # a prefix of one suffix is in no internal node
                if size + len(part) > limit:
                    yield np.concatenate(held), depth
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield np.concatenate(held), depth


def deep_nodes(words: np.ndarray, starts: np.ndarray, limit: int = SUFFIXES) -> Iterator[np.ndarray]:
    """Leaves of each internal node at depth ``WINDOW``: starts of equal windows."""
    for some, depth in groups_by_prefix(words, starts, limit):
        if depth == WINDOW:
            yield some
            continue
        rows = words[some[:, None] + np.arange(WINDOW)]
        order = np.lexsort(rows.T[::-1])
        rows, some = rows[order], some[order]
        # Neighbours with a common prefix of the whole window hang under one deep node.
        common = (rows[1:] == rows[:-1]).all(axis=1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], common, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield some[a : b + 1]


def smaller_elsewhere(parts: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """Per part the starts of windows that a part with a smaller owner has as well."""
    numbers: dict[bytes, int] = {}
    split = [[numbers.setdefault(w, len(numbers)) for w in p.split(b" ")] for p in parts]
    sizes = np.array([len(p) for p in split])
    words = np.concatenate([np.array(p, np.int32) for p in split])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate(
        [np.arange(b, b + n - WINDOW + 1) for b, n in zip(begins.tolist(), sizes.tolist())]
    )
    of = np.repeat(np.arange(len(parts)), sizes)
    found = np.zeros(len(words), bool)
    for leaves in deep_nodes(words, starts):
        own = owners[of[leaves]]
        found[leaves[own > own.min()]] = True
    return [np.flatnonzero(found[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist())]


def _shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by gram, taken in lots of about ``SHARD_BYTES`` that part no gram."""

    def settle(lot: pd.DataFrame) -> pd.DataFrame:
        out = []
        starts = smaller_elsewhere(lot["part"].tolist(), lot["owner"].to_numpy())
        for fp, fd, owner, asks, own in zip(lot["fp"], lot["fd"], lot["owner"], lot["asks"], starts):
            if asks:
                out += [(fp, fd, owner, a, b) for a, b in runs(own)]
        return pd.DataFrame(out, columns=["fp", "fd", "owner", "first", "last"])

    for lot in anchors.lots(frames, SHARD_BYTES):
        yield settle(lot)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A 128-bit digest of each window of each part."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            words = row.part.split(b" ")
            n = len(words) - WINDOW + 1
            made = b"".join(
                [xxhash.xxh3_128_digest(b" ".join(words[k : k + WINDOW])) for k in range(n)]
            )
            both = np.frombuffer(made, "<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {"w1": both[:, 0], "w2": both[:, 1], "first": np.arange(n)}
            ).assign(fp=row.fp, fd=row.fd, owner=row.owner, asks=row.asks)[
                ["fp", "fd", "owner", "asks", "w1", "w2", "first"]
            ]


def repeats(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Per text the ranges of window starts that a smaller id has: doc_id, key, low, high."""
    shared = anchors.fragments(rows, groups, anchors.word_units, WINDOW, GRAM)
    rank = F.coalesce("doc_id", F.lit(LAST))
    kinds = shared.groupBy("fp", "fd").agg(
        F.min(rank).alias("owner"),
        F.max(rank).alias("top"),
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in ("doc_id", "key", "place")],
    )
    kinds = materialize(kinds, "kinds")
    taken = kinds.where("top > owner").select("fp", "fd", "owner", "n")
    whole = balanced(shared, taken, ["fp", "fd"], "n").where(rank > F.col("owner"))
    whole = whole.select("doc_id", "key", *anchors.start_range())
    # Fragments of a gram that has others, some of them with a smaller owner.
    grams = kinds.groupBy("fp").agg(
        F.count(F.lit(1)).alias("different"), F.min("owner").alias("least"), F.max("owner").alias("most")
    )
    grams = materialize(grams.where("different > 1 AND most > least"), "grams")
    close = balanced(kinds, grams, ["fp"], "different").select(
        "doc_id",
        "key",
        "fp",
        "fd",
        "owner",
        (F.col("owner") > F.col("least")).alias("asks"),
        (F.col("different") > HOT).alias("hot"),
        *anchors.start_range(),
    )
    close = materialize(close, "close")
    total = close.agg(F.sum(F.col("high") - F.col("low") + WINDOW)).first()[0] or 0
    if not total:
        return whole

    def parts(some: DataFrame) -> DataFrame:
        cut = F.struct("fp", "fd", "owner", "asks", "low", "high")
        cuts = some.groupBy("doc_id", "key").agg(F.collect_list(cut).alias("cuts"))
        texts = anchors.on_text(rows.select("doc_id", "key", "text"), materialize(cuts, "cuts"), "inner")
        return texts.select("text", "cuts").mapInArrow(_parts, PARTS)

    # About eight bytes a word.
    shards = parts(close.where("NOT hot")).repartition(max(1, -(-8 * total // SHARD_BYTES)), "fp")
    found = shards.sortWithinPartitions("fp").mapInPandas(_shard, FOUND)
    if close.where("hot").limit(1).count():
        names = "fp long, fd long, owner long, asks boolean, w1 long, w2 long, first long"
        each = materialize(parts(close.where("hot")).mapInPandas(_windows, names), "windows")
        least = each.groupBy("fp", "w1", "w2").agg(F.min("owner").alias("least"), F.count(F.lit(1)).alias("n"))
        least = materialize(least, "least")
        again = balanced(each.where("asks"), least, ["fp", "w1", "w2"], "n").where("owner > least")
        found = found.unionByName(
            again.select("fp", "fd", "owner", "first", F.col("first").alias("last"))
        )
    found = materialize(found, "found")
    # The owner's rows only, so that a fragment many documents share meets in no task.
    owned = shared.withColumn("owner", rank).join(found, ["fp", "fd", "owner"])
    low, _ = anchors.start_range()
    owned = owned.select(
        "doc_id", "key", (low + F.col("first")).alias("low"), (low + F.col("last")).alias("high")
    )
    return whole.unionByName(owned)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, copy, found in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text or "").encode().split()
            if copy and len(words) >= WINDOW:
                spans = [(0, len(words))]
            else:
                spans = merged(sorted((c["low"], c["high"] + WINDOW) for c in found or ()))
            kept, at = [], 0
            for start, end in spans:
                kept += words[at:start]
                at = end
            kept += words[at:]
            spans = [{"start": a, "end": b} for a, b in spans]
            out.append((doc, len(words), spans, b" ".join(kept).decode()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), span, pa.string()]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)],
            names=["doc_id", "n_words", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, removed spans of words, and the kept words."""
    rows = anchors.keyed(docs)
    groups = anchors.copies(rows)
    found = repeats(rows, groups).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("low", "high")).alias("found")
    )
    joined = anchors.on_text(anchors.with_copies(rows, groups), materialize(found, "repeats"), "left")
    later = F.col("owner").isNotNull() & F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(True))
    return joined.select("doc_id", "text", later.alias("copy"), "found").mapInArrow(
        _remove, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"
    )


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
least AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (g), range(50) r(j) WHERE doc_id > owner),
word AS (SELECT doc_id, p, w[p] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


@query("op10_suffix_trees", SQL)
def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )
