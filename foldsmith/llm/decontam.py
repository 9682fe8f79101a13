"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set, taken in blocks of bounded size; all documents are held
against each block. Windows of ``MIN_TILE`` words that a document shares with an item are
the seeds of their join. For each such pair running Karp-Rabin looks for the longest common
stretches of words not yet marked, marks them as tiles, and goes on with shorter ones, down
to ``MIN_TILE``. A document is contaminated by an item when its tiles cover at least
``COVERAGE`` of the item's words, in whatever order they stand.

Words are lower-cased runs of letters, digits and underscores. Defined results: NULL or
empty texts share nothing; an item of fewer than ``MIN_TILE`` words matches nothing; items
and rows that repeat are compared each; empty tables give no pair. Documents keep all their
columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.session import materialize

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20  # of benchmark text that is held against the documents at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash
PAIRS = "doc_id long, item_id long, coverage double, item_words long, tiles string"
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window, in 64-bit arithmetic that wraps around."""
    n = max(0, len(ids) - size + 1)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * BASE + ids[k : k + n]
    return value


@dataclass
class Index:
    """Items of a block: word numbers from 1, word sequences, and sorted seeds."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    seeds: np.ndarray
    owners: np.ndarray
    min_tile: int

    @classmethod
    def of(cls, rows: list[tuple[int, str]], min_tile: int) -> Index:
        vocabulary: dict[str, int] = {}
        items = []
        for item, text in rows:
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text)]
            if len(w) >= min_tile:
                items.append((item, np.array(w, np.uint64)))
        hashed = [np.unique(window_hashes(w, min_tile)) for _, w in items]
        seeds = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(items)), [len(h) for h in hashed])
        order = np.argsort(seeds, kind="stable")
        return cls(vocabulary, items, seeds[order], owners[order], min_tile)

    def matches(self, text: str | None) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Item number, its words, and tiles (place in text, in item, length), per item met."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.uint64)
        if len(ids) < self.min_tile or not len(self.seeds):
            return
        hashes = window_hashes(ids, self.min_tile)
        first = np.searchsorted(self.seeds, hashes, "left")
        hit = self.seeds[np.minimum(first, len(self.seeds) - 1)] == hashes
        # Words outside the vocabulary are 0 and in no item.
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        hit &= unknown[self.min_tile :] == unknown[: -self.min_tile]
        at = np.flatnonzero(hit)
        if not len(at):
            return
        last = np.searchsorted(self.seeds, hashes[at], "right")
        sizes = last - first[at]
        owner = self.owners[np.repeat(first[at], sizes) + _counted(sizes)]
        place = np.repeat(at, sizes)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        bounds = np.flatnonzero(np.diff(owner)) + 1
        for own, where in zip(np.split(owner, bounds), np.split(place, bounds)):
            item = self.items[own[0]][1]
            covered = np.unique((where[:, None] + np.arange(self.min_tile)).ravel())
            yield int(own[0]), len(item), tile(item, ids, covered, self.min_tile)


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def tile(
    item: np.ndarray, text: np.ndarray, covered: np.ndarray, min_tile: int
) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length) of one pair.

    Only the places of the text that seeds cover can be part of a tile. The search length
    starts at the item's length; when longer stretches are found they are marked first, and
    when nothing is left of a length it is halved, down to the shortest tile.
    """
    free_item = np.ones(len(item), bool)
    # Stretches of covered places, a stop between them.
    breaks = np.flatnonzero(np.diff(covered) > 1) + 1
    places = np.concatenate([np.append(part, -1) for part in np.split(covered, breaks)])
    words_ = np.where(places >= 0, text[places], 0)
    free_text = places >= 0
    found = []
    size = len(item)
    while size >= min_tile:
        matches = _scan(item, words_, free_item, free_text, size)
        for length, at, p in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[p : p + length].all() and free_text[at : at + length].all():
                free_item[p : p + length] = False
                free_text[at : at + length] = False
                found.append((int(places[at]), p, length))
        # What overlapped a tile may still hold one of this length or less.
        if any(_open(free_item, free_text, m, size) for m in matches):
            continue
        size = size // 2 if size > 2 * min_tile else min_tile if size > min_tile else 0
    return sorted(found)


def _open(free_item: np.ndarray, free_text: np.ndarray, match: tuple, size: int) -> bool:
    length, at, p = match
    both = free_item[p : p + length] & free_text[at : at + length]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], both, [False]]).astype(np.int8)))
    return bool(len(edges)) and int((edges[1::2] - edges[::2]).max()) >= size


def _scan(item, text, free_item, free_text, size) -> list[tuple[int, int, int]]:
    """Unmarked common stretches of at least ``size`` words, as long as they can be."""

    def unmarked(free: np.ndarray) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[size:] == taken[:-size]) if len(free) >= size else np.zeros(0, int)

    of_item, of_text = window_hashes(item, size), window_hashes(text, size)
    places: dict[int, list[int]] = {}
    for p in unmarked(free_item).tolist():
        places.setdefault(int(of_item[p]), []).append(p)
    found, seen = [], set()
    for at in unmarked(free_text).tolist():
        for p in places.get(int(of_text[at]), ()):
            if (at - 1, p - 1) in seen:  # inside the stretch found before
                seen.add((at, p))
                continue
            length = 0
            while (
                p + length < len(item)
                and at + length < len(text)
                and item[p + length] == text[at + length]
                and free_item[p + length]
                and free_text[at + length]
            ):
                length += 1
            if length >= size:
                seen.add((at, p))
                found.append((length, at, p))
    return found


def blocks(benchmark: DataFrame, min_tile: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes over parts of the benchmark, each of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = materialize(rows.where(F.length("text") > 0), "benchmark")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Index.of([tuple(r) for r in own.collect()], min_tile)


def _pairs(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, size, tiles in index.matches(text):
                    share = sum(t[2] for t in tiles) / size
                    if share >= coverage:
                        spans = ",".join(":".join(map(str, t)) for t in tiles)
                        out.append((doc, index.items[number][0], share, size, spans))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            names = [c.split()[0] for c in PAIRS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=names
            )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE
) -> DataFrame:
    """Pairs (doc_id, item_id) whose tiles cover enough of the item, with the tiles."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    context = docs.sparkSession.sparkContext
    found = None
    for index in blocks(benchmark, min_tile):
        part = rows.mapInArrow(_pairs(context.broadcast(index), coverage), PAIRS)
        found = part if found is None else found.unionByName(part)
    return found


def _clean(shared, text: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = [
                not any(sum(t[2] for t in tiles) >= coverage * size for _, size, tiles in index.matches(x))
                for x in batch.column(text).to_pylist()
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def clean(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    context = docs.sparkSession.sparkContext
    rows = docs
    for index in blocks(benchmark, min_tile):
        at = docs.columns.index("text")
        rows = rows.mapInArrow(_clean(context.broadcast(index), at, coverage), docs.schema)
    return rows


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))
