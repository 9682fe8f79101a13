"""Anchors: which windows of a text can occur elsewhere at all.

A window of W units (bytes or words) is owned by the smallest hash among the grams of G units
inside it, the leftmost where equal. That depends on nothing but the window's content, so
equal windows are owned by equal grams at the same distance. Each occurrence of an owning
gram owns a range of window starts; the units from the first start to the end of the last
window are its fragment. Only windows whose gram occurs again can be repeated, and fragments
that are equal as a whole need no closer look. About 2 of W - G + 2 positions are anchors.

Rows of a table of fragments: the document (``doc_id``, ``key``), the gram's hash ``fp``,
the fragment's digest ``fd``, and in ``place`` the anchor's position with the distances to
the first and last start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.joins import balanced, looked_up
from foldsmith.session import materialize

BLOCK_UNITS = 1 << 20
LOT_BYTES = 1 << 22  # of texts worked on at a time
SPACE = re.compile(rb"[\x20\x09-\x0D]")
STEP = 1 << 8
ROWS = "doc_id long, key long, fp long, fd long, place long"
ROW_TYPES = [pa.int64()] * 5
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` units, put together from runs of powers of two."""
    run, power, have = units.astype(np.uint64), BASE, 1
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & have:
                # ``total`` covers the first ``done`` units of each gram.
                part = run[done:]
                total = part if total is None else total[: len(part)] * power + part
                done += have
            if done == size:
                return mixed(total[: max(0, len(units) - size + 1)])
            run = run[: max(0, len(run) - have)] * power + run[have:]
            power, have = power * power, 2 * have


def owners(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the position of its leftmost minimum."""
    value, at, size = hashes, np.arange(len(hashes), dtype=np.int32), 1

    def joined(value, at, by):
        less = value[by:] < value[: len(value) - by]
        return (
            np.where(less, value[by:], value[: len(value) - by]),
            np.where(less, at[by:], at[: len(at) - by]),
        )

    while 2 * size <= width:
        value, at = joined(value, at, size)
        size *= 2
    if size < width:
        value, at = joined(value, at, width - size)
    return at


def owned(units: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Anchors of texts laid end to end (``ends``: where each stops).

    Gives per anchor: its position, first and last window start it owns, and its hash.
    """
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(units, gram)
    at = owners(hashes, window - gram + 1)
    sizes = np.diff(np.concatenate([[0], ends]))
    stop = np.repeat(ends, sizes)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + window <= stop)
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = at[starts]
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(starts)]]) - 1
    return at[first].astype(np.int64), starts[first], starts[last], hashes[at[first]]


def blocks(sizes: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (text, from, to) of about ``BLOCK_UNITS`` in all; long texts overlap by a window."""
    pieces, total = [], 0
    for text, size in enumerate(sizes.tolist()):
        at = 0
        while True:
            stop = min(size, at + BLOCK_UNITS)
            pieces.append((text, at, stop))
            total += stop - at
            if total >= BLOCK_UNITS:
                yield pieces
                pieces, total = [], 0
            if stop == size:
                break
            at = stop - window + 1
    if pieces:
        yield pieces


@dataclass
class Units:
    """Units of texts laid end to end, and the bytes they stand for.

    ``begins``: where each text begins, with the end of the last one. Unit k is the bytes
    from ``first[k]`` to ``last[k]`` of ``data``; single bytes need no such arrays.
    """

    values: np.ndarray
    begins: np.ndarray
    data: bytes
    first: np.ndarray | None = None
    last: np.ndarray | None = None

    def digests(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Digest of the bytes of each run of units."""
        stop = begin + size
        if self.first is not None:
            begin, stop = self.first[begin], self.last[stop - 1]
        digest, data = xxhash.xxh3_64_intdigest, self.data
        return np.array([digest(data[a:b]) for a, b in zip(begin.tolist(), stop.tolist())], np.uint64)


def byte_units(texts: list[bytes]) -> Units:
    """All bytes of the texts."""
    data = b"".join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return Units(np.frombuffer(data, np.uint8), begins, data)


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``LOT_BYTES`` at a time."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + LOT_BYTES)
        stop = space.start() if space else len(text)
        yield text[at:stop].split()  # at 0x20 and 0x09 to 0x0D
        at = stop


def word_units(texts: list[bytes]) -> Units:
    """A 64-bit digest per word of all texts; the bytes are the words joined by one space."""
    counts, hashes, sizes, joined = [0], [], [], []
    for text in texts:
        count = 0
        for words in pieces_of(text):
            if not words:
                continue
            n = len(words)
            count += n
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n))
            sizes.append(np.fromiter(map(len, words), np.int64, n))
            joined.append(b" ".join(words))
        counts.append(count)
    begins = np.cumsum(counts, dtype=np.int64)
    if not joined:
        none = np.zeros(0, np.int64)
        return Units(none.astype(np.uint64), begins, b"", none, none)
    size = np.concatenate(sizes)
    last = np.cumsum(size + 1) - 1
    return Units(np.concatenate(hashes), begins, b" ".join(joined), last - size, last)


def text_lots(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (NULL: empty) in lots of about ``LOT_BYTES``, with the place of the first."""
    held, size, at = [], 0, 0
    for k, text in enumerate(column.cast(pa.large_binary())):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= LOT_BYTES:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def _emit(units_of: Callable[[list[bytes]], Units], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            for row, texts in text_lots(batch.column(2)):
                units = units_of(texts)
                begins = units.begins
                for pieces in blocks(np.diff(begins), window):
                    part = np.concatenate([units.values[begins[t] + a : begins[t] + b] for t, a, b in pieces])
                    ends = np.cumsum([b - a for _, a, b in pieces])
                    at, low, high, fp = owned(part, ends, window, gram)
                    if not len(at):
                        continue
                    of = np.searchsorted(ends, low, "right")
                    text = np.array([t for t, _, _ in pieces])[of]
                    shift = (np.array([a for _, a, _ in pieces]) - np.concatenate([[0], ends[:-1]]))[of]
                    fd = units.digests(begins[text] + low + shift, high - low + window)
                    # Where the anchor stands in its fragment is part of the fragment's identity.
                    fd = mixed(fd ^ (at - low).astype(np.uint64))
                    place = ((at + shift) * STEP + (at - low)) * STEP + (at - high)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[row + text], pa.int64(), from_pandas=True),
                            pa.array(key[row + text]),
                            pa.array(fp.view(np.int64)),
                            pa.array(fd.view(np.int64)),
                            pa.array(place),
                        ],
                        names=["doc_id", "key", "fp", "fd", "place"],
                    )

    return run


def unpack(place):
    """(first start, last start, anchor) of a packed place, for numbers and arrays.

    A start is at most as far right as its anchor, so both distances are counted back.
    """
    at = place >> 16
    return at - (place >> 8 & STEP - 1), at - (place & STEP - 1), at


def start_range() -> tuple[Column, Column]:
    """First and last window start, from the column ``place``."""
    place, low_bits = F.col("place"), F.lit(STEP - 1)
    at = F.shiftright(place, 16)
    return (
        (at - F.shiftright(place, 8).bitwiseAND(low_bits)).alias("low"),
        (at - place.bitwiseAND(low_bits)).alias("high"),
    )


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text (no NULL) and digests of it, for any docs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole.alias("text"),
        F.xxhash64(whole).alias("key"),
        F.hash(whole).alias("key2"),
        F.octet_length(whole).alias("size"),
    )


SAME_TEXT = ["key", "key2", "size"]


def copies(rows: DataFrame) -> DataFrame:
    """Texts that occur more than once: number of rows, smallest id."""
    groups = rows.groupBy(*SAME_TEXT).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("owner"))
    return materialize(groups.where("copies > 1"), "copies")


def with_copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return looked_up(rows, groups, SAME_TEXT, weight="copies")


def fragments(rows: DataFrame, groups: DataFrame, units_of: Callable, window: int, gram: int) -> DataFrame:
    """Fragments, of one row of each group of equal texts, whose gram occurs more than once."""
    first = with_copies(rows, groups).where(
        F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("owner"))
    )
    made = first.select("doc_id", "key", "text").mapInArrow(_emit(units_of, window, gram), ROWS)
    made = materialize(made, "anchors")
    often = made.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = materialize(often, "often")
    shared = balanced(made, often, ["fp"], "n", "left_semi")
    return materialize(shared.select("doc_id", "key", "fp", "fd", "place"), "shared")


def on_text(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Rows joined with a table by document and digest; ids may be NULL."""
    return looked_up(rows, other, ["doc_id", "key"], how)


def lots(frames: Iterator[pd.DataFrame], lot_bytes: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``fp`` in lots of about ``lot_bytes`` of ``part``; no ``fp`` is parted."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += int(frame["part"].str.len().sum())
        while size >= lot_bytes:
            rows = pd.concat(held, ignore_index=True)
            total = rows["part"].str.len().cumsum().to_numpy()
            fp = rows["fp"].to_numpy()
            ends = np.flatnonzero(fp[1:] != fp[:-1]) + 1
            fit = ends[total[ends - 1] <= lot_bytes]
            cut = int(fit[-1]) if len(fit) else int(ends[0]) if len(ends) else 0
            held = [rows.iloc[cut:]]
            if not cut:
                break
            yield rows.iloc[:cut]
            size = int(total[-1] - total[cut - 1])
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)
