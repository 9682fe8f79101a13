"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids in input order. A window of ``WINDOW`` sequences takes
from every queue its share; what a share has in fractions of a token is the queue's deficit
and is carried to the next window. With whole-number arithmetic the carried sums have a
closed form: after k of K windows a queue of N tokens has given ``floor(k * N / K)``. So each
document knows from its place in its queue which windows and sequences its ids fall into,
in any partition, and nothing has to run one window after another.

Targets are the tokens of the sources themselves, so that all queues end together, or given
weights; then a queue that runs dry ends a phase, and the others go on by their weights.
Sources without a target that would get fewer than ``MIN_QUANTUM`` tokens of a window share
one last queue, so the number of queues is bounded by window, quantum and targets, whatever
the number of sources. In that queue whole documents are ordered by their fractional place
in their own source: tokens before them, and of the document itself a part drawn from the
source's digest (else all first documents would come together), by tokens of the source. So
every stretch of the queue holds its sources by their sizes, to within a document each. The
order is exact: documents are dealt to ranges of places, and ranges are summed up.

Documents are cut freely. Sequences follow each other without a gap; only the last one may
be shorter than ``SEQUENCE``.

Defined results: NULL or empty text is the end id alone; a NULL source is a source of its
own; repeated rows are packed each; an empty table gives no piece. Extra columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.session import broadcast_if_small, materialize, small_batches

SEQUENCE = 2048
WINDOW = 64  # sequences
MIN_QUANTUM = 64  # tokens of a window
END_ID = 1
WORDS = 120_000  # of a generation of the cache
TEXTS = 512  # looked up together
SLICE = 128  # rows of token ids cut at a time
BASE_ROW_BYTES = 100

TOKENS = "doc_id long, source string, part int, before long, n long, ids binary"
PIECES_ROW = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, source string"
)
# Fixed values of the tokenizer: the mark of a piece's last token, and the letters and
# numbers below U+0250. Texts with other characters, with U+0130, with control characters
# that are white space to some only, or with the start of a special token are not cut here,
# and neither are those with a capital whose lower case is above U+024F.
WORD_END = "</w>"
_RISING = {c for c in map(chr, range(0x250)) if max(c.lower()) > "\u024f"}
_CUT = "".join(c for c in map(chr, range(0x250)) if c not in {*"\x1c\x1d\x1e\x1f\x85\xa0\u0130", *_RISING})
_OTHER = re.compile(f"[^{re.escape(_CUT)}]|<\\|")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
# Whole runs of signs without an apostrophe, which may belong to letters, in or beside them.
_SIGN = f"[^{_LETTERS}{_NUMBERS}\\s"
_SIGNS, _APART = re.compile(f"(?<!{_SIGN}]){_SIGN}']++(?!')"), r" \g<0> "
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class Recent:
    """Values made for keys, of which those not asked for lately are forgotten.

    There are two generations; a full one becomes the old one, and what is asked for again
    moves to the new one.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, keys: set[str]) -> set[str]:
        """The keys without a value; those of the others are in ``now`` then."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        missing = keys.difference(self.now)
        known = missing.intersection(self.old)
        self.now.update((k, self.old[k]) for k in known)
        return missing - known


class WordTokenizer:
    """Ids of texts as little-endian 32-bit numbers, words looked up in bounded caches.

    The tokenizer lower-cases, drops white space, and cuts what is left into runs of letters,
    single digits and runs of other signs; a text's ids are those of its pieces in a row. For
    letters below U+0250, where no sign composes and lower case is one to one, words are
    lower-cased and parted from the signs around them here, so that they share an entry.
    Other texts go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words = Recent(WORDS)
        # The parts of a word of letters, without the way there that such a word passes unchanged.
        self.parts = self.model.model.tokenize
        self.bytes = [i.to_bytes(4, "little") for i in range(len(self.last))]

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Words of the letters a to z are one piece and their own bytes, so they
        go to the model itself; of the others many go to the tokenizer in one call, as the last
        id of each of their pieces is known."""
        parts, number, rest = self.parts, self.bytes, []
        for word in words:
            if word.isascii() and word.isalpha():
                self.words.now[word] = b"".join([number[t.id] for t in parts(word)])
            else:
                rest.append(word)
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            pieces = [1 if w.isalpha() else len(_PIECE.findall(w)) for w in some]
            made = self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(made[0].ids, "<u4")
            ends, last = np.flatnonzero(self.last[ids]) + 1, np.cumsum(pieces)
            if len(ends) == last[-1]:
                data, begin = ids.tobytes(), 0
                for word, end in zip(some, (4 * ends[last - 1]).tolist()):
                    self.words.now[word] = data[begin:end]
                    begin = end
            else:
                self.words.now.update((w, self._whole(w)) for w in some)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [None if _OTHER.search(t) else _SIGNS.sub(_APART, t.lower()).split() for t in texts]
        self._learn(list(self.words.unknown(set().union(*(p for p in plain if p)))))
        get = self.words.now.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, plain)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        part = TaskContext.get().partitionId()
        before: dict = {}
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                doc, source, text = batch.slice(at, TEXTS).columns
                ids = [i + end for i in model.encode(text.fill_null("").to_pylist())]
                sizes, earlier = [len(i) // 4 for i in ids], []
                for name, n in zip(source.to_pylist(), sizes):
                    earlier.append(before.get(name, 0))
                    before[name] = earlier[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        source,
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(earlier, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each document, and how many of its source came before it in its partition.

    The table is written, so partition numbers and sums are those of the tasks that committed.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source"), F.col("text"))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(_tokenize(path), TOKENS), "tokens")


@dataclass(frozen=True)
class Plan:
    """What each queue gives in each phase: tokens[phase, queue], windows[phase]."""

    tokens: np.ndarray
    windows: np.ndarray

    @property
    def given(self) -> np.ndarray:
        """Tokens of each queue before each phase."""
        return np.concatenate([np.zeros((1, self.tokens.shape[1]), np.int64), np.cumsum(self.tokens, 0)])

    def spans(self, queue: int, at: int, n: int) -> list[tuple[int, int, int]]:
        """Where tokens [at, at + n) of a queue go: (offset from at, length, place in all)."""
        given = self.given[:, queue]
        starts = np.concatenate([[0], np.cumsum(self.tokens.sum(1))])
        found, done = [], 0
        while done < n:
            x = at + done
            phase = int(np.searchsorted(given, x, "right")) - 1
            share, k_all = self.tokens[phase], int(self.windows[phase])
            size, y = int(share[queue]), x - int(given[phase])
            k = -((-(y + 1) * k_all) // size) - 1
            first = k * share // k_all if _fits(k, share) else _exact(k, share, k_all)
            then = (k + 1) * share // k_all if _fits(k + 1, share) else _exact(k + 1, share, k_all)
            length = min(int(then[queue]) - y, n - done)
            place = int(starts[phase]) + int(first.sum()) + int((then - first)[:queue].sum()) + y - int(first[queue])
            found.append((done, length, place))
            done += length
        return found


def _fits(k: int, share: np.ndarray) -> bool:
    return k * int(share.max()) < 2**62


def _exact(k: int, share: np.ndarray, k_all: int) -> np.ndarray:
    return np.array([k * int(s) // k_all for s in share], np.int64)


def make_plan(totals: list[int], weights: list[float] | None, window: int) -> Plan:
    """Phases of the round-robin; each ends where at least one queue runs dry."""
    left = [int(t) for t in totals]
    tokens, windows = [], []
    while any(left):
        if weights is None:
            given = list(left)
        else:
            active = [i for i, t in enumerate(left) if t and weights[i] > 0]
            if not active:  # what has no target comes last, by its size
                given = list(left)
            else:
                rounds = min(left[i] / weights[i] for i in active)
                dry = {i for i in active if left[i] / weights[i] <= rounds}
                given = [
                    left[i] if i in dry else min(left[i], int(rounds * weights[i])) if i in active else 0
                    for i in range(len(left))
                ]
        tokens.append(given)
        windows.append(max(1, round(sum(given) / window)))
        left = [a - b for a, b in zip(left, given)]
    shape = (len(tokens), len(totals))
    return Plan(np.array(tokens, np.int64).reshape(shape), np.array(windows, np.int64))


def _cut(plan: Plan, sequence: int):
    columns = [c.strip().split()[0] for c in PIECES_ROW.split(",")]
    types = [pa.int64()] * 7 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer.cache_clear()  # a reused worker needs its words no longer
        for batch in batches:
            for first in range(0, len(batch), SLICE):
                out = []
                rows = zip(*(c.to_pylist() for c in batch.slice(first, SLICE).columns))
                for doc, source, n, ids, queue, at in rows:
                    view = memoryview(ids)
                    for start, length, place in plan.spans(queue, at, n):
                        while length:
                            offset = place % sequence
                            size = min(length, sequence - offset)
                            crc = zlib.crc32(view[4 * start : 4 * (start + size)])
                            out.append((doc, start, size, crc, n, place // sequence, offset, source))
                            start, length, place = start + size, length - size, place + size
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns
                    )

    return run


def _in_tail(rows: DataFrame, tail: int, window: int) -> DataFrame:
    """``at`` of each document of the shared queue, in order of places in their sources."""
    ranges = max(1, tail // window)
    drawn = F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))), F.lit(2**31)) / F.lit(2.0**31)
    place = (F.col("base") + F.col("before") + drawn * F.col("n")) / F.col("total")
    rows = rows.withColumn("_place", place)
    rows = rows.withColumn("_range", F.least(F.floor(F.col("_place") * ranges), F.lit(ranges - 1)))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per window of the queue at most.
    starts = rows.groupBy("_range").agg(F.sum("n").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier.orderBy("_range")), F.lit(0)).alias("_start")
    )
    starts = materialize(starts, "ranges")
    within = earlier.partitionBy("_range").orderBy("_place", "source", "base", "before")
    rows = rows.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return rows.join(starts, "_range").withColumn("at", F.col("_start") + F.col("_within"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: document, place in it, digest of its ids, sequence and offset."""
    tokens = tokenized(docs, tokenizer_path)
    sums = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    # At most window * sequence / MIN_QUANTUM sources can reach the quantum.
    floor = MIN_QUANTUM * total / (window * sequence)
    wanted = [name for name, weight in (targets or {}).items() if weight > 0]
    named = F.col("source").isin([x for x in wanted if x is not None])
    named = F.coalesce(named, F.lit(None in wanted))
    own = sources.where((F.col("n") >= floor) | named).orderBy("source").collect()
    names = [r["source"] for r in own]
    sizes = [r["n"] for r in own]
    tail = total - sum(sizes)
    weights = None
    if targets is not None:
        weights = [float(targets.get(name, 0.0)) for name in names] + [0.0]
    plan = make_plan([*sizes, tail], weights, window * sequence)
    numbered = docs.sparkSession.createDataFrame(
        [(name, k) for k, name in enumerate(names)], "source string, queue int"
    )
    # Where a partition's ids of a source begin among those of the source.
    whole = Window.partitionBy("_source")
    running = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.alias("s").join(
        F.broadcast(numbered).alias("q"), F.col("s.source").eqNullSafe(F.col("q.source")), "left"
    ).select("part", F.col("s.source").alias("_source"), "n", F.coalesce("queue", F.lit(len(names))).alias("queue"))
    base = base.select(
        "part", "_source", "queue",
        F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"),
    )
    base = materialize(base, "bases").withColumnRenamed("part", "_part")
    base = broadcast_if_small(base, base.count() * BASE_ROW_BYTES)
    same = [F.col("part") == F.col("_part"), F.col("source").eqNullSafe(F.col("_source"))]
    rows = tokens.join(base, same)
    own_rows = rows.where(F.col("queue") < len(names)).withColumn("at", F.col("base") + F.col("before"))
    columns = ["doc_id", "source", "n", "ids", "queue", "at"]
    if not tail:
        rows = own_rows.select(columns)
    else:
        in_tail = _in_tail(rows.where(F.col("queue") == len(names)), tail, window * sequence)
        rows = own_rows.select(columns).union(in_tail.select(columns))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(_cut(plan, sequence), PIECES_ROW), "pieces")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; the mixture is that of the table, every source by its tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, default_tokenizer()).drop("source")
