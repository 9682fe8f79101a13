"""Importance resampling towards a target text, with n-gram hashes from prefix CRCs.

A document is a bag of its runs of 1 to ``RUN`` words; each run falls into the bucket of its
CRC-32. Words are lower-cased (A-Z) and joined by one space, and each document is scanned
once, keeping the running CRC at the begin and end of every word. The CRC of any run follows
from two of these prefixes: ``crc(B) = crc(AB) ^ shift(crc(A), bytes of B)``, where shifting
by n zero bytes is linear over GF(2) and done by powers of two.

Bucket counts over all documents and over the target give each bucket a gain, the logarithm
of its smoothed ratio; a document's weight is the sum over its runs, and Gumbel noise from
its id turns the highest scores into a draw without replacement in proportion to the weights.

The scan is written once (two bytes a run); counting adds up a task's buckets before the
shuffle, and what the driver holds is two numbers a bucket. Ranks come from range partitions.

Defined results: NULL text has no words; a NULL id draws noise as the text ``null`` and loses
ties; repeated rows are drawn as rows, ties between them are broken by weight and size;
an empty table gives an empty result, an empty target gives every bucket its smoothed share.
Long texts are scanned in pieces. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.operators.ranking import RANGE_ROWS, value_rank
from foldsmith.session import materialize

RUN = 1  # words of the longest run
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
PIECE = 1 << 20  # bytes of a text scanned at a time

# Every separator becomes a space, A-Z become a-z; bytes above 0x7F belong to words.
PLAIN = bytes(
    b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32


def applied(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear operator on CRCs, given as a table for each of their four bytes."""
    out = operator[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ operator[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


def shifts() -> list[np.ndarray]:
    """Operators that append 2**k zero bytes, k from 0 to 31."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & np.uint32(1), one >> np.uint32(1) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    byte = np.arange(256, dtype=np.uint32)
    # The lowest byte leaves through the table, the others move down by one.
    found = [np.stack([one, byte, byte << np.uint32(8), byte << np.uint32(16)])]
    for _ in range(31):
        found.append(np.stack([applied(found[-1], part) for part in found[-1]]))
    return found


SHIFTS = shifts()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as ``size`` says."""
    crc, bit = crc.copy(), 0
    while len(size) and int(size.max()) >> bit:
        at = np.flatnonzero(size >> bit & 1)
        crc[at] = applied(SHIFTS[bit], crc[at])
        bit += 1
    return crc


def prefixes(text: bytes, tail: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Running CRCs of the normalised text, piece by piece.

    Gives the number of words taken over from the piece before (``tail`` at most), and for
    these and the new words: CRC before and after the word, and its begin and end.
    """
    plain = text.translate(PLAIN)
    size = len(plain)
    at, crc, place = 0, 0, 0
    held = [np.zeros(0, t) for t in (np.uint32, np.uint32, np.int64, np.int64)]
    while at < size:
        stop = plain.find(b" ", at + PIECE)
        stop = size if stop < 0 else stop
        words = plain[at:stop].split()
        at = stop
        if not words:
            continue
        # A space stands before every word, the first one too: all prefixes end in one.
        after = np.fromiter(
            accumulate(map(b" ".__add__, words), lambda c, w: crc32(w, c), initial=crc), np.uint32, len(words) + 1
        )
        ends = place + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate([[place], ends[:-1]]) + 1
        before = ~after[:-1]
        before = ~applied(SHIFTS[0], before ^ np.uint32(0x20))
        crc, place = int(after[-1]), int(ends[-1])
        new = [before, after[1:], begins, ends]
        old = len(held[0])
        held = [np.concatenate(pair) for pair in zip(held, new)]
        yield old, *held
        keep = max(0, len(held[0]) - tail)
        held = [h[keep:] for h in held]


def buckets(text: bytes, run: int = RUN, count: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``run`` words."""
    words, found = 0, []
    for old, before, after, begins, ends in prefixes(text, run - 1):
        words += len(before) - old
        for n in range(1, run + 1):
            # Runs that end in a new word.
            last = np.arange(max(old, n - 1), len(before))
            first = last - n + 1
            crc = after[last] ^ shifted(before[first], ends[last] - begins[first])
            found.append(crc % np.uint32(count))
    return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


def _scan(run: int, count: int) -> Callable:
    kind = np.min_scalar_type(count - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = [buckets(t.as_py() or b"", run, count) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([w for w, _ in made], pa.int64()),
                    pa.array([len(b) for _, b in made], pa.int64()),
                    pa.array([b.astype(kind).tobytes() for _, b in made], pa.binary()),
                ],
                names=["doc_id", "n_words", "n_features", "buckets"],
            )

    return scan


def scanned(docs: DataFrame, doc_id: str, text: str, run: int = RUN, count: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of each row, written."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = rows.mapInArrow(_scan(run, count), "doc_id long, n_words long, n_features long, buckets binary")
    return materialize(made, "buckets")


def bucket_counts(features: DataFrame, count: int = BUCKETS) -> np.ndarray:
    """Runs per bucket over all rows."""
    kind = np.min_scalar_type(count - 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = features.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(count, np.int64)
    for bucket, n in rows.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of the smoothed share in the target over that in the source."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b))))
            for x, y in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of its runs."""
    kind = np.min_scalar_type(len(gain) - 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(p.as_py(), kind)].sum()) for p in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return features.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        add, "doc_id long, n_words long, n_features long, weight long"
    )


def noise(doc_id: str, seed: int = SEED) -> Column:
    """floor(1000 g), g a Gumbel draw from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    run: int = RUN,
    count: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank.

    ``percent`` of the documents with ``min_words`` words are drawn; the others' rank is NULL.
    ``target`` holds the texts to be like, in a column ``text``.
    """
    features = scanned(docs, doc_id, text, run, count)
    wanted = scanned(target.select(F.lit(0).alias("item"), "text"), "item", "text", run, count)
    gain = gains(bucket_counts(features, count), bucket_counts(wanted, count))
    scored = weighted(features, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = materialize(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    # Highest score first, then the smaller id.
    order = F.struct(-F.col("score"), F.col("doc_id").isNull(), "doc_id", -F.col("weight"))
    ranges = max(1, math.ceil(n / RANGE_ROWS))
    ranked = value_rank(able.withColumn("order", order), "order", "n_features", "place", ranges).drop("order")
    drawn = F.when(F.col("place") <= n * percent // 100, F.col("place"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn.cast("long")).drop("place").unionByName(rest)


SQL = f"""
WITH RECURSIVE tab(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END FROM tab WHERE k < 8),
crctab AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
vocab AS (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)),
bytes AS (SELECT x, list_transform(range(0, octet_length(encode(x))),
  lambda k: CAST(('0x' || substr(hex(encode(x)), 2 * k + 1, 2)) AS BIGINT)) AS y FROM vocab),
crc AS (SELECT x, xor(list_reduce(y, lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295)
  % {BUCKETS} AS bucket FROM bytes, crctab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (x) GROUP BY 1),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS}))))
  AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN crc USING (x) JOIN gain USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
sc AS (SELECT doc_id, n_features, weight,
  weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM sc WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)"""


@query("op12_importance", SQL)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
