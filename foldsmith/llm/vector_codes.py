"""Vector code compression: product codes with equal-average nearest-entry search.

Components become integers ``floor(SCALE * x)``, vectors are cut into ``PARTS`` equal parts
and each part is replaced by the index of its nearest entry in the codebook of its place.
Codebooks start as the parts of the vectors with the smallest ids and are improved by
``ROUNDS`` rounds: assign every part, then move each entry to the floor of its parts' mean.

The search sorts entries by their component sum. For a part with sum s, an entry with sum t
is at least ``(s - t)**2 / dimension`` away, so entries are visited outward from s until that
bound is strictly beyond the best distance; at equality an entry may still tie, and ties go
to the lower index. Parts are sorted by sum and taken in groups that walk together, a few
entries at a time; a part leaves a side as soon as its own bound says so.

Arithmetic is exact: whole numbers in doubles where no intermediate can reach 2**53, else
Python integers. A round is one job: a task sums up all its rows by entry, so at most
entries x parts rows a task are shuffled, and the codebooks (parts x entries x dimension
numbers, whatever the table's size) are what the driver holds between rounds.

Defined results: rows whose vector is NULL or holds NULL, NaN or infinite components are left
out; vectors shorter than the longest, or whose length no number of parts divides, count as
filled up with zeros; with fewer vectors than entries the codebook is smaller; repeated ids
are rows like others (ordered by vector for the start); NULL ids come last; components are
below 10**25, beyond which summing raises an error; an error over 2**63 - 1 is given as that
number. An empty table gives an empty result. Columns besides id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.llm.registry import query, table
from foldsmith.session import broadcast_if_small, materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256  # two hex digits
ROUNDS = 4
GROUP = 512  # parts that walk outward together
STRIDE = 24  # entries visited at a time on a side
BLOCK = 1 << 20  # components worked on at a time
EXACT = 1 << 53
LONGEST = (1 << 63) - 1
LABEL_BYTES = 64

Books = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole(x: float) -> int:
    """floor(SCALE * x) without overflow."""
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE)


def integers(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers: doubles where they are small, else Python integers."""
    values = values.astype(np.float64)
    if values.size and np.abs(values).max() >= EXACT / SCALE:
        return np.frompyfunc(whole, 1, 1)(values)
    return np.floor(values * SCALE)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles if squared distances between them stay exact, else as integers."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    width = max(a.shape[1] for a in arrays)
    if 4 * max(width, 1) ** 2 * most * most < EXACT:
        return [a.astype(np.float64) for a in arrays]
    return [np.frompyfunc(int, 1, 1)(a) if a.size else a.astype(object) for a in arrays]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each part's nearest entry, its squared distance, and how many were looked at."""
    parts, book = exact(parts, book)
    n, width = parts.shape
    sums, centre = parts.sum(axis=1), book.sum(axis=1)
    by_sum = np.argsort(centre, kind="stable")
    centre = centre[by_sum]
    own, norm = (parts * parts).sum(axis=1), (book * book).sum(axis=1)
    index, error = np.full(n, len(book)), np.full(n, np.inf, parts.dtype)
    looked = 0

    def look(rows: np.ndarray, entries: np.ndarray) -> None:
        nonlocal looked
        entries = np.sort(entries)  # the first minimum is the lowest index
        far = own[rows, None] + norm[entries] - 2 * (parts[rows] @ book[entries].T)
        looked += far.size
        at = far.argmin(axis=1)
        near, found = far[np.arange(len(rows)), at], entries[at]
        better = (near < error[rows]) | ((near == error[rows]) & (found < index[rows]))
        error[rows[better]], index[rows[better]] = near[better], found[better]

    order = np.argsort(sums, kind="stable")
    for begin in range(0, n, GROUP):
        group = order[begin : begin + GROUP]
        right = int(np.searchsorted(centre, sums[group[len(group) // 2]]))
        left = right
        up, down = group, group  # parts that still look to the right, to the left
        while (len(up) and right < len(book)) or (len(down) and left > 0):
            if len(up) and right < len(book):
                gap = np.maximum(centre[right] - sums[up], 0)
                up = up[gap * gap <= width * error[up]]
                if len(up):
                    look(up, by_sum[right : right + STRIDE])
                    right += STRIDE
            if len(down) and left > 0:
                gap = np.maximum(sums[down] - centre[left - 1], 0)
                down = down[gap * gap <= width * error[down]]
                if len(down):
                    look(down, by_sum[max(0, left - STRIDE) : left])
                    left -= STRIDE
    return index, error, looked


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of ``width`` columns, short rows filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield some, integers(matrix(some.column("vector"), width))


def cut(vectors: np.ndarray, parts: int) -> Books:
    return np.split(vectors, parts, axis=1)


SUMS = "part int, entry int, n long, total array<decimal(38,0)>"


def _sums(books: Books, width: int) -> Callable:
    """Per task the number and the sum of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for _, vectors in blocks(batches, width):
            for p, some in enumerate(cut(vectors, len(books))):
                index, _, _ = nearest(some, books[p])
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                (some,) = exact(some)  # sums of a block stay exact with its squares
                counts[p][used] += n
                added = np.add.reduceat(some[order], first, axis=0)
                totals[p][used] += np.frompyfunc(int, 1, 1)(added) if added.size else added.astype(object)
        rows = [
            (p, int(e), int(counts[p][e]), [Decimal(v) for v in totals[p][e]])
            for p in range(len(books))
            for e in np.flatnonzero(counts[p])
        ]
        if rows:
            part, entry, n, total = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    pa.array(entry, pa.int32()),
                    pa.array(n, pa.int64()),
                    pa.array(total, pa.list_(pa.decimal128(38, 0))),
                ],
                names=["part", "entry", "n", "total"],
            )

    return run


def _codes(books: Books, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, vectors in blocks(batches, width):
            found = [nearest(part, book) for part, book in zip(cut(vectors, len(books)), books)]
            digits = np.stack([index for index, _, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            error = sum(e.astype(object) for _, e, _ in found)
            rest = [i for i, name in enumerate(some.schema.names) if name != "vector"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[some.column(i) for i in rest],
                    pa.array([digits[k : k + step] for k in range(0, len(digits), step)], pa.string()),
                    pa.array([min(int(e), LONGEST) for e in error], pa.int64()),
                ],
                names=[*[some.schema.names[i] for i in rest], "code", "error"],
            )

    return run


def kept(vectors: DataFrame, vec_id: str, vector: str, *more: str) -> DataFrame:
    """The rows that are coded, as columns vec_id, vector and ``more``."""
    return vectors.where(usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        *[F.col(f"`{c}`") for c in more],
        F.col(f"`{vector}`").alias("vector"),
    )


def train(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[Books, int]:
    """Codebooks fitted on all rows of ``kept``, and the width of a vector with its filling."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries: an index is written as two hex digits")
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return [], 0
    width = max(1, -(-longest // parts)) * parts
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.select("vec_id", "vector").orderBy(*order).limit(entries).collect()
    start = np.zeros((len(first), width))
    for k, row in enumerate(first):
        start[k, : len(row["vector"])] = row["vector"]
    books = cut(integers(start), parts)
    for _ in range(rounds):
        size = width // parts
        moved = (
            rows.select("vector")
            .mapInArrow(_sums(books, width), SUMS)
            .groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(size)]).alias("total"))
        )
        books = [book.astype(object) for book in books]
        for row in moved.collect():  # at most parts x entries rows
            books[row["part"]][row["entry"]] = [int(t) // row["n"] for t in row["total"]]
    return books, width


def encode(rows: DataFrame, books: Books, width: int) -> DataFrame:
    """Rows of ``kept`` with their ``code`` and ``error`` in place of the vector."""
    fields = [f for f in rows.schema.fields if f.name != "vector"]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_codes(books, width), schema)


def digest(books: Books) -> str:
    """Of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


SQL_ROUND = """
a{k} AS MATERIALIZED (SELECT vec_id, part, min({{'d': q - 2 * list_dot_product(p.x, c.x) + r, 'e': entry}}) AS m
  FROM p JOIN c{k} c USING (part) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (
  SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (
    SELECT part, m.e AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k} JOIN p USING (vec_id, part))
  GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS r FROM (
  SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))),"""

SQL = (
    f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS q FROM (
  SELECT vec_id, g AS part, x[g * len(x) // {PARTS} + 1 : (g + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(g))),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x, q AS r FROM p JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM v) USING (vec_id) WHERE n <= {ENTRIES}),"""
    + "".join(SQL_ROUND.format(k=k, n=k + 1) for k in range(ROUNDS))
    + f"""
f AS (SELECT vec_id, part, min({{'d': q - 2 * list_dot_product(p.x, c.x) + r, 'e': entry}}) AS m
  FROM p JOIN c{ROUNDS} c USING (part) GROUP BY ALL),
e AS (SELECT vec_id, string_agg(printf('%02x', m.e::INT), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM e JOIN v USING (vec_id), h"""
)


@query("op11_vector_codes", SQL)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the digest of the codebooks."""
    rows = kept(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    books, width = train(rows)
    coded = materialize(encode(rows, books, width), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = coded.groupBy(F.col("label").alias("same")).agg(
        F.least(total, F.lit(Decimal(LONGEST))).cast("long").alias("label_error")
    )
    labels = materialize(labels, "labels")
    labels = broadcast_if_small(labels, labels.count() * LABEL_BYTES)
    return coded.join(labels, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
