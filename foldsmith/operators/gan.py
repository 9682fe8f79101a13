"""Synthetic rows of a generative adversarial network per group, trained on the executors.

Generator and discriminator are small: one layer of 128 with batch norm and one of 256 against
one of 256 and one of 128 with dropout, binary cross-entropy and Adam at 0.0002. A row is its
standardised numbers and the indicators of its categories, the label among them; the indicators
are the condition that the generator is given beside its noise.

A group of up to ``SHARD_ROWS`` rows is trained by one task, epoch after epoch. A larger one is
dealt into shards: in every epoch each shard goes on from the common weights, and their mean by
rows is the next common weights. Tasks hold one shard at a time and pass on one set of weights a
group, so neither a task nor the driver grows with the rows. Every draw follows from the seed,
the group, the shard and the epoch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.clean import impute_synth_prep
from foldsmith.operators.encode import one_hot_decode, one_hot_encode, vocabulary
from foldsmith.operators.synth import synth_decode, synth_prepare
from foldsmith.session import materialize
from foldsmith.spec import TableSpec

SHARD_ROWS = 20_000

# Rows that are generated at a time.
CHUNK = 20_000

NOISE = 100
RATE, BETAS, TINY = 2e-4, (0.9, 0.999), 1e-8
LEAK, DROP, MOMENTUM, NORM = 0.2, 0.3, 0.1, 1e-5


class Networks:
    """Both networks over one flat vector: parameters, running statistics, Adam's moments and
    the number of steps, so that vectors of several shards can be averaged."""

    def __init__(self, width: int, conditions: int, noise: int = NOISE):
        self.width, self.conditions, self.noise = width, conditions, noise
        self.generator = [
            ("w1", (noise + conditions, 128)), ("b1", (128,)), ("scale", (128,)), ("shift", (128,)),
            ("w2", (128, 256)), ("b2", (256,)), ("w3", (256, width)), ("b3", (width,)),
        ]
        self.discriminator = [
            ("v1", (width, 256)), ("c1", (256,)), ("v2", (256, 128)), ("c2", (128,)),
            ("v3", (128, 1)), ("c3", (1,)),
        ]
        self.n_generator = sum(math.prod(s) for _, s in self.generator)
        self.n = self.n_generator + sum(math.prod(s) for _, s in self.discriminator)
        self.size = 3 * self.n + 2 * 128 + 1

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The named parts of a vector that begins with the parameters."""
        out, at = {}, 0
        for name, shape in (*self.generator, *self.discriminator):
            end = at + math.prod(shape)
            out[name] = flat[at:end].reshape(shape)
            at = end
        return out

    def running(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running mean and variance of the batch norm."""
        at = 3 * self.n
        return state[at : at + 128], state[at + 128 : at + 256]

    def start(self, rng: np.random.Generator, dtype=np.float32) -> np.ndarray:
        """Weights and biases within one over the root of a layer's inputs."""
        state = np.zeros(self.size, dtype)
        parts = self.views(state)
        for weight, bias in (("w1", "b1"), ("w2", "b2"), ("w3", "b3"), ("v1", "c1"), ("v2", "c2"), ("v3", "c3")):
            reach = 1 / math.sqrt(parts[weight].shape[0])
            for name in (weight, bias):
                parts[name][...] = rng.uniform(-reach, reach, parts[name].shape)
        parts["scale"][...] = 1
        self.running(state)[1][...] = 1
        return state

    def generate(self, state: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Rows by the running statistics, each on its own."""
        p, (mean, var) = self.views(state), self.running(state)
        h = (z @ p["w1"] + p["b1"] - mean) / np.sqrt(var + NORM)
        a = np.maximum(h * p["scale"] + p["shift"], 0)
        return np.tanh(np.maximum(a @ p["w2"] + p["b2"], 0) @ p["w3"] + p["b3"])

    def forward(self, p: dict, z: np.ndarray, state: np.ndarray | None = None):
        """Rows by the batch's own statistics, and what the way back needs."""
        h = z @ p["w1"] + p["b1"]
        mean, var = h.mean(axis=0), h.var(axis=0)
        if state is not None:
            n, (kept_mean, kept_var) = len(h), self.running(state)
            kept_mean += MOMENTUM * (mean - kept_mean)
            kept_var += MOMENTUM * (var * n / max(n - 1, 1) - kept_var)
        sd = np.sqrt(var + NORM)
        unit = (h - mean) / sd
        a = np.maximum(unit * p["scale"] + p["shift"], 0)
        e = np.maximum(a @ p["w2"] + p["b2"], 0)
        out = np.tanh(e @ p["w3"] + p["b3"])
        return out, (z, sd, unit, a, e, out)

    def backward(self, p: dict, g: dict, held: tuple, slope: np.ndarray) -> None:
        """Gradients of the generator's parameters from those of its rows."""
        z, sd, unit, a, e, out = held
        slope = slope * (1 - out * out)
        np.matmul(e.T, slope, out=g["w3"])
        slope.sum(axis=0, out=g["b3"])
        slope = (slope @ p["w3"].T) * (e > 0)
        np.matmul(a.T, slope, out=g["w2"])
        slope.sum(axis=0, out=g["b2"])
        slope = (slope @ p["w2"].T) * (a > 0)
        (slope * unit).sum(axis=0, out=g["scale"])
        slope.sum(axis=0, out=g["shift"])
        slope = slope * p["scale"]
        slope = (slope - slope.mean(axis=0) - unit * (slope * unit).mean(axis=0)) / sd
        np.matmul(z.T, slope, out=g["w1"])
        slope.sum(axis=0, out=g["b1"])

    def judge(self, p: dict, x: np.ndarray, kept: np.ndarray):
        """How real the rows look; ``kept`` is the dropout's mask."""
        u = x @ p["v1"] + p["c1"]
        s = np.where(u > 0, u, LEAK * u) * kept
        t = s @ p["v2"] + p["c2"]
        r = np.where(t > 0, t, LEAK * t)
        real = 1 / (1 + np.exp(-np.clip(r @ p["v3"] + p["c3"], -60, 60)))
        return real, (x, kept, u, s, t, r)

    def judge_backward(self, p: dict, g: dict | None, held: tuple, slope: np.ndarray) -> np.ndarray:
        """Gradients of the discriminator's parameters into ``g``, and those of its rows."""
        x, kept, u, s, t, r = held
        down = (slope @ p["v3"].T) * np.where(t > 0, 1, LEAK).astype(t.dtype)
        below = (down @ p["v2"].T) * kept * np.where(u > 0, 1, LEAK).astype(u.dtype)
        if g is not None:
            np.matmul(r.T, slope, out=g["v3"])
            slope.sum(axis=0, out=g["c3"])
            np.matmul(s.T, down, out=g["v2"])
            down.sum(axis=0, out=g["c2"])
            np.matmul(x.T, below, out=g["v1"])
            below.sum(axis=0, out=g["c1"])
        return below @ p["v1"].T

    def step(self, state: np.ndarray, x: np.ndarray, rng: np.random.Generator, gradient: np.ndarray) -> None:
        """One batch of real rows: the discriminator learns from them and as many made ones, then
        the generator from what the discriminator makes of its rows. ``gradient`` is scratch."""
        n, dtype = len(x), state.dtype
        p, g = self.views(state), self.views(gradient)

        def kept(rows: int) -> np.ndarray:
            return (rng.random((rows, 256), dtype=dtype) >= DROP).astype(dtype) / dtype.type(1 - DROP)

        z = np.concatenate([rng.standard_normal((n, self.noise), dtype=dtype), x[:, self.width - self.conditions :]], axis=1)
        made, way = self.forward(p, z, state)
        state[-1] += 1
        real, held = self.judge(p, np.concatenate([x, made]), kept(2 * n))
        truth = np.repeat(np.array([1, 0], dtype), n)[:, None]
        self.judge_backward(p, g, held, (real - truth) / (2 * n))
        self._adam(state, gradient, slice(self.n_generator, self.n))
        real, held = self.judge(p, made, kept(n))
        self.backward(p, g, way, self.judge_backward(p, None, held, (real - 1) / n))
        self._adam(state, gradient, slice(0, self.n_generator))

    def _adam(self, state: np.ndarray, gradient: np.ndarray, part: slice) -> None:
        n, t = self.n, float(state[-1])
        g = gradient[part]
        first, second = state[n : 2 * n][part], state[2 * n : 3 * n][part]
        first += (1 - BETAS[0]) * (g - first)
        second += (1 - BETAS[1]) * (g * g - second)
        root = np.sqrt(second / (1 - BETAS[1] ** t)) + TINY
        state[part] -= (RATE / (1 - BETAS[0] ** t)) * first / root

    def train(self, state: np.ndarray, x: np.ndarray, epochs: range, batch: int, seed: tuple) -> None:
        """Pass over the rows in a new order every epoch."""
        gradient = np.zeros(self.n, state.dtype)
        for epoch in epochs:
            rng = np.random.default_rng([*seed, epoch])
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                self.step(state, x[order[at : at + batch]], rng, gradient)


def _number(key: tuple) -> int:
    """A number for a group, the same in every process."""
    return zlib.crc32(repr(tuple(str(k) for k in key)).encode())


class GanModel:
    """Trained networks of all groups, and what turns their output into rows."""

    def __init__(self, spec, by, types, vocab, stats, networks, states, shares, seed):
        self.spec, self.by, self.types, self.vocab, self.stats = spec, by, types, vocab, stats
        self.networks, self.states, self.shares, self.seed = networks, states, shares, seed

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        spec: TableSpec,
        by=("fold_id",),
        epochs: int = 100,
        batch_size: int = 128,
        seed: int = 42,
    ) -> GanModel:
        """``df`` holds the groups, the row id, features and a label that is never missing; other
        missing values are filled by :func:`impute_synth_prep`. Half a batch is real rows."""
        by, texts = list(by), [*spec.categorical, spec.target]
        columns = [*by, spec.row_id, *spec.features, spec.target]
        df = df.select(*columns)
        types = {f.name: f.dataType for f in df.schema.fields}
        vocab = vocabulary(df, texts)
        if spec.numeric:
            rows, stats = synth_prepare(df, spec.numeric, texts, vocab, by)
            stats = materialize(stats, "scaling")
        else:
            rows, stats = one_hot_encode(impute_synth_prep(df, [], texts, by), vocab), None
        flags = [f"{c}_{v}" for c, values in vocab.items() for v in values]
        cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).cast("float") for c in (*spec.numeric, *flags)]
        rows = materialize(rows.select(*by, F.col(spec.row_id).alias("__id"), F.array(*cells).alias("x")), "gan-rows")
        networks = Networks(len(cells), len(flags))
        at = len(spec.numeric)
        found = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(F.col("x")[at + i]) for i in range(len(flags))]).alias("share"),
        ).collect()  # one row per group
        shards = {tuple(r[c] for c in by): math.ceil(r.n / SHARD_ROWS) for r in found}
        shares = {tuple(r[c] for c in by): np.array(r.share) for r in found}
        packs = _packed(rows, by, shards, seed)
        states = {key: networks.start(np.random.default_rng([seed, _number(key)])) for key in shards}
        rounds = [range(epochs)] if max(shards.values(), default=1) == 1 else [range(e, e + 1) for e in range(epochs)]
        for some in rounds:
            states = _round(packs, by, networks, states, some, max(1, batch_size // 2), seed)
        return cls(spec, by, types, vocab, stats, networks, states, shares, seed)

    def sample(self, wanted: DataFrame) -> DataFrame:
        """``n`` new rows per group; ``wanted`` holds the group columns and ``n``. The columns
        are those of the fitted rows, with ``synth_id`` (dense per group) for the row id.

        The condition of a made row has each category as often as the fitted rows have it. A
        group without fitted rows gets none.
        """
        spec, by, networks, states, shares, seed = (
            self.spec, self.by, self.networks, self.states, self.shares, self.seed
        )
        context = wanted.sparkSession.sparkContext
        flags = [f"{c}_{v}" for c, values in self.vocab.items() for v in values]
        names = [*spec.numeric, *flags]
        groups = [len(values) for values in self.vocab.values()]
        schema = T.StructType(
            [wanted.schema[c] for c in by]
            + [T.StructField("synth_id", T.LongType())]
            + [T.StructField(c, T.DoubleType()) for c in names]
        )
        held = context.broadcast(states)

        def generate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for *key, n, chunk in frame.itertuples(index=False):
                    if tuple(key) not in shares:
                        continue
                    rows = int(min(CHUNK, n - chunk * CHUNK))
                    rng = np.random.default_rng([seed, _number(tuple(key)), 1 << 20, int(chunk)])
                    z = [rng.standard_normal((rows, networks.noise))]
                    start = 0
                    for size in groups:
                        ends = np.cumsum(shares[tuple(key)][start : start + size])
                        chosen = np.searchsorted(ends, rng.random(rows) * ends[-1], "right")
                        z.append(np.eye(size)[np.minimum(chosen, size - 1)])
                        start += size
                    made = networks.generate(held.value[tuple(key)], np.concatenate(z, axis=1).astype("float32"))
                    out = pd.DataFrame(made.astype(float), columns=names)
                    out.insert(0, "synth_id", np.arange(rows) + chunk * CHUNK)
                    for c, value in zip(reversed(by), reversed(key), strict=True):
                        out.insert(0, c, value)
                    yield out

        chunks = wanted.filter(F.col("n") > 0).select(
            *by,
            F.col("n").cast("long").alias("n"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("c"),
        )
        made = chunks.repartition(4 * context.defaultParallelism, *by, "c").mapInPandas(generate, schema)
        columns = [*by, "synth_id", *spec.features, spec.target]
        if spec.numeric:
            rows = synth_decode(made, self.stats, spec.numeric, self.vocab, columns, by)
        else:
            rows = one_hot_decode(made, self.vocab).select(*columns)
        return rows.select(
            *by,
            "synth_id",
            *[F.col(f"`{c}`").cast(self.types[c]).alias(c) for c in (*spec.features, spec.target)],
        )


def _packed(rows: DataFrame, by, shards: dict, seed: int) -> DataFrame:
    """One row per group and shard with the shard's numbers as bytes, in an order that does not
    depend on partitions."""
    by = list(by)
    parts = rows.sparkSession.createDataFrame(
        [(*key, n) for key, n in shards.items()],
        T.StructType([*[rows.schema[c] for c in by], T.StructField("__shards", T.IntegerType())]),
    )
    drawn = rows.join(F.broadcast(parts), by).withColumn("__draw", F.xxhash64(F.lit(seed), "__id", "x"))
    dealt = drawn.withColumn("__shard", F.pmod(F.shiftrightunsigned("__draw", 20), F.col("__shards")).cast("int"))
    schema = T.StructType(
        [*[rows.schema[c] for c in by], T.StructField("__shard", T.IntegerType()), T.StructField("x", T.BinaryType())]
    )

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["__draw"].to_numpy(), kind="stable")
        x = np.stack(frame["x"].to_numpy()[order]).astype("float32")
        return pd.DataFrame([[*key, x.tobytes()]], columns=schema.names)

    packs = dealt.select(*by, "__shard", "__draw", "x").groupBy(*by, "__shard").applyInPandas(pack, schema)
    files = min(sum(shards.values()), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return materialize(packs.repartitionByRange(max(1, files), *by, "__shard"), "gan-shards")


def _round(packs: DataFrame, by, networks: Networks, states: dict, epochs: range, batch: int, seed: int) -> dict:
    """All shards trained from the common weights, and the mean of theirs by rows."""
    by = list(by)
    spark = packs.sparkSession
    held = spark.sparkContext.broadcast(states)
    schema = T.StructType(
        [*[packs.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("state", T.BinaryType())]
    )

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for *key, shard, raw in frame.itertuples(index=False):
                x = np.frombuffer(raw, "float32").reshape(-1, networks.width)
                state = held.value[tuple(key)].copy()
                networks.train(state, x, epochs, batch, (seed, _number(tuple(key)), int(shard)))
                n, total = sums.get(tuple(key), (0, 0.0))
                sums[tuple(key)] = n + len(x), total + len(x) * state.astype(float)
        for key, (n, total) in sums.items():
            yield pd.DataFrame([[*key, n, total.tobytes()]], columns=schema.names)

    sums = {}
    for *key, n, raw in packs.mapInPandas(train, schema).collect():  # tasks x groups
        rows, total = sums.get(tuple(key), (0, 0.0))
        sums[tuple(key)] = rows + n, total + np.frombuffer(raw)
    held.unpersist()
    return {key: (total / n).astype("float32") for key, (n, total) in sums.items()}
