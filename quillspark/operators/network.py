"""A feed-forward classifier with dropout, batch norm and Adam, trained in mini-batches that the tasks of a barrier stage share."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut

TINY = 1e-5
KEPT = 0.9  # of the running statistics at each step
ADAM = (0.9, 0.999, 1e-8)
#: Times in an epoch that the tasks meet. A barrier takes about a second, whatever is sent, so their number must not follow the rows.
ROUNDS = 16


def shapes(sizes: list[int]) -> list[tuple[int, ...]]:
    """Of each layer's weights and offsets and, but for the last one, of the scale and shift after it."""
    out: list[tuple[int, ...]] = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        out += [(a, b), (b,)] + ([(b,), (b,)] if i < len(sizes) - 2 else [])
    return out


def unpack(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    ends = np.cumsum([np.prod(s, dtype=int) for s in shapes(sizes)])
    return [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes(sizes), strict=True)]


def start(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform weights and offsets within the root of 1 / inputs, scales of 1, shifts of 0."""
    rng, out = np.random.default_rng(seed), []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        edge = 1 / np.sqrt(a)
        out += [rng.uniform(-edge, edge, a * b), rng.uniform(-edge, edge, b)]
        if i < len(sizes) - 2:
            out += [np.ones(b), np.zeros(b)]
    return np.concatenate(out)


def forward(parts, x, running=None, masks=None):
    """(logits, what `backward` needs, each norm's mean and variance). With `running` the norms use those statistics, otherwise the batch's own."""
    kept, seen = [], []
    for i in range(len(parts) // 4):
        w, b, scale, shift = parts[4 * i : 4 * i + 4]
        z = x @ w + b
        if masks is not None:
            z = z * masks[i]
        r = np.maximum(z, 0)
        mean, var = (r.mean(axis=0), r.var(axis=0)) if running is None else running[i]
        unit = (r - mean) / np.sqrt(var + TINY)
        kept.append((x, z, unit, np.sqrt(var + TINY)))
        seen.append((mean, var))
        x = scale * unit + shift
    return x @ parts[-2] + parts[-1], (kept, x), seen


def log_softmax(logits):
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def backward(parts, held, logits, labels, masks=None) -> np.ndarray:
    """The gradient of the mean cross entropy, flat like the parameters."""
    kept, last = held
    n = len(labels)
    d = np.exp(log_softmax(logits))
    d[np.arange(n), labels] -= 1
    d /= n
    out = [last.T @ d, d.sum(axis=0)]
    d = d @ parts[-2].T
    for i in reversed(range(len(kept))):
        x, z, unit, spread = kept[i]
        w, _, scale, _ = parts[4 * i : 4 * i + 4]
        dscale, dshift = (d * unit).sum(axis=0), d.sum(axis=0)
        du = d * scale
        d = (du - du.mean(axis=0) - unit * (du * unit).mean(axis=0)) / spread * (z > 0)
        if masks is not None:
            d = d * masks[i]
        out = [x.T @ d, d.sum(axis=0), dscale, dshift, *out]
        d = d @ w.T
    return np.concatenate([g.ravel() for g in out])


@dataclass
class Network:
    """Parameters, running statistics and Adam's two averages; `losses` has (epoch, loss, valid_loss, valid_accuracy), `rounds` how often tasks met in each epoch."""

    sizes: list[int]
    flat: np.ndarray
    running: list[tuple[np.ndarray, np.ndarray]]
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    losses: list[tuple] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)

    @classmethod
    def new(cls, sizes: list[int], seed: int) -> Network:
        flat = start(sizes, seed)
        return cls(sizes, flat, [(np.zeros(b), np.ones(b)) for b in sizes[1:-1]], np.zeros_like(flat), np.zeros_like(flat))

    def move(self, gradient: np.ndarray, rate: float) -> None:
        """One step of Adam."""
        a, b, tiny = ADAM
        self.steps += 1
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        self.flat = self.flat - rate * (self.first / (1 - a**self.steps)) / (np.sqrt(self.second / (1 - b**self.steps)) + tiny)

    def watch(self, seen) -> None:
        """Moves the running statistics towards those of a batch."""
        self.running = [tuple(KEPT * old + (1 - KEPT) * v for old, v in zip(r, new, strict=True)) for r, new in zip(self.running, seen, strict=True)]

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """rows with `scores` (log probabilities) and `prediction` (ties to the smaller class); both null where the features are null."""
        shared = rows.sparkSession.sparkContext.broadcast((unpack(self.flat, self.sizes), self.running))

        @F.pandas_udf("array<double>")
        def scores(column: pd.Series) -> pd.Series:
            parts, running = shared.value
            given = column.notna().to_numpy()
            out = np.full(len(column), None, object)
            if given.any():
                logits, _, _ = forward(parts, np.stack(column[given].to_numpy()).astype(float), running)
                for i, row in zip(np.flatnonzero(given), log_softmax(logits), strict=True):
                    out[i] = row
            return pd.Series(out)

        # the index of the largest score, taken from the array once
        best = F.when(F.col("scores").isNotNull(), F.array_position("scores", F.array_max("scores")) - 1).cast("int")
        return rows.withColumn("scores", scores(features)).withColumn("prediction", best)

    def evaluate(self, rows: DataFrame) -> tuple[float | None, float | None]:
        """(mean cross entropy, accuracy) of rows (features, label); both None without rows."""
        done = self.predict(rows.where("features IS NOT NULL AND label IS NOT NULL"))
        r = done.agg(F.avg(-F.get("scores", F.col("label").cast("int"))), F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()
        return r[0], r[1]

    def save(self, spark, path: str) -> None:
        state = [("flat", self.flat), ("first", self.first), ("second", self.second), *((f"{n}{i}", v) for i, p in enumerate(self.running) for n, v in zip(("mean", "var"), p, strict=True))]
        rows = [(n, v.tolist()) for n, v in state] + [("sizes", [float(s) for s in self.sizes]), ("steps", [float(self.steps)])]
        spark.createDataFrame(rows, "name string, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Network:
        """A stored model, which can be trained on."""
        x = {r["name"]: np.array(r["x"]) for r in spark.read.parquet(path).collect()}
        sizes = [int(s) for s in x["sizes"]]
        return cls(sizes, x["flat"], [(x[f"mean{i}"], x[f"var{i}"]) for i in range(len(sizes) - 2)], x["first"], x["second"], int(x["steps"][0]))


def _pairs(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each norm's mean and variance, as they lie one after another."""
    parts = np.split(flat, np.cumsum(np.repeat(sizes[1:-1], 2))[:-1])
    return list(zip(parts[::2], parts[1::2], strict=True))


def _epoch(net: Network, rows: DataFrame, turn: int, every: int, batch: int, workers: int, dropout: float, rate: float, seed: int) -> float | None:
    """One pass: in each round every task takes `every` times the next batch / workers of its rows, until none has rows.

    With one batch a round all gather each other's gradients and take the same step. With more, each task takes its steps by itself, from the state that all
    share, and then all go on from the mean of their states, by rows."""
    own = -(-batch // workers)
    shared = rows.sparkSession.sparkContext.broadcast((net.sizes, net.flat, net.running, net.first, net.second, net.steps))

    def train(batches):
        task = BarrierTaskContext.get()
        me, at = task.partitionId(), shared.value
        net = Network(at[0], at[1], list(at[2]), *at[3:])
        size, total, n_total, step, rounds = len(net.flat), 0.0, 0, 0, 0
        held_x, held_y = [], []
        source = iter(batches)
        done = False

        def gathered(message: np.ndarray) -> list[np.ndarray]:
            got = [np.frombuffer(base64.b64decode(m)) for m in task.allGather(base64.b64encode(message.tobytes()).decode())]
            return [g for g in got if len(g)]

        while True:
            n, loss, message = 0, 0.0, np.zeros(0)
            for _ in range(every):
                while not done and len(held_y) < own:
                    part = next(source, None)
                    if part is None:
                        done = True
                    else:
                        held_x += list(part["features"])
                        held_y += part["label"].tolist()
                x, y = held_x[:own], held_y[:own]
                held_x, held_y = held_x[own:], held_y[own:]
                if not y:
                    break
                x, y = np.stack(x).astype(float), np.array(y, int)
                rng = np.random.default_rng([seed, turn, me, step])
                masks = [(rng.random((len(y), b)) >= dropout) / (1 - dropout) for b in net.sizes[1:-1]]
                parts = unpack(net.flat, net.sizes)
                logits, held, seen = forward(parts, x, masks=masks)
                n, loss, step = n + len(y), loss - log_softmax(logits)[np.arange(len(y)), y].sum(), step + 1
                gradient = backward(parts, held, logits, y, masks)
                if every == 1:
                    message = np.concatenate([[n, loss / n, 0], *(np.concatenate(s) for s in seen), gradient])
                else:
                    net.watch(seen)
                    net.move(gradient, rate)
            if n and every > 1:
                message = np.concatenate([[n, loss / n, net.steps], *(np.concatenate(r) for r in net.running), net.flat, net.first, net.second])
            got = gathered(message)
            if not got:
                break
            n, rounds = sum(g[0] for g in got), rounds + 1
            mean = sum(g[1:] * (g[0] / n) for g in got)
            total, n_total, step = total + mean[0] * n, n_total + n, rounds * every
            state = mean[2:]
            if every == 1:
                net.watch(_pairs(state[:-size], net.sizes))
                net.move(state[-size:], rate)
            else:
                net.steps = int(max(g[2] for g in got))
                net.running = _pairs(state[: -3 * size], net.sizes)
                net.flat, net.first, net.second = state[-3 * size :].reshape(3, size)
        if me == 0:
            state = np.concatenate([net.flat, net.first, net.second, *(np.concatenate(r) for r in net.running)])
            yield pd.DataFrame({"steps": [net.steps], "rounds": [rounds], "n": [int(n_total)], "loss": [total], "state": [state.tobytes()]})

    # a seeded shuffle: rows are dealt in turn by a hash that changes with the epoch, so that shares are even and neighbours others
    mixed = F.xxhash64("key", F.lit(seed), F.lit(turn))
    dealt = rows.withColumn("mixed", mixed).repartition(workers).sortWithinPartitions("mixed", "key").select("features", "label")
    ends = dealt.mapInPandas(train, "steps long, rounds long, n long, loss double, state binary", barrier=True).collect()
    shared.destroy()
    if not ends:  # a plan that is known to be empty starts no task
        return None
    r = ends[0]
    state, size = np.frombuffer(r["state"]).copy(), len(net.flat)
    net.flat, net.first, net.second = state[: 3 * size].reshape(3, size)
    net.running = _pairs(state[3 * size :], net.sizes)
    net.steps = r["steps"]
    net.rounds.append(r["rounds"])
    return r["loss"] / r["n"] if r["n"] else None


def fit(rows: DataFrame, sizes: list[int], valid: DataFrame | None = None, epochs: int = 20, batch: int = 256, workers: int = 2, dropout: float = 0.5, rate: float = 1e-3, seed: int = 1, net: Network | None = None) -> Network:
    """A network of these layer sizes for rows (key, features array<double>, label from 0), or `net` trained on.

    A layer is linear, dropout, max(0, x), batch norm; the last one is linear. A step's gradient is the mean over the batch, each task having normed its share by that share's
    statistics. Where an epoch has more than ROUNDS batches, tasks meet ROUNDS times only, at even distances, and go on from the mean of what each has learnt from its batches
    since; every row is still seen once an epoch. Tasks hold one batch and read the rest in sorted order, so memory does not follow the rows; messages have three times the model's size. All `workers` tasks must
    run at once. A task that is lost makes its epoch start again from the same state, with the same order and masks. Rows with null features or labels teach nothing, and
    rows with features of another length are an error; without rows the network stays as it is, with a null loss."""
    net = net or Network.new(sizes, seed)
    kept = _cut(rows.where("features IS NOT NULL AND label IS NOT NULL").select("key", "features", F.col("label").cast("int").alias("label")))
    every = max(1, -(-kept.count() // (batch * ROUNDS)))
    for turn in range(len(net.losses), len(net.losses) + epochs):
        loss = _epoch(net, kept, turn, every, batch, workers, dropout, rate, seed)
        net.losses.append((turn, loss, *(net.evaluate(valid) if valid is not None else (None, None))))
    return net
