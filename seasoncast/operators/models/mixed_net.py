"""Mixed-input regressor fitted on the pinball loss itself by a distributed first-order optimiser.

Categories get learned factors, the embedding a narrow layer of its own; both
join the scaled numbers in one hidden layer.  The loss is the pinball loss,
rounded off within ``delta`` of its corner; ``delta`` shrinks as the fit goes on.

Every step is one Spark job: parameters are broadcast, each task adds up the
gradient and the losses of its rows, and the sums meet in a shuffle by slices of
the parameter vector, so neither a task nor the driver ever holds more than a
few copies of it.  The driver only does the limited-memory quasi-Newton update.
State is a table: every ``commit_every`` steps the parameters and the history
are written, and a fit started again on the same folder goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.functions.measures import embedding_width as factor_width
from seasoncast.operators import encode
from seasoncast.operators.models.features import embedding_width
from seasoncast.operators.quantile import exact_quantile
from seasoncast.session import materialise, path_exists
from seasoncast.sources import io

_SLICE = 2048  # parameters that one row of a gradient holds
_INPUTS = ("_net_codes", "_net_numbers", "_net_vector")
STAGES = (0.5, 0.1, 0.02)  # widths of the rounded corner, in standard deviations of the label


class Shapes:
    """Places of the parameters in one flat vector."""

    def __init__(self, classes: Sequence[int], widths: Sequence[int], numbers: int, vector: int, branch: int, hidden: int):
        self.classes, self.widths, self.numbers, self.vector, self.branch, self.hidden = list(classes), list(widths), numbers, vector, branch, hidden
        inner = (branch if vector else 0) + numbers + sum(self.widths)
        # One row more than classes: unseen values, which stay at zero.
        shapes = [("v_w", (vector, branch)), ("v_b", (branch,))] if vector else []
        shapes += [(f"c{i}", (n + 1, w)) for i, (n, w) in enumerate(zip(self.classes, self.widths))]
        shapes += [("h_w", (inner, hidden)), ("h_b", (hidden,)), ("o_w", (hidden,)), ("o_b", (1,))]
        self.shapes, self.at, size = dict(shapes), {}, 0
        for name, shape in shapes:
            n = int(np.prod(shape))
            self.at[name] = slice(size, size + n)
            size += n
        self.size = size

    def split(self, flat: np.ndarray) -> dict:
        return {n: flat[self.at[n]].reshape(s) for n, s in self.shapes.items()}

    def start(self, seed: int) -> np.ndarray:
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for name, shape in self.shapes.items():
            if name.endswith("_w"):
                flat[self.at[name]] = rng.standard_normal(int(np.prod(shape))) * np.sqrt(2 / shape[0]) * (0.1 if name == "o_w" else 1.0)
            elif name[0] == "c":
                values = rng.standard_normal(shape) * 0.1
                values[-1] = 0
                flat[self.at[name]] = values.ravel()
        return flat

    def decayed(self) -> np.ndarray:
        """1 for weights and factors, 0 for offsets."""
        out = np.ones(self.size)
        for name in self.shapes:
            if name.endswith("_b"):
                out[self.at[name]] = 0
        return out

    def forward(self, p: dict, c: np.ndarray, x: np.ndarray, v: np.ndarray):
        inputs, branch = [], None
        if self.vector:
            branch = np.maximum(v @ p["v_w"] + p["v_b"], 0)
            inputs.append(branch)
        inputs += [x] + [p[f"c{i}"][c[:, i]] for i in range(len(self.classes))]
        inner = np.concatenate(inputs, axis=1)
        hidden = np.maximum(inner @ p["h_w"] + p["h_b"], 0)
        return hidden @ p["o_w"] + p["o_b"][0], (branch, inner, hidden)

    def backward(self, p: dict, c, v, kept, slope: np.ndarray) -> np.ndarray:
        """Gradient of the sum of losses, whose derivatives by the forecast are ``slope``."""
        branch, inner, hidden = kept
        out = np.zeros(self.size)
        g = self.split(out)
        g["o_w"][:], g["o_b"][0] = hidden.T @ slope, slope.sum()
        up = slope[:, None] * p["o_w"] * (hidden > 0)
        g["h_w"][:], g["h_b"][:] = inner.T @ up, up.sum(0)
        down, at = up @ p["h_w"].T, 0
        if self.vector:
            back = down[:, :self.branch] * (branch > 0)
            g["v_w"][:], g["v_b"][:] = v.T @ back, back.sum(0)
            at = self.branch
        at += self.numbers
        for i, w in enumerate(self.widths):
            np.add.at(g[f"c{i}"], c[:, i], down[:, at:at + w])
            g[f"c{i}"][-1] = 0  # the row of unseen values
            at += w
        return out


def rounded_pinball(r: np.ndarray, alpha: float, delta: float):
    """Loss and its slope by the residual; equal to the pinball loss, plus ``delta / 4`` at the corner, beyond ``delta``."""
    near = np.abs(r) < delta
    loss = np.where(near, (alpha - 0.5) * r + r * r / (4 * delta) + delta / 4, np.maximum(alpha * r, (alpha - 1) * r))
    return loss, alpha - np.clip((delta - r) / (2 * delta), 0, 1)


def _arrays(batch, shapes: Shapes):
    n = batch.num_rows
    flat = lambda name, width, kind: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, width)
    return (flat(_INPUTS[0], len(shapes.classes), np.int64), flat(_INPUTS[1], shapes.numbers, np.float64),
            flat(_INPUTS[2], shapes.vector, np.float64) if shapes.vector else np.zeros((n, 0)))


def _gradient(held, shapes: Shapes, alpha: float, delta: float):
    """Rows ``slice, part``: a task's gradient in slices; slice -1 holds rows, loss, hold-out rows and hold-out pinball loss."""
    def run(batches):
        p = shapes.split(held.value)
        total, sums = np.zeros(shapes.size), np.zeros(4)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                c, x, v = _arrays(part, shapes)
                y, hold = part.column("y").to_numpy(), part.column("hold").to_numpy(zero_copy_only=False)
                f, kept = shapes.forward(p, c, x, v)
                loss, slope = rounded_pinball(y - f, alpha, delta)
                total += shapes.backward(p, c, v, kept, np.where(hold, 0.0, -slope))
                r = (y - f)[hold]
                sums += [len(y) - len(r), loss[~hold].sum(), len(r), np.maximum(alpha * r, (alpha - 1) * r).sum()]
        parts = [sums] + [total[i:i + _SLICE] for i in range(0, len(total), _SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(parts) - 1)), pa.array(parts, pa.list_(pa.float64()))], ["slice", "part"])
    return run


def _direction(slope: np.ndarray, memory: list) -> np.ndarray:
    """Two-loop recursion: the quasi-Newton direction from pairs of (step, change of slope)."""
    q, kept = slope.copy(), []
    for s, t in reversed(memory):
        a = (s @ q) / (s @ t)
        q -= a * t
        kept.append(a)
    if memory:
        s, t = memory[-1]
        q *= (s @ t) / (t @ t)
    for (s, t), a in zip(memory, reversed(kept)):
        q += s * (a - (t @ q) / (s @ t))
    return -q


class MixedNet:
    """Fit, score, store and load; columns by name, label in its own units."""

    def __init__(self, categorical: Sequence[str], numeric: Sequence[str], embedding: str | None = None, label: str = "label", alpha: float = 0.8,
                 branch: int = 8, hidden: int = 16, max_factor: int = 8, decay: float = 3e-3, steps: int = 60, patience: int = 15,
                 commit_every: int = 10, clip_zero: bool = True, seed: int = 42):
        self.settings = dict(categorical=list(categorical), numeric=list(numeric), embedding=embedding, label=label, alpha=alpha, branch=branch, hidden=hidden,
                             max_factor=max_factor, decay=decay, steps=steps, patience=patience, commit_every=commit_every, clip_zero=clip_zero, seed=seed)
        self.__dict__.update(self.settings)
        self.shapes: Shapes | None = None
        self.params: np.ndarray | None = None
        self.history: list = []  # (step, training loss, hold-out pinball loss), in standard deviations of the label

    def _prepare(self, df: DataFrame, *more) -> DataFrame:
        coded = encode.apply_label_dictionary(df, self.labels, self.categorical, suffix="__code") if self.categorical else df
        stats = {r["column"]: (r["mean"], r["std"] or 1.0) for r in self.scaler.collect()}  # a row a column
        numbers = [F.coalesce((F.col(c).cast("double") - stats[c][0]) / stats[c][1], F.lit(0.0)) for c in self.numeric]
        codes = [F.least(F.col(f"{c}__code"), F.lit(n)) for c, n in zip(self.categorical, self.shapes.classes)]
        vector = F.col(self.embedding).cast("array<double>") if self.embedding else F.array().cast("array<double>")
        inputs = F.array(*codes).cast("array<int>"), F.array(*numbers).cast("array<double>"), vector
        return coded.select(*more, *[i.alias(n) for i, n in zip(inputs, _INPUTS)])

    def fit(self, df: DataFrame, holdout_col: str | None = None, state: str | None = None) -> "MixedNet":
        """Fit on the rows not held out; held-out ones choose the step that is kept (the training loss does without any).

        With ``state``, a folder in shared storage, a fit that was cut off goes on from its last commit.
        """
        spark = df.sparkSession
        hold = F.coalesce(F.col(holdout_col), F.lit(False)) if holdout_col else F.lit(False)
        df = materialise(df.where(F.col(self.label).isNotNull()).withColumn("_hold", hold), "mixed-net")
        train = df.where("not _hold")
        self._fit_inputs(train)
        y = (F.col(self.label).cast("double") - self.centre) / self.unit
        rows = self._prepare(df, y.alias("y"), F.col("_hold").alias("hold"))
        rows = materialise(rows, "mixed-net-rows").coalesce(4 * spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            start = self.shapes.start(self.seed)
            start[self.shapes.at["o_b"]] = exact_quantile(rows.where("not hold"), "y", self.alpha) or 0.0
            self._optimise(spark, rows, start, state)
        finally:
            rows.unpersist()
        return self

    def _fit_inputs(self, train: DataFrame) -> None:
        self.labels = encode.fit_label_dictionary(train, self.categorical) if self.categorical else None
        self.scaler = materialise(encode.fit_scaler(train, [*self.numeric, self.label]), "mixed-net-scaler")
        centre = {r["column"]: r for r in self.scaler.collect()}[self.label]
        self.centre, self.unit = float(centre["mean"] or 0.0), float(centre["std"] or 1.0)
        sizes = {r["column"]: r["count"] for r in self.labels.groupBy("column").count().collect()} if self.categorical else {}
        classes = [sizes.get(c, 0) for c in self.categorical]
        widths = [min(self.max_factor, int(w["w"])) for w in train.sparkSession.createDataFrame(
            [(i, n) for i, n in enumerate(classes)], "i int, n int").withColumn("w", factor_width("n")).orderBy("i").collect()] if classes else []
        self.shapes = Shapes(classes, widths, len(self.numeric), embedding_width(train, self.embedding) if self.embedding else 0, self.branch, self.hidden)

    def _optimise(self, spark, rows, start, state) -> None:
        decay = self.decay * self.shapes.decayed()

        def measure(flat, delta):
            sent = rows.mapInArrow(_gradient(spark.sparkContext.broadcast(flat), self.shapes, self.alpha, delta), "slice long, part array<double>")
            summed = sent.groupBy("slice").applyInPandas(
                lambda p: pd.DataFrame({"slice": p["slice"].iloc[:1], "part": [np.sum(np.stack(p["part"].to_numpy()), axis=0)]}), sent.schema)
            got = {r["slice"]: np.array(r["part"]) for r in summed.collect()}  # the parameter vector, in slices
            n, loss, held, off = got.pop(-1)
            slope = np.concatenate([got[i] for i in range(len(got))]) / max(n, 1)
            return loss / max(n, 1) + 0.5 * (decay * flat * flat).sum(), slope + decay * flat, off / held if held else None

        now = dict(step=0, flat=start, best=start, best_score=np.inf, since=0, history=[])
        if state and path_exists(spark, f"{state}/settings/_SUCCESS"):
            now = self._last_commit(spark, state, now)
        elif state:
            spark.createDataFrame([(json.dumps(self.settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{state}/settings")
        flat, memory, delta, loss, slope, length = now["flat"], [], None, None, None, 1.0
        while now["step"] < self.steps and now["since"] < self.patience:
            corner = STAGES[min(len(STAGES) - 1, now["step"] * len(STAGES) // max(1, self.steps * 2 // 3))]
            if corner != delta or loss is None:
                delta, memory, length = corner, [], 1.0
                loss, slope, score = measure(flat, delta)
            way = _direction(slope, memory)
            if way @ slope >= 0:
                memory, way = [], -slope
            size = length if memory else min(1.0, 0.1 / max(np.abs(way).max(), 1e-12))
            for _ in range(12):
                moved = flat + size * way
                new_loss, new_slope, score = measure(moved, delta)
                if new_loss <= loss + 1e-4 * size * (way @ slope):
                    break
                size /= 2
            else:
                if not memory:
                    now["since"] = self.patience  # no way down at this corner
                memory, now["step"] = [], now["step"] + 1
                continue
            step, change = moved - flat, new_slope - slope
            if step @ change > 1e-10 * np.sqrt((step @ step) * (change @ change)):
                memory = [*memory, (step, change)][-8:]
            flat, loss, slope = moved, new_loss, new_slope
            now["step"] += 1
            judged = float(score if score is not None else loss)
            now["history"].append((now["step"], float(loss), judged))
            if judged < now["best_score"] - 1e-6:
                now.update(best=flat, best_score=judged, since=0)
            else:
                now["since"] += 1
            now["flat"] = flat
            if state and now["step"] % self.commit_every == 0:
                self._commit(spark, state, now)
            if now["step"] % self.commit_every == 0:
                memory = []  # a commit holds no memory: a resumed fit takes the same steps
        self.params, self.history = now["best"], [tuple(h) for h in now["history"]]

    def _commit(self, spark, state, now) -> None:
        row = (now["step"], [float(x) for x in now["flat"]], [float(x) for x in now["best"]], float(now["best_score"]), now["since"], json.dumps(now["history"]))
        table = spark.createDataFrame([row], "step int, flat array<double>, best array<double>, best_score double, since int, history string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{state}/step-{now['step']:05d}")

    def _last_commit(self, spark, state, now) -> dict:
        if spark.read.text(f"{state}/settings").first()[0] != json.dumps(self.settings, sort_keys=True):
            raise ValueError(f"{state} holds a fit with other settings")
        last = next((s for s in range(self.steps, 0, -1) if path_exists(spark, f"{state}/step-{s:05d}/_SUCCESS")), None)
        if last is None:
            return now
        row = spark.read.parquet(f"{state}/step-{last:05d}").first()
        return dict(step=row["step"], flat=np.array(row["flat"]), best=np.array(row["best"]), best_score=row["best_score"], since=row["since"],
                    history=json.loads(row["history"]))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Score in one vectorised projection; unseen categories have zero factors, missing numbers the mean."""
        held = df.sparkSession.sparkContext.broadcast(self.params)
        shapes, centre, unit, clip = self.shapes, self.centre, self.unit, self.clip_zero

        @F.pandas_udf("double")
        def score(c: pd.Series, x: pd.Series, v: pd.Series) -> pd.Series:
            n = len(c)
            stack = lambda s, w, kind: np.stack(s.to_numpy()).astype(kind).reshape(n, w) if n else np.zeros((0, w), kind)
            f, _ = shapes.forward(shapes.split(held.value), stack(c, len(shapes.classes), np.int64), stack(x, shapes.numbers, np.float64),
                                  stack(v, shapes.vector, np.float64))
            f = f * unit + centre
            return pd.Series(np.maximum(f, 0.0) if clip else f)

        return self._prepare(df, *[F.col(f"`{c}`") for c in df.columns]).withColumn(out, score(*_INPUTS)).drop(*_INPUTS)

    def save(self, path: str) -> str:
        """A folder of tables: settings, dictionary, scaler and parameters."""
        spark = self.scaler.sparkSession
        s = self.shapes
        meta = dict(settings=self.settings, centre=self.centre, unit=self.unit, history=self.history,
                    shapes=[s.classes, s.widths, s.numbers, s.vector, s.branch, s.hidden])
        io.save_spec(spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1), path, "meta")
        io.save_spec(spark.createDataFrame([(i, float(x)) for i, x in enumerate(self.params)], "place int, value double").coalesce(1), path, "params")
        io.save_spec(self.scaler, path, "scaler")
        if self.categorical:
            io.save_spec(self.labels, path, "labels")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MixedNet":
        meta = json.loads(io.load_spec(spark, path, "meta").first()["meta"])
        net = cls(**meta["settings"])
        net.centre, net.unit, net.history, net.shapes = meta["centre"], meta["unit"], [tuple(h) for h in meta["history"]], Shapes(*meta["shapes"])
        net.params = np.array([r["value"] for r in io.load_spec(spark, path, "params").orderBy("place").collect()])
        net.scaler = io.load_spec(spark, path, "scaler")
        net.labels = io.load_spec(spark, path, "labels") if net.categorical else None
        return net
