"""Per-cluster reward models and Thompson scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from casewise.functions.draws import betas, normals

# Larger clusters are fitted from sums made in parallel instead of in one task.
GROUP_ROWS = 200_000
# Rows a task gathers before it hands them on as one block per cluster.
PACK_ROWS = 65_536
# Largest model (numbers in all coefficient and covariance arrays) sent to every task.
MODEL_NUMBERS = 1_000_000


def _in_arms(arm: str, arms: Sequence[str]):
    return F.col(arm).isin(list(arms))


def arm_counts(df: DataFrame, cluster: str, arm: str, rewards: Mapping[str, Sequence[str]]) -> DataFrame:
    """``<reward>_success`` and ``<reward>_failure`` per cluster, each reward on its own arms.

    NULL where the cluster has no row in those arms.
    """
    aggs = []
    for reward, arms in rewards.items():
        value = F.when(_in_arms(arm, arms), F.col(reward))
        success = F.sum(value).cast("bigint")
        aggs += [success.alias(f"{reward}_success"), (F.count(value) - success).alias(f"{reward}_failure")]
    return df.groupBy(cluster).agg(*aggs)


def beta_posterior(counts: DataFrame, cluster: str, rewards: Sequence[str]) -> DataFrame:
    """Beta(success + 1, failure + 1) per cluster and reward, with mean and variance."""
    out = [F.col(cluster)]
    for reward in rewards:
        a = F.coalesce(F.col(f"{reward}_success"), F.lit(0)) + 1
        b = F.coalesce(F.col(f"{reward}_failure"), F.lit(0)) + 1
        out += [
            a.alias(f"{reward}_alpha"),
            b.alias(f"{reward}_beta"),
            (a / (a + b)).alias(f"{reward}_mean"),
            (a * b / ((a + b) * (a + b) * (a + b + 1))).alias(f"{reward}_var"),
        ]
    return counts.select(*out)


def _seed(key: str, seed: int, reward: str | None):
    parts = [F.col(key), F.lit(seed)] + ([F.lit(reward)] if reward else [])
    return F.xxhash64(*parts)


def beta_ts(
    df: DataFrame, posterior: DataFrame, cluster: str, key: str, rewards: Sequence[str], draws: int = 10, seed: int = 42, shared_seed: bool = True
) -> DataFrame:
    """Add ``<reward>_score``: the mean of ``draws`` posterior draws times 1000, half-even.

    Draws depend on the row's key only; with ``shared_seed`` all rewards of a row use the
    same stream. A cluster without history scores from Beta(1, 1).
    """

    @F.pandas_udf("double")
    def score(seeds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        drawn = betas(seeds.to_numpy(), a.to_numpy(dtype=float), b.to_numpy(dtype=float), draws)
        return pd.Series(np.around(drawn.mean(axis=1) * 1000))

    slim = posterior.select(cluster, *[f"{r}_{p}" for r in rewards for p in ("alpha", "beta")])
    joined = df.join(slim, cluster, "left")
    one = F.lit(1)
    scores = {
        f"{r}_score": score(
            _seed(key, seed, None if shared_seed else r),
            F.coalesce(F.col(f"{r}_alpha"), one),
            F.coalesce(F.col(f"{r}_beta"), one),
        )
        for r in rewards
    }
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[s.alias(n) for n, s in scores.items()])


def _positive_definite(a: np.ndarray) -> np.ndarray:
    """``a`` itself if it has a Cholesky factor, else its nearest neighbour that has one."""
    try:
        np.linalg.cholesky(a)
        return a
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        lift = np.spacing(np.linalg.norm(a))
        while True:
            fixed = (vectors * np.maximum(values, lift)) @ vectors.T
            fixed = (fixed + fixed.T) / 2
            try:
                np.linalg.cholesky(fixed)
                return fixed
            except np.linalg.LinAlgError:
                lift *= 2


def _sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """What one Newton step needs from the rows: losses, gradient, Hessian without ridge."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -709, 709)))
    safe = np.clip(p, 1e-10, 1 - 1e-10)
    positives = -float((y * np.log(safe)).sum())
    full = positives - float(((1 - y) * np.log(1 - safe)).sum())
    return positives, full, x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


class _Newton:
    """State of one ridge-damped logistic fit; feed it :func:`_sums` until ``done``.

    It stops when the loss over positive rows has not dropped by ``tol`` twice in a row.
    """

    def __init__(self, size: int, ridge: float, steps: int, tol: float):
        self.beta, self.cov = np.zeros(size), np.eye(size) / ridge
        self.ridge, self.most, self.tol = ridge, steps, tol
        self.losses: list[float] = []
        self.full = None
        self.steps, self.done, self.converged = 0, False, False

    def feed(self, positives: float, full: float, grad: np.ndarray, hessian: np.ndarray) -> None:
        self.full = full
        if self.steps:
            self.losses.append(positives)
            drops = -np.diff(self.losses[-3:])
            self.converged = len(self.losses) >= 3 and bool((drops < self.tol).all())
            if self.converged or self.steps >= self.most:
                self.done = True
                return
        self.cov = _positive_definite(np.linalg.pinv(hessian + self.ridge * np.eye(len(self.beta))))
        self.beta = self.beta - self.cov @ grad
        self.steps += 1


_MODEL = (
    "reward string, success bigint, failure bigint, beta array<double>, cov array<array<double>>, "
    "steps int, converged boolean, loss double"
)


def _model_row(reward: str, success: int, failure: int, fit: _Newton) -> dict:
    return {
        "reward": reward,
        "success": int(success),
        "failure": int(failure),
        "beta": fit.beta.tolist(),
        "cov": fit.cov.tolist(),
        "steps": fit.steps,
        "converged": fit.converged,
        "loss": None if fit.full is None else float(fit.full),
    }


def fit_logit_by_group(
    df: DataFrame,
    cluster: str,
    arm: str,
    xs: Sequence[str],
    rewards: Mapping[str, Sequence[str]],
    ridge: float = 0.001,
    steps: int = 100,
    tol: float = 1e-4,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Bayesian logistic models: one row per cluster and reward with ``beta`` (intercept
    first), its covariance, counts and convergence facts.

    A cluster of up to ``group_rows`` rows is fitted in one task. Larger ones advance
    together: each Newton step is one Spark job whose tasks reduce their rows to a
    gradient and Hessian, so no task ever holds a large cluster. A cluster and reward
    without rows keeps the prior.
    """
    names = [f"x{i}" for i in range(len(xs))]
    ys = {r: f"y{i}" for i, r in enumerate(rewards)}
    rows = df.select(
        F.col(cluster).alias("cluster"),
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(xs, names)],
        *[F.when(_in_arms(arm, rewards[r]), F.col(r).cast("double")).alias(y) for r, y in ys.items()],
    ).filter(F.col("cluster").isNotNull())
    size = len(xs) + 1
    counts = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
    large = [r["cluster"] for r in counts.select("cluster").collect()]  # at most rows / group_rows
    kind = dict(rows.dtypes)["cluster"]

    def design(batch: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=float)])

    def fit_cluster(group: pd.DataFrame) -> pd.DataFrame:
        x, out = design(group), []
        for reward, y_name in ys.items():
            y = group[y_name].to_numpy(dtype=float)
            known = ~np.isnan(y)
            fit = _Newton(size, ridge, steps, tol)
            while known.any() and not fit.done:
                fit.feed(*_sums(x[known], y[known], fit.beta))
            hits = y[known].sum()
            out.append({"cluster": group["cluster"].iloc[0], **_model_row(reward, hits, known.sum() - hits, fit)})
        return pd.DataFrame(out)

    small = rows if not large else rows.filter(~F.col("cluster").isin(large))
    models = small.groupBy("cluster").applyInPandas(fit_cluster, f"cluster {kind}, {_MODEL}")
    if large:
        big = _fit_large(rows.filter(F.col("cluster").isin(large)), large, ys, names, size, ridge, steps, tol)
        models = models.unionByName(df.sparkSession.createDataFrame(big, models.schema))
    return models.withColumnRenamed("cluster", cluster)


def _packed_clusters(rows: DataFrame, names: Sequence[str], rewards: Sequence[str]) -> DataFrame:
    """``cluster, x, y``: blocks of rows of one cluster as doubles, with a 1 before the x; y is NaN outside a reward's arms."""
    cols = [*names, *rewards]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def blocks() -> pd.DataFrame:
            found = {c: np.concatenate(parts) for c, parts in held.items()}
            ones = {c: np.column_stack([np.ones(len(v)), v[:, : len(names)]]) for c, v in found.items()}
            y = [np.ascontiguousarray(v[:, len(names) :].T).tobytes() for v in found.values()]
            return pd.DataFrame({"cluster": list(found), "x": [v.tobytes() for v in ones.values()], "y": y})

        count = 0
        for batch in batches:
            values = batch[cols].to_numpy(dtype=float)
            for c, where in batch.groupby("cluster").indices.items():
                held.setdefault(c, []).append(values[where])
            count += len(batch)
            if count >= PACK_ROWS:
                yield blocks()
                held, count = {}, 0
        if held:
            yield blocks()

    return rows.mapInPandas(pack, f"cluster {dict(rows.dtypes)['cluster']}, x binary, y binary")


def _fit_large(rows: DataFrame, large: list, ys: Mapping[str, str], names: Sequence[str], size: int, ridge: float, steps: int, tol: float) -> list[dict]:
    # Packed and grouped once; every Newton step reads the blocks only.
    rows = _packed_clusters(rows, names, list(ys.values())).persist(StorageLevel.MEMORY_AND_DISK)
    upper = np.triu_indices(size)
    fits = {(c, r): _Newton(size, ridge, steps, tol) for c in large for r in ys}
    totals: dict = {}
    try:
        while True:
            open_ = {k: f.beta for k, f in fits.items() if not f.done}
            if not open_:
                break

            def reduce(batches: Iterator[pd.DataFrame], open_=open_) -> Iterator[pd.DataFrame]:
                sums: dict = {}
                for batch in batches:
                    for c, raw, answers in zip(batch["cluster"], batch["x"], batch["y"]):
                        x = np.frombuffer(raw).reshape(-1, size)
                        for reward, y in zip(ys, np.frombuffer(answers).reshape(len(ys), -1)):
                            if (c, reward) not in open_:
                                continue
                            known = ~np.isnan(y)
                            if not known.any():
                                continue
                            loss, full, grad, hess = _sums(x[known], y[known], open_[c, reward])
                            row = np.concatenate([[known.sum(), y[known].sum(), loss, full], grad, hess[upper]])
                            sums[c, reward] = sums.get((c, reward), 0) + row
                for (c, reward), row in sums.items():
                    yield pd.DataFrame({"cluster": c, "reward": reward, "at": np.arange(len(row)), "s": row})

            kind = dict(rows.dtypes)["cluster"]
            partial = rows.mapInPandas(reduce, f"cluster {kind}, reward string, at int, s double")
            # Models x D² / 2 numbers, whatever the number of rows.
            summed = partial.groupBy("cluster", "reward", "at").agg(F.sum("s").alias("s")).toPandas()
            seen = set()
            for (c, reward), part in summed.groupby(["cluster", "reward"]):
                v = part.sort_values("at")["s"].to_numpy()
                hess = np.zeros((size, size))
                hess[upper] = v[4 + size :]
                hess = hess + np.triu(hess, 1).T
                fits[c, reward].feed(v[2], v[3], v[4 : 4 + size], hess)
                totals[c, reward] = (v[0], v[1])
                seen.add((c, reward))
            for key in open_:
                if key not in seen:
                    fits[key].done = True  # no row in these arms: the prior stays
    finally:
        rows.unpersist()
    out = []
    for (c, reward), fit in fits.items():
        n, hits = totals.get((c, reward), (0, 0))
        out.append({"cluster": c, **_model_row(reward, hits, n - hits, fit)})
    return out


def lin_mean_score(df: DataFrame, models: DataFrame, cluster: str, xs: Sequence[str], reward: str, out: str) -> DataFrame:
    """Add the model's mean log-odds ``beta · (1, x)`` as a native expression."""
    beta = models.filter(F.col("reward") == reward).select(cluster, F.col("beta").alias("_beta"))
    x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in xs])
    dot = F.aggregate(F.zip_with("_beta", x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(beta, cluster, "left").withColumn(out, dot).drop("_beta")


def lin_ts(
    df: DataFrame,
    models: DataFrame,
    cluster: str,
    key: str,
    xs: Sequence[str],
    rewards: Sequence[str],
    draws: int = 10,
    seed: int = 42,
    shared_seed: bool = True,
    model_numbers: int = MODEL_NUMBERS,
    chunk_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``<reward>_score``: sigmoid of x dotted with the mean of ``draws`` coefficient
    draws, times 1000, half-even. NULL for a cluster without a model.

    A model table of up to ``model_numbers`` numbers goes to every task. A larger one is
    sent by cluster to the chunks of at most about ``chunk_rows`` rows that need it.
    """
    size = len(xs) + 1
    names = [f"_x{i}" for i in range(len(xs))]
    scores = [f"{r}_score" for r in rewards]
    wanted = models.filter(F.col("reward").isin(list(rewards))).select(
        F.col(cluster).alias("_cluster"), "reward", "beta", "cov"
    )

    def score(batch: pd.DataFrame, table: Mapping) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=float)])
        seeds = batch["_seed"].to_numpy()
        out = {s: np.full(len(batch), np.nan) for s in scores}
        drawn = normals(seeds, size * draws).reshape(len(batch), draws, size).mean(axis=1)
        for at, reward in enumerate(rewards):
            if at and not shared_seed:
                drawn = normals(seeds, size * draws, at).reshape(len(batch), draws, size).mean(axis=1)
            for c, where in batch.groupby("_cluster").indices.items():
                if (c, reward) not in table:
                    continue
                beta, factor = table[c, reward]
                # x · (beta + L z) with L L' = cov, averaged over the draws z.
                odds = x[where] @ beta + ((x[where] @ factor) * drawn[where]).sum(axis=1)
                out[scores[at]][where] = np.around(1000 / (1 + np.exp(-np.clip(odds, -709, 709))))
        return pd.DataFrame(out)

    def factors(rows) -> dict:
        return {
            (r["_cluster"], r["reward"]): (
                np.asarray(r["beta"], dtype=float),
                np.linalg.cholesky(_positive_definite(np.array([list(v) for v in r["cov"]], dtype=float))),
            )
            for r in rows
        }

    inputs = [F.col(cluster).alias("_cluster"), _seed(key, seed, None).alias("_seed")] + [
        F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(xs, names)
    ]
    # Fitting is costly and the table is read twice: for its size and for its rows.
    wanted = wanted.persist(StorageLevel.MEMORY_AND_DISK)
    if wanted.count() * (size + size * size) <= model_numbers:
        shared = df.sparkSession.sparkContext.broadcast(factors(wanted.collect()))
        wanted.unpersist()

        @F.pandas_udf(", ".join(f"`{s}` double" for s in scores))
        def score_batch(rows: pd.DataFrame) -> pd.DataFrame:
            return score(rows, shared.value)

        scored = df.withColumn("_s", score_batch(F.struct(*inputs)))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_s.`{s}`").alias(s) for s in scores])

    # Every cluster is cut into chunks by key, so a hot one is spread too.
    most = df.groupBy(cluster).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chunks = -(-most // chunk_rows)
    left = df.withColumns({"_row": F.struct(*df.columns), "_chunk": F.pmod(_seed(key, seed, None), F.lit(chunks)).cast("int")})
    left = left.select(*inputs, "_chunk", "_row")
    right = wanted.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(int(chunks) - 1))))

    # Arrow tables hand the caller's row through as it is, whatever its types.
    def score_chunk(rows: pa.Table, model: pa.Table) -> pa.Table:
        found = score(rows.drop_columns(["_row"]).to_pandas(), factors(model.to_pylist()))
        return pa.table({"_row": rows["_row"]} | {s: pa.array(found[s], from_pandas=True) for s in scores})

    schema = StructType([StructField("_row", df.schema), *[StructField(s, DoubleType()) for s in scores]])
    done = left.groupBy("_cluster", "_chunk").cogroup(right.groupBy("_cluster", "_chunk")).applyInArrow(score_chunk, schema)
    return done.select("_row.*", *[f"`{s}`" for s in scores])
