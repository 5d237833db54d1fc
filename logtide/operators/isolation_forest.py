"""Isolation forest over the per-IP feature matrix, as a distributed job.

Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008). Spark MLlib has no
isolation forest, so the job is composed from DataFrame operators:

1. The feature matrix (one row per IP) is checkpointed to the session's
   checkpoint directory: it is read by sampling, scoring and the offset.
2. Sampling without replacement, per tree: every IP draws a uniform hash
   ``u(ip, tree, seed)`` for each tree JVM-side (``filter`` over
   ``sequence``); IPs under a rate of about 3*psi/n are kept for that tree,
   and the tree keeps its psi smallest draws. The exploded sample has about
   3*psi*T rows, whatever the number of IPs. A tree that drew fewer than psi
   candidates is redrawn with a higher rate, so each tree gets exactly
   min(psi, n) IPs.
3. ``groupBy('tree').applyInPandas`` grows each tree from at most psi rows
   (random non-constant feature, uniform split, height limit ceil(log2 psi)).
4. The forest (at most T * (2 psi - 1) nodes, fixed by the parameters, not
   by the data) is broadcast, and ``mapInPandas`` scores every IP in Arrow
   batches with a vectorised walk of all trees.
5. ``s = 2^(-E[h] / c(psi))``; the offset is the ``contamination`` quantile
   of ``-s`` (exact, see ``exact_quantile``); decision = -s - offset;
   raw_score = -1 when decision < 0.

Features are not standardised: split choice is invariant to a positive
affine change of a feature, so the scores have the same distribution.
Results are deterministic for a seed and independent of partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import half_even
from ..functions.quantile import exact_quantile
from ..session import ensure_checkpoint_dir
from ..sinks.writers import write_parquet
from .ip_features import FEATURE_NAMES, ip_feature_matrix

EULER_GAMMA = 0.5772156649
NODE_VALUES = ("feature", "threshold", "left_child", "right_child", "leaf_depth")
MODEL_PARAMS = ("psi", "n", "max_depth", "offset", "contamination", "seed")
NODE_TABLE = "tree int, node int, feature int, threshold double, left_child int, right_child int, leaf_depth double"
PARAM_TABLE = ("psi int, n long, max_depth int, offset double, contamination double, seed long, n_estimators int, "
               "features array<string>")
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, "
               "right_child int, leaf_depth double, sample_size int")


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, leaf_depth) of one tree."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        node_id = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = node_id
        sub = x[idx]
        split_feature = -1
        if depth < max_depth and len(idx) > 1:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            candidates = np.flatnonzero(hi > lo)
            if len(candidates):
                split_feature = int(candidates[rng.integers(len(candidates))])
        if split_feature < 0:
            leaf_depth = depth + float(average_path_length(float(len(idx))))
            nodes.append([node_id, -1, 0.0, -1, -1, leaf_depth])
            continue
        a, b = lo[split_feature], hi[split_feature]
        threshold = rng.uniform(a, b)
        if threshold >= b:
            threshold = a
        nodes.append([node_id, split_feature, float(threshold), -1, -1, 0.0])
        go_left = sub[:, split_feature] <= threshold
        stack.append((idx[~go_left], depth + 1, node_id, True))
        stack.append((idx[go_left], depth + 1, node_id, False))
    return [tuple(n) for n in nodes]


def _tree_builder(psi: int, seed: int, features: tuple[str, ...]):
    max_depth = max(1, int(math.ceil(math.log2(max(psi, 2)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["u", "ip"], kind="mergesort").head(psi)
        x = pdf[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        rows = _grow_tree(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left_child",
                                          "right_child", "leaf_depth"])
        out.insert(0, "tree", tree)
        out["sample_size"] = len(pdf)
        return out[["tree", "node", "feature", "threshold", "left_child", "right_child",
                    "leaf_depth", "sample_size"]]

    return build


def _uniform_hash(ip, tree, seed: int):
    """Uniform draw in [0, 1) from (ip, tree, seed), computed JVM-side."""
    h = F.xxhash64(ip, tree, F.lit(seed))
    return (F.abs(h % F.lit(1 << 53))).cast("double") / F.lit(float(1 << 53))


def fit_forest(feats: DataFrame, n_estimators: int = 200, max_samples: int = 256,
               seed: int = 42, features: tuple[str, ...] = FEATURE_NAMES) -> dict:
    """Grow the forest on a (checkpointed) feature matrix; returns numpy arrays."""
    n = feats.count()
    if n == 0:
        raise ValueError("no IPs to fit the forest on")
    psi = int(min(max_samples, n))
    rate = min(1.0, 3.0 * psi / max(n, 1))
    while True:
        trees = F.sequence(F.lit(0), F.lit(n_estimators - 1))
        picked = F.filter(trees, lambda t: _uniform_hash(F.col("ip"), t, seed) < F.lit(rate))
        sample = (feats.select("ip", *features, F.explode(picked).alias("tree"))
                  .withColumn("u", _uniform_hash(F.col("ip"), F.col("tree"), seed)))
        # The sample is small (about 3*psi*T rows) at any data size, so AQE
        # would coalesce it into one task; an explicit repartition on the
        # tree id keeps the trees growing in parallel, and the grouping below
        # reuses that partitioning (no second shuffle).
        parallel = max(1, min(n_estimators, feats.sparkSession.sparkContext.defaultParallelism))
        nodes = (sample.repartition(parallel, "tree").groupBy("tree")
                 .applyInPandas(_tree_builder(psi, seed, features), NODE_SCHEMA)
                 .toPandas())
        sizes = nodes.groupby("tree")["sample_size"].first() if len(nodes) else pd.Series(dtype=int)
        if len(sizes) == n_estimators and (sizes >= psi).all():
            break
        if rate >= 1.0:
            break
        rate = min(1.0, rate * 2.0)
    width = int(nodes.groupby("tree")["node"].max().max()) + 1
    shape = (n_estimators, width)
    arrays = {k: np.zeros(shape, dtype=float if k in ("threshold", "leaf_depth") else np.int32)
              for k in ("feature", "threshold", "left_child", "right_child", "leaf_depth")}
    arrays["feature"][:] = -1
    t, i = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    for k in arrays:
        arrays[k][t, i] = nodes[k].to_numpy()
    arrays["psi"] = psi
    arrays["n"] = n
    arrays["max_depth"] = max(1, int(math.ceil(math.log2(max(psi, 2)))))
    return arrays


def _scorer(bc, features: tuple[str, ...]):
    def score(batches):
        m = bc.value
        feat, thr = m["feature"], m["threshold"]
        left, right, leaf = m["left_child"], m["right_child"], m["leaf_depth"]
        n_trees = feat.shape[0]
        c_psi = float(average_path_length(float(m["psi"])))
        tree_ix = np.arange(n_trees)[None, :]
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(anomaly_score=pd.Series(dtype=float))
                continue
            x = pdf[list(features)].to_numpy(dtype=float)
            node = np.zeros((len(x), n_trees), dtype=np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(m["max_depth"] + 1):
                f = feat[tree_ix, node]
                inner = f >= 0
                if not inner.any():
                    break
                xv = x[rows, np.where(inner, f, 0)]
                nxt = np.where(xv <= thr[tree_ix, node], left[tree_ix, node], right[tree_ix, node])
                node = np.where(inner, nxt, node)
            depth = leaf[tree_ix, node].mean(axis=1)
            s = np.power(2.0, -depth / c_psi) if c_psi > 0 else np.full(len(x), 0.5)
            yield pdf.assign(anomaly_score=s)
    return score


def _no_rows(feats: DataFrame) -> DataFrame:
    return feats.sparkSession.createDataFrame([], T.StructType(feats.schema.fields + [
        T.StructField("raw_score", T.IntegerType()), T.StructField("decision_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType())]))


def _scored(feats: DataFrame, model: dict) -> DataFrame:
    bc = feats.sparkSession.sparkContext.broadcast(model)
    scored_schema = T.StructType(feats.schema.fields + [T.StructField("anomaly_score", T.DoubleType())])
    return feats.mapInPandas(_scorer(bc, FEATURE_NAMES), scored_schema)


def _offset(scored: DataFrame, contamination: float, n: int) -> float:
    return exact_quantile(scored.select((-F.col("anomaly_score")).alias("neg_score")), "neg_score", contamination, n=n)


def _decided(scored: DataFrame, offset: float) -> DataFrame:
    decision = -F.col("anomaly_score") - F.lit(offset)
    return (scored
            .withColumn("raw_score", F.when(decision < 0, F.lit(-1)).otherwise(F.lit(1)))
            .withColumn("decision_score", half_even(decision, 4))
            .withColumn("is_anomaly", F.col("raw_score") == -1)
            .drop("anomaly_score")
            .orderBy(F.desc("is_anomaly"), F.asc("decision_score"), F.asc("ip")))


def isolation_forest(df: DataFrame, contamination: float = 0.05, n_estimators: int = 200,
                     max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Per-IP features plus raw_score (-1 outlier / 1 inlier), decision_score
    (4 dp) and is_anomaly; outliers first, then by decision_score.

    Fewer than 10 log rows give an empty result with the same columns.
    """
    feats = ip_feature_matrix(df)
    if len(df.select("ip").take(10)) < 10:
        return _no_rows(feats)
    ensure_checkpoint_dir(df.sparkSession)
    feats = feats.checkpoint(eager=True)
    if feats.isEmpty():                      # e.g. every row has a null IP
        return _no_rows(feats)
    model = fit_forest(feats, n_estimators, max_samples, seed)
    scored = _scored(feats, model).checkpoint(eager=True)  # the offset search reads the scores several times
    return _decided(scored, _offset(scored, contamination, model["n"]))  # every IP gets a score


# --- a fitted model that scores other logs ----------------------------------

def fit_model(df: DataFrame, contamination: float = 0.05, n_estimators: int = 200, max_samples: int = 256,
              seed: int = 42) -> dict:
    """Forest and offset of a log: what ``isolation_forest`` fits on it.

    Scoring the same log with ``score_log`` gives the same table. Raises
    ValueError where ``isolation_forest`` would be empty for want of rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if len(df.select("ip").take(10)) < 10:
        raise ValueError("fewer than 10 rows to fit the forest on")
    feats = ip_feature_matrix(df).checkpoint(eager=True)
    model = fit_forest(feats, n_estimators, max_samples, seed)
    scored = _scored(feats, model).checkpoint(eager=True)
    return model | {"offset": _offset(scored, contamination, model["n"]), "contamination": contamination, "seed": seed}


def score_log(df: DataFrame, model: dict) -> DataFrame:
    """``isolation_forest``'s columns for the IPs of another log, by a fitted
    model: outliers lie beyond the offset of the log that it was fitted on."""
    return _decided(_scored(ip_feature_matrix(df), model), model["offset"])


def model_tables(spark: SparkSession, model: dict) -> tuple[DataFrame, DataFrame]:
    """The model as rows: its nodes (tree, node, feature, threshold,
    left_child, right_child, leaf_depth) and one row of parameters."""
    used = np.zeros(model["feature"].shape, dtype=bool)
    used[:, 0] = True
    for tree, node in zip(*np.nonzero(model["feature"] >= 0)):  # the forest's size is fixed by its parameters
        used[tree, model["left_child"][tree, node]] = used[tree, model["right_child"][tree, node]] = True
    tree, node = np.nonzero(used)
    nodes = pd.DataFrame({"tree": tree, "node": node, **{k: model[k][tree, node] for k in NODE_VALUES}})
    params = {k: model[k] for k in MODEL_PARAMS}
    return (spark.createDataFrame(nodes, NODE_TABLE),
            spark.createDataFrame([(*params.values(), len(used), list(FEATURE_NAMES))], PARAM_TABLE))


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Write the model as two Parquet tables under ``path``."""
    nodes, params = model_tables(spark, model)
    write_parquet(nodes, f"{path.rstrip('/')}/nodes")
    write_parquet(params, f"{path.rstrip('/')}/params")  # last: a model without parameters is not finished


def load_model(spark: SparkSession, path: str) -> dict:
    """A model that ``save_model`` wrote."""
    return model_from(spark.read.parquet(f"{path.rstrip('/')}/nodes"), spark.read.parquet(f"{path.rstrip('/')}/params"))


def model_from(nodes: DataFrame, params: DataFrame) -> dict:
    """The model of ``model_tables``; its nodes number 2 * psi - 1 a tree at most."""
    row = params.first().asDict()
    if tuple(row["features"]) != FEATURE_NAMES:
        raise ValueError(f"the model was fitted on {row['features']}, the features here are {list(FEATURE_NAMES)}")
    found = nodes.toPandas()
    shape = (row["n_estimators"], int(found["node"].max()) + 1)
    model = {k: np.zeros(shape, dtype=float if k in ("threshold", "leaf_depth") else np.int32) for k in NODE_VALUES}
    model["feature"][:] = -1
    for k in NODE_VALUES:
        model[k][found["tree"], found["node"]] = found[k]
    return model | {k: row[k] for k in MODEL_PARAMS}
