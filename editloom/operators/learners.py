"""Learners of many groups at once on 0/1 features of short texts: ridge and logistic regression, boosted trees.

Rows of a group with the same text have the same features, so a group's rows are first summed to cells: text, training
rows and their sum of targets. A fit needs nothing else, and predictions go back to the rows by group and text.

Linear fits take one job a step for all groups: each task sums its cells' weighted products of features (numpy, a matrix a group),
the matrices are added by group, and each group's system is solved in a task. Trees of a group whose cells fit a worker are
grown there, many groups at once. In a larger group each level is one aggregation of gradients by node and feature,
for all such groups together, and the state between trees is a table in the shared folder. Both grow the same
trees: same sums, same gain, the first feature among those within a billionth of the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.operators import trees
from editloom.sources.shared import new_folder, removed, written

LETTERS = "ACGT"
#: Cells of a group beyond which its trees are grown over all tasks: in a worker a cell takes its text twice, numbers of its letters and some
#: ten doubles, as many as these about 130 MB.
FIT_CELLS = 640_000
#: Least gain of a split, and how near the best a gain is as good.
LEAST_GAIN, SAME_GAIN = 1e-15, 1e-9
# The learners go to executors within the tasks, so that these need not have this package.
cloudpickle.register_pickle_by_value(trees)


def cells(rows: DataFrame, by: list[str], context: str, target: str) -> DataFrame:
    """``by``, context, n and y: training rows and the sum of their targets. Rows without a target are left out."""
    train, y = F.col("split") == "train", F.col(target).cast("double")
    out = rows.where(y.isNotNull()).groupBy(*by, F.col(context).alias("context"))
    return out.agg(F.count_if(train).cast("double").alias("n"), F.coalesce(F.sum(F.when(train, y)), F.lit(0.0)).alias("y"))


def active(context: Column, letters: str = LETTERS) -> Column:
    """Numbers of the features that are 1: one a place, none where the letter is none of ``letters``."""
    letter = lambda i: F.instr(F.lit(letters), F.substring(context, i + 1, F.lit(1)))
    each = F.transform(F.sequence(F.lit(0), F.length(context) - 1), lambda i: F.when(letter(i) > 0, i * len(letters) + letter(i) - 1).otherwise(-1))
    return F.when(F.length(context) > 0, F.filter(each, lambda f: f >= 0)).otherwise(F.array().cast("array<int>"))


def feature_name(number: Column, letters: str = LETTERS) -> Column:
    """Place and letter of a feature's number; a negative one is the intercept."""
    name = F.concat(F.floor(number / len(letters)).cast("string"), F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1)))
    return F.when(number >= 0, name).otherwise("intercept")


def _schema(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def _sums(table: DataFrame, by: list[str], letters: str, held: dict[tuple, np.ndarray] | None) -> DataFrame:
    """``by``, sums: of each task's cells of a group the loss, the slopes and the matrix of weighted products of features and constant, one after
    another; for ridge (``held`` None) the products with the target stand for the slopes."""
    import pandas as pd

    def framed(found: dict[tuple, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame([(*k, v) for k, v in found.items()], columns=[*by, "sums"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(by, sort=False):
                x = np.column_stack([trees.encoded(part["context"], letters), np.ones(len(part))])
                n, y = part["n"].to_numpy(), part["y"].to_numpy()
                if held is None:
                    loss, slope, weight = 0.0, x.T @ y, n
                elif key not in held:
                    continue
                else:
                    score = x @ held[key]
                    p = trees.sigmoid(score)
                    loss, slope, weight = n @ np.logaddexp(0, score) - y @ score, x.T @ (n * p - y), n * p * (1 - p)
                told = np.concatenate([[loss], slope, (x.T @ (x * weight[:, None])).ravel()])
                found[key] = found[key] + told if key in found else told
            if len(found) > 2000:
                yield framed(found)
                found = {}
        if found:
            yield framed(found)

    return table.mapInPandas(partial, _schema(table, by) + "sums array<double>")


def _solved(table: DataFrame, by: list[str], letters: str, held: dict[tuple, np.ndarray] | None, penalty: float) -> DataFrame:
    """``by``, loss, steepest, solution: for ridge the coefficients; else, at the coefficients held, the loss, the largest slope and
    the Newton step. The last coefficient is the constant's, which isn't penalised."""
    import pandas as pd

    def solve(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        whole = trees.added(parts["sums"])
        loss, slope, left = trees.system(whole)
        alpha = np.append(np.full(len(slope) - 1, penalty), 0.0)
        if held is not None:
            w = held[key]
            loss, slope = loss + alpha @ w**2 / 2, slope + alpha * w
        solution = np.linalg.lstsq(left + np.diag(alpha), slope, rcond=None)[0]
        return pd.DataFrame([(*key, float(loss), float(np.abs(slope).max()), solution)], columns=[*by, "loss", "steepest", "solution"])

    return _sums(table, by, letters, held).groupBy(*by).applyInPandas(solve, _schema(table, by) + "loss double, steepest double, solution array<double>")


def ridge_curve(table: DataFrame, by: list[str], part: str, parts: int, letters: str = LETTERS, alpha: float = 1.0) -> DataFrame:
    """``by``, part, rows and w: ridge fits on the cells of parts 1, 1 and 2, and so on up to all ``parts``. Sums are taken by part, once
    a row, and added up from part to part; each group's systems are solved in a task."""
    import pandas as pd

    def solve(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        whole, out = 0.0, []
        for i in range(1, parts + 1):
            own = held.loc[held[part] == i, "sums"]
            whole = whole + trees.added(own) if len(own) else whole
            if np.ndim(whole):
                _, right, left = trees.system(whole)
                penalty = np.append(np.full(len(right) - 1, alpha), 0.0)
                out.append((*key, i, int(left[-1, -1]), np.linalg.lstsq(left + np.diag(penalty), right, rcond=None)[0]))
        return pd.DataFrame(out, columns=[*by, part, "rows", "w"])

    cells = table.where("n > 0").sortWithinPartitions(*by, part)
    return _sums(cells, [*by, part], letters, None).groupBy(*by).applyInPandas(solve, _schema(table, by) + f"`{part}` int, rows long, w array<double>")


def ridge_fits(table: DataFrame, by: list[str], letters: str = LETTERS, alpha: float = 1.0) -> DataFrame:
    """L3: ``by`` and w, the coefficients of the features and the constant, of the groups of ``cells`` with training rows."""
    return _solved(table.where("n > 0").sortWithinPartitions(*by), by, letters, None, alpha).select(*by, F.col("solution").alias("w"))


def logistic_fits(table: DataFrame, by: list[str], letters: str = LETTERS, penalty: float = 1.0, slope: float = 1e-8, most: int = 200) -> DataFrame:
    """``by`` and w, by damped Newton steps on reweighted sums, a job a step for all groups that have not come to rest.
    The driver holds the coefficients of every group. A group of one label has an infinite constant alone. ``table``, best a stored one, is
    first dealt by ranges of group and text, so that a task meets few groups and as many cells as any other."""
    folder = new_folder(table.sparkSession, "newton")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    train = written(table.where("n > 0").repartitionByRange(parts, *by, "context").sortWithinPartitions(*by), folder)
    sizes = train.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max(F.length("context")).alias("length")).collect()  # a row a group
    key = lambda r: tuple(r[c] for c in by)
    fits, trial = {}, {}
    for r in sizes:
        zero = np.zeros(r.length * len(letters) + 1)
        if 0 < r.y < r.n:
            trial[key(r)] = zero
        else:
            zero[-1] = np.inf if r.y else -np.inf
            fits[key(r)] = zero
    base: dict[tuple, tuple] = {}  # accepted coefficients, their loss, the step from them and its share
    for _ in range(most):
        if not trial:
            break
        for r in _solved(train, by, letters, trial, penalty).collect():
            k = key(r)
            # Near rest the losses differ by less than their own rounding.
            if k in base and r.loss > base[k][1] + 1e-12 * (1 + abs(base[k][1])) and base[k][3] > 1e-10:
                w, loss, step, share = base[k]
                base[k] = w, loss, step, share / 2
            elif r.steepest < slope:
                fits[k] = trial.pop(k)
                continue
            else:
                base[k] = trial[k], r.loss, np.array(r.solution), 1.0
            trial[k] = base[k][0] - base[k][3] * base[k][2]
    removed(train.sparkSession, folder)
    fits |= {k: base[k][0] for k in trial}
    return table.sparkSession.createDataFrame([(*k, w.tolist()) for k, w in fits.items()], _schema(table, by) + "w array<double>")


def linear(context: Column, w: Column, letters: str = LETTERS) -> Column:
    """The constant and the coefficients of the features that are 1."""
    return F.aggregate(active(context, letters), F.element_at(w, -1), lambda a, f: a + F.get(w, f))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ridge_slopes(table: DataFrame, by: list[str], fits: DataFrame, letters: str = LETTERS, alpha: float = 1.0) -> DataFrame:
    """``by``, feature, residual: what ridge fits leave of their normal equations."""
    return _slopes(table, by, fits, lambda score, n, y: n * score - y, letters, alpha)


def curve_slopes(table: DataFrame, by: list[str], part: str, parts: int, fits: DataFrame, letters: str = LETTERS, alpha: float = 1.0) -> DataFrame:
    """``by``, part, feature, residual: what the fits of ``ridge_curve`` leave of their normal equations on all the cells that each was given. A
    cell meets the fits of its own and of all later parts where it lies."""
    later = lambda key: [(*key[:-1], i) for i in range(key[-1], parts + 1)]
    return _slopes(table, [*by, part], fits, lambda score, n, y: n * score - y, letters, alpha, later)


def logistic_slopes(table: DataFrame, by: list[str], fits: DataFrame, letters: str = LETTERS, penalty: float = 1.0) -> DataFrame:
    """``by``, feature, residual: the slope of the penalised loss that a fit leaves, of groups with both labels."""
    told = fits.where(F.abs(F.element_at("w", -1)) < float("inf"))
    return _slopes(table, by, told, lambda score, n, y: n * trees.sigmoid(score) - y, letters, penalty)


def _slopes(table: DataFrame, by: list[str], fits: DataFrame, left: Callable, letters: str, penalty: float, met: Callable[[tuple], list[tuple]] = lambda key: [key]) -> DataFrame:
    """``by``, feature, residual, of the features that a group has. The driver holds the coefficients of every group; ``met`` gives the
    groups whose fits a cell counts for, and tasks give out sums a group and feature, never a row a cell."""
    import pandas as pd

    held = {tuple(r[c] for c in by): np.array(r["w"]) for r in fits.select(*by, "w").collect()}  # a row a group

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(by, sort=False):
                keys = [k for k in met(key) if k in held]
                if not keys:
                    continue
                x = np.column_stack([trees.encoded(part["context"], letters), np.ones(len(part))])
                score = x @ np.column_stack([held[k] for k in keys])
                slopes, seen = x.T @ left(score, part[["n"]].to_numpy(), part[["y"]].to_numpy()), x.sum(0)
                for k, slope in zip(keys, slopes.T):
                    told = np.concatenate([slope, seen])
                    found[k] = found[k] + told if k in found else told
        if found:
            yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=[*by, "sums"])

    def named(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        slope, seen = np.split(trees.added(parts["sums"]), 2)
        slope[:-1] += penalty * held[key][:-1]
        name = lambda i: "intercept" if i == len(slope) - 1 else f"{i // len(letters)}{letters[i % len(letters)]}"
        return pd.DataFrame([(*key, name(i), slope[i]) for i in np.flatnonzero(seen).tolist()], columns=[*by, "feature", "residual"])

    cells = table.where("n > 0").select(*by, "context", "n", "y").sortWithinPartitions(*by)
    sums = cells.mapInPandas(partial, _schema(table, by) + "sums array<double>")
    return sums.groupBy(*by).applyInPandas(named, _schema(table, by) + "feature string, residual double")


def _best(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f, n, gain: the best split of each node, f null where none gains. ``hist``: keys, f, n1, s1; f = -1 is the whole node."""
    parts = hist.groupBy(*keys).agg(F.max(F.when(F.col("f") < 0, F.struct("n1", "s1"))).alias("all"), F.collect_list(F.when(F.col("f") >= 0, F.struct("f", "n1", "s1"))).alias("fs"))  # at most the features

    def gain(e: Column) -> Column:
        n, s = F.col("all.n1"), F.col("all.s1")
        n0, s0 = n - e["n1"], s - e["s1"]
        return F.when((e["n1"] > 0) & (n0 > 0), e["n1"] * n0 / n * F.pow(e["s1"] / e["n1"] - s0 / n0, F.lit(2))).otherwise(0.0)

    told = parts.withColumn("gains", F.transform("fs", lambda e: F.struct(e["f"].alias("f"), gain(e).alias("gain"))))
    told = told.withColumn("most", F.coalesce(F.array_max(F.transform("gains", lambda e: e["gain"])), F.lit(0.0)))
    first = F.array_min(F.transform(F.filter("gains", lambda e: e["gain"] >= F.col("most") * (1 - SAME_GAIN)), lambda e: e["f"]))
    return told.select(*keys, F.when(F.col("most") > LEAST_GAIN, first).alias("f"), F.col("all.n1").alias("n"), F.col("most").alias("gain"))


def level_splits(rows: DataFrame, by: list[str]) -> DataFrame:
    """The best split of every node of ``rows`` (by, node, active, n, r): one aggregation by group, node and feature."""
    each = rows.where("n > 0").select(*by, "node", "n", "r", F.explode(F.concat("active", F.array(F.lit(-1)))).alias("f"))
    return _best(each.groupBy(*by, "node", "f").agg(F.sum("n").alias("n1"), F.sum("r").alias("s1")), [*by, "node"])


def _down(rows: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Every row in the child that the split of its node sends it to; without a split, the left one."""
    side = F.coalesce(F.array_contains("active", F.col("f")).cast("int"), F.lit(0))
    return rows.join(splits.select(*by, "node", "f"), [*by, "node"], "left").withColumn("node", 2 * F.col("node") + side).drop("f")


def first_tree(table: DataFrame, by: list[str], letters: str = LETTERS, depth: int = 3) -> DataFrame:
    """L4: ``by``, node (the root is 1, the children of k are 2k and 2k + 1), f, n, gain: the splits of each group's first regression tree."""
    table = table.where("n > 0")
    mean = table.groupBy(*by).agg((F.sum("y") / F.sum("n")).alias("mean"))
    rows = table.join(mean, by).select(*by, active(F.col("context"), letters).alias("active"), "n", (F.col("y") - F.col("n") * F.col("mean")).alias("r"), F.lit(1).alias("node"))
    folder, out = new_folder(table.sparkSession, "tree"), None
    for level in range(depth):
        rows = written(rows, f"{folder}/rows-{level}")
        splits = written(level_splits(rows, by), f"{folder}/splits-{level}")
        out = splits if out is None else out.unionByName(splits)
        rows = _down(rows, splits, by)
    return out


def boosted_large(table: DataFrame, by: list[str], classify: bool, letters: str = LETTERS, count: int = 100, depth: int = 3, step: float = 0.1) -> DataFrame:
    """L4, L6 for groups beyond a worker: ``by``, context, predicted. A level is one job that sends a row a node to the driver; the
    scores after each tree are a table of their own, so a lost executor costs no earlier tree."""
    spark = table.sparkSession
    folder = new_folder(spark, "boost")
    mean = table.groupBy(*by).agg(F.try_divide(F.sum("y"), F.sum("n")).alias("mean"))
    start = F.when(F.col("mean") > 0, F.when(F.col("mean") < 1, F.ln(F.col("mean") / (1 - F.col("mean")))).otherwise(F.lit(float("inf")))).otherwise(F.lit(float("-inf"))) if classify else F.col("mean")
    state = table.join(mean.where("mean is not null"), by).select(*by, "context", active(F.col("context"), letters).alias("active"), "n", "y", start.alias("score"))
    state = written(state, f"{folder}/tree-0")
    kinds = _schema(table, by)
    for tree in range(1, count + 1):
        p = expit(F.col("score")) if classify else F.col("score")
        base = F.col("n") * p * (1 - p) if classify else F.col("n")
        rows = state.withColumns({"r": F.col("y") - F.col("n") * p, "h": base, "node": F.lit(0)})
        for _ in range(depth):
            found = level_splits(rows, by).collect()  # a row a node of each large group
            splits = spark.createDataFrame([tuple(r[c] for c in [*by, "node", "f"]) for r in found], kinds + "node int, f int")
            rows = _down(rows, F.broadcast(splits), by)
        sums = rows.where("n > 0").groupBy(*by, "node").agg(F.sum("r").alias("r"), F.sum("h").alias("h")).collect()  # likewise
        leaves = spark.createDataFrame([(*(s[c] for c in by), s.node, step * s.r / s.h if s.h > 1e-150 else 0.0) for s in sums], kinds + "node int, leaf double")
        moved = rows.join(F.broadcast(leaves), [*by, "node"], "left").withColumn("score", F.col("score") + F.coalesce("leaf", F.lit(0.0)))
        state = written(moved.select(*state.columns), f"{folder}/tree-{tree}")
        removed(spark, f"{folder}/tree-{tree - 1}")
    return state.select(*by, "context", (expit(F.col("score")) if classify else F.col("score")).alias("predicted"))


def boosted(table: DataFrame, by: list[str], classify: bool, letters: str = LETTERS, fit_cells: int = FIT_CELLS, count: int = 100) -> DataFrame:
    """``by``, context, predicted from 100 trees of depth 3 with step 0.1, of the groups of ``cells`` with training rows."""
    import pyarrow as pa

    def fit(group: pa.Table) -> pa.Table:
        # Sorted cells: sums do not depend on how they were partitioned.
        group = group.sort_by("context")
        n, y = group.column("n").to_numpy(), group.column("y").to_numpy()
        found = trees.boosted_texts(trees.letters_of(group.column("context")), letters, n, y, classify, count) if n.any() else np.full(len(n), None)
        return group.select([*by, "context"]).append_column("predicted", pa.array(found, pa.float64()))

    schema = _schema(table, by) + "context string, predicted double"
    large = table.groupBy(*by).agg(F.count("*").alias("cells")).where(F.col("cells") > fit_cells).select(*by).collect()  # at most cells / fit_cells
    if not large:
        return table.groupBy(*by).applyInArrow(fit, schema)
    names = F.broadcast(table.sparkSession.createDataFrame([tuple(r) for r in large], _schema(table, by)[:-2]))
    small = table.join(names, by, "left_anti").groupBy(*by).applyInArrow(fit, schema)
    return small.unionByName(boosted_large(table.join(names, by, "left_semi"), by, classify, letters, count))


def learn_groups(df: DataFrame, by: list[str], kind: str, context: str, target: str, letters: str = LETTERS, fit_cells: int = FIT_CELLS, count: int = 100) -> DataFrame:
    """All rows with a target, with ``predicted`` from one learner a group of ``by``, fitted on its rows of split 'train'.
    Features are 0/1 of ``context``, of one length within a group. Nothing is predicted in a group without training rows.
    ``kind``: ridge (alpha = 1), logistic (L2, C = 1), gbt_regressor or gbt_classifier (100 trees of depth 3, step 0.1)."""
    folder = new_folder(df.sparkSession, "learn")
    rows = written(df.where(F.col(target).isNotNull()), f"{folder}/rows")
    table = written(cells(rows, by, context, target), f"{folder}/cells")
    if kind in ("gbt_regressor", "gbt_classifier"):
        told = boosted(table, by, kind == "gbt_classifier", letters, fit_cells, count)
        return rows.join(told.withColumnRenamed("context", context), [*by, context], "left")
    fits = ridge_fits(table, by, letters) if kind == "ridge" else logistic_fits(table, by, letters)
    score = linear(F.col(context), F.col("w"), letters)
    return rows.join(fits, by, "left").withColumn("predicted", score if kind == "ridge" else expit(score)).drop("w")
