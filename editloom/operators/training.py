"""Training sets: which cells, targets and features each family of models is fitted on.

A driver is a row of parameters, so one job forms the sets of all drivers and conditions; conditions
pick their drivers by their editor's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators.models import NTS, one_hot

#: Driver, editor kind, class, substitutions in it, first and last position, context radius.
DRIVERS = [
    ("efficiency", "CBE", "C_G", ["C_G"], 3, 8, 10),
    ("efficiency", "CBE", "C_A", ["C_A"], 3, 8, 10),
    ("efficiency", "CBE", "C_GA", ["C_G", "C_A"], 3, 8, 10),
    ("efficiency", "CBE", "C_T", ["C_T"], 3, 8, 10),
    ("efficiency", "CBE", "C_TGA", ["C_T", "C_G", "C_A"], 3, 8, 10),
    ("opposite", "CBE", "G_A", ["G_A"], -4, 0, 6),
    ("opposite", "CBE", "G_ACT", ["G_A", "G_C", "G_T"], -4, 0, 6),
    ("opposite_context", "CBE", "G_A", ["G_A"], -4, 0, 5),
    ("opposite_context", "CBE", "G_ACT", ["G_A", "G_C", "G_T"], -4, 0, 5),
    ("six_mer", "CBE", "C_G", ["C_G"], 6, 6, 10),
    ("six_mer", "CBE", "C_A", ["C_A"], 6, 6, 10),
    ("six_mer", "CBE", "C_GA", ["C_G", "C_A"], 6, 6, 10),
    ("six_mer", "CBE", "C_T", ["C_T"], 6, 6, 10),
    ("six_mer", "CBE", "C_TGA", ["C_T", "C_G", "C_A"], 6, 6, 10),
    ("efficiency", "ABE", "A_G", ["A_G"], 4, 8, 10),
    ("efficiency", "ABE", "A_CT", ["A_C", "A_T"], 4, 8, 10),
    ("efficiency", "ABE", "C_GT", ["C_G", "C_T"], 4, 8, 10),
    ("efficiency", "ABE", "C_G", ["C_G"], 4, 8, 10),
    ("efficiency", "ABE", "C_T", ["C_T"], 4, 8, 10),
    ("efficiency", "ABE", "C_TGA", ["C_T", "C_G", "C_A"], 4, 8, 10),
]
#: Outcome fractions among substitutions of C, numerator and denominator.
FRACTIONS = {
    "C_GA_over_C_D": (["C_G", "C_A"], ["C_T", "C_G", "C_A"]),
    "C_T_over_C_D": (["C_T"], ["C_T", "C_G", "C_A"]),
    "C_G_over_C_D": (["C_G"], ["C_T", "C_G", "C_A"]),
    "C_A_over_C_D": (["C_A"], ["C_T", "C_G", "C_A"]),
    "C_G_over_C_GA": (["C_G"], ["C_A", "C_G"]),
}


def training_rows(freq: DataFrame, sites: DataFrame, kinds: DataFrame, drivers: list[tuple] = DRIVERS) -> DataFrame:
    """Per driver, class, condition, site and position the class's frequency and the local context.

    ``freq`` has a row a cell, zeros included; ``kinds`` gives a condition's kind. Cells whose context
    reaches past the sequence are left out.
    """
    rows = [(d, kind, c, s, lo, hi, r) for d, kind, c, subs, lo, hi, r in drivers for s in subs]
    table = freq.sparkSession.createDataFrame(rows, "driver string, kind string, class string, substitution string, first int, last int, radius int")
    members = F.broadcast(kinds.select("condition", "kind").join(F.broadcast(table), "kind"))
    cells = freq.withColumn("substitution", F.concat_ws("_", "ref_nt", "obs_nt")).join(members, ["condition", "substitution"])
    cells = cells.where(F.col("position").between(F.col("first"), F.col("last"))).join(sites.select("site", "seq"), "site")
    cells = cells.withColumn("context", seq.context(F.col("seq"), F.col("idx"), F.col("radius"))).where("context is not null")
    # Sums in another order miss 1 by rounding, and a logit of what misses it would be a row of its own.
    whole = F.when(F.sum("frequency") > 1 - 1e-12, 1.0).otherwise(F.sum("frequency"))
    return cells.groupBy("driver", "class", "condition", "site", "position", "context").agg(whole.alias("frequency"))


def pivot_substitutions(freq: DataFrame, ref_nt: str = "C") -> DataFrame:
    """R2: one column a substitution of ``ref_nt``, the mean frequency of the site's position, 0 where it was not seen."""
    names = [f"{ref_nt}_{n}" for n in NTS if n != ref_nt]
    rows = freq.where((F.col("ref_nt") == ref_nt) & (F.col("obs_nt") != ref_nt)).withColumn("substitution", F.concat_ws("_", "ref_nt", "obs_nt"))
    return rows.groupBy("condition", "site", "position").pivot("substitution", names).agg(F.avg("frequency")).na.fill(0.0, names)


def outcome_fractions(freq: DataFrame, fractions: dict[str, tuple[list[str], list[str]]] = FRACTIONS) -> DataFrame:
    """Outcome fractions among substitutions of C in long form; a fraction of nothing is left out."""
    def add(names: list[str]) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0]))

    wide = pivot_substitutions(freq)
    shares = F.explode(F.array(*[F.struct(F.lit(name).alias("fraction"), F.try_divide(add(top), add(base)).alias("value")) for name, (top, base) in fractions.items()]))
    return wide.select("condition", "site", "position", shares.alias("s")).select("condition", "site", "position", "s.fraction", "s.value").where("value is not null")


def with_position(features: Column, position: Column, positions: range) -> Column:
    """L1: context features and one 0/1 a position."""
    return F.concat(features, F.array(*[F.when(position == p, 1.0).otherwise(0.0) for p in positions]))


def scaled_by_position(rows: DataFrame, by: list[str], value: str = "frequency") -> DataFrame:
    """``scaled``, the value less its position's mean over its deviation (of the whole), among rows above 0; null for the others and
    where a position's values don't vary. Means and deviations are one aggregation, joined back."""
    above = rows.where(F.col(value) > 0).groupBy(*by, "position").agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    score = F.when((F.col(value) > 0) & (F.col("__std") > 0), (F.col(value) - F.col("__mean")) / F.col("__std"))
    return rows.join(above, [*by, "position"], "left").withColumn("scaled", score).drop("__mean", "__std")


def with_combined(rows: DataFrame, column: str = "celltype", name: str = "Combined") -> DataFrame:
    """Every row once under its own cell type and once under all of them together."""
    return rows.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def split_counts(rows: DataFrame, by: list[str], target: str = "site") -> DataFrame:
    """Rows and distinct targets, of all and of either split, beside a motif table's coefficients. Rows are first counted by
    target and split, so that no task holds a group's targets."""
    each = rows.groupBy(*by, target).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    return each.groupBy(*by).agg(
        F.sum(F.col("a") + F.col("b")).alias("rows"), F.sum("a").alias("train_rows"), F.sum("b").alias("test_rows"),
        F.count("*").alias("targets"), F.count_if(F.col("a") > 0).alias("train_targets"), F.count_if(F.col("b") > 0).alias("test_targets"),
    )


def window_features(window: Column, length: int = 30) -> Column:
    """L1: 0/1 for each place and nucleotide of the window, and the counts of A, C, G and T in it."""
    return F.concat(one_hot(window, length), F.array(*[seq.count_in(window, n).cast("double") for n in NTS]))


def window_names(length: int = 30, first: int = -9) -> list[str]:
    return [f"{first + i}{n}" for i in range(length) for n in NTS] + [f"Num. {n}" for n in NTS]


def design_stats(sites: DataFrame, found: DataFrame, key: str | list[str] = "site") -> DataFrame:
    """The design and its measurements, rows of either side kept, and which side a row is from."""
    left = sites.withColumn("designed", F.lit(True))
    right = found.withColumn("measured", F.lit(True))
    return left.join(right, key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("designed", "measured")})


def labelled(df: DataFrame, sites: DataFrame, labels: list[str], without: list[str] = ()) -> DataFrame:
    """Rows of sites with one of the design labels and none of those flagged."""
    keep = sites.where(F.col("category").isin(*labels))
    return df.join((keep.where(~F.col("category").isin(*without)) if without else keep).select("site"), "site", "left_semi")


def with_prefix(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """every column but the keys renamed by a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def reliable(g4: DataFrame, out: tuple[int, ...] = (21, 22, 23)) -> DataFrame:
    """without the positions whose counts are not to be trusted."""
    return g4.where(~F.col("position").isin(*out))


def error_rate(quality: Column, default: float = 30.0) -> Column:
    """X11: the chance of a wrong call from a Phred score."""
    return F.pow(F.lit(10.0), -F.coalesce(quality.cast("double"), F.lit(default)) / 10)
