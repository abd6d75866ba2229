"""Position-wise counts (g4): long rows of condition, site, idx, position, ref_nt, obs_nt, count.

A null count is a cell that a batch filter removed. ``role`` T is treatment, C control.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.operators.ranges import order_statistics

NTS = ("A", "C", "G", "T")
CELL = ["condition", "site", "idx"]


def treatment_control_status(design: DataFrame, treated: DataFrame, controlled: DataFrame) -> DataFrame:
    """Condition, site, status of each designed site: No treatment, No control or Adjusted."""
    keys = ["condition", "site"]
    t = treated.select(*keys).distinct().withColumn("__t", F.lit(True))
    c = controlled.select(*keys).distinct().withColumn("__c", F.lit(True))
    status = F.when(F.col("__t").isNull(), "No treatment").when(F.col("__c").isNull(), "No control").otherwise("Adjusted")
    return design.join(t, keys, "left").join(c, keys, "left").select(*keys, status.alias("status"))


def matrix(g4: DataFrame, keys: list[str]) -> DataFrame:
    """Counts as ARRAY<STRUCT<idx, STRUCT<a, c, g, t>>> in order of idx (the ingest shape)."""
    wide = g4.groupBy(*keys, "idx").agg(*[F.coalesce(F.sum(F.when(F.col("obs_nt") == n, F.col("count"))), F.lit(0.0)).alias(n.lower()) for n in NTS])
    cells = F.array_sort(F.collect_list(F.struct("idx", F.struct("a", "c", "g", "t").alias("cell"))))  # a site's positions
    return wide.groupBy(*keys).agg(cells.alias("cells"))


def long_from_matrix(wide: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell other than the reference's; ``sites`` has site, seq, pos0_idx."""
    rows = wide.join(sites.select("site", "seq", "pos0_idx"), "site").select(*keys, "seq", "pos0_idx", F.inline("cells"))
    rows = rows.withColumn("ref_nt", F.substring(F.col("seq"), F.col("idx") + 1, F.lit(1)))
    pairs = F.array(*[F.struct(F.lit(n).alias("obs_nt"), F.col("cell")[n.lower()].alias("count")) for n in NTS])
    rows = rows.withColumn("pair", F.explode(pairs)).where("pair.obs_nt <> ref_nt")
    return rows.select(*keys, "idx", (F.col("idx") - F.col("pos0_idx")).alias("position"), "ref_nt", F.col("pair.obs_nt").alias("obs_nt"), F.col("pair.count").alias("count"))


def total(value: str, by: list[str], nan_total: str = "skip") -> Column:
    """A total over ``by``; with ``propagate`` one removed cell removes it."""
    w = Window.partitionBy(*by)
    whole = F.sum(value).over(w)
    return whole if nan_total == "skip" else F.when(F.count(F.when(F.col(value).isNull(), 1)).over(w) == 0, whole)


def frequencies(g4: DataFrame, keys: list[str] = CELL, depth: float = 0, nan_total: str = "skip") -> DataFrame:
    """A1, F1: total and frequency of each cell of positions with at least ``depth`` reads."""
    rows = g4.withColumn("total", total("count", keys, nan_total)).where(F.col("total") >= depth)
    return rows.withColumn("frequency", F.try_divide(F.col("count"), F.col("total")))


def paired(t: DataFrame, c: DataFrame, how: str = "left") -> DataFrame:
    """Treatment cells beside their control cells, with both totals of the position."""
    keys = [*CELL, "position", "ref_nt", "obs_nt"]
    left = t.withColumn("t_total", total("count", CELL)).select(*keys, F.col("count").alias("t_count"), "t_total")
    sums = c.groupBy(*CELL).agg(F.sum("count").alias("c_total"))
    cells = c.select(*CELL, "obs_nt", F.col("count").alias("c_count"))
    return left.join(cells, [*CELL, "obs_nt"], how).join(sums, CELL, "left").withColumns({"c_count": F.coalesce("c_count", F.lit(0.0)), "c_total": F.coalesce("c_total", F.lit(0.0))})


def subtract(t: DataFrame, c: DataFrame) -> DataFrame:
    """Control, rescaled to the treatment's depth at the position, taken off; the reference stays, nothing falls below 0."""
    scaled = F.coalesce(F.try_divide(F.col("c_count"), F.col("c_total")) * F.col("t_total"), F.lit(0.0))
    left = F.when(F.col("obs_nt") == F.col("ref_nt"), F.col("t_count")).otherwise(F.greatest(F.lit(0.0), F.col("t_count") - scaled))
    return paired(t, c).select(*CELL, "position", "ref_nt", "obs_nt", left.alias("count"))


def wipe_high_control(t: DataFrame, c: DataFrame, most: float = 0.05) -> DataFrame:
    """Cells of positions where a mutation seen in both reaches ``most`` in control become 0."""
    rate = F.when((F.col("obs_nt") != F.col("ref_nt")) & (F.col("t_count") > 0), F.try_divide(F.col("c_count"), F.col("c_total")))
    rows = paired(t, c).withColumn("wiped", F.coalesce(F.max(rate).over(Window.partitionBy(*CELL)) >= most, F.lit(False)))
    return rows.select(*CELL, "position", "ref_nt", "obs_nt", F.when(F.col("wiped"), 0.0).otherwise(F.col("t_count")).alias("count"), "wiped")


def mask(g4: DataFrame, rules: DataFrame, keys: list[str], mode: str = "zero") -> DataFrame:
    """Cells listed in ``rules`` become 0, null, or (``fold``) are given back to the reference cell."""
    marked = g4.join(rules.select(*keys).distinct().withColumn("__rule", F.lit(True)), keys, "left")
    hit = F.col("__rule").isNotNull()
    if mode in ("zero", "null"):
        return marked.withColumn("count", F.when(hit, F.lit(0.0 if mode == "zero" else None).cast("double")).otherwise(F.col("count"))).drop("__rule")
    others = [x for x in g4.columns if x not in ("obs_nt", "count")]
    return marked.withColumn("obs_nt", F.when(hit, F.col("ref_nt")).otherwise(F.col("obs_nt"))).groupBy(*others, "obs_nt").agg(F.sum("count").alias("count"))


def zero_fraction(g4: DataFrame, depth: float = 100) -> DataFrame:
    """A2: per condition and mutation: sites, sites without it, their share, and mean frequency."""
    rows = frequencies(g4, depth=depth).where("obs_nt <> ref_nt")
    zero = F.sum(F.when(F.col("count") == 0, 1).otherwise(0))
    found = rows.groupBy("condition", "position", "ref_nt", "obs_nt").agg(
        zero.cast("long").alias("zero_sites"), F.count("*").alias("sites"), F.avg("frequency").alias("mean_activity")
    )
    return found.withColumn("zero_fraction", F.col("zero_sites") / F.col("sites"))


def dense_cells(g4: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """All four cells of every position that has any: absent ones as 0 (the array shape's zeros)."""
    head = g4.select(*keys, "position", "ref_nt").distinct().withColumn("obs_nt", F.explode(F.array(*[F.lit(n) for n in NTS])))
    return head.join(g4.select(*keys, "obs_nt", "count"), [*keys, "obs_nt"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


def activity_grid(g4: DataFrame, depth: float = 100) -> DataFrame:
    """A3: mean frequency for every condition, position and substitution, null where no site has it."""
    means = frequencies(g4, depth=depth).where("obs_nt <> ref_nt").groupBy("condition", "position", "ref_nt", "obs_nt").agg(F.avg("frequency").alias("mean_activity"))
    nts = F.array(*[F.lit(n) for n in NTS])
    grid = means.select("condition").distinct().join(means.groupBy().agg(F.min("position").alias("lo"), F.max("position").alias("hi")))
    grid = grid.withColumn("position", F.explode(F.sequence("lo", "hi"))).withColumn("ref_nt", F.explode(nts)).withColumn("obs_nt", F.explode(nts))
    return grid.where("ref_nt <> obs_nt").drop("lo", "hi").join(means, ["condition", "position", "ref_nt", "obs_nt"], "left")


def pool_replicates(g4: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of member conditions summed; ``groups``: name, members."""
    members = groups.select(F.col("name").alias("condition_group"), F.explode("members").alias("condition"))
    return g4.join(F.broadcast(members), "condition").groupBy("condition_group", *keys).agg(F.sum("count").alias("count"))


def median_background(freq: DataFrame, positions: tuple[int, int], value: str = "frequency") -> DataFrame:
    """The substitution's median over far positions taken off, nothing below 0."""
    keys = ["condition", "ref_nt", "obs_nt"]
    level = order_statistics(freq.where(F.col("position").between(*positions)), keys, value, {"background": 0.5})
    return freq.join(level, keys, "left").withColumn("adjusted", F.greatest(F.lit(0.0), F.col(value) - F.coalesce("background", F.lit(0.0))))


def substitution_shares(g4: DataFrame, edited_least: float = 1000, rows_least: int = 20) -> DataFrame:
    """Shares of C to T, G, A among edits per condition, site and position; positions with enough sites."""
    c_edits = g4.where("ref_nt = 'C' and obs_nt <> 'C'")
    wide = c_edits.groupBy("condition", "site", "position").pivot("obs_nt", ["A", "G", "T"]).agg(F.avg("count")).na.fill(0, ["A", "G", "T"])
    wide = wide.withColumn("edited", F.col("A") + F.col("G") + F.col("T")).withColumn("rows", F.count("*").over(Window.partitionBy("condition", "position")))
    share = lambda e: F.try_divide(e, F.col("edited"))
    return wide.where((F.col("rows") >= rows_least) & (F.col("edited") >= edited_least)).select(
        "condition", "site", "position", share(F.col("T")).alias("c_t"), share(F.col("G")).alias("c_g"), share(F.col("A")).alias("c_a"),
        share(F.col("A") + F.col("G")).alias("c_ga"),
    )


def on_off_target(g4: DataFrame, sites: DataFrame, target: str = "C", positions: tuple[int, ...] = (6, 7)) -> DataFrame:
    """Edited fraction at core positions with the guide's match count."""
    from editloom.functions.seq import match_count

    sums = g4.where((F.col("ref_nt") == target) & F.col("position").isin(*positions)).groupBy("condition", "site", "position").agg(
        F.sum(F.when(F.col("obs_nt") != F.col("ref_nt"), F.col("count")).otherwise(0.0)).alias("edit_count"), F.sum("count").alias("total_count")
    )
    named = sites.select("site", "category", match_count(F.col("grna"), F.col("seq"), F.col("pos0_idx") + 1).alias("match_count"))
    return sums.join(named, "site").withColumn("edited_fraction", F.try_divide(F.col("edit_count"), F.col("total_count")))
