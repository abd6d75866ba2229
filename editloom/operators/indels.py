"""Indel counts (h6): condition, site, category (wildtype, del, ins), indel_start, indel_end, indel_length,
mh_length, inserted_bases, count. Null signature fields match null fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.seq import left_shift, run_length, substr0
from editloom.functions.special import binom_sf
from editloom.operators.batch import SIGNATURE
from editloom.operators.ranges import order_statistics

SITE = ["condition", "site"]


def _full(t: DataFrame, c: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, null to null; t_count and c_count, 0 where a side is absent (full join only)."""
    left = t.select(*keys, F.col("count").alias("t_count"))
    right = c.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("count").alias("c_count"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = left.join(right, on, how)
    if how != "full":
        return both.drop(*[f"__{k}" for k in keys])
    here = F.col("t_count").isNotNull()
    return both.select(*[F.when(here, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys], F.coalesce("t_count", F.lit(0.0)).alias("t_count"), F.coalesce("c_count", F.lit(0.0)).alias("c_count"))


def subtract(t: DataFrame, c: DataFrame) -> DataFrame:
    """Control indels scaled to the treatment's depth of the site and taken off, clipped at 0, zeros dropped;
    a site stays as it is where either side has no indel."""
    w = Window.partitionBy(*SITE)
    both = _full(t, c, [*SITE, *SIGNATURE], "full")
    indel = F.col("category") != "wildtype"
    mixed = (F.max(F.when(indel & (F.col("t_count") > 0), 1).otherwise(0)).over(w) == 1) & (F.max(F.when(indel & (F.col("c_count") > 0), 1).otherwise(0)).over(w) == 1)
    scaled = F.coalesce(F.try_divide(F.col("c_count"), F.sum("c_count").over(w)) * F.sum("t_count").over(w), F.lit(0.0))
    left = F.when(indel & mixed, F.greatest(F.lit(0.0), F.col("t_count") - scaled)).otherwise(F.col("t_count"))
    return both.select(*SITE, *SIGNATURE, left.alias("count")).where("count > 0")


def control_explained(t: DataFrame, c: DataFrame) -> DataFrame:
    """Indels of both sides: P(X >= treatment count) at the control's frequency, n being the treatment reads
    of the matched rows."""
    rate = c.withColumn("c_freq", F.col("count") / F.sum("count").over(Window.partitionBy(*SITE)))
    sides = [df.groupBy(*SITE).agg(F.max(F.when(F.col("category") != "wildtype", 1).otherwise(0)).alias(n)) for df, n in ((t, "__ti"), (rate, "__ci"))]
    rows = _full(t, rate.select(*SITE, *SIGNATURE, F.col("c_freq").alias("count")), [*SITE, *SIGNATURE], "inner").withColumnRenamed("c_count", "c_freq")
    rows = rows.join(sides[0], SITE).join(sides[1], SITE).where("__ti = 1 and __ci = 1").withColumn("matched", F.sum("t_count").over(Window.partitionBy(*SITE)))
    rows = rows.where("category <> 'wildtype'")
    return rows.select(*SITE, *SIGNATURE, "t_count", "c_freq", "matched", binom_sf(F.col("t_count"), F.col("matched"), F.col("c_freq")).alias("p_value"))


def remove(indels: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """rows listed in ``rules`` go; frequencies are made anew."""
    other = rules.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    left = indels.join(other, on, "left_anti")
    return left.withColumn("frequency", F.try_divide(F.col("count"), F.sum("count").over(Window.partitionBy(*SITE))))


def wipe_sites(t: DataFrame, c: DataFrame, most: float = 0.05) -> DataFrame:
    """sites with a control indel of at least that frequency keep only wildtype reads."""
    rate = c.withColumn("f", F.col("count") / F.sum("count").over(Window.partitionBy(*SITE))).where("category <> 'wildtype'")
    bad = rate.groupBy(*SITE).agg(F.max("f").alias("f")).where(F.col("f") >= most).select(*SITE, F.lit(True).alias("wiped"))
    return t.join(bad, SITE, "left").where("category = 'wildtype' or wiped is null").drop("wiped")


def cas9_adjust(t: DataFrame, c: DataFrame, keys: list[str], least_control: float = 1000) -> DataFrame:
    """Genotype counts lowered by the control's share, floor 0; unchanged where control is thin or treatment empty."""
    w = Window.partitionBy(*SITE)
    both = _full(t, c, [*SITE, *keys], "full").withColumns({"t_total": F.sum("t_count").over(w), "c_total": F.sum("c_count").over(w)})
    lowered = F.greatest(F.lit(0.0), F.col("t_count") - F.try_divide(F.col("c_count"), F.col("c_total")) * F.col("t_total"))
    out = F.when((F.col("c_total") < least_control) | (F.col("t_total") == 0), F.col("t_count")).when(F.col("t_count") == 0, 0.0).otherwise(lowered)
    return both.select(*SITE, *keys, out.alias("count")).where("count <> 0")


def site_indels(t: DataFrame, c: DataFrame, depth: float = 100) -> DataFrame:
    """Per site, the indel count left after the control's indel rate, both sides deep enough."""
    sums = [summary(df).select(*SITE, F.col("total_count").alias(f"{n}_total"), F.col("indel_count").alias(f"{n}_indel")) for df, n in ((t, "t"), (c, "c"))]
    both = sums[0].join(sums[1], SITE).where((F.col("t_total") >= depth) & (F.col("c_total") >= depth))
    left = F.greatest(F.lit(0.0), F.col("t_indel") - F.col("c_indel") / F.col("c_total") * F.col("t_total"))
    return both.select(*SITE, "t_total", left.alias("indel_count"), (left / F.col("t_total")).alias("indel_freq"))


def summary(h6: DataFrame) -> DataFrame:
    """Counts and frequencies of indels, deletions, insertions and wildtype per site."""
    part = lambda cond, n: F.sum(F.when(cond, F.col("count")).otherwise(0.0)).alias(n)
    kind = F.col("category")
    sums = h6.groupBy(*SITE).agg(
        F.sum("count").alias("total_count"), part(kind != "wildtype", "indel_count"), part(kind == "del", "del_count"), part(kind == "ins", "ins_count"), part(kind == "wildtype", "wildtype_count")
    )
    return sums.withColumns({f"{n}_freq": F.try_divide(f"{n}_count", "total_count") for n in ("indel", "del", "ins", "wildtype")})


def signed_length() -> Column:
    return F.when(F.col("category") == "del", -F.col("indel_length")).otherwise(F.col("indel_length"))


def frequency(h6: DataFrame) -> DataFrame:
    return h6.withColumn("frequency", F.try_divide(F.col("count"), F.sum("count").over(Window.partitionBy(*SITE))))


def aligned(h6: DataFrame) -> DataFrame:
    """Indels with shifted start and end; an insertion covers the position it starts at."""
    rows = h6.where("category <> 'wildtype'").withColumn("__end", F.when(F.col("category") == "ins", F.col("indel_start") + 1).otherwise(F.col("indel_end")))
    shift = left_shift(F.col("indel_start"), F.col("__end"), F.col("mh_length"))
    return rows.withColumn("shift", shift).withColumns({"start_adj": F.col("indel_start") - F.col("shift"), "end_adj": F.col("__end") - F.col("shift"), "signed_length": signed_length()}).drop("__end")


def length_spectrum(h6: DataFrame, first: int = -40, last: int = 15) -> DataFrame:
    """Frequency by signed length, every length of the range for every site."""
    sums = frequency(h6).where("category <> 'wildtype'").groupBy(*SITE, signed_length().alias("signed_length")).agg(F.sum("frequency").alias("frequency"))
    grid = h6.select(*SITE).distinct().withColumn("signed_length", F.explode(F.array(*[F.lit(i) for i in range(first, last + 1) if i])))
    return grid.join(sums, [*SITE, "signed_length"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def length_cells(h6: DataFrame) -> DataFrame:
    """Frequency by site and signed length as far as there is any; what is no indel has none, so that every site has a row."""
    length = F.when(F.col("category") != "wildtype", signed_length())
    return frequency(h6).groupBy(*SITE, length.alias("signed_length")).agg(F.sum("frequency").alias("frequency"))


def position_spectrum(h6: DataFrame) -> DataFrame:
    """Each indel adds its frequency to every position it covers."""
    rows = aligned(frequency(h6)).where("end_adj > start_adj").withColumn("position", F.explode(F.sequence("start_adj", F.col("end_adj") - 1)))
    return rows.groupBy(*SITE, "position").agg(F.sum("frequency").alias("frequency"))


def single_base_positions(h6: DataFrame) -> DataFrame:
    """The frequency of one-base indels at every position of a condition that has any, of every site of it, zeros included."""
    found = position_length(h6).where("abs(signed_length) = 1").groupBy(*SITE, "position").agg(F.sum("frequency").alias("frequency"))
    grid = h6.select(*SITE).distinct().join(found.select("condition", "position").distinct(), "condition")
    return grid.join(found, [*SITE, "position"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def position_length(h6: DataFrame, whole: bool = False) -> DataFrame:
    """Frequency by position and signed length; ``whole`` adds counts at the start position over all sites."""
    if whole:
        return aligned(h6).groupBy("condition", F.col("start_adj").alias("position"), "signed_length").agg(F.sum("count").alias("count"))
    rows = aligned(frequency(h6)).where("end_adj > start_adj").withColumn("position", F.explode(F.sequence("start_adj", F.col("end_adj") - 1)))
    return rows.groupBy(*SITE, "position", "signed_length").agg(F.sum("frequency").alias("frequency"))


def reduce_single(h6: DataFrame, most: float = 0.30) -> DataFrame:
    """A10: where a condition's share of 1-base indels passes ``most``, their counts are scaled so that it doesn't."""
    indel = h6.where("category <> 'wildtype'")
    shares = indel.groupBy("condition").agg(F.try_divide(F.sum(F.when(F.col("indel_length") == 1, F.col("count")).otherwise(0.0)), F.sum("count")).alias("share"))
    factor = F.when(F.col("share") > most, (1 - F.col("share")) * most / (1 - most) / F.col("share")).otherwise(1.0)
    rows = h6.join(F.broadcast(shares.select("condition", factor.alias("factor"))), "condition", "left")
    return rows.withColumn("reduced", F.when(F.col("indel_length") == 1, F.col("count") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("count")))


def deleted_bases(h6: DataFrame, sites: DataFrame) -> DataFrame:
    """Bases of each deletion and the first and last of them; null outside the sequence."""
    rows = aligned(h6).join(sites.select("site", "seq", "pos0_idx"), "site")
    first, last = F.col("start_adj") + F.col("pos0_idx"), F.col("end_adj") + F.col("pos0_idx")
    inside = (F.col("category") == "del") & (first >= 0) & (last <= F.length("seq")) & (last > first)
    rows = rows.withColumn("del_nts", F.when(inside, substr0(F.col("seq"), first, last - first)))
    return rows.withColumns({"left_nt": F.substring("del_nts", 1, 1), "right_nt": F.when(F.col("del_nts").isNotNull(), F.right("del_nts", F.lit(1)))}).drop("seq", "pos0_idx")


def run_deletions(h6: DataFrame, sites: DataFrame, position: int = 4) -> DataFrame:
    """1-base deletion frequency right after ``position`` by length of the C run that ends there."""
    at = F.col("pos0_idx") + position
    named = sites.where((substr0(F.col("seq"), at, 1) == "C") & (substr0(F.col("seq"), at + 1, 1) != "C")).select("site", run_length(F.col("seq"), at).alias("run"))
    hit = (F.col("category") == "del") & (F.col("indel_length") == 1) & (F.col("end_adj") == position + 1)
    sums = aligned(frequency(h6)).groupBy(*SITE).agg(F.sum(F.when(hit, F.col("frequency")).otherwise(0.0)).alias("frequency"))
    return h6.select(*SITE).distinct().join(named, "site").join(sums, SITE, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def single_shares(h6: DataFrame) -> DataFrame:
    """Shares of 1-base indels, deletions and insertions among a condition's indel frequency."""
    rows = frequency(h6).where("category <> 'wildtype'").withColumn("s", signed_length())
    part = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("frequency")).otherwise(0.0)), F.sum("frequency"))
    return rows.groupBy("condition").agg(part(F.abs("s") == 1).alias("indel1"), part(F.col("s") == -1).alias("del1"), part(F.col("s") == 1).alias("ins1"))


def cas9_fraction(h6: DataFrame, edited: tuple[str, ...] = ("del", "ins", "del_notatcut", "ins_notatcut", "combination_indel")) -> DataFrame:
    """Edited share of a site's signal reads."""
    part = lambda cond, n: F.sum(F.when(cond, F.col("count")).otherwise(0.0)).alias(n)
    sums = h6.groupBy(*SITE).agg(part(F.col("category").isin(*edited), "edited_count"), part(F.col("category").isin("wildtype", *edited), "total_count"))
    return sums.withColumn("edited_fraction", F.try_divide("edited_count", "total_count"))


def mean_heatmap(h6: DataFrame) -> DataFrame:
    """Mean and median over sites of the frequency at each position and length."""
    rows, keys = position_length(h6), ["condition", "position", "signed_length"]
    return rows.groupBy(*keys).agg(F.avg("frequency").alias("mean_frequency")).join(order_statistics(rows, keys, "frequency", {"median_frequency": 0.5}), keys)
