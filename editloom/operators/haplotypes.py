"""Read haplotypes (g5): rows of condition, site, hap MAP<STRING, STRING>, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.seq import apply_haplotype, edited, has_edit, hap_text, impute, is_edited, n_edits, position_of, substr0, translate_frame, window30
from editloom.functions.special import pearson

SITE = ["condition", "site"]
#: Editor-specific centre positions; others use 6.
CENTRES = {"ABE": 6, "ABE-CP": 6, "AID": 6, "BE4": 6, "BE4-CP": 8, "CDA": 5, "eA3A": 6, "evoAPOBEC": 5}


def from_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row a read: its observed nucleotides as a map."""
    entry = F.struct(F.concat("ref_nt", F.col("pos").cast("string")).alias("k"), F.col("obs_nt").alias("v"))
    return long.groupBy(*keys, "read_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("hap"), F.max("count").alias("count"))


def regroup(haps: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """A5: equal haplotypes of a site summed."""
    return haps.groupBy(*keys, "hap").agg(F.sum("count").alias("count"))


def marginals(haps: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """A4: reads by position and nucleotide; the total includes unknown ones."""
    rows = haps.select(*keys, "count", F.explode("hap").alias("key", "obs_nt"))
    sums = rows.groupBy(*keys, "key", "obs_nt").agg(F.sum("count").alias("count"))
    return sums.withColumn("total", F.sum("count").over(Window.partitionBy(*keys, "key")))


def mask_columns(haps: DataFrame, rules: DataFrame, to: str = ".", keys: list[str] = SITE) -> DataFrame:
    """Nucleotides listed in ``rules`` (keys, key, obs_nt) become unknown, or (``to='ref'``) the reference."""
    listed = rules.select(*keys, F.concat_ws("=", "key", "obs_nt").alias("__m")).groupBy(*keys).agg(F.collect_set("__m").alias("__rules"))
    value = lambda k, v: F.lit(".") if to == "." else F.substring(k, 1, 1)
    hit = lambda k, v: F.array_contains(F.col("__rules"), F.concat(k, F.lit("="), v))
    masked = F.when(F.col("__rules").isNull(), F.col("hap")).otherwise(F.transform_values("hap", lambda k, v: F.when(hit(k, v), value(k, v)).otherwise(v)))
    return regroup(haps.join(listed, keys, "left").withColumn("hap", masked), keys)


def subtract(t: DataFrame, c: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """Control scaled to the treatment's depth of the site and taken off mutated haplotypes; what is left above 0."""
    sides = []
    for df, name in ((t, "t"), (c, "c")):
        one = regroup(df.where("count > 0"), keys)
        sides.append(one.select(*keys, hap_text(F.col("hap")).alias("__key"), F.col("hap").alias(f"hap_{name}"), F.col("count").alias(f"n_{name}")))
    both = sides[0].join(sides[1], [*keys, "__key"], "full").withColumns({"n_t": F.coalesce("n_t", F.lit(0.0)), "n_c": F.coalesce("n_c", F.lit(0.0)), "hap": F.coalesce("hap_t", "hap_c")})
    w = Window.partitionBy(*keys)
    scaled = F.coalesce(F.try_divide(F.col("n_c"), F.sum("n_c").over(w)) * F.sum("n_t").over(w), F.lit(0.0))
    left = both.withColumn("count", F.when(is_edited(F.col("hap")), F.col("n_t") - scaled).otherwise(F.col("n_t")))
    return left.where("count > 0").select(*keys, "hap", "count")


def profile(haps: DataFrame, ranges: DataFrame) -> DataFrame:
    """F8: columns of the editor's window, with off-profile nucleotides unknown. ``ranges``: condition, ref, obs, first, last."""
    allowed = ranges.groupBy("condition").agg(F.collect_list(F.struct("ref", "obs", "first", "last")).alias("__p"))
    within = lambda k, r: (F.substring(k, 1, 1) == r["ref"]) & position_of(k).between(r["first"], r["last"])
    rows = haps.join(F.broadcast(allowed), "condition")
    kept = F.map_filter("hap", lambda k, v: F.exists("__p", lambda r: within(k, r)))
    fits = lambda k, v: (v == F.substring(k, 1, 1)) | (v == ".") | F.exists("__p", lambda r: within(k, r) & (v == r["obs"]))
    return rows.withColumn("hap", F.transform_values(kept, lambda k, v: F.when(fits(k, v), v).otherwise("."))).drop("__p")


def drop_unknown(haps: DataFrame) -> DataFrame:
    """F9."""
    return haps.where(F.exists(F.map_values("hap"), lambda v: v != "."))


def drop_noisy(haps: DataFrame, core_nt: Column, least: float = 0.025, core: tuple[int, int] = (1, 10)) -> DataFrame:
    """frequent rows without an edit of the core nucleotide at core positions go."""
    rows = haps.withColumn("frequency", F.col("count") / F.sum("count").over(Window.partitionBy(*SITE)))
    centre = F.exists(F.map_entries("hap"), lambda e: (F.substring(e["key"], 1, 1) == core_nt) & position_of(e["key"]).between(*core) & (e["value"] != F.substring(e["key"], 1, 1)))
    return rows.where(centre | (F.col("frequency") < least))


def annotate(haps: DataFrame) -> DataFrame:
    """Per site edited, aberrant (C to G or A, A to anything but G) and total counts, and their shares."""
    odd = has_edit(F.col("hap"), "C", ("G", "A"))
    sums = haps.groupBy(*SITE).agg(
        F.sum(F.when(n_edits(F.col("hap")) > 0, F.col("count")).otherwise(0.0)).alias("edited_count"),
        F.sum(F.when(odd, F.col("count")).otherwise(0.0)).alias("aberrant_count"), F.sum("count").alias("total_count"),
    )
    return sums.withColumns({"fraction_edited": F.try_divide("edited_count", "total_count"), "fraction_aberrant": F.try_divide("aberrant_count", "total_count")})


def simulated_bystander(haps: DataFrame, substrate: Column, centre: Column) -> DataFrame:
    """Precision at the substrate nearest the editor's centre: reads whose only edit is there, of all edited."""
    rows = haps.withColumns({"__s": substrate, "__c": centre})
    near = rows.select(*SITE, "__s", "__c", F.explode(F.map_keys("hap")).alias("key")).where(
        (F.substring("key", 1, 1) == F.col("__s")) & position_of(F.col("key")).between(-3, 14)
    )
    pick = near.groupBy(*SITE).agg(F.min_by("key", F.struct(F.abs(position_of(F.col("key")) - F.col("__c")), position_of(F.col("key")))).alias("central"))
    only = (n_edits(F.col("hap")) == 1) & edited(F.col("central"), F.element_at("hap", F.col("central")))
    sums = rows.join(pick, SITE).groupBy(*SITE, "central", "__c").agg(
        F.sum(F.when(only, F.col("count")).otherwise(0.0)).alias("precise_count"), F.sum(F.when(n_edits(F.col("hap")) > 0, F.col("count")).otherwise(0.0)).alias("edited_count")
    )
    at = position_of(F.col("central"))
    return sums.select(*SITE, at.alias("position"), (at - F.col("__c")).alias("distance"), F.try_divide("precise_count", "edited_count").alias("precision"), "edited_count")


def precise_correction(haps: DataFrame, key: Column, correct: Column) -> DataFrame:
    """Reads whose only edit is the wanted one, of all and of edited reads."""
    whole = haps.withColumn("hap", impute(F.col("hap")))
    good = (n_edits(F.col("hap")) == 1) & (F.element_at("hap", key) == correct)
    sums = whole.groupBy(*SITE).agg(
        F.sum("count").alias("total_count"), F.sum(F.when(is_edited(F.col("hap")), F.col("count")).otherwise(0.0)).alias("edited_count"),
        F.sum(F.when(F.coalesce(good, F.lit(False)), F.col("count")).otherwise(0.0)).alias("correct_count"),
    )
    return sums.withColumns({"corrected": F.try_divide("correct_count", "total_count"), "precision": F.try_divide("correct_count", "edited_count")})


def amino_outcomes(haps: DataFrame, sites: DataFrame) -> DataFrame:
    """Edited reads by what they do to the protein. ``sites``: site, seq, pos0_idx, frame, strand, snp, correct.
    Each distinct edited sequence of a site is translated once, and the site's own and wanted ones once a site."""
    aas = lambda s: translate_frame(s, F.col("frame"), F.col("snp"), F.col("strand"))
    goal = F.concat(substr0(F.col("w"), F.lit(0), F.col("snp") + 9), F.col("correct"), substr0(F.col("w"), F.col("snp") + 10, 30))
    told = sites.withColumn("w", window30(F.col("seq"), F.col("pos0_idx"))).select("site", "w", "frame", "strand", "snp", aas(F.col("w")).alias("path"), aas(goal).alias("goal"))
    reads = haps.withColumn("hap", impute(F.col("hap"))).where(is_edited(F.col("hap"))).join(told.select("site", "w"), "site")
    edited = reads.select(*SITE, apply_haplotype(F.col("w"), F.col("hap")).alias("edited"), "count").groupBy(*SITE, "edited").agg(F.sum("count").alias("count"))
    rows = edited.join(told.drop("w"), "site").withColumn("obs", aas(F.col("edited")))
    part = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0.0))
    return rows.groupBy(*SITE).agg(part(F.col("obs") == F.col("path")).alias("unedited_aa"), part(F.col("obs") != F.col("path")).alias("edited_aa"), part(F.col("obs") == F.col("goal")).alias("goal_aa"))


def transversions(haps: DataFrame, positions: tuple[int, ...] = tuple(range(1, 10))) -> DataFrame:
    """By C position, share of edits there that are transversions, and editing efficiency among edited reads."""
    rows = haps.where(is_edited(F.col("hap"))).select(*SITE, "count", F.explode("hap").alias("key", "obs_nt"))
    rows = rows.where((F.substring("key", 1, 1) == "C") & position_of(F.col("key")).isin(*positions))
    part = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0.0))
    sums = rows.groupBy(*SITE, "key").agg(part(F.col("obs_nt").isin("G", "A")).alias("ga"), part(F.col("obs_nt") != "C").alias("away"), F.sum("count").alias("whole"))
    return sums.select(*SITE, "key", F.try_divide("ga", "away").alias("purity"), F.try_divide("away", "whole").alias("efficiency"))


def compare_conditions(haps: DataFrame, key: str = "site") -> DataFrame:
    """Correlation of haplotype frequencies of every two conditions of a site over their shared columns."""
    rows = haps.withColumn("hap", impute(F.col("hap"))).where(is_edited(F.col("hap")))
    keys = rows.select(key, "condition", F.explode(F.map_keys("hap")).alias("k")).distinct()
    columns = keys.groupBy(key, "condition").agg(F.collect_set("k").alias("ks"))
    a, b = (columns.select(key, F.col("condition").alias(f"c{i}"), F.col("ks").alias(f"k{i}")) for i in (1, 2))
    pairs = a.join(b, key).where("c1 < c2").select(key, "c1", "c2", F.array_intersect("k1", "k2").alias("shared")).where("size(shared) > 0")
    sides = []
    for i in (1, 2):
        part = rows.withColumnRenamed("condition", f"c{i}").join(pairs, [key, f"c{i}"]).select(key, "c1", "c2", F.map_filter("hap", lambda k, v: F.array_contains("shared", k)).alias("h"), "count")
        sums = part.groupBy(key, "c1", "c2", hap_text(F.col("h")).alias("hap_key")).agg(F.sum("count").alias("n"))
        sides.append(sums.withColumn(f"f{i}", F.col("n") / F.sum("n").over(Window.partitionBy(key, "c1", "c2"))).drop("n"))
    full = sides[0].join(sides[1], [key, "c1", "c2", "hap_key"], "full").na.fill(0.0, ["f1", "f2"])
    return full.groupBy(key, "c1", "c2").agg(F.count("*").alias("haplotypes"), pearson("f1", "f2").alias("pearson"))


def endogenous_summary(haps: DataFrame, indels: DataFrame) -> DataFrame:
    """Per condition, read counts, edit and indel shares, and shares of reads with each kind of edit."""
    hap = F.col("hap")
    part = lambda cond, n: F.sum(F.when(cond, F.col("count")).otherwise(0.0)).alias(n)
    kinds = {"ctot": ("T",), "ctoga": ("G", "A"), "ctog": ("G",), "ctoa": ("A",)}
    edits = haps.withColumn("hap", impute(hap)).groupBy("condition").agg(part(is_edited(hap), "edited_reads"), *[part(has_edit(hap, "C", o), f"{n}_reads") for n, o in kinds.items()])
    category, one = F.col("category"), F.col("indel_length") == 1
    cuts = indels.groupBy("condition").agg(
        part(category.isin("del", "ins"), "indel_reads"), F.sum("count").alias("total_reads"), part((category == "del") & one, "del1"), part((category == "ins") & one, "ins1"), part(one, "one")
    )
    rows = edits.join(cuts, "condition")
    share = F.try_divide
    c = F.col
    return rows.select(
        "condition", "indel_reads", "edited_reads", "total_reads", (c("total_reads") - c("edited_reads") - c("indel_reads")).alias("wildtype_reads"),
        share(c("indel_reads"), c("total_reads")).alias("indel_freq"), share(c("edited_reads"), c("total_reads")).alias("edit_freq"),
        share(c("edited_reads") + c("indel_reads"), c("total_reads")).alias("any_freq"), share(c("edited_reads"), c("indel_reads")).alias("edit_indel_ratio"),
        share(c("del1"), c("indel_reads")).alias("del1_share"), share(c("ins1"), c("indel_reads")).alias("ins1_share"), share(c("one"), c("indel_reads")).alias("one_share"),
        *[share(c(f"{n}_reads"), c("edited_reads")).alias(f"{n}_of_edited") for n in kinds], *[share(c(f"{n}_reads"), c("total_reads")).alias(f"{n}_of_all") for n in kinds],
    )
