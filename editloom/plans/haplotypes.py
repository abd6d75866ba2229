"""Queries over read haplotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators import haplotypes as hp
from editloom.plans.registry import query, rounded
from editloom.sources.fixtures import Source, oracle

# A read's side alternates with its number within the site, so that both sides have every site.
LONG = """hl AS (SELECT read_id, CASE WHEN (read_id // 40) % 2 = 0 THEN 'T' ELSE 'C' END AS side, condition, site, pos, ref_nt, obs_nt, ref_nt || pos AS key, count FROM v_g5_long),
h0 AS (SELECT * FROM hl WHERE side = 'T'),
reads AS (SELECT side, read_id, condition, site, string_agg(key || '=' || obs_nt, ',' ORDER BY pos) AS hap, bool_or(obs_nt NOT IN ('.', ref_nt)) AS edited,
  CAST(sum(CASE WHEN obs_nt NOT IN ('.', ref_nt) THEN 1 ELSE 0 END) AS INT) AS edits, max(count) AS count FROM hl GROUP BY ALL),
t AS (SELECT condition, site, hap, edited, edits, sum(count) AS count FROM reads WHERE side = 'T' GROUP BY ALL),
c AS (SELECT condition, site, hap, edited, edits, sum(count) AS count FROM reads WHERE side = 'C' GROUP BY ALL)"""
IMPUTED = LONG + """,
ih AS (SELECT read_id, condition, site, pos, ref_nt, key, CASE WHEN obs_nt = '.' THEN ref_nt ELSE obs_nt END AS obs_nt, count FROM h0),
ir AS (SELECT read_id, condition, site, string_agg(key || '=' || obs_nt, ',' ORDER BY pos) AS hap, CAST(sum(CASE WHEN obs_nt <> ref_nt THEN 1 ELSE 0 END) AS INT) AS edits, max(count) AS count FROM ih GROUP BY ALL)"""


def reads(s: Source, side: str = "T") -> DataFrame:
    keep = (F.floor(F.col("read_id") / 40) % 2) == (0 if side == "T" else 1)
    return hp.from_long(s.v_g5_long.where(keep), hp.SITE)


def told(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("hap", seq.hap_text(F.col("hap"))))


def with_editor(s: Source, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(s.v_cond.select("condition", "editor")), "condition")


@query("a5_regroup", oracle("SELECT condition, site, hap, count FROM t", "v_g5_long", ctes=LONG))
def a5_regroup(s: Source) -> DataFrame:
    return told(hp.regroup(reads(s)))


@query("a4_marginals", oracle("""
SELECT *, sum(count) OVER (PARTITION BY condition, site, key) AS total FROM (SELECT condition, site, key, obs_nt, sum(count) AS count FROM h0 GROUP BY ALL) x""", "v_g5_long", ctes=LONG))
def a4_marginals(s: Source) -> DataFrame:
    return hp.marginals(reads(s))


@query("j2_hap_subtract", oracle("""
SELECT condition, site, hap, round(CASE WHEN edited THEN nt - coalesce(nc / nullif(sum(nc) OVER w, 0) * sum(nt) OVER w, 0) ELSE nt END, 6) AS count FROM (
  SELECT coalesce(t.condition, c.condition) AS condition, coalesce(t.site, c.site) AS site, coalesce(t.hap, c.hap) AS hap, coalesce(t.edited, c.edited) AS edited, coalesce(t.count, 0.0) AS nt, coalesce(c.count, 0.0) AS nc
  FROM t FULL JOIN c ON t.condition = c.condition AND t.site = c.site AND t.hap = c.hap) x
WINDOW w AS (PARTITION BY condition, site)
QUALIFY CASE WHEN edited THEN nt - coalesce(nc / nullif(sum(nc) OVER w, 0) * sum(nt) OVER w, 0) ELSE nt END > 0""", "v_g5_long", ctes=LONG))
def j2_hap_subtract(s: Source) -> DataFrame:
    return told(hp.subtract(reads(s), reads(s, "C")))


@query("f5_edited", oracle("SELECT condition, site, hap, edits, count FROM t WHERE edited", "v_g5_long", ctes=LONG))
def f5_edited(s: Source) -> DataFrame:
    return told(hp.regroup(reads(s)).where(seq.is_edited(F.col("hap"))).withColumn("edits", seq.n_edits(F.col("hap"))))


@query("f6_kinds", oracle("""
SELECT condition, site, sum(CASE WHEN g THEN count ELSE 0.0 END) AS ctog, sum(CASE WHEN a THEN count ELSE 0.0 END) AS ctoa, sum(CASE WHEN g OR a THEN count ELSE 0.0 END) AS ctoga, sum(CASE WHEN u THEN count ELSE 0.0 END) AS ctot
FROM (SELECT read_id, condition, site, max(count) AS count, bool_or(ref_nt = 'C' AND obs_nt = 'G') AS g, bool_or(ref_nt = 'C' AND obs_nt = 'A') AS a, bool_or(ref_nt = 'C' AND obs_nt = 'T') AS u FROM h0 GROUP BY ALL) x GROUP BY ALL""", "v_g5_long", ctes=LONG))
def f6_kinds(s: Source) -> DataFrame:
    kinds = {"ctog": ("G",), "ctoa": ("A",), "ctoga": ("G", "A"), "ctot": ("T",)}
    return reads(s).groupBy(*hp.SITE).agg(*[F.sum(F.when(seq.has_edit(F.col("hap"), "C", o), F.col("count")).otherwise(0.0)).alias(n) for n, o in kinds.items()])


@query("f7_impute", oracle("SELECT condition, site, hap, sum(count) AS count FROM ir GROUP BY ALL", "v_g5_long", ctes=IMPUTED))
def f7_impute(s: Source) -> DataFrame:
    return told(hp.regroup(reads(s).withColumn("hap", seq.impute(F.col("hap")))))


PROFILE = [("BE4", "C to T", "(3, 9)"), ("BE4", "C to G", "(4, 8)"), ("ABE", "A to G", "(3, 8)")]
RANGES = LONG + """,
ranges(editor, ref, obs, lo, hi) AS (VALUES ('BE4', 'C', 'T', 3, 9), ('BE4', 'C', 'G', 4, 8), ('ABE', 'A', 'G', 3, 8)),
windowed AS (SELECT h0.*, editor FROM h0 JOIN v_cond USING (condition) WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.editor = v_cond.editor AND r.ref = ref_nt AND pos BETWEEN lo AND hi)),
masked AS (SELECT read_id, condition, site, pos, ref_nt, key, count, CASE WHEN obs_nt IN (ref_nt, '.') OR EXISTS (SELECT 1 FROM ranges r WHERE r.editor = windowed.editor AND r.ref = ref_nt AND pos BETWEEN lo AND hi AND r.obs = obs_nt) THEN obs_nt ELSE '.' END AS obs_nt FROM windowed),
profiled AS (SELECT read_id, condition, site, string_agg(key || '=' || obs_nt, ',' ORDER BY pos) AS hap, bool_or(obs_nt <> '.') AS known, max(count) AS count FROM masked GROUP BY ALL)"""


def ranges(s: Source) -> DataFrame:
    cells = s.spark.createDataFrame(PROFILE, "editor string, change string, cell string")
    first, last = seq.profile_range(F.col("cell"))
    parsed = cells.select("editor", F.substring("change", 1, 1).alias("ref"), F.substring("change", 6, 1).alias("obs"), first.alias("first"), last.alias("last"))
    return s.v_cond.select("condition", "editor").join(F.broadcast(parsed), "editor").drop("editor")


@query("f8_profile", oracle("SELECT condition, site, hap, sum(count) AS count FROM profiled GROUP BY ALL", "v_cond", "v_g5_long", ctes=RANGES))
def f8_profile(s: Source) -> DataFrame:
    return told(hp.regroup(hp.profile(reads(s), ranges(s)).where(F.size("hap") > 0)))


@query("f9_drop_dots", oracle("SELECT condition, site, hap, sum(count) AS count FROM profiled WHERE known GROUP BY ALL", "v_cond", "v_g5_long", ctes=RANGES))
def f9_drop_dots(s: Source) -> DataFrame:
    return told(hp.regroup(hp.drop_unknown(hp.profile(reads(s), ranges(s)))))


@query("f10_noisy", oracle("""
SELECT condition, site, hap, count, round(f, 6) AS frequency FROM (
  SELECT *, count / sum(count) OVER (PARTITION BY condition, site) AS f FROM (
    SELECT condition, site, hap, core, sum(count) AS count FROM (
      SELECT read_id, condition, site, string_agg(key || '=' || obs_nt, ',' ORDER BY pos) AS hap, bool_or(ref_nt = CASE WHEN editor = 'ABE' THEN 'A' ELSE 'C' END AND pos BETWEEN 1 AND 10 AND obs_nt <> ref_nt) AS core, max(count) AS count
      FROM ih JOIN v_cond USING (condition) GROUP BY read_id, condition, site HAVING bool_or(obs_nt <> ref_nt)) r GROUP BY ALL) x) y WHERE core OR f < 0.025""", "v_cond", "v_g5_long", ctes=IMPUTED))
def f10_noisy(s: Source) -> DataFrame:
    rows = hp.regroup(reads(s).withColumn("hap", seq.impute(F.col("hap")))).where(seq.is_edited(F.col("hap")))
    core = F.when(F.col("editor") == "ABE", "A").otherwise("C")
    return told(hp.drop_noisy(with_editor(s, rows), core).drop("editor"))


@query("f11_mask", oracle("""
SELECT condition, site, hap, sum(count) AS count FROM (
  SELECT read_id, condition, site, string_agg(key || '=' || CASE WHEN (site % 4 = 1 AND key = 'C6' AND obs_nt = 'T') OR (site % 4 = 2 AND key = 'A5' AND obs_nt = 'G') THEN '.' ELSE obs_nt END, ',' ORDER BY pos) AS hap, max(count) AS count FROM h0 GROUP BY ALL) x GROUP BY ALL""", "v_g5_long", ctes=LONG))
def f11_mask(s: Source) -> DataFrame:
    base = s.v_site.select("site").join(F.broadcast(s.v_cond.select("condition")))
    rules = base.where("site % 4 = 1").select("condition", "site", F.lit("C6").alias("key"), F.lit("T").alias("obs_nt")).unionByName(
        base.where("site % 4 = 2").select("condition", "site", F.lit("A5").alias("key"), F.lit("G").alias("obs_nt"))
    )
    return told(hp.mask_columns(reads(s), rules))


@query("a11_site_annot", oracle("""
SELECT condition, site, e AS edited_count, a AS aberrant_count, n AS total_count, round(e / n, 6) AS fraction_edited, round(a / n, 6) AS fraction_aberrant FROM (
  SELECT condition, site, sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END) AS e, sum(CASE WHEN odd THEN count ELSE 0.0 END) AS a, sum(count) AS n FROM (
    SELECT read_id, condition, site, max(count) AS count, sum(CASE WHEN obs_nt NOT IN ('.', ref_nt) THEN 1 ELSE 0 END) AS edits, bool_or(ref_nt = 'C' AND obs_nt IN ('G', 'A')) AS odd FROM h0 GROUP BY ALL) x GROUP BY ALL) y""", "v_g5_long", ctes=LONG))
def a11_site_annot(s: Source) -> DataFrame:
    return rounded(hp.annotate(reads(s)))


@query("a12_sim_bystander", oracle("""
SELECT condition, site, CAST(central AS INT) AS position, CAST(central - 6 AS INT) AS distance, round(sum(CASE WHEN edits = 1 AND hit THEN count ELSE 0.0 END) / nullif(sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END), 0), 6) AS precision,
  sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END) AS edited_count FROM (
  SELECT h0.read_id, h0.condition, h0.site, central, max(count) AS count, sum(CASE WHEN obs_nt NOT IN ('.', ref_nt) THEN 1 ELSE 0 END) AS edits, bool_or(pos = central AND obs_nt NOT IN ('.', ref_nt)) AS hit
  FROM h0 JOIN (SELECT condition, site, arg_min(pos, abs(pos - 6) * 100 + pos) AS central FROM h0 JOIN v_cond USING (condition) WHERE ref_nt = CASE WHEN editor = 'ABE' THEN 'A' ELSE 'C' END GROUP BY ALL) k
    ON h0.condition = k.condition AND h0.site = k.site GROUP BY ALL) x GROUP BY condition, site, central""", "v_cond", "v_g5_long", ctes=LONG))
def a12_sim_bystander(s: Source) -> DataFrame:
    centre = F.lit(6)
    for editor, at in hp.CENTRES.items():
        centre = F.when(F.col("editor") == editor, F.lit(at)).otherwise(centre)
    return rounded(hp.simulated_bystander(with_editor(s, reads(s)), F.when(F.contains("editor", F.lit("ABE")), "A").otherwise("C"), centre))


@query("a24_precise", oracle("""
SELECT condition, site, sum(count) AS total_count, sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END) AS edited_count, sum(CASE WHEN edits = 1 AND good THEN count ELSE 0.0 END) AS correct_count,
  round(sum(CASE WHEN edits = 1 AND good THEN count ELSE 0.0 END) / sum(count), 6) AS corrected, round(sum(CASE WHEN edits = 1 AND good THEN count ELSE 0.0 END) / nullif(sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END), 0), 6) AS precision
FROM (SELECT read_id, condition, site, max(count) AS count, sum(CASE WHEN obs_nt <> ref_nt THEN 1 ELSE 0 END) AS edits, bool_or(key = 'C6' AND obs_nt = 'T') AS good FROM ih GROUP BY ALL) x GROUP BY ALL""", "v_g5_long", ctes=IMPUTED))
def a24_precise(s: Source) -> DataFrame:
    return rounded(hp.precise_correction(reads(s), F.lit("C6"), F.lit("T")))


CODONS = """codons AS (SELECT substr('TCAG', CAST(i // 16 + 1 AS INT), 1) || substr('TCAG', CAST(i // 4 % 4 + 1 AS INT), 1) || substr('TCAG', CAST(i % 4 + 1 AS INT), 1) AS codon,
  substr('FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(i + 1 AS INT), 1) AS aa FROM range(64) r(i)), table_ AS (SELECT map(list(codon), list(aa)) AS m FROM codons)"""
TURN = "CASE WHEN strand = '-' THEN reverse(translate({s}, 'ACGT', 'TGCA')) ELSE {s} END"
READ = """array_to_string(list_transform(range(((3 - ((frame - 1 - spot) % 3 + 3) % 3) % 3)::BIGINT, 28, 3), lambda i: list_extract(map_extract(m, substr({s}, CAST(i + 1 AS INT), 3)), 1)), '')"""


def frames(s: Source) -> DataFrame:
    """Sites with a made-up reading frame, strand, SNP position and wanted base."""
    return s.v_site.select(
        "site", "seq", "pos0_idx", (F.col("site") % 3 + 1).cast("int").alias("frame"), F.when(F.col("site") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("site") % 5 + 4).cast("int").alias("snp"), F.lit("T").alias("correct"),
    )


FRAMES = """frames AS (SELECT site, substr(seq, 2, 30) AS w, site % 3 + 1 AS frame, CASE WHEN site % 2 = 0 THEN '+' ELSE '-' END AS strand, site % 5 + 4 AS snp,
  CASE WHEN site % 2 = 0 THEN site % 5 + 13 ELSE 30 - (site % 5 + 13) - 1 END AS spot FROM v_site)"""


@query("x3_translate", oracle("SELECT site, w AS seq30, " + READ.format(s="turned") + " AS amino_acids FROM (SELECT *, " + TURN.format(s="w") + " AS turned FROM frames) f, table_", "v_site", ctes=CODONS + ", " + FRAMES))
def x3_translate(s: Source) -> DataFrame:
    w = seq.window30(F.col("seq"), F.col("pos0_idx"))
    return frames(s).select("site", w.alias("seq30"), seq.translate_frame(w, F.col("frame"), F.col("snp"), F.col("strand")).alias("amino_acids"))


EDITED30 = """edited30 AS (SELECT ih.read_id, ih.condition, ih.site, any_value(w) AS w, string_agg(ref_nt || '>' || obs_nt, ',' ORDER BY pos) AS changes,
  array_to_string(list_transform(range(1, 31), lambda i: coalesce(list_extract(map_extract(map(list(CAST(pos + 10 AS BIGINT)), list(obs_nt)), i), 1), substr(any_value(w), CAST(i AS INT), 1))), '') AS e, max(count) AS count,
  sum(CASE WHEN obs_nt <> ref_nt THEN 1 ELSE 0 END) AS edits FROM ih JOIN frames USING (site) GROUP BY ALL)"""


@query("x4_apply_hap", oracle("SELECT condition, site, e AS edited_seq, sum(count) AS count FROM edited30 WHERE edits > 0 GROUP BY ALL", "v_g5_long", ctes=IMPUTED + ", " + FRAMES + ", " + EDITED30))
def x4_apply_hap(s: Source) -> DataFrame:
    rows = reads(s).withColumn("hap", seq.impute(F.col("hap"))).where(seq.is_edited(F.col("hap"))).join(s.v_site.select("site", "seq", "pos0_idx"), "site")
    edited = seq.apply_haplotype(seq.window30(F.col("seq"), F.col("pos0_idx")), F.col("hap"))
    return rows.select("condition", "site", edited.alias("edited_seq"), "count").groupBy("condition", "site", "edited_seq").agg(F.sum("count").alias("count"))


@query("a25_amino", oracle("""
SELECT condition, site, sum(CASE WHEN o = p THEN count ELSE 0.0 END) AS unedited_aa, sum(CASE WHEN o <> p THEN count ELSE 0.0 END) AS edited_aa, sum(CASE WHEN o = g THEN count ELSE 0.0 END) AS goal_aa FROM (
  SELECT condition, site, count, """ + READ.format(s="ts") + " AS o, " + READ.format(s="tp") + " AS p, " + READ.format(s="tg") + """ AS g FROM (
    SELECT condition, site, count, frame, spot, """ + TURN.format(s="e") + " AS ts, " + TURN.format(s="w") + " AS tp, " + TURN.format(s="goal") + """ AS tg
    FROM (SELECT edited30.*, frame, strand, spot, substr(edited30.w, 1, snp + 9) || 'T' || substr(edited30.w, snp + 11) AS goal FROM edited30 JOIN frames USING (site) WHERE edits > 0) x) y, table_) z GROUP BY ALL""",
    "v_g5_long", ctes=IMPUTED + ", " + FRAMES + ", " + EDITED30 + ", " + CODONS))
def a25_amino(s: Source) -> DataFrame:
    return hp.amino_outcomes(reads(s), frames(s))


@query("a21_transversion", oracle("""
SELECT condition, site, key, round(ga / nullif(away, 0), 6) AS purity, round(away / whole, 6) AS efficiency FROM (
  SELECT condition, site, key, sum(CASE WHEN obs_nt IN ('G', 'A') THEN count ELSE 0.0 END) AS ga, sum(CASE WHEN obs_nt <> 'C' THEN count ELSE 0.0 END) AS away, sum(count) AS whole
  FROM (SELECT *, bool_or(obs_nt <> ref_nt) OVER (PARTITION BY read_id) AS any_edit FROM ih) x WHERE any_edit AND ref_nt = 'C' GROUP BY ALL) y""", "v_g5_long", ctes=IMPUTED))
def a21_transversion(s: Source) -> DataFrame:
    return rounded(hp.transversions(reads(s).withColumn("hap", seq.impute(F.col("hap")))))


@query("j12_pairwise", oracle("""
SELECT site, c1, c2, count(*) AS haplotypes, round(covar_pop(f1, f2) / nullif(stddev_pop(f1) * stddev_pop(f2), 0), 6) + 0.0 AS pearson FROM (
  SELECT coalesce(a.site, b.site) AS site, coalesce(a.c1, b.c1) AS c1, coalesce(a.c2, b.c2) AS c2, coalesce(a.f, 0.0) AS f1, coalesce(b.f, 0.0) AS f2
  FROM (SELECT t.site, t.condition AS c1, o.condition AS c2, t.hap, t.n / sum(t.n) OVER (PARTITION BY t.site, t.condition, o.condition) AS f FROM ed t JOIN cs o ON t.site = o.site AND t.condition < o.condition) a
  FULL JOIN (SELECT t.site, o.condition AS c1, t.condition AS c2, t.hap, t.n / sum(t.n) OVER (PARTITION BY t.site, o.condition, t.condition) AS f FROM ed t JOIN cs o ON t.site = o.site AND o.condition < t.condition) b
    ON a.site = b.site AND a.c1 = b.c1 AND a.c2 = b.c2 AND a.hap = b.hap) x GROUP BY ALL""", "v_g5_long", ctes=IMPUTED + """,
ed AS (SELECT site, condition, hap, sum(count) AS n FROM ir WHERE edits > 0 GROUP BY ALL), cs AS (SELECT DISTINCT site, condition FROM ed)"""))
def j12_pairwise(s: Source) -> DataFrame:
    return rounded(hp.compare_conditions(reads(s)))


@query("a17_endo", oracle("""
SELECT condition, indel_reads, edited_reads, total_reads, total_reads - edited_reads - indel_reads AS wildtype_reads, round(indel_reads / total_reads, 6) AS indel_freq, round(edited_reads / total_reads, 6) AS edit_freq,
  round((edited_reads + indel_reads) / total_reads, 6) AS any_freq, round(edited_reads / indel_reads, 6) AS edit_indel_ratio, round(del1 / indel_reads, 6) AS del1_share, round(ins1 / indel_reads, 6) AS ins1_share, round((del1 + ins1) / indel_reads, 6) AS one_share,
  round(u / edited_reads, 6) AS ctot_of_edited, round(ga / edited_reads, 6) AS ctoga_of_edited, round(g / edited_reads, 6) AS ctog_of_edited, round(a / edited_reads, 6) AS ctoa_of_edited,
  round(u / total_reads, 6) AS ctot_of_all, round(ga / total_reads, 6) AS ctoga_of_all, round(g / total_reads, 6) AS ctog_of_all, round(a / total_reads, 6) AS ctoa_of_all
FROM (SELECT condition, sum(CASE WHEN e THEN count ELSE 0.0 END) AS edited_reads, sum(CASE WHEN ut THEN count ELSE 0.0 END) AS u, sum(CASE WHEN gt OR av THEN count ELSE 0.0 END) AS ga, sum(CASE WHEN gt THEN count ELSE 0.0 END) AS g, sum(CASE WHEN av THEN count ELSE 0.0 END) AS a
  FROM (SELECT read_id, condition, max(count) AS count, bool_or(obs_nt <> ref_nt) AS e, bool_or(ref_nt = 'C' AND obs_nt = 'T') AS ut, bool_or(ref_nt = 'C' AND obs_nt = 'G') AS gt, bool_or(ref_nt = 'C' AND obs_nt = 'A') AS av FROM ih GROUP BY ALL) x GROUP BY ALL) p
JOIN (SELECT condition, sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) AS indel_reads, sum(count) AS total_reads, sum(CASE WHEN category = 'del' AND indel_length = 1 THEN count ELSE 0.0 END) AS del1, sum(CASE WHEN category = 'ins' AND indel_length = 1 THEN count ELSE 0.0 END) AS ins1
  FROM v_h6 WHERE role = 'T' GROUP BY ALL) q USING (condition)""", "v_g5_long", "v_h6", ctes=IMPUTED))
def a17_endo(s: Source) -> DataFrame:
    return rounded(hp.endogenous_summary(reads(s), s.v_h6.where("role = 'T'")))
