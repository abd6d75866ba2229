"""Queries over indel counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators import batch, indels
from editloom.operators.batch import SIGNATURE
from editloom.plans.positions import TAIL, f_tail
from editloom.plans.registry import query, rounded
from editloom.sources.fixtures import Source, oracle

SIG = ", ".join(SIGNATURE)
NULLS = ", ".join(f"{c} NULLS FIRST" for c in SIGNATURE)
SIDES = f"t AS (SELECT condition, site, {SIG}, count FROM v_h6 WHERE role = 'T'), c AS (SELECT condition, site, {SIG}, count FROM v_h6 WHERE role = 'C')"
SAME = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in ["condition", "site", *SIGNATURE])
PICK = ", ".join(f"CASE WHEN t.count IS NOT NULL THEN t.{k} ELSE c.{k} END AS {k}" for k in ["condition", "site", *SIGNATURE])
SHIFT = """CASE WHEN mh_length <= 0 THEN 0 WHEN e0 - indel_start >= 7 AND e0 - 18 >= 0 AND e0 - 18 < mh_length THEN e0 - 18
  ELSE list_extract(list_sort(list_transform(range(0, greatest(mh_length, 1)), lambda s: {'d': least(abs((indel_start + e0) / 2.0 - s - 6), abs((indel_start + e0) / 2.0 - s - 18)), 's': s})), 1).s END"""
ALIGNED = SIDES + f""",
f AS (SELECT *, count / sum(count) OVER (PARTITION BY condition, site) AS frequency FROM t),
a AS (SELECT *, CAST(indel_start - shift AS INT) AS start_adj, CAST(e0 - shift AS INT) AS end_adj, CASE WHEN category = 'del' THEN -indel_length ELSE indel_length END AS signed_length FROM (
  SELECT *, CAST({SHIFT} AS INT) AS shift FROM (SELECT *, CASE WHEN category = 'ins' THEN indel_start + 1 ELSE indel_end END AS e0 FROM f WHERE category <> 'wildtype') x) y),
covered AS (SELECT *, unnest(range(start_adj, end_adj)) AS position FROM a WHERE end_adj > start_adj)"""


def sides(s: Source) -> tuple[DataFrame, DataFrame]:
    return s.v_h6.where("role = 'T'").drop("role"), s.v_h6.where("role = 'C'").drop("role")


@query("j3_indel_subtract", oracle(f"""
SELECT condition, site, {SIG}, round(v, 6) AS count FROM (
  SELECT *, CASE WHEN category <> 'wildtype' AND ti AND ci THEN greatest(0.0, nt - coalesce(nc / nullif(sc, 0) * st, 0)) ELSE nt END AS v FROM (
    SELECT *, sum(nt) OVER w AS st, sum(nc) OVER w AS sc, bool_or(category <> 'wildtype' AND nt > 0) OVER w AS ti, bool_or(category <> 'wildtype' AND nc > 0) OVER w AS ci
    FROM (SELECT {PICK}, coalesce(t.count, 0.0) AS nt, coalesce(c.count, 0.0) AS nc FROM t FULL JOIN c ON {SAME}) x WINDOW w AS (PARTITION BY condition, site)) y) z WHERE v > 0""", "v_h6", ctes=SIDES))
def j3_indel_subtract(s: Source) -> DataFrame:
    return rounded(indels.subtract(*sides(s)))


@query("j4_indel_bc", oracle(f"""
SELECT condition, site, {SIG}, t_count, round(c_freq, 6) AS c_freq, matched, round(least(1.0, {TAIL.format(k="t_count", n="matched", p="c_freq")}), 6) AS p_value FROM (
  SELECT m.*, sum(t_count) OVER (PARTITION BY m.condition, m.site) AS matched FROM (
    SELECT {", ".join(f"t.{k}" for k in ["condition", "site", *SIGNATURE])}, t.count AS t_count, c.f AS c_freq FROM t JOIN (SELECT *, count / sum(count) OVER (PARTITION BY condition, site) AS f FROM c) c ON {SAME}) m
  JOIN (SELECT condition, site FROM t GROUP BY ALL HAVING bool_or(category <> 'wildtype')) p ON m.condition = p.condition AND m.site = p.site
  JOIN (SELECT condition, site FROM c GROUP BY ALL HAVING bool_or(category <> 'wildtype')) q ON m.condition = q.condition AND m.site = q.site) y WHERE category <> 'wildtype'""", "v_h6", ctes=SIDES))
def j4_indel_bc(s: Source) -> DataFrame:
    return rounded(indels.control_explained(*sides(s)))


@query("f13_anti", oracle(f"""
SELECT *, round(count / sum(count) OVER (PARTITION BY condition, site), 6) AS frequency FROM t
WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM c WHERE category = 'del' AND count >= 40) c WHERE {SAME})""", "v_h6", ctes=SIDES))
def f13_anti(s: Source) -> DataFrame:
    t, c = sides(s)
    return rounded(indels.remove(t, c.where("category = 'del' and count >= 40"), ["condition", "site", *SIGNATURE]))


@query("f14_site_wipe", oracle("""
SELECT t.* FROM t LEFT JOIN (SELECT condition, site FROM (SELECT *, count / sum(count) OVER (PARTITION BY condition, site) AS f FROM c) x WHERE category <> 'wildtype' GROUP BY ALL HAVING max(f) >= 0.05) b
  ON t.condition = b.condition AND t.site = b.site WHERE category = 'wildtype' OR b.site IS NULL""", "v_h6", ctes=SIDES))
def f14_site_wipe(s: Source) -> DataFrame:
    return indels.wipe_sites(*sides(s))


T9 = SIDES + f""",
f AS (SELECT *, count / sum(count) OVER (PARTITION BY condition, site) AS frequency FROM t),
fi AS (SELECT * FROM f WHERE category <> 'wildtype'),
seen AS (SELECT DISTINCT fi.condition, site, batch FROM fi JOIN v_cond ON fi.condition = v_cond.condition),
kinds AS (SELECT DISTINCT site, {SIG} FROM fi),
obs AS (SELECT kinds.*, seen.condition, batch, coalesce(frequency, 0.0) AS frequency FROM kinds JOIN seen ON kinds.site = seen.site
  LEFT JOIN fi ON fi.condition = seen.condition AND fi.site = kinds.site AND {" AND ".join(f"fi.{k} IS NOT DISTINCT FROM kinds.{k}" for k in SIGNATURE)}),
bt AS (SELECT site, {SIG}, batch, count(*) AS n, avg(frequency) AS m, stddev_pop(frequency) AS sd, max(frequency) AS top, var_pop(frequency) * count(*) AS ss FROM obs GROUP BY ALL),
tests AS (SELECT site, {SIG}, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(ss) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, bool_or(sd > 0) AS varies, bool_or(n = 1 AND top > 0) AS lone, avg(m) AS mean_means FROM bt GROUP BY ALL)"""


@query("t9_indel_anova", oracle(f"""
SELECT site, {SIG}, round(greatest(b, 0.0) / (k - 1) / (w / (n - k)), 3) AS f_stat, k - 1 AS df_between, n - k AS df_within, round(mean_means, 6) AS mean_means
FROM tests WHERE k >= 2 AND n > k AND w > 0 AND (varies OR NOT lone)""", "v_h6", "v_cond", ctes=T9))
def t9_indel_anova(s: Source) -> DataFrame:
    found = batch.indel_anova(sides(s)[0], s.v_cond).select("site", *SIGNATURE, "f_stat", "df_between", "df_within", "mean_means")
    return rounded(found.withColumn("f_stat", F.round("f_stat", 3)))


def culprits(alpha: float) -> str:
    return f"""
, scored AS (SELECT *, k - 1 AS d1, n - k AS d2, greatest(b, 0.0) / (k - 1) / (w / (n - k)) AS f FROM tests WHERE k >= 2 AND n > k AND w > 0 AND (varies OR NOT lone)),
tailed AS (SELECT *, exp(floor(ln(greatest(p_value, 1e-300)) * 1e9 + 0.5) / 1e9) AS p FROM (SELECT *, {f_tail("f", "d1", "d2")} AS p_value FROM scored) x),
placed AS (SELECT *, p <= row_number() OVER (ORDER BY p, site, {NULLS}) / CAST(count(*) OVER () AS DOUBLE) * {alpha} AS accept FROM tailed WHERE p <= 0.995)
SELECT {", ".join(f"bt.{c}" for c in ["site", *SIGNATURE])}, batch, round(m, 6) AS batch_mean FROM bt JOIN placed ON bt.site = placed.site AND {" AND ".join(f"bt.{c} IS NOT DISTINCT FROM placed.{c}" for c in SIGNATURE)}
WHERE accept AND (m >= mean_means - 1e-12 OR m >= 0.005 - 1e-12)"""


@query("t9_culprits", oracle(culprits(1.5), "v_h6", "v_cond", ctes=T9).replace("\n\n, scored", ",\nscored"))
def t9_culprits(s: Source) -> DataFrame:
    """Batches that carry an indel more than others. The tables hold no batch effects: at the reference's level of
    0.01 nothing is accepted, so that of this query, 1.5, lets through what lies below the ranks of chance."""
    return rounded(batch.indel_batch_effects(sides(s)[0], s.v_cond, alpha=1.5)[1])


PLANTED = T9.replace(SIDES, f"""real AS (SELECT condition, site, {SIG}, count FROM v_h6 WHERE role = 'T'),
t AS (SELECT * FROM real UNION ALL SELECT condition, site, 'ins', 7, 8, 1, 0, 'T', sum(count) * (0.4 + 0.01 * k) FROM real JOIN v_cond USING (condition) WHERE batch = 'b1' AND site % 7 = 0 GROUP BY condition, site, k)""")


@query("t9_planted", oracle(culprits(0.01), "v_h6", "v_cond", ctes=PLANTED).replace("\n\n, scored", ",\nscored"))
def t9_planted(s: Source) -> DataFrame:
    """Batches that carry an indel more than others, at the reference's level: one batch has an insertion of its own at every
    seventh site, as much as two fifths of the site's reads."""
    t = sides(s)[0]
    depth = t.where("site % 7 = 0").groupBy("condition", "site").agg(F.sum("count").alias("depth")).join(F.broadcast(s.v_cond.where("batch = 'b1'").select("condition", "k")), "condition")
    own = depth.select("condition", "site", F.lit("ins").alias("category"), F.lit(7).alias("indel_start"), F.lit(8).alias("indel_end"), F.lit(1).alias("indel_length"), F.lit(0).alias("mh_length"), F.lit("T").alias("inserted_bases"), (F.col("depth") * (0.4 + 0.01 * F.col("k"))).alias("count"))
    return rounded(batch.indel_batch_effects(t.unionByName(own), s.v_cond, alpha=0.01)[1])


@query("a6_indel_summary", oracle("""
SELECT *, round(indel_count / total_count, 6) AS indel_freq, round(del_count / total_count, 6) AS del_freq, round(ins_count / total_count, 6) AS ins_freq, round(wildtype_count / total_count, 6) AS wildtype_freq FROM (
  SELECT condition, site, sum(count) AS total_count, sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) AS indel_count, sum(CASE WHEN category = 'del' THEN count ELSE 0.0 END) AS del_count,
    sum(CASE WHEN category = 'ins' THEN count ELSE 0.0 END) AS ins_count, sum(CASE WHEN category = 'wildtype' THEN count ELSE 0.0 END) AS wildtype_count FROM t GROUP BY ALL) x""", "v_h6", ctes=SIDES))
def a6_indel_summary(s: Source) -> DataFrame:
    return rounded(indels.summary(sides(s)[0]))


@query("j7_site_indels", oracle("""
SELECT condition, site, tn AS t_total, round(greatest(0.0, ti - ci / cn * tn), 6) AS indel_count, round(greatest(0.0, ti - ci / cn * tn) / tn, 6) AS indel_freq
FROM (SELECT condition, site, sum(count) AS tn, sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) AS ti FROM t GROUP BY ALL) x
JOIN (SELECT condition, site, sum(count) AS cn, sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) AS ci FROM c GROUP BY ALL) y USING (condition, site) WHERE tn >= 100 AND cn >= 100""", "v_h6", ctes=SIDES))
def j7_site_indels(s: Source) -> DataFrame:
    return rounded(indels.site_indels(*sides(s)))


@query("a7_len_spectrum", oracle("""
SELECT g.condition, g.site, CAST(l AS INT) AS signed_length, round(coalesce(v, 0.0), 6) AS frequency FROM (SELECT DISTINCT condition, site FROM t) g CROSS JOIN (SELECT unnest(range(-40, 16)) AS l) r
LEFT JOIN (SELECT condition, site, signed_length, sum(frequency) AS v FROM a GROUP BY ALL) z ON g.condition = z.condition AND g.site = z.site AND l = signed_length WHERE l <> 0""", "v_h6", ctes=ALIGNED))
def a7_len_spectrum(s: Source) -> DataFrame:
    return rounded(indels.length_spectrum(sides(s)[0]))


@query("a8_pos_spectrum", oracle("SELECT condition, site, CAST(position AS INT) AS position, round(sum(frequency), 6) AS frequency FROM covered GROUP BY ALL", "v_h6", ctes=ALIGNED))
def a8_pos_spectrum(s: Source) -> DataFrame:
    return rounded(indels.position_spectrum(sides(s)[0]))


@query("a9_pos_len", oracle("SELECT condition, site, CAST(position AS INT) AS position, signed_length, round(sum(frequency), 6) AS frequency FROM covered GROUP BY ALL", "v_h6", ctes=ALIGNED))
def a9_pos_len(s: Source) -> DataFrame:
    return rounded(indels.position_length(sides(s)[0]))


@query("a9_global", oracle("SELECT condition, start_adj AS position, signed_length, sum(count) AS count FROM a GROUP BY ALL", "v_h6", ctes=ALIGNED))
def a9_global(s: Source) -> DataFrame:
    return indels.position_length(sides(s)[0], whole=True)


@query("a10_reduce_1bp", oracle(f"""
SELECT t.condition, site, {SIG}, count, round(CASE WHEN indel_length = 1 THEN count * (CASE WHEN share > 0.3 THEN (1 - share) * 0.3 / 0.7 / share ELSE 1 END) ELSE count END, 6) AS reduced
FROM t JOIN (SELECT condition, sum(CASE WHEN indel_length = 1 THEN count ELSE 0.0 END) / sum(count) AS share FROM t WHERE category <> 'wildtype' GROUP BY ALL) f ON t.condition = f.condition""", "v_h6", ctes=SIDES))
def a10_reduce_1bp(s: Source) -> DataFrame:
    return rounded(indels.reduce_single(sides(s)[0]).drop("factor"))


@query("x7_left_shift", oracle(f"SELECT condition, site, {SIG}, shift, start_adj, end_adj, signed_length FROM a", "v_h6", ctes=ALIGNED))
def x7_left_shift(s: Source) -> DataFrame:
    return indels.aligned(sides(s)[0]).drop("count")


@query("x13_del_nts", oracle(f"""
SELECT a.condition, a.site, {SIG}, start_adj, end_adj, del_nts, substr(del_nts, 1, 1) AS left_nt, right(del_nts, 1) AS right_nt FROM (
  SELECT a.*, CASE WHEN a.category = 'del' AND start_adj + pos0_idx >= 0 AND end_adj + pos0_idx <= length(seq) AND end_adj > start_adj THEN substr(seq, start_adj + pos0_idx + 1, end_adj - start_adj) END AS del_nts
  FROM a JOIN v_site ON a.site = v_site.site) a""", "v_h6", "v_site", ctes=ALIGNED))
def x13_del_nts(s: Source) -> DataFrame:
    return indels.deleted_bases(sides(s)[0], s.v_site).drop("count", "shift", "signed_length")


@query("a27_crun", oracle("""
SELECT g.condition, g.site, CAST(length(regexp_extract(substr(seq, 1, pos0_idx + 5), 'C*$', 0)) AS INT) AS run, round(coalesce(v, 0.0), 6) AS frequency
FROM (SELECT DISTINCT condition, site FROM t) g JOIN v_site ON g.site = v_site.site
LEFT JOIN (SELECT condition, site, sum(CASE WHEN category = 'del' AND indel_length = 1 AND end_adj = 5 THEN frequency ELSE 0.0 END) AS v FROM a GROUP BY ALL) z ON g.condition = z.condition AND g.site = z.site
WHERE substr(seq, pos0_idx + 5, 1) = 'C' AND substr(seq, pos0_idx + 6, 1) <> 'C'""", "v_h6", "v_site", ctes=ALIGNED))
def a27_crun(s: Source) -> DataFrame:
    return rounded(indels.run_deletions(sides(s)[0], s.v_site))


@query("a28_frac_1nt", oracle("""
SELECT condition, round(sum(CASE WHEN abs(signed_length) = 1 THEN frequency ELSE 0.0 END) / sum(frequency), 6) AS indel1, round(sum(CASE WHEN signed_length = -1 THEN frequency ELSE 0.0 END) / sum(frequency), 6) AS del1,
  round(sum(CASE WHEN signed_length = 1 THEN frequency ELSE 0.0 END) / sum(frequency), 6) AS ins1 FROM a GROUP BY ALL""", "v_h6", ctes=ALIGNED))
def a28_frac_1nt(s: Source) -> DataFrame:
    return rounded(indels.single_shares(sides(s)[0]))


@query("a29_heatmap", oracle("""
SELECT condition, CAST(position AS INT) AS position, signed_length, round(avg(v), 6) AS mean_frequency, round(quantile_cont(v, 0.5), 6) AS median_frequency
FROM (SELECT condition, site, position, signed_length, sum(frequency) AS v FROM covered GROUP BY ALL) x GROUP BY ALL""", "v_h6", ctes=ALIGNED))
def a29_heatmap(s: Source) -> DataFrame:
    return rounded(indels.mean_heatmap(sides(s)[0]))


@query("j5_cas9", oracle(f"""
SELECT condition, site, {SIG}, round(v, 6) AS count FROM (
  SELECT *, CASE WHEN sc < 1000 OR st = 0 THEN nt WHEN nt = 0 THEN 0.0 ELSE greatest(0.0, nt - nc / sc * st) END AS v FROM (
    SELECT *, sum(nt) OVER w AS st, sum(nc) OVER w AS sc FROM (SELECT {PICK}, coalesce(t.count, 0.0) AS nt, coalesce(c.count, 0.0) AS nc FROM t FULL JOIN c ON {SAME}) x WINDOW w AS (PARTITION BY condition, site)) y) z WHERE v <> 0""", "v_h6", ctes=SIDES))
def j5_cas9(s: Source) -> DataFrame:
    return rounded(indels.cas9_adjust(*sides(s), SIGNATURE))


@query("a14_cas9_frac", oracle("""
SELECT *, round(edited_count / total_count, 6) AS edited_fraction FROM (SELECT condition, site, sum(CASE WHEN category IN ('del', 'ins') THEN count ELSE 0.0 END) AS edited_count, sum(count) AS total_count FROM t GROUP BY ALL) x""", "v_h6", ctes=SIDES))
def a14_cas9_frac(s: Source) -> DataFrame:
    return rounded(indels.cas9_fraction(sides(s)[0]))
