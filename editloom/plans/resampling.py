"""Queries over bootstrap intervals whose cost does not join every draw with its row."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.operators import indels, resample
from editloom.operators.resample import BELOW, FACTOR, MOST, PICK, REP, ROW, SHIFT, SPAN
from editloom.plans import indels as iq
from editloom.plans.registry import query, rounded
from editloom.plans.summaries import ANNOT, V, ratios
from editloom.sources.fixtures import Source, oracle
from editloom.sources.shared import new_folder, written

QUANTILES = ", ".join(f"round(quantile_cont(m, {q}), 6) AS {n}" for n, q in resample.INTERVAL.items())


def mixed(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {FACTOR}) & {SPAN - 1})"
    return f"xor({x}, {x} >> 16)"


def multinomial(rows: str, by: str, replicates: int, value: str = "m") -> str:
    """CTEs up to ``means`` (by, rep, m) with the draws of ``resample.multinomial_means``. ``rows``: by, x and ``spot``, the order."""
    sums = " + ".join(f"pow(r, {k}) / {factorial(k)}.0" for k in range(MOST + 1))
    cut = ", ".join(f"CAST(floor({SPAN} * (exp(-r) * ({' + '.join(sums.split(' + ')[: k + 1])}))) AS BIGINT)" for k in range(MOST + 1))
    return f"""
numbered AS MATERIALIZED (SELECT *, (spot * {ROW} + {SHIFT}) & {SPAN - 1} AS s FROM ({rows}) x),
hashed AS MATERIALIZED (SELECT *, {mixed("s")} AS h FROM numbered),
cut AS MATERIALIZED (SELECT n, [{cut}] AS cuts FROM (SELECT DISTINCT n, greatest(0.0, 1 - {BELOW} / sqrt(n)) AS r FROM numbered) x),
shifted AS (SELECT {by}, n, x, cuts, rep, (h + rep * {REP}) & {SPAN - 1} AS v FROM hashed JOIN cut USING (n), (SELECT unnest(range(1, {replicates + 1})) AS rep) r),
totals AS MATERIALIZED (SELECT {by}, rep, n, sum(w) AS drawn, sum(w * x) AS held FROM (SELECT {by}, rep, n, x, len(list_filter(cuts, lambda c: u >= c)) AS w FROM (SELECT *, {mixed("v")} AS u FROM shifted) y) z GROUP BY ALL),
lacking AS (SELECT {by}, rep, n, unnest(range(1, CAST(CASE WHEN drawn <= n THEN n - drawn ELSE n END AS BIGINT) + 1)) AS j FROM totals),
pick1 AS (SELECT {by}, rep, n, {mixed("v")} AS h FROM (SELECT *, (j * {PICK} + {SHIFT}) & {SPAN - 1} AS v FROM lacking) x),
pick2 AS (SELECT {by}, rep, {mixed("v")} % n AS spot FROM (SELECT *, (h + rep * {REP}) & {SPAN - 1} AS v FROM pick1) x),
more AS (SELECT {by}, rep, sum(x) AS more FROM pick2 JOIN numbered USING ({by}, spot) GROUP BY ALL),
means AS (SELECT {by}, {value.replace("m", "(CASE WHEN drawn <= n THEN held ELSE 0 END + coalesce(more, 0)) / n")} AS m FROM totals LEFT JOIN more USING ({by}, rep))"""


def _spots(select: str, by: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS spot, count(*) OVER (PARTITION BY {by}) AS n FROM ({select}) z"


@query("t12_mean_multinomial", oracle(f"SELECT condition, {QUANTILES} FROM means GROUP BY ALL", *V, ctes=ANNOT + "," + multinomial(_spots("SELECT condition, site, ratio AS x FROM ratios WHERE ratio IS NOT NULL", "condition", "site"), "condition", 5000)))
def t12_mean_multinomial(s: Source) -> DataFrame:
    return rounded(resample.bootstrap_means(ratios(s), "ratio", ["condition"], ["site"], 5000))


@query("t12_gmean_multinomial", oracle(f"SELECT condition, {QUANTILES.replace('(m,', '(exp(m),')} FROM means GROUP BY ALL", *V, ctes=ANNOT + "," + multinomial(_spots("SELECT condition, site, ln(ratio) AS x FROM ratios WHERE ratio > 0", "condition", "site"), "condition", 10000)))
def t12_gmean_multinomial(s: Source) -> DataFrame:
    return rounded(resample.bootstrap_means(ratios(s), "ratio", ["condition"], ["site"], 10000, "gmean"))


SINGLE = iq.ALIGNED + """,
single AS (SELECT condition, site, position, sum(frequency) AS frequency FROM covered WHERE abs(signed_length) = 1 GROUP BY ALL),
filled AS (SELECT condition, site, position, coalesce(frequency, 0.0) AS x FROM (SELECT DISTINCT condition, site FROM t) g JOIN (SELECT DISTINCT condition, position FROM single) p USING (condition) LEFT JOIN single USING (condition, site, position)),"""


@query("t12_by_position", oracle(f"SELECT condition, CAST(position AS INT) AS position, {QUANTILES} FROM means GROUP BY ALL", "v_h6", ctes=SINGLE + multinomial(_spots("SELECT * FROM filled", "condition, position", "site"), "condition, position", 1000)))
def t12_by_position(s: Source) -> DataFrame:
    """The mean frequency of one-base indels by position, over a condition's sites."""
    rows = indels.single_base_positions(iq.sides(s)[0])
    return rounded(resample.bootstrap_means(rows, "frequency", ["condition", "position"], ["site"], 1000))


LENGTHS = iq.ALIGNED + """,
lengths AS (SELECT condition, site, signed_length, sum(frequency) AS v FROM a GROUP BY ALL),
filled AS (SELECT editor, g.condition, g.site, CAST(l AS INT) AS signed_length, coalesce(v, 0.0) AS x FROM (SELECT DISTINCT condition, site FROM t) g JOIN v_cond ON g.condition = v_cond.condition CROSS JOIN (SELECT unnest(range(-40, 16)) AS l) r
  LEFT JOIN lengths z ON g.condition = z.condition AND g.site = z.site AND l = z.signed_length WHERE l <> 0),"""


@query("t12_by_length", oracle(f"SELECT editor, signed_length, {QUANTILES} FROM means GROUP BY ALL", "v_h6", "v_cond", ctes=LENGTHS + multinomial(_spots("SELECT * FROM filled", "editor, signed_length", "condition, site"), "editor, signed_length", 1000)))
def t12_by_length(s: Source) -> DataFrame:
    """The mean frequency of indels by length, over all sites of an editor's conditions. Only lengths that a site has are rows."""
    by, told = ["editor", "signed_length"], F.col("signed_length").between(-40, 15) & (F.col("signed_length") != 0)
    cells = written(indels.length_cells(iq.sides(s)[0]), new_folder(s.spark, "lengths")).join(s.v_cond.select("condition", "editor"), "condition")
    sites = cells.select("editor", "condition", "site").distinct()
    found = resample.bootstrap_means(cells.where(told), "frequency", by, ["condition", "site"], 1000, over=sites)
    every = sites.select("editor").distinct().withColumn("signed_length", F.explode(F.array(*[F.lit(i) for i in range(-40, 16) if i])))
    return rounded(every.join(found, by, "left").na.fill(0.0))


def _tail(least: str) -> str:
    """P(X >= least) of n draws with chance k / n, by its terms."""
    return f"CASE WHEN k = n THEN 1.0 ELSE list_sum(list_transform(range({least}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln(1 - k / n)))) END"


LAW = ANNOT + f""",
spot AS MATERIALIZED (SELECT *, (n + 1) // 2 AS m FROM (SELECT condition, ratio AS x, row_number() OVER (PARTITION BY condition ORDER BY ratio) AS k, count(*) OVER (PARTITION BY condition) AS n FROM ratios WHERE ratio IS NOT NULL) z),
tails AS MATERIALIZED (SELECT *, {_tail("m")} AS one, {_tail("m + 1")} AS two, lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) AS c FROM spot),
same AS (SELECT condition, x AS median, CASE WHEN n % 2 = 1 THEN one - coalesce(lag(one) OVER w, 0) ELSE two - coalesce(lag(one) OVER w, 0) + CASE WHEN k > 1 AND k < n THEN exp(c + m * ln((k - 1) / n) + (n - m) * ln(1 - k / n)) ELSE 0 END END AS chance FROM tails WINDOW w AS (PARTITION BY condition ORDER BY k)),
apart AS (SELECT a.condition, (a.x + b.x) / 2 AS median, exp(c + m * ln(a.k / a.n) + (a.n - m) * ln((a.n - b.k + 1) / a.n)) * (1 - CASE WHEN a.k > 1 THEN exp(m * ln((a.k - 1) / a.k)) ELSE 0 END)
  * (1 - CASE WHEN b.k < a.n THEN exp((a.n - m) * ln((a.n - b.k) / (a.n - b.k + 1))) ELSE 0 END) AS chance FROM tails a JOIN (SELECT condition, k, x FROM spot) b ON a.condition = b.condition AND a.k < b.k WHERE a.n % 2 = 0),
law AS (SELECT condition, median, sum(chance) AS chance FROM (SELECT * FROM same UNION ALL SELECT * FROM apart) z GROUP BY ALL),
summed AS (SELECT *, sum(chance) OVER (PARTITION BY condition ORDER BY median) AS total FROM law)"""


@query("t12_median_law", oracle("SELECT condition, " + ", ".join(f"round(min(median) FILTER (total >= {q} - 1e-9), 6) AS {n}" for n, q in resample.INTERVAL.items()) + " FROM summed GROUP BY ALL", *V, ctes=LAW))
def t12_median_law(s: Source) -> DataFrame:
    return rounded(resample.median_intervals(ratios(s), "ratio", ["condition"]))
