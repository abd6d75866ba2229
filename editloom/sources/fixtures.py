"""Count tables in the engine's shapes, viewed over the driver's tables.

Sites follow part keys, ten to a site, and reads follow customer keys, so sites, cells and reads grow with the tables; the
eight conditions are the experiment's design. Quantities stand for five reads each, so that depths are those of a screen.
``v_g4`` has the positions of the guide, ``v_g4_early`` those before and at its start, ``v_quality`` a Phred score a call of ``v_g4``.

The SQL of each view runs unchanged in Spark and DuckDB, so an oracle can start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_cond": """
SELECT DISTINCT s_suppkey % 8 AS k, concat('c', CAST(s_suppkey % 8 AS STRING)) AS condition,
 CASE WHEN s_suppkey % 2 = 0 THEN 'BE4' ELSE 'ABE' END AS editor,
 CASE WHEN s_suppkey % 8 < 2 THEN 'b0' WHEN s_suppkey % 8 < 4 THEN 'b1' WHEN s_suppkey % 8 < 6 THEN 'b2' ELSE 'b3' END AS batch,
 CASE WHEN s_suppkey % 8 < 4 THEN '12kChar' ELSE 'CtoT' END AS library, 'mES' AS celltype FROM supplier""",
    "v_site": """
SELECT site, seq, substr(seq, 12, 20) AS grna, 10 AS pos0_idx,
 CASE WHEN site % 5 = 0 THEN 'mismatch' ELSE 'satmut' END AS category FROM (
 SELECT site, concat(translate(md5(CAST(site AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT'),
                     translate(md5(concat('s',CAST(site AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT')) AS seq
 FROM (SELECT DISTINCT CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT) AS site FROM part) a) b""",
    "v_g4": """
SELECT role, condition, site, idx, idx - pos0_idx AS position, ref_nt, obs_nt, CAST(sum(qty) AS DOUBLE) AS count FROM (
 SELECT CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'C' END AS role, concat('c', CAST(l_suppkey % 8 AS STRING)) AS condition,
  s.site AS site, s.pos0_idx AS pos0_idx, 14 + l_linenumber AS idx, substr(s.seq, 15 + l_linenumber, 1) AS ref_nt,
  CASE WHEN l_orderkey % 10 < 7 THEN substr(s.seq, 15 + l_linenumber, 1) ELSE substr('ACGT', CAST(1 + (l_orderkey + l_partkey) % 4 AS INT), 1) END AS obs_nt,
  l_quantity * 5 AS qty FROM lineitem JOIN v_site s ON CAST((l_partkey - l_partkey % 10) / 10 AS BIGINT) = s.site) x
 GROUP BY role, condition, site, idx, idx - pos0_idx, ref_nt, obs_nt""",
    "v_g4_early": """
SELECT role, condition, site, idx, idx - pos0_idx AS position, ref_nt, obs_nt, CAST(sum(qty) AS DOUBLE) AS count FROM (
 SELECT CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'C' END AS role, concat('c', CAST(l_suppkey % 8 AS STRING)) AS condition,
  s.site AS site, s.pos0_idx AS pos0_idx, 5 + l_linenumber AS idx, substr(s.seq, 6 + l_linenumber, 1) AS ref_nt,
  CASE WHEN l_orderkey % 10 < 7 THEN substr(s.seq, 6 + l_linenumber, 1) ELSE substr('ACGT', CAST(1 + (l_orderkey + l_partkey) % 4 AS INT), 1) END AS obs_nt,
  l_quantity * 5 AS qty FROM lineitem JOIN v_site s ON CAST((l_partkey - l_partkey % 10) / 10 AS BIGINT) = s.site) x
 GROUP BY role, condition, site, idx, idx - pos0_idx, ref_nt, obs_nt""",
    "v_quality": """
SELECT CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'C' END AS role, concat('c', CAST(l_suppkey % 8 AS STRING)) AS condition,
 CAST((l_partkey - l_partkey % 10) / 10 AS BIGINT) AS site, 14 + l_linenumber AS idx, 34 + CAST(round(l_tax * 100) AS INT) % 7 AS quality FROM lineitem""",
    "v_g5_long": """
SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'C' END AS role,
 concat('c', CAST(o_custkey % 8 AS STRING)) AS condition, s.site AS site, p.pos AS pos,
 substr(s.seq, s.pos0_idx + p.pos + 1, 1) AS ref_nt,
 CASE WHEN substr(md5(concat(CAST(o_orderkey AS STRING),'|',CAST(p.pos AS STRING))),1,1) IN ('0','1','2')
        THEN CASE WHEN substr(s.seq, s.pos0_idx + p.pos + 1, 1) = 'C' THEN substr('TTGA', CAST(1 + o_orderkey % 4 AS INT), 1) ELSE 'G' END
      WHEN substr(md5(concat(CAST(o_orderkey AS STRING),'|',CAST(p.pos AS STRING))),1,1) = 'f' THEN '.'
      ELSE substr(s.seq, s.pos0_idx + p.pos + 1, 1) END AS obs_nt, CAST(1 + o_orderkey % 50 AS DOUBLE) AS count
 FROM orders JOIN v_site s ON CAST((o_custkey - o_custkey % 8) / 8 AS BIGINT) = s.site CROSS JOIN (VALUES (3),(4),(5),(6),(7),(8),(9)) AS p(pos)
 WHERE substr(s.seq, s.pos0_idx + p.pos + 1, 1) IN ('A','C')""",
    "v_h6": """
SELECT role, condition, site, category, indel_start, indel_end, indel_length, mh_length, inserted_bases, CAST(sum(c) AS DOUBLE) AS count FROM (
 SELECT CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'C' END AS role, concat('c', CAST(l_suppkey % 8 AS STRING)) AS condition, CAST((l_partkey - l_partkey % 10) / 10 AS BIGINT) AS site,
  CASE l_returnflag WHEN 'A' THEN 'del' WHEN 'R' THEN 'ins' ELSE 'wildtype' END AS category,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity % 3 AS INT) + 5 END AS indel_start,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity % 3 AS INT) + 6 + (l_linenumber - 1) % 3 END AS indel_end,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE (l_linenumber - 1) % 3 + 1 END AS indel_length,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(round(l_tax * 100) AS INT) % 3 END AS mh_length,
  CASE WHEN l_returnflag = 'R' THEN substr('ACG', 1, CAST((l_linenumber - 1) % 3 + 1 AS INT)) ELSE NULL END AS inserted_bases,
  CAST(l_quantity * CASE WHEN l_returnflag = 'N' THEN 20 ELSE 1 END AS DOUBLE) AS c FROM lineitem) x
 GROUP BY role, condition, site, category, indel_start, indel_end, indel_length, mh_length, inserted_bases""",
}
READS = {"v_cond": ["supplier"], "v_site": ["part"], "v_g4": ["lineitem", "v_site"], "v_g4_early": ["lineitem", "v_site"], "v_quality": ["lineitem"], "v_g5_long": ["orders", "v_site"], "v_h6": ["lineitem"]}


class Source:
    """Lazy frames of one scale-factor folder: driver tables and views by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name in VIEWS:
            frames = {r: getattr(self, r) for r in READS[name]}
            text = VIEWS[name]
            for r in frames:
                text = text.replace(f"FROM {r}", "FROM {" + r + "}").replace(f"JOIN {r} ", "JOIN {" + r + "} ")
            found = self.spark.sql(text, **frames)
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = found
        return found


#: What is added before rounding on both sides, so that halves, which sums in another order miss on either side, fall alike.
NUDGE = 1e-10


def nudged(sql: str) -> str:
    """``sql`` with ``NUDGE`` added to what is rounded to a number of digits."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, comma, end = 1, None, begin + len("round(")
        while depth:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        inner = begin + len("round(")
        out += sql[at:inner] + (f"({nudged(sql[inner:comma])}) + {NUDGE}{sql[comma:end]}" if comma else nudged(sql[inner:end]))
        at = end
    return out + sql[at:]


def oracle(select: str, *views: str, ctes: str = "") -> str:
    """SQL over the views: their definitions as CTEs, more CTEs, then ``select``."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in views or any(v in READS[w] for w in views)]
    return nudged("WITH " + ",\n".join([*parts, *([ctes] if ctes else [])]) + "\n" + select if parts or ctes else select)
