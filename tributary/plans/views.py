"""Networks, boxes and sweeps derived from the test tables; one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # one heap-shaped tree per nation, root r = 1
    "net": """SELECT c_custkey AS node_id, CAST(c_nationkey AS BIGINT) AS basin, c_acctbal AS inv,
      CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS r FROM customer""",
    "edge": """SELECT a.node_id AS pidx, a.node_id AS u, b.node_id AS v, a.basin, a.inv AS up_inv, b.inv AS dn_inv, a.inv / 1000e0 - 2e0 AS slope
      FROM net a JOIN net b ON a.basin = b.basin AND b.r = CAST(floor(a.r/2e0) AS BIGINT) WHERE a.r >= 2""",
    "mx": "SELECT basin, max(r) AS m FROM net GROUP BY basin",
    # in every fifth basin the root leads back to the last node
    "edge_cyc": """SELECT pidx, u, v, basin FROM edge UNION ALL SELECT a.node_id + 1000000, a.node_id, b.node_id, a.basin
      FROM net a JOIN mx ON mx.basin = a.basin JOIN net b ON b.basin = mx.basin AND b.r = mx.m WHERE a.r = 1 AND a.basin % 5 = 0""",
    # only edges between different segments conduct
    "edge_frag": """SELECT e.pidx, e.u, e.v, e.basin FROM edge e JOIN customer a ON a.c_custkey = e.u JOIN customer b ON b.c_custkey = e.v
      WHERE a.c_mktsegment <> b.c_mktsegment""",
    "multi": "SELECT l_suppkey % 40 AS u, l_partkey % 40 AS v FROM lineitem",
    "pt": "SELECT c_custkey AS id, (c_acctbal+1000)/5.5e0 AS x, ((c_custkey*7919)%2003)*1e0 AS y FROM customer",
    "spt": """SELECT s_suppkey AS id, (s_acctbal+1000)/5.5e0 AS x, ((s_suppkey*7919)%2003)*1e0 AS y,
      CASE WHEN s_nationkey < 12 THEN 200e0 ELSE 80e0 END AS tol FROM supplier""",
    # chains of customers of one nation, segment and balance bracket
    "pipe": """SELECT id AS pidx, concat('P', CAST(id AS VARCHAR(20))) AS fid, x AS sx, y AS sy, ex, ey FROM (SELECT id, x, y,
      lead(x) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal/1000) ORDER BY id) AS ex,
      lead(y) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal/1000) ORDER BY id) AS ey
      FROM pt JOIN customer ON c_custkey = id) chained WHERE ex IS NOT NULL""",
    "qpipe": """SELECT pidx, fid, CASE WHEN pidx % 11 = 0 THEN NULL ELSE concat('H', CAST(pidx AS VARCHAR(20))) END AS frommh, CASE WHEN pidx % 13 = 0 THEN NULL ELSE concat('H', CAST(pidx+1 AS VARCHAR(20))) END AS tomh,
      (pidx%7)*1e0-1 AS slope, (pidx*37)%50*1e0-5 AS up_inv, (pidx*53)%50*1e0-5 AS dn_inv, sx, sy, ex, ey FROM pipe""",
    "hole": """SELECT CAST(s_suppkey AS BIGINT) AS ord, concat('H', CAST(s_suppkey*7 AS VARCHAR(20))) AS fid, (s_acctbal+1000)/5.5e0 AS x, ((s_suppkey*7919)%2003)*1e0 AS y FROM supplier""",
    # reviewers' edits of pipes, some named, some only by a place
    "wanted": """SELECT CAST(s_suppkey AS BIGINT) AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'flip' WHEN 1 THEN 'extend' ELSE 'delete' END AS decision,
      CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('P', CAST((s_suppkey*13) % 150 AS VARCHAR(20))) END AS pipe_id, (c_acctbal+1000)/5.5e0+3 AS x, ((c_custkey*7919)%2003)*1e0+4 AS y,
      CASE WHEN s_suppkey % 3 <> 1 THEN NULL WHEN s_suppkey % 2 = 0 THEN concat(CAST(s_suppkey*3 AS VARCHAR(20)), ', ', CAST(s_suppkey*5 AS VARCHAR(20))) ELSE concat('H', CAST(s_suppkey*7 AS VARCHAR(20))) END AS target FROM supplier JOIN customer ON c_custkey = s_suppkey*10""",
    "unit": """SELECT c_custkey AS uid, c_mktsegment AS seg, greatest(c_acctbal,0) AS cnt, (c_custkey%40)*50e0 AS x0,
      (CAST(floor(c_custkey/40e0) AS BIGINT)%40)*50e0 AS y0, (c_custkey%40)*50e0+50 AS x1, (CAST(floor(c_custkey/40e0) AS BIGINT)%40)*50e0+50 AS y1 FROM customer""",
    "block": """SELECT DISTINCT CAST(floor(x0/100e0) AS BIGINT)*1000 + CAST(floor(y0/100e0) AS BIGINT) AS block, floor(x0/100e0)*100e0 AS x0,
      floor(y0/100e0)*100e0 AS y0, floor(x0/100e0)*100e0+100 AS x1, floor(y0/100e0)*100e0+100 AS y1 FROM unit""",
    "parcel": """SELECT o_orderkey AS pid, o_orderpriority AS use_desc, o_totalprice AS val, ((o_orderkey*31)%2000)*1e0 AS x0, ((o_orderkey*57)%2000)*1e0 AS y0,
      ((o_orderkey*31)%2000)+10e0+(o_orderkey%20) AS x1, ((o_orderkey*57)%2000)+10e0+(o_orderkey%20) AS y1 FROM orders""",
    "home": "SELECT * FROM parcel WHERE use_desc NOT LIKE '5%'",
    "site": """SELECT CAST(n_nationkey AS BIGINT) AS sid, (n_nationkey%5)*400e0 AS x0, CAST(floor(n_nationkey/5e0) AS BIGINT)*400e0 AS y0,
      (n_nationkey%5)*400e0+430 AS x1, CAST(floor(n_nationkey/5e0) AS BIGINT)*400e0+430 AS y1 FROM nation""",
    # lines from above to below all units, unevenly spaced, every third one traced
    "vline": "SELECT CAST(n_nationkey AS BIGINT) AS pidx, n_nationkey*55e0+20+(n_nationkey*7)%5*10 AS sx, -200e0 AS sy, 2300e0 AS ey, n_nationkey % 3 = 0 AS in_trace FROM nation",
    # block groups of two by two units, and estimates for them
    "ublock": """SELECT concat(lpad(CAST(CAST(floor(x0/100e0) AS BIGINT)*1000 + CAST(floor(y0/100e0) AS BIGINT) AS VARCHAR(20)), 12, '0'), lpad(CAST(min(uid)%1000 AS VARCHAR(20)), 3, '0')) AS geoid,
      CAST(floor(x0/100e0) AS BIGINT)*1000 + CAST(floor(y0/100e0) AS BIGINT) AS grp, x0, y0, x1, y1, sum(cnt) AS p_all,
      sum(CASE WHEN seg = 'BUILDING' THEN cnt ELSE 0e0 END) AS p_a, sum(CASE WHEN seg < 'F' THEN cnt/2 ELSE cnt/5 END) AS p_h FROM unit GROUP BY x0, y0, x1, y1""",
    "acs": """SELECT grp, (grp*7)%100*1e0 AS pn, 50e0+(grp*3)%200 AS pd, (grp*5)%40*1e0 AS pnm, (grp*11)%60*1e0 AS pdm, (grp*13)%90*1e0 AS sn, 20e0+(grp*17)%300 AS sd,
      (grp*19)%300*1e0 AS snm, (grp*23)%60*1e0 AS sdm, (grp*29)%50*1e0 AS i1, (grp*31)%50*1e0 AS i2, (grp*37)%50*1e0 AS i3 FROM (SELECT DISTINCT grp FROM ublock) g""",
    "sweep": """SELECT CAST(l_suppkey%24 AS BIGINT) AS site, l_returnflag AS method, CAST(l_linenumber%2 AS BIGINT) AS sel_r, floor(avg(l_discount)*1e5+0.5e0)/1e4 AS iou
      FROM lineitem GROUP BY l_suppkey%24, l_returnflag, l_linenumber%2""",
    # force mains in runs of neighbouring parts, some without a diameter
    "main": """SELECT p_partkey AS pidx, p_partkey AS a, p_partkey + p_size % 3 AS b, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size * 1e0 END AS diameter,
      p_retailprice AS length_ft FROM part""",
}
ORDER = list(VIEWS)


def needed(names: set[str]) -> list[str]:
    """The views that the given ones rest on, in order."""
    out: set[str] = set()
    todo = set(names)
    while todo:
        n = todo.pop()
        if n in VIEWS and n not in out:
            out.add(n)
            todo |= set(re.findall(r"\b[a-z_]+\b", VIEWS[n])) & set(VIEWS)
    return [n for n in ORDER if n in out]


def with_clause(sql: str) -> str:
    """Views (as common table expressions) in front of SQL text that may begin with further ones."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed(set(re.findall(r"\b[a-z_]+\b", sql)))]
    own = sql.strip()
    if own.upper().startswith("WITH "):
        return f"WITH RECURSIVE {', '.join([*parts, own[5:]])}"
    return f"WITH RECURSIVE {', '.join(parts)} {own}" if parts else own


class Views:
    """Tables and derived views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        own = needed({name})
        text = " ".join(VIEWS[n] for n in own)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in own)
        return self.spark.sql(f"WITH {parts} SELECT * FROM {name}")
