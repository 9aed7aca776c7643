"""Shared fragments of the check SQL (DuckDB dialect)."""

ORD = """ord AS (
  SELECT r_name, o_orderkey, o_orderpriority, o_orderstatus, c_mktsegment, o_totalprice, o_orderdate, c_acctbal, c_custkey,
    CASE WHEN o_totalprice < 100000 THEN 'p1' WHEN o_totalprice < 200000 THEN 'p2'
         WHEN o_totalprice < 350000 THEN 'p3' ELSE 'p4' END AS price_band
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CODED = ORD + """, coded AS (
  SELECT ord.*,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE -1 END AS pri,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS sta,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
         WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE -1 END AS seg,
    CASE price_band WHEN 'p1' THEN 1 WHEN 'p2' THEN 2 WHEN 'p3' THEN 3 ELSE 4 END AS pb
  FROM ord), keyed AS (
  SELECT coded.*, ((((pri + 1) * 4 + sta + 1) * 6 + seg + 1) * 5 + pb)::BIGINT AS vid FROM coded)"""

VECTORS = CODED + """, collapsed AS (
  SELECT r_name, vid, pri, sta, seg, pb, count(*)::BIGINT AS w, min(o_orderkey) AS first_row
  FROM keyed GROUP BY ALL), v AS (
  SELECT collapsed.*, sum(w) OVER (PARTITION BY r_name)::BIGINT AS n,
    max(pb) OVER (PARTITION BY r_name)::DOUBLE AS top FROM collapsed)"""

# The same vectors with a price step of 12,500 instead of the price band.
FINE_VECTORS = VECTORS.replace(
    "CASE price_band WHEN 'p1' THEN 1 WHEN 'p2' THEN 2 WHEN 'p3' THEN 3 ELSE 4 END AS pb",
    "least(floor(o_totalprice / 12500), 39)::INT + 1 AS pb",
).replace("* 5 + pb", "* 41 + pb")

PAIRS = VECTORS + """, parts AS (
  SELECT a.r_name, a.vid, a.w, a.n, a.first_row, b.vid AS vid_b, b.w AS w_b, b.first_row AS first_b, a.top,
    (CASE WHEN a.pri = b.pri THEN 0 WHEN a.pri = -1 OR b.pri = -1 THEN 1 ELSE 2 END
     + CASE WHEN a.sta = b.sta THEN 0 ELSE 2 END + CASE WHEN a.seg = b.seg THEN 0 ELSE 2 END)::DOUBLE AS m,
    abs(a.pb - b.pb)::DOUBLE / a.top AS g, (a.pb <> b.pb)::INT AS pb_differs
  FROM v a JOIN v b ON a.r_name = b.r_name), d AS (
  SELECT *, sqrt(m + g * g) AS dist, m + pb_differs AS apart FROM parts)"""

KDIST = PAIRS + """, hist AS (
  SELECT r_name, vid, w, n, first_row, dist, sum(w_b)::BIGINT AS cnt FROM d GROUP BY ALL), cum AS (
  SELECT *, sum(cnt) OVER (PARTITION BY r_name, vid ORDER BY dist) AS reached FROM hist), kd AS (
  SELECT r_name, vid, w, n, first_row, min(dist) AS kdist FROM cum WHERE reached >= 10 GROUP BY ALL)"""

# Given partitions used to check the metrics before any algorithm: one by order status with
# "P" as noise, one by segment, one by price band.
LABELS = """labels_of AS (
  SELECT r_name, vid, w, n, pri, sta, seg, pb, top, 'status' AS algorithm, CASE sta WHEN 2 THEN -1 ELSE sta END AS label FROM v
  UNION ALL SELECT r_name, vid, w, n, pri, sta, seg, pb, top, 'segment', seg FROM v
  UNION ALL SELECT r_name, vid, w, n, pri, sta, seg, pb, top, 'band', CASE WHEN pb = 4 THEN -1 ELSE pb END FROM v)"""

FEATURES = """points AS (
  SELECT *, [(pri = 0)::INT, (pri = 1)::INT, (pri = 2)::INT, (pri = 3)::INT, (sta = 0)::INT, (sta = 1)::INT, (sta = 2)::INT,
    (seg = 0)::INT, (seg = 1)::INT, (seg = 2)::INT, (seg = 3)::INT, (seg = 4)::INT, pb / top]::DOUBLE[] AS x
  FROM labels_of WHERE label >= 0), long AS (
  SELECT r_name, algorithm, label, vid, w, unnest(generate_series(1, 13)) AS j, unnest(x) AS xj FROM points), centre AS (
  SELECT r_name, algorithm, label, j, sum(w * xj) / sum(w) AS c FROM long GROUP BY ALL)"""


def uniform(*parts: str) -> str:
    """MD5 uniform in [0, 1) of the given SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE / pow(2, 52))"
