"""SQL of the derived tables that queries read: the same tables as ``sources.views``, written for DuckDB."""

PX = """px AS (
  WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  q AS (SELECT vec_id, label, i, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + 2 * v)) AS p FROM e),
  t AS (SELECT label, i, CAST(2 * sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) >= count(*) AS INT) AS truth FROM q GROUP BY label, i)
  SELECT 'emb' AS dataset, CAST(label AS VARCHAR) AS condition, vec_id AS sample_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, p, truth FROM q JOIN t USING (label, i))"""

REC = """rec AS (
  WITH a AS (SELECT l_orderkey, count(*) AS n, sum(CAST(round(100 * l_discount) AS BIGINT)) AS d, sum(CAST(round(100 * l_tax) AS BIGINT)) AS t, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderpriority AS dataset, o_orderstatus AS condition, o_orderkey AS sample_id, o_custkey AS cluster_id, CAST(o_orderkey % 3 AS INT) AS seed,
         CAST(d AS DOUBLE) / (10 * n) AS risk_dice, CAST(t AS DOUBLE) / (8 * n) AS risk_nhd, -CAST(5 * d + q AS DOUBLE) / (100 * n) AS confidence_dice_m32,
         -CAST(5 * t + q AS DOUBLE) / (90 * n) AS confidence_nhd_m32, 1 - CAST(d + t AS DOUBLE) / (18 * n) AS confidence_sdc
  FROM orders JOIN a ON o_orderkey = l_orderkey)"""

DISC = """disc AS (
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS r FROM lineitem),
  k AS (SELECT l_suppkey AS s, CAST(floor(r / 24) AS INT) AS y, CAST(r % 24 AS INT) AS x, CAST(round(100 * l_discount) AS INT) AS d, CAST(round(100 * l_tax) AS INT) AS t FROM r),
  g AS (SELECT s, y, x, d, t, (y-10-s%3)*(y-10-s%3) + (x-11-s%4)*(x-11-s%4) AS d2, 25+s%40 AS r2 FROM k)
  SELECT 'disc' AS dataset, CAST(s % 5 AS VARCHAR) AS condition, s AS sample_id, y, x, CAST(r2 AS DOUBLE) / (r2+d2+d) AS p, CASE WHEN d2+t <= r2 THEN 1 ELSE 0 END AS truth FROM g)"""

ENS = (
    PX
    + """, ens AS (SELECT px.* EXCLUDE (p), j AS member, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p + CAST((7*y + 3*x + 5*j) % 11 - 5 AS DOUBLE) / 100.0::DOUBLE)) AS p FROM px, unnest(range(3)) AS m(j))"""
)

STREAM = "st AS (SELECT ts, user_id, value / (value + 50) AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS truth, event_type, value FROM events)"

DOC = """doc AS (SELECT lang AS dataset, doc_id AS sample_id, source AS condition, CAST(1 - quality AS DOUBLE) AS risk, CAST(toxic AS DOUBLE) AS risk2, CAST(n_chars AS DOUBLE) AS confidence FROM documents JOIN labels USING (doc_id))"""



def bits(p: str) -> str:
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) ELSE 0.0::DOUBLE END)"


def nats(p: str) -> str:
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN -({p} * ln({p}) + (1 - {p}) * ln(1 - {p})) ELSE 0.0::DOUBLE END)"


def clipped(p: str) -> str:
    c = f"greatest(least({p}, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE)"
    return f"(-({c} * ln({c}) + (1 - {c}) * ln(1 - {c})))"


def unit(text: str) -> str:
    """A number in (0, 1) from the first 52 bits of SHA-256."""
    return f"((('0x' || substr(sha256({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def r(x: str, name: str) -> str:
    """A double as ``functions.scores.rounded`` rounds it; the small step takes exact halves the same way everywhere."""
    return f"round(({x}) + 1e-13::DOUBLE, 9) + 0.0 AS {name}"
