"""Registered queries over probability maps, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import dice_loss, entropy_bits, entropy_nats, entropy_nats_clipped, rounded
from ..functions.shared import written
from ..operators import calibration, cardinality
from ..operators import pixels as P
from ..operators.ranks import quantiles
from ..sources.views import COND, KEY, pixels
from .base_sql import DISC, ENS, PX, bits, clipped, nats, r, unit

K = "dataset, condition, sample_id"
REGISTRY: dict[str, tuple] = {}

IMG = (
    PX
    + f""", img AS (
  SELECT {K}, count(*) AS n, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS action, sum(truth) AS truth_pixels,
    sum(CASE WHEN p >= 0.5 AND truth = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND truth = 0 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN p < 0.5 AND truth = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p < 0.5 AND truth = 0 THEN 1 ELSE 0 END) AS tn,
    max(y) + 1 AS height, max(x) + 1 AS width, sum(p) AS sum_p, coalesce(sum(p) FILTER (p >= 0.5), 0) AS sum_p_in, max(p) AS max_p, min(p) AS min_p,
    avg(greatest(p, 1 - p)) AS mean_max_probability, -avg({clipped("p")}) AS negative_mean_entropy, coalesce(-avg({bits("p")}) FILTER (p >= 0.5), -1.0) AS foreground_entropy,
    avg((p - truth) * (p - truth)) AS brier, quantile_cont({bits("p")}, 0.5) AS med, min({bits("p")}) AS low, max({bits("p")}) AS high
  FROM px GROUP BY {K})"""
)


def add(name: str, run, sql: str, digits: tuple[str, ...] = (), places: int = 9) -> None:
    """``run`` gives the frame; columns in ``digits`` are rounded, as the SQL rounds them."""

    def query(spark, sf_dir):
        df = run(spark, sf_dir)
        return df.withColumns({c: rounded(F.col(c), places) for c in digits}) if digits else df

    REGISTRY[name] = (query, "WITH " + sql if not sql.lstrip().upper().startswith("WITH") else sql)


def img(*cols, names=()):
    return lambda s, d: P.image_scores(pixels(s, d), KEY).select(*KEY, *cols)


add("p1_hard_action", lambda s, d: P.hard_action(pixels(s, d)).select(*KEY, "y", "x", "a"), f"{PX} SELECT {K}, y, x, CAST(p >= 0.5 AS INT) AS a FROM px")
add("p2_fractions", img("action_fraction", "truth_fraction", "diagonal"), f"{IMG} SELECT {K}, {r('action / n', 'action_fraction')}, {r('truth_pixels / n', 'truth_fraction')}, {r('sqrt(CAST(height * height + width * width AS DOUBLE))', 'diagonal')} FROM img", ("action_fraction", "truth_fraction", "diagonal"))
add("p3_confusion", img("tp", "fp", "fn", "tn", "hard_error"), f"{IMG} SELECT {K}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {r('(fp + fn) / n', 'hard_error')} FROM img", ("hard_error",))
add("p4_entropy_bits", lambda s, d: pixels(s, d).select(*KEY, "y", "x", entropy_bits(F.col("p")).alias("h")), f"{PX} SELECT {K}, y, x, {r(bits('p'), 'h')} FROM px", ("h",))
add("p5_entropy_nats", lambda s, d: pixels(s, d).select(*KEY, "y", "x", entropy_nats_clipped(F.col("p")).alias("clipped"), entropy_nats(F.col("p")).alias("exact")), f"{PX} SELECT {K}, y, x, {r(clipped('p'), 'clipped')}, {r(nats('p'), 'exact')} FROM px", ("clipped", "exact"))
add("p6_mean_max_probability", img("mean_max_probability"), f"{IMG} SELECT {K}, {r('mean_max_probability', 'mean_max_probability')} FROM img", ("mean_max_probability",))
add("p7_negative_mean_entropy", img("negative_mean_entropy"), f"{IMG} SELECT {K}, {r('negative_mean_entropy', 'negative_mean_entropy')} FROM img", ("negative_mean_entropy",))
add("p8_foreground_entropy", img("foreground_entropy"), f"{IMG} SELECT {K}, {r('foreground_entropy', 'foreground_entropy')} FROM img", ("foreground_entropy",))
QFR = f"""qh AS (SELECT {K}, {bits('p')} AS h, CAST(p >= 0.5 AS INT) AS a FROM px),
 qr AS (SELECT *, count(*) OVER w AS n, sum(a) OVER w AS s, row_number() OVER (PARTITION BY {K} ORDER BY h) - 1 AS rk FROM qh WINDOW w AS (PARTITION BY {K})),
 qa AS (SELECT {K}, h, rk, (n - 1) * (n - s) // n AS lo, CAST((n - 1) * (n - s) % n AS DOUBLE) / n AS part FROM qr),
 qq AS (SELECT {K}, max(h) FILTER (rk = lo) AS qa_, max(h) FILTER (rk = lo + 1) AS qb_, max(part) AS part FROM qa GROUP BY {K}),
 qfr AS (SELECT {K}, -avg(h) AS qfr FROM qa JOIN (SELECT {K}, CASE WHEN part = 0 THEN qa_ ELSE qa_ + (qb_ - qa_) * part END AS qt FROM qq) USING ({K}) WHERE h >= qt GROUP BY {K})"""
add("p9_qfr", lambda s, d: P.quantile_foreground_ratio(pixels(s, d), KEY), f"{PX}, {QFR} SELECT {K}, {r('qfr', 'qfr')} FROM qfr", ("qfr",))
MMMC = "CASE WHEN high = 0 THEN 0 ELSE -(med + low) / high END"
add("p10_mmmc", img("mmmc"), f"{IMG} SELECT {K}, {r(MMMC, 'mmmc')} FROM img", ("mmmc",))
PLM = f"""ph AS (SELECT {K}, y, x, {bits('p')} AS h FROM px),
 pr AS (SELECT *, sum(h) OVER (PARTITION BY {K}, y ORDER BY x ROWS 2 PRECEDING) AS rs FROM ph),
 pc AS (SELECT *, sum(rs) OVER (PARTITION BY {K}, x ORDER BY y ROWS 2 PRECEDING) AS cs FROM pr),
 plm AS (SELECT {K}, -max(cs / 9) AS plm FROM pc WHERE x >= 2 AND y >= 2 GROUP BY {K})"""
add("p11_plm", lambda s, d: P.patch_maximum(pixels(s, d), KEY, 3), f"{PX}, {PLM} SELECT {K}, {r('plm', 'plm')} FROM plm", ("plm",))
SDC = "CASE WHEN sum_p + action = 0 THEN 0 ELSE 2 * sum_p_in / (sum_p + action) END"
add("p12_sdc", img("sdc"), f"{IMG} SELECT {K}, {r(SDC, 'sdc')} FROM img", ("sdc",))
DICE = "CASE WHEN action + truth_pixels = 0 THEN 0 ELSE 1 - 2 * tp / (action + truth_pixels) END"
JAC = "CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 1 - tp / (tp + fp + fn) END"
add("p13_common_scores", lambda s, d: P.common_scores(pixels(s, d), KEY, patch=3).select(*KEY, "mean_max_probability", "negative_mean_entropy", "foreground_entropy", "mmmc", "sdc", "dice_loss", "qfr", "plm"),
    f"{IMG}, {QFR}, {PLM} SELECT {K}, " + ", ".join(r(x, y) for x, y in (("mean_max_probability",) * 2, ("negative_mean_entropy",) * 2, ("foreground_entropy",) * 2, (MMMC, "mmmc"), (SDC, "sdc"), (DICE, "dice_loss"), ("qfr", "qfr"), ("plm", "plm"))) + f" FROM img JOIN qfr USING ({K}) JOIN plm USING ({K})",
    ("mean_max_probability", "negative_mean_entropy", "foreground_entropy", "mmmc", "sdc", "dice_loss", "qfr", "plm"))
add("m1_dice_loss", img("dice_loss"), f"{IMG} SELECT {K}, {r(DICE, 'dice_loss')} FROM img", ("dice_loss",))
add("m2_jaccard", img("jaccard_distance"), f"{IMG} SELECT {K}, {r(JAC, 'jaccard_distance')} FROM img", ("jaccard_distance",))

# --- level sets ---
LOSS = "CASE WHEN z + w + action = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * z / (z + w + action) END"


def ladder(m: int, name: str = "lad", gamma: float = 0.5, src: str = "px") -> str:
    return f"""{name} AS (SELECT {K}, k, sum(CASE WHEN p >= {gamma} AND p >= (k + 0.5::DOUBLE) / {m} THEN 1 ELSE 0 END) AS z, sum(CASE WHEN p < {gamma} AND p >= (k + 0.5::DOUBLE) / {m} THEN 1 ELSE 0 END) AS w,
   sum(CASE WHEN p >= {gamma} THEN 1 ELSE 0 END) AS action, count(*) AS n FROM {src}, unnest(range({m})) AS g(k) GROUP BY {K}, k)"""


from pyspark.sql import SparkSession  # noqa: E402


def q1(spark: SparkSession, sf_dir: str):
    """Nodes and weights of the midpoint rules, with the share of all pixels that reach each node."""
    px = pixels(spark, sf_dir)
    rule = spark.sql("SELECT m, k FROM VALUES (2), (8), (32) AS t(m) LATERAL VIEW explode(sequence(0, m - 1)) AS k").selectExpr("m", "k", "(k + 0.5D) / m AS t", "1.0D / m AS w")
    hist = px.groupBy("p").agg(F.count("*").alias("c"))
    joined = F.broadcast(rule).join(hist, hist.p >= rule.t, "left").groupBy("m", "k", "t", "w").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("pixels"))  # 42 nodes
    return joined


add("q1_nodes", q1, f"{PX}, rule AS (SELECT m, k, (k + 0.5::DOUBLE) / m AS t, 1.0::DOUBLE / m AS w FROM (VALUES (2), (8), (32)) AS v(m), unnest(range(m)) AS g(k)) SELECT CAST(m AS INT) AS m, CAST(k AS INT) AS k, {r('t', 't')}, {r('w', 'w')}, (SELECT count(*) FROM px WHERE p >= t) AS pixels FROM rule", ("t", "w"))
add("q2_level_set_risk", lambda s, d: P.level_set_risk(pixels(s, d), KEY, {0.25: 0.25, 0.75: 0.75}, dice_loss),
    f"""{PX}, c AS (SELECT {K}, t, v, sum(CASE WHEN p >= 0.5 AND p >= t THEN 1 ELSE 0 END) AS z, sum(CASE WHEN p < 0.5 AND p >= t THEN 1 ELSE 0 END) AS w, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS action
    FROM px, (VALUES (0.25::DOUBLE, 0.25::DOUBLE), (0.75::DOUBLE, 0.75::DOUBLE)) AS g(t, v) GROUP BY {K}, t, v) SELECT {K}, {r(f'sum(v * ({LOSS}))', 'risk')} FROM c GROUP BY {K}""", ("risk",))  # fmt: skip
LADDERS = ("confidence_dice_m2", "confidence_dice_m8", "confidence_dice_m32")
add("q3_dice_ladder", lambda s, d: P.dice_ladder(pixels(s, d), KEY, [2, 8, 32]),
    f"{PX}, {ladder(2, 'l2')}, {ladder(8, 'l8')}, {ladder(32, 'l32')}, " + ", ".join(f"a{m} AS (SELECT {K}, -avg({LOSS}) AS c FROM l{m} GROUP BY {K})" for m in (2, 8, 32)) + f" SELECT {K}, {r('a2.c', 'confidence_dice_m2')}, {r('a8.c', 'confidence_dice_m8')}, {r('a32.c', 'confidence_dice_m32')} FROM a2 JOIN a8 USING ({K}) JOIN a32 USING ({K})", LADDERS)
add("q6_union_of_nodes", lambda s, d: P.dice_ladder(pixels(s, d), KEY, [4, 12]),
    f"{PX}, {ladder(4, 'l4')}, {ladder(12, 'l12')}, a4 AS (SELECT {K}, -avg({LOSS}) AS c FROM l4 GROUP BY {K}), a12 AS (SELECT {K}, -avg({LOSS}) AS c FROM l12 GROUP BY {K}) SELECT {K}, {r('a4.c', 'confidence_dice_m4')}, {r('a12.c', 'confidence_dice_m12')} FROM a4 JOIN a12 USING ({K})", ("confidence_dice_m4", "confidence_dice_m12"))
EXACT = f"""eg AS (SELECT {K}, p, count(*) AS c, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS i FROM px GROUP BY {K}, p),
 es AS (SELECT *, sum(c) OVER w AS size, sum(i) OVER w AS inter, coalesce(lead(p) OVER w, 0.0) AS under, sum(i) OVER (PARTITION BY {K}) AS action, max(p) OVER (PARTITION BY {K}) AS top FROM eg WINDOW w AS (PARTITION BY {K} ORDER BY p DESC)),
 exact AS (SELECT {K}, -(sum(CASE WHEN p > 0 THEN (p - under) * (1 - 2.0::DOUBLE * inter / (size + action)) ELSE 0 END) + (1 - max(top)) * max(CASE WHEN action > 0 THEN 1.0 ELSE 0.0 END)) AS confidence_dice_exact FROM es GROUP BY {K})"""
add("q7_exact_dice", lambda s, d: P.exact_dice(pixels(s, d), KEY), f"{PX}, {EXACT} SELECT {K}, {r('confidence_dice_exact', 'confidence_dice_exact')} FROM exact", ("confidence_dice_exact",))


def q9(spark, sf_dir):
    """Losses and scores at other decision thresholds, all in one pass: gamma joins the key."""
    px = pixels(spark, sf_dir).withColumn("gamma", F.explode(F.array(F.lit(0.3), F.lit(0.7))))
    px = px.withColumn("shifted", F.col("p") - F.col("gamma"))
    a, p, t = F.col("shifted") >= 0, F.col("p"), F.col("truth")
    s = px.groupBy(*KEY, "gamma").agg(F.sum(F.when(a & (t == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(a, 1).otherwise(0)).alias("action"), F.sum("truth").alias("truth_pixels"), F.sum("p").alias("sum_p"), F.sum(F.when(a, p).otherwise(F.lit(0.0))).alias("sum_in"))
    return s.select(*KEY, "gamma", dice_loss(F.col("tp"), F.col("action"), F.col("truth_pixels")).alias("dice_loss"), F.when(F.col("sum_p") + F.col("action") == 0, 0.0).otherwise(2 * F.col("sum_in") / (F.col("sum_p") + F.col("action"))).alias("sdc"))


add("q9_other_gammas", q9, f"""{PX}, g AS (SELECT {K}, gamma, sum(CASE WHEN p - gamma >= 0 AND truth = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p - gamma >= 0 THEN 1 ELSE 0 END) AS action, sum(truth) AS truth_pixels, sum(p) AS sum_p, sum(CASE WHEN p - gamma >= 0 THEN p ELSE 0 END) AS sum_p_in
  FROM px, (VALUES (0.3::DOUBLE), (0.7::DOUBLE)) AS v(gamma) GROUP BY {K}, gamma) SELECT {K}, gamma, {r(DICE, 'dice_loss')}, {r(SDC, 'sdc')} FROM g""", ("dice_loss", "sdc"))  # fmt: skip

# --- counts ---
add("c1_count_ladders", lambda s, d: P.count_ladders(pixels(s, d), KEY, P.nodes(32)).select(*KEY, F.posexplode(F.arrays_zip("z", "w")).alias("k", "zw")).select(*KEY, "k", "zw.z", "zw.w"), f"{PX}, {ladder(32)} SELECT {K}, CAST(k AS INT) AS k, CAST(z AS BIGINT) AS z, CAST(w AS BIGINT) AS w FROM lad")
STUDY = f"""{ladder(32)}, mom AS (SELECT {K}, max(action) AS action, -avg({LOSS}) AS shared_dice, avg(z) AS mean_overlap, avg(w) AS mean_outside, var_pop(z) AS var_z, var_pop(w) AS var_w, covar_pop(z, w) AS cov FROM lad GROUP BY {K}),
 sums AS (SELECT {K}, sum(CASE WHEN p >= 0.5 THEN p ELSE 0 END) AS si, sum(CASE WHEN p < 0.5 THEN p ELSE 0 END) AS so FROM px GROUP BY {K}),
 two AS (SELECT a.dataset, a.condition, a.sample_id, -avg(CASE WHEN a.z + b.w + a.action = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * a.z / (a.z + b.w + a.action) END) AS two_block_dice FROM lad a JOIN lad b ON a.dataset = b.dataset AND a.condition = b.condition AND a.sample_id = b.sample_id GROUP BY a.dataset, a.condition, a.sample_id),
 study AS (SELECT {K}, action, shared_dice, two_block_dice, mean_overlap, mean_outside, var_z, var_w, cov, CASE WHEN action + si + so = 0 THEN 1 ELSE 2 * si / (action + si + so) END AS sdc,
   CASE WHEN action + si + so = 0 THEN 1 ELSE 2 * si / (action + si + so) + (-2 * (action + so) * var_z + 2 * (si - action - so) * cov + 2 * si * var_w) / pow(action + si + so, 3) END AS second_order FROM mom JOIN sums USING ({K}) JOIN two USING ({K}))"""


def study(*cols):
    return lambda s, d: P.count_study(pixels(s, d), KEY).select(*KEY, *cols)


def study_sql(*cols):
    return f"{PX}, {STUDY} SELECT {K}, " + ", ".join(r(c, c) for c in cols) + " FROM study"


for name, cols in {"c2_shared_dice": ("shared_dice",), "c3_two_block_dice": ("two_block_dice",), "c4_count_moments": ("mean_overlap", "mean_outside", "var_z", "var_w", "cov"), "c5_second_order": ("sdc", "second_order")}.items():
    add(name, study(*cols), study_sql(*cols).replace(", 9) +", ", 6) +"), cols, places=6)


def c12(spark, sf_dir):
    b = P.sdc_bound(pixels(spark, sf_dir), KEY)
    stratum = F.when(F.col("action") <= 24, "1-24").when(F.col("action") <= 32, "25-32").when(F.col("action") <= 40, "33-40").otherwise("41+")
    group = ["condition", "stratum"]
    b = written(b.select("condition", stratum.alias("stratum"), "error", "bound", "slack", "ratio", "holds"), "bounds")
    own = b.groupBy(*group).agg(F.count("*").alias("images"), F.avg("error").alias("mean_error"), F.min("slack").alias("min_slack"), F.max("ratio").alias("max_ratio"), F.min(F.col("holds").cast("int")).alias("all_hold"))
    return own.join(quantiles(b, group, F.col("bound"), {"bound_p95": 0.95}), group)


add("c12_sdc_bound", c12, f"""{PX}, {STUDY}, {EXACT}, b0 AS (SELECT condition, action, abs(-confidence_dice_exact - (1 - sdc)) AS error, 2 * sqrt(var_z) / action + sqrt(var_w) / (2 * action) AS bound FROM study JOIN exact USING ({K}) WHERE action > 0),
  b AS (SELECT *, bound - error AS slack, CASE WHEN bound = 0 AND error = 0 THEN 0 ELSE error / bound END AS ratio, CASE WHEN action <= 24 THEN '1-24' WHEN action <= 32 THEN '25-32' WHEN action <= 40 THEN '33-40' ELSE '41+' END AS stratum FROM b0)
  SELECT condition, stratum, count(*) AS images, {r('avg(error)', 'mean_error')}, {r('quantile_cont(bound, 0.95)', 'bound_p95')}, {r('min(slack)', 'min_slack')}, {r('max(ratio)', 'max_ratio')}, min(CAST(slack >= -64 * pow(2.0, -52) * greatest(1.0, bound, error) AS INT)) AS all_hold FROM b GROUP BY condition, stratum""", ("mean_error", "bound_p95", "min_slack", "max_ratio"))  # fmt: skip
add("c13_empty_chance", lambda s, d: P.empty_chance(pixels(s, d).withColumn("block", F.expr("y div 4 * 2 + x div 4")), KEY, "block"),
    f"""{PX}, f AS (SELECT {K}, 1 - max(p) AS shared, CASE WHEN max(p) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END)) END AS independent FROM px GROUP BY {K}),
    t AS (SELECT {K}, y // 4 * 2 + x // 4 AS block, max(p) AS top FROM px GROUP BY {K}, block),
    b AS (SELECT {K}, CASE WHEN max(top) >= 1 THEN 0 ELSE exp(sum(CASE WHEN top < 1 THEN ln(1 - top) ELSE 0 END)) END AS blk, greatest(0.0, 1 - coalesce(max(top) FILTER (block % 2 = 0), 0) - coalesce(max(top) FILTER (block % 2 = 1), 0)) AS antithetic FROM t GROUP BY {K})
    SELECT {K}, {r('shared', 'shared')}, {r('independent', 'independent')}, {r('blk', 'block')}, {r('antithetic', 'antithetic')} FROM f JOIN b USING ({K})""", ("shared", "independent", "block", "antithetic"))  # fmt: skip

# --- calibration ---
C = "dataset, condition"
add("k1_brier", lambda s, d: calibration.brier(pixels(s, d), KEY, COND), f"{PX}, b AS (SELECT {K}, sum((p - truth) * (p - truth)) AS s, count(*) AS n FROM px GROUP BY {K}) SELECT {C}, {r('sum(s) / sum(n)', 'pixel_weighted')}, {r('avg(s / n)', 'image_mean')}, CAST(sum(n) AS BIGINT) AS pixels FROM b GROUP BY {C}", ("pixel_weighted", "image_mean"))
BIN = "CAST(least(floor(p * 15), 14) AS INT)"
BINS = f"bins AS (SELECT {C}, {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(truth) AS rate FROM px GROUP BY {C}, bin)"
add("k2_reliability", lambda s, d: calibration.reliability_table(pixels(s, d), COND), f"{PX}, {BINS} SELECT {C}, CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n, {r('mean_p', 'mean_p')}, {r('rate', 'rate')}, {r('rate - mean_p', 'gap')} FROM (SELECT DISTINCT {C} FROM px) CROSS JOIN unnest(range(15)) AS g(bin) LEFT JOIN bins USING ({C}, bin)", ("mean_p", "rate", "gap"))
add("k3_ece", lambda s, d: calibration.expected_calibration_error(pixels(s, d), COND), f"{PX}, {BINS} SELECT {C}, {r('sum(n * abs(rate - mean_p)) / sum(n)', 'ece')}, CAST(sum(n) AS BIGINT) AS pixels FROM bins GROUP BY {C}", ("ece",))
LC = f"lc AS (SELECT {K}, k, sum(CASE WHEN p >= (k + 0.5::DOUBLE) / 32 THEN 1 ELSE 0 END) AS c, count(*) AS n FROM px, unnest(range(32)) AS g(k) GROUP BY {K}, k)"
CH = f"{LC}, ch AS (SELECT {K}, k, n, c - lead(c) OVER (PARTITION BY {K} ORDER BY k) AS d FROM lc QUALIFY k < 31)"
add("k4_ladder_masks", lambda s, d: calibration.ladder_masks(pixels(s, d), KEY, COND), f"{PX}, {LC} SELECT {C}, CAST(k AS INT) AS k, {r('sum(c) / sum(n)', 'pixel_fraction')}, {r('avg(c / n)', 'image_fraction')}, {r('avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END)', 'empty_ratio')} FROM lc GROUP BY {C}, k", ("pixel_fraction", "image_fraction", "empty_ratio"))
add("k5_adjacent_changes", lambda s, d: calibration.adjacent_changes(pixels(s, d), KEY, COND), f"{PX}, {CH} SELECT {C}, CAST(k AS INT) AS k, CAST(sum(d) AS BIGINT) AS changed, {r('avg(d / n)', 'mean_fraction')}, {r('max(d / n)', 'max_fraction')}, {r('avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END)', 'zero_ratio')} FROM ch GROUP BY {C}, k", ("mean_fraction", "max_fraction", "zero_ratio"))
add("k6_distinct_masks", lambda s, d: calibration.distinct_masks(pixels(s, d), KEY, COND), f"{PX}, {CH}, dm AS (SELECT {K}, CAST(1 + sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS INT) AS masks FROM ch GROUP BY {K}) SELECT {C}, masks, count(*) AS images FROM dm GROUP BY {C}, masks")
TS = f"ts_ AS (SELECT {K}, count(*) AS n, sum(truth) AS t FROM px GROUP BY {K})"
add("k7_mask_summary", lambda s, d: calibration.mask_summary(pixels(s, d), KEY, COND), f"{PX}, {TS} SELECT {C}, CAST(sum(n) AS BIGINT) AS pixels, {r('sum(t) / sum(n)', 'pixel_fraction')}, {r('avg(t / n)', 'image_fraction')}, CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, {r('avg(CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END)', 'empty_ratio')} FROM ts_ GROUP BY {C}", ("pixel_fraction", "image_fraction", "empty_ratio"))
add("k8_descriptors", lambda s, d: calibration.descriptors(pixels(s, d), KEY).select(*KEY, "prediction_only.n", F.array_join(F.col("prediction_only.ladder").cast("array<string>"), ",").alias("ladder"), F.array_join(F.col("prediction_only.changes").cast("array<string>"), ",").alias("changes"), "label_only.truth_pixels", "label_outcomes.wrong", "label_outcomes.brier"),
    f"{PX}, {CH}, l AS (SELECT {K}, max(n) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY k) AS ladder FROM lc GROUP BY {K}), c2 AS (SELECT {K}, string_agg(CAST(d AS VARCHAR), ',' ORDER BY k) AS changes FROM ch GROUP BY {K}), o AS (SELECT {K}, CAST(sum(truth) AS BIGINT) AS truth_pixels, CAST(sum(CASE WHEN (p >= 0.5) <> (truth = 1) THEN 1 ELSE 0 END) AS BIGINT) AS wrong, avg((p - truth) * (p - truth)) AS brier FROM px GROUP BY {K}) SELECT {K}, n, ladder, changes, truth_pixels, wrong, {r('brier', 'brier')} FROM l JOIN c2 USING ({K}) JOIN o USING ({K})", ("brier",))
add("k9_headline", lambda s, d: calibration.headline(pixels(s, d), KEY, COND), f"""{PX}, {BINS}, {CH}, b AS (SELECT {K}, sum((p - truth) * (p - truth)) AS s, count(*) AS n FROM px GROUP BY {K}), b2 AS (SELECT {C}, sum(s) / sum(n) AS brier, avg(s / n) AS brier_image FROM b GROUP BY {C}),
  e AS (SELECT {C}, sum(n * abs(rate - mean_p)) / sum(n) AS ece FROM bins GROUP BY {C}), w AS (SELECT {C}, avg(CASE WHEN (p >= 0.5) <> (truth = 1) THEN 1.0 ELSE 0.0 END) AS hard_error, avg(truth) AS foreground FROM px GROUP BY {C}),
  dm AS (SELECT {K}, 1 + sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS masks FROM ch GROUP BY {K}), dm2 AS (SELECT {C}, avg(masks) AS mean_masks FROM dm GROUP BY {C}), te AS (SELECT {C}, avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END) AS top_empty FROM lc WHERE k = 31 GROUP BY {C})
  SELECT {C}, """ + ", ".join(r(c, c) for c in ("brier", "brier_image", "ece", "hard_error", "foreground", "mean_masks", "top_empty")) + f" FROM b2 JOIN e USING ({C}) JOIN w USING ({C}) JOIN dm2 USING ({C}) JOIN te USING ({C})", ("brier", "brier_image", "ece", "hard_error", "foreground", "mean_masks", "top_empty"))  # fmt: skip


def k10(spark, sf_dir):
    """Accumulators of single images, added up by condition: the same numbers as over all pixels at once."""
    parts = calibration.accumulators(pixels(spark, sf_dir), KEY)
    return calibration.from_accumulators(calibration.merged(parts, COND), COND)


add("k10_accumulators", k10, f"{PX}, {BINS}, b AS (SELECT {C}, avg((p - truth) * (p - truth)) AS brier FROM px GROUP BY {C}) SELECT {C}, CAST(sum(n) AS BIGINT) AS n, {r('max(brier)', 'brier')}, {r('sum(n * abs(rate - mean_p)) / sum(n)', 'ece')} FROM bins JOIN b USING ({C}) GROUP BY {C}", ("brier", "ece"))

# --- mask sizes ---
SIZE = f"sz AS (SELECT {K}, count(*) AS n, CAST(sum(truth) AS BIGINT) AS k, sum(p) AS expected, max(p) AS top FROM px GROUP BY {K})"
add("d1_size_errors", lambda s, d: cardinality.size_errors(pixels(s, d), KEY).drop("empty_probability", "empty"), f"{PX}, {SIZE} SELECT {K}, n, k, {r('expected', 'expected')}, {r('expected / n', 'expected_fraction')}, {r('k / n', 'fraction')}, {r('expected - k', 'signed_error')}, {r('abs(expected - k)', 'absolute_error')} FROM sz", ("expected", "expected_fraction", "fraction", "signed_error", "absolute_error"))
CDF = f"""rk AS (SELECT {K}, p, row_number() OVER (PARTITION BY {K} ORDER BY p DESC) AS r, sum(truth) OVER (PARTITION BY {K}) AS k, count(*) OVER (PARTITION BY {K}) AS n FROM px),
 cdf AS (SELECT {K}, CAST(k AS BIGINT) AS k, CASE WHEN k = 0 THEN 0.0 ELSE 1 - max(p) FILTER (r = k) END AS lower, CASE WHEN k = n THEN 1.0 ELSE 1 - max(p) FILTER (r = k + 1) END AS upper FROM rk GROUP BY {K}, k, n)"""
PIT = f"{CDF}, pit AS (SELECT *, {unit("'pit|20260720|' || sample_id")} AS randomizer, lower + {unit("'pit|20260720|' || sample_id")} * (upper - lower) AS pit, upper - lower AS mass FROM cdf)"
SEED = 20260720
add("d2_cdf_bounds", lambda s, d: cardinality.cdf_bounds(pixels(s, d), KEY), f"{PX}, {CDF} SELECT {K}, k, {r('lower', 'lower')}, {r('upper', 'upper')} FROM cdf", ("lower", "upper"))
add("d3_pit", lambda s, d: cardinality.pit(pixels(s, d), KEY, SEED).select(*KEY, "randomizer", "pit"), f"{PX}, {PIT} SELECT {K}, {r('randomizer', 'randomizer')}, {r('pit', 'pit')} FROM pit", ("randomizer", "pit"))
add("d4_empty_probability", lambda s, d: cardinality.size_errors(pixels(s, d), KEY).select(*KEY, "empty_probability", "empty"), f"{PX}, {SIZE} SELECT {K}, {r('1 - top', 'empty_probability')}, CAST(k = 0 AS INT) AS empty FROM sz", ("empty_probability",))
add("d5_error_summary", lambda s, d: cardinality.error_summary(cardinality.size_errors(pixels(s, d), KEY), COND, "expected_fraction", "fraction"), f"{PX}, {SIZE}, e AS (SELECT {C}, expected / n AS a, k / n AS b FROM sz) SELECT {C}, {r('avg(a)', 'mean_predicted')}, {r('avg(b)', 'mean_observed')}, {r('avg(a - b)', 'bias')}, {r('avg(abs(a - b))', 'mae')}, {r('sqrt(avg((a - b) * (a - b)))', 'rmse')} FROM e GROUP BY {C}", ("mean_predicted", "mean_observed", "bias", "mae", "rmse"))
add("d6_ks_uniform", lambda s, d: cardinality.ks_uniform(cardinality.pit(pixels(s, d), KEY, SEED), COND), f"{PX}, {PIT}, o AS (SELECT {C}, pit AS u, row_number() OVER (PARTITION BY {C} ORDER BY pit) AS r, count(*) OVER (PARTITION BY {C}) AS n FROM pit) SELECT {C}, {r('max(greatest(r / n - u, u - (r - 1) / n))', 'ks')} FROM o GROUP BY {C}", ("ks",))
add("d7_pit_summary", lambda s, d: cardinality.pit_summary(cardinality.pit(pixels(s, d), KEY, SEED), COND), f"{PX}, {PIT} SELECT {C}, {r('avg(pit)', 'mean')}, {r('var_pop(pit)', 'variance')}, {r('avg(CASE WHEN pit < 0.05 OR pit > 0.95 THEN 1.0 ELSE 0.0 END)', 'outside')}, {r('avg(CASE WHEN mass = 0 THEN 1.0 ELSE 0.0 END)', 'zero_mass')}, {r('avg(mass)', 'mean_mass')}, CAST(sum(CASE WHEN mass = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM pit GROUP BY {C}", ("mean", "variance", "outside", "zero_mass", "mean_mass"))
add("d8_equal_count_bins", lambda s, d: cardinality.equal_count_bins(cardinality.size_errors(pixels(s, d), KEY), COND, "expected_fraction", "fraction", "sample_id"), f"{PX}, {SIZE}, b AS (SELECT {C}, expected / n AS a, k / n AS o, CAST(ntile(10) OVER (PARTITION BY {C} ORDER BY expected / n, sample_id) AS INT) AS bin FROM sz) SELECT {C}, bin, count(*) AS n, {r('avg(a)', 'mean_predicted')}, {r('avg(o)', 'mean_observed')}, {r('avg(a) - avg(o)', 'gap')} FROM b GROUP BY {C}, bin", ("mean_predicted", "mean_observed", "gap"))
