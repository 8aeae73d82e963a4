"""Registered queries of summaries, cases, contracts, sources and streaming, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rounded
from ..functions.shared import scratch, written
from ..operators import agreement as A
from ..operators import assembly as T
from ..operators import pixels as P
from ..operators import selective as S
from ..operators import summaries as M
from ..operators import validate as V
from ..operators.ranks import quantiles
from ..sources import io
from ..sources.views import COND, KEY, pixels, read, records, stream_rows
from ..streaming import monitor
from .base_sql import PX, REC, STREAM, r
from .pixel_queries import DICE, EXACT, IMG, LOSS, SDC, STUDY, ladder
from .record_queries import COVER, HARM, LONG, METHODS, RISKS, area, ranked, rho, shares, summed, tau

K = "dataset, condition, sample_id"
C = "dataset, condition"
REGISTRY: dict[str, tuple] = {}


def add(name: str, run, sql: str | None, digits: tuple[str, ...] = ()) -> None:
    def query(spark, sf_dir):
        df = run(spark, sf_dir)
        return df.withColumns({c: rounded(F.col(c)) for c in digits}) if digits else df

    REGISTRY[name] = (query, sql and "WITH " + sql)


# --- summaries ---
ERR = f"e AS (SELECT *, 1 - confidence_sdc AS p, 1 - confidence_sdc - risk_dice AS e FROM rec), wb AS (SELECT {C}, p, risk_dice AS o, ntile(10) OVER (PARTITION BY {C} ORDER BY p, sample_id) AS bin FROM e), wg AS (SELECT {C}, bin, count(*) AS c, abs(avg(p) - avg(o)) AS gap FROM wb GROUP BY {C}, bin), we AS (SELECT {C}, sum(c * gap) / sum(c) AS ece FROM wg GROUP BY {C})"
add("w1_grouped_reliability", lambda s, d: M.grouped_reliability(records(s, d).withColumn("p", 1 - F.col("confidence_sdc")), COND, "p", "risk_dice", "sample_id"), f"{REC}, {ERR} SELECT {C}, count(*) AS n, {r('avg(e)', 'bias')}, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('max(ece)', 'ece')} FROM e JOIN we USING ({C}) GROUP BY {C}", ("bias", "mae", "rmse", "ece"))
add("w2_action_quality", lambda s, d: M.action_quality(P.image_scores(pixels(s, d), KEY), COND), f"{IMG}, {HARM}, di AS (SELECT *, {DICE} AS dl FROM img), {area('o', 'di', C, '-dl', 'dl')} SELECT {C}, {r('avg(dl)', 'mean_loss')}, {r('avg(CASE WHEN action = 0 THEN 1.0 ELSE 0.0 END)', 'empty_actions')}, {r('avg(CASE WHEN truth_pixels = 0 THEN 1.0 ELSE 0.0 END)', 'empty_truths')}, {r('max(aurc)', 'oracle')}, {r('avg(dl)', 'random')} FROM di JOIN o USING ({C}) GROUP BY {C}", ("mean_loss", "empty_actions", "empty_truths", "oracle", "random"))
CONTRASTS = [("dice", "confidence_dice_m32", "confidence_sdc", "risk_dice"), ("nhd", "confidence_nhd_m32", "confidence_sdc", "risk_nhd"), ("cross", "confidence_dice_m32", "confidence_nhd_m32", "risk_nhd")]
VALUES = ", ".join(str(x) for x in CONTRASTS)


def w3(spark, sf_dir):
    specs = spark.sql(f"SELECT * FROM VALUES {VALUES} AS t(name, left, right, risk)")
    return M.contrast_table(S.matrix(records(spark, sf_dir), COND, "sample_id", METHODS, RISKS), specs, COND)


add("w3_contrasts", w3, f"{REC}, {HARM}, {LONG}, {area('z', 'lg', C + ', risk_name, method', 'score', 'risk')} SELECT a.dataset, a.condition, v.name, {r('a.aurc', 'left_aurc')}, {r('b.aurc', 'right_aurc')}, {r('a.aurc - b.aurc', 'difference')}, CASE WHEN round(a.aurc - b.aurc, 9) < 0 THEN 'left_lower' WHEN round(a.aurc - b.aurc, 9) > 0 THEN 'right_lower' ELSE 'tie' END AS direction FROM (VALUES {VALUES}) AS v(name, l, rr, risk) JOIN z a ON a.method = l AND a.risk_name = risk JOIN z b ON b.method = rr AND b.risk_name = risk AND a.dataset = b.dataset AND a.condition = b.condition", ("left_aurc", "right_aurc", "difference"))
GAMMAS = [0.3, 0.5, 0.7]


def gamma_sql() -> str:
    parts = []
    for i, g in enumerate(GAMMAS):
        parts.append(f"""gi{i} AS (SELECT {K}, sum(CASE WHEN p >= {g} THEN 1 ELSE 0 END) AS action, sum(truth) AS truth_pixels, sum(CASE WHEN p >= {g} AND truth = 1 THEN 1 ELSE 0 END) AS tp, sum(p) AS sum_p, coalesce(sum(p) FILTER (p >= {g}), 0) AS sum_p_in FROM px GROUP BY {K}), {ladder(8, f'gl{i}', g)},
 gr{i} AS (SELECT {K}, {g}::DOUBLE AS gamma, {DICE} AS risk, round({SDC}, 9) AS sdc, round(ld, 9) AS ladder FROM gi{i} JOIN (SELECT {K}, -avg({LOSS}) AS ld FROM gl{i} GROUP BY {K}) USING ({K}))""")
    return ", ".join(parts) + ", gam AS (" + " UNION ALL ".join(f"SELECT * FROM gr{i}" for i in range(3)) + ")"


def gammas(s, d):
    g = M.gamma_records(pixels(s, d), KEY, GAMMAS)
    return g.withColumns({"sdc": F.round("sdc", 9), "ladder": F.round("ladder", 9)})


GC = f"{area('ga', 'gam', C + ', gamma', 'ladder', 'risk')}, {area('gb', 'gam', C + ', gamma', 'sdc', 'risk')}, gc AS (SELECT {C}, gamma, round(ga.aurc - gb.aurc, 9) AS d FROM ga JOIN gb USING ({C}, gamma)), dirs AS (SELECT *, CASE WHEN d < 0 THEN 'left_lower' WHEN d > 0 THEN 'right_lower' ELSE 'tie' END AS dir FROM gc), ch AS (SELECT {C}, a.gamma, a.d - b.d AS change, b.dir AS was, a.dir AS now, CAST(a.dir = b.dir AS INT) AS retained, CAST(a.dir <> b.dir AND a.dir <> 'tie' AND b.dir <> 'tie' AS INT) AS reversal, CAST(a.dir <> b.dir AND (a.dir = 'tie' OR b.dir = 'tie') AS INT) AS tie_transition FROM dirs a JOIN dirs b USING ({C}) WHERE a.gamma <> 0.5 AND b.gamma = 0.5)"


def changes(s, d):
    return M.sensitivity(M.gamma_contrasts(gammas(s, d), COND, "ladder", "sdc"), COND)


add("w4_sensitivity", changes, f"{PX}, {HARM}, {gamma_sql()}, {GC} SELECT {C}, gamma, {r('change', 'change')}, was, now, retained, reversal, tie_transition FROM ch", ("change",))
add("w5_gamma_stability", lambda s, d: M.gamma_stability(gammas(s, d), COND, "sample_id", "sdc", COVER), f"{PX}, {gamma_sql()}, gp AS (SELECT {C}, a.gamma AS g1, b.gamma AS g2, a.sdc AS x, b.sdc AS y FROM gam a JOIN gam b USING ({K}) WHERE a.gamma < b.gamma), {rho('q', 'gp', C + ', g1, g2', 'x', 'y')}, {shares('aw', 'gam.sdc', 'gam', C + ', gamma')}, j AS (SELECT {C}, a.gamma AS g1, b.gamma AS g2, coverage, sum(least(a.w, b.w)) / sum(greatest(a.w, b.w)) AS j FROM aw a JOIN aw b USING ({C}, sample_id, coverage) WHERE a.gamma < b.gamma GROUP BY {C}, a.gamma, b.gamma, coverage) SELECT {C}, g1, g2, coverage, {r('j', 'jaccard')}, {r('rho', 'rho')} FROM j JOIN q USING ({C}, g1, g2)", ("jaccard", "rho"))
add("w6_roll_up", lambda s, d: M.roll_up(changes(s, d), ["gamma"], "condition"), f"{PX}, {HARM}, {gamma_sql()}, {GC} SELECT gamma, {r('min(change)', 'low')}, {r('max(change)', 'high')}, {r('quantile_cont(change, 0.5)', 'median')}, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(reversal) AS BIGINT) AS reversals, coalesce(string_agg(condition, ',' ORDER BY condition) FILTER (reversal = 1), '') AS reversed FROM ch GROUP BY gamma", ("low", "high", "median"))
SEEDS = f"{area('sa', 'rec', C + ', seed', 'confidence_dice_m32', 'risk_dice')}, {area('sb', 'rec', C + ', seed', 'confidence_sdc', 'risk_dice')}, sd AS (SELECT {C}, seed, sa.aurc AS aurc, round(sa.aurc - sb.aurc, 9) AS d FROM sa JOIN sb USING ({C}, seed))"


def seeds(s, d):
    rec = records(s, d)
    a = S.aurc(rec, [*COND, "seed"], "confidence_dice_m32", "risk_dice").select(*COND, "seed", "aurc")
    b = S.aurc(rec, [*COND, "seed"], "confidence_sdc", "risk_dice").select(*COND, "seed", F.col("aurc").alias("b"))
    return a.join(b, [*COND, "seed"]).select(*COND, "seed", "aurc", F.round(F.col("aurc") - F.col("b"), 9).alias("difference"))


add("w7_seed_summary", lambda s, d: M.seed_summary(seeds(s, d), COND, "aurc").drop("by_seed"), f"{REC}, {HARM}, {SEEDS} SELECT {C}, count(*) AS seeds, {r('avg(aurc)', 'mean')}, {r('min(aurc)', 'low')}, {r('max(aurc)', 'high')}, {r('max(aurc) - min(aurc)', 'range')}, {r('stddev_samp(aurc)', 'sd')} FROM sd GROUP BY {C}", ("mean", "low", "high", "range", "sd"))
add("w8_seed_direction", lambda s, d: M.seed_direction(seeds(s, d), COND, "difference", 0), f"{REC}, {HARM}, {SEEDS}, g AS (SELECT {C}, count(*) AS seeds, sum(CAST(d > 0 AS INT)) AS up, sum(CAST(d < 0 AS INT)) AS down, max(CAST(sign(d) AS INT)) FILTER (seed = 0) AS reference FROM sd GROUP BY {C}), m AS (SELECT *, CASE WHEN up > down THEN 1 WHEN down > up THEN -1 ELSE 0 END AS majority FROM g), n AS (SELECT *, CASE WHEN majority > 0 THEN down WHEN majority < 0 THEN up ELSE 0 END AS against FROM m) SELECT {C}, seeds, majority, CAST(reference = majority AS INT) AS reference_agrees, CAST(against > 0 AS INT) AS reversal, CAST(majority <> 0 AND against = 0 AND reference = majority AS INT) AS passes FROM n")


def w10(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("CAST(user_id % 5 AS STRING) AS condition", "event_type AS method", "value AS wall")
    return M.timings(rows, ["condition"], "method", "wall", 16, 4.2, "error")


W10 = ("low", "median", "high", "ms_per_image", "ms_per_megapixel", "images_per_second", "ratio")
add("w10_timings", w10, f"t AS (SELECT CAST(user_id % 5 AS VARCHAR) AS condition, event_type AS method, count(*) AS runs, min(value) AS low, quantile_cont(value, 0.5) AS median, max(value) AS high FROM events GROUP BY ALL), b AS (SELECT condition, median AS base FROM t WHERE method = 'error') SELECT condition, method, runs, {r('low', 'low')}, {r('median', 'median')}, {r('high', 'high')}, {r('1000 * median / 16', 'ms_per_image')}, {r('1000 * median / 4.2', 'ms_per_megapixel')}, {r('16 / median', 'images_per_second')}, {r('median / base', 'ratio')} FROM t LEFT JOIN b USING (condition)", W10)

# --- counts and masks of images against their scores ---


def a7(spark, sf_dir):
    """Rank correlation of the difference of shared and two-block scores with the covariance of their counts."""
    study = P.count_study(pixels(spark, sf_dir), KEY)
    return A.spearman(study.select(*KEY, rounded(F.col("shared_dice") - F.col("two_block_dice")).alias("gap"), rounded(F.col("cov"), 6).alias("cov")), COND, "gap", "cov")


add("a7_difference_correlation", a7, f"{PX}, {STUDY}, g AS (SELECT {K}, {r('shared_dice - two_block_dice', 'gap')}, {r('cov', 'cv').replace(', 9) +', ', 6) +')} FROM study), {rho('z', 'g', C, 'gap', 'cv')} SELECT {C}, {r('rho', 'rho')}, n FROM z", ("rho",))
#: Masks by their share of the image, each from the bound before it, which it leaves out.
STRATA = {"empty": 0.0, "very_small": 0.01, "small": 0.1, "medium": 0.5, "large": 1.0}
SPREAD = ("mean", "mean_absolute", "rmse", "p10", "median", "p90")


def a8(spark, sf_dir):
    """(1 + exact Dice confidence) - SDC, over all images of a condition and by the size of their masks."""
    px = pixels(spark, sf_dir)
    both = P.image_scores(px, KEY).select(*KEY, "sdc", "action_fraction").join(P.exact_dice(px, KEY), KEY)
    stratum = F.coalesce(*[F.when(F.col("action_fraction") <= top, F.lit(name)) for name, top in STRATA.items()])
    return A.strata_summary(both, COND, 1 + F.col("confidence_dice_exact") - F.col("sdc"), stratum, list(STRATA))


add("a8_strata", a8, f"""{IMG}, {EXACT}, v0 AS (SELECT {C}, 1 + confidence_dice_exact - {SDC} AS v, CASE {" ".join(f"WHEN action / n <= {top} THEN '{name}'" for name, top in STRATA.items())} END AS stratum FROM img JOIN exact USING ({K})),
  v AS (SELECT * FROM v0 UNION ALL SELECT {C}, v, 'all' FROM v0), g AS (SELECT {C}, stratum, count(*) AS n, avg(v) AS mean, avg(abs(v)) AS mean_absolute, sqrt(avg(v * v)) AS rmse, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90 FROM v GROUP BY {C}, stratum)
  SELECT {C}, stratum, coalesce(n, 0) AS n, {", ".join(r(c, c) for c in SPREAD)} FROM (SELECT DISTINCT {C} FROM v0) CROSS JOIN unnest({["all", *STRATA]}) AS u(stratum) LEFT JOIN g USING ({C}, stratum)""", SPREAD)

# --- assembly and cases ---


def t2(spark, sf_dir):
    rec = records(spark, sf_dir)
    aux = rec.select(*KEY, "risk_dice", (F.col("confidence_sdc") * 2).alias("confidence_twice"))
    return T.append_scores(rec.select(*KEY, "risk_dice", "confidence_sdc"), aux, KEY, ["confidence_twice"], ["risk_dice"])


add("t2_append_scores", t2, f"{REC} SELECT {K}, {r('risk_dice', 'risk_dice')}, {r('confidence_sdc', 'confidence_sdc')}, {r('confidence_sdc * 2', 'confidence_twice')} FROM rec", ("risk_dice", "confidence_sdc", "confidence_twice"))
REP = f"rp AS (SELECT {C}, sample_id, rep, risk_dice, round(confidence_sdc + ((sample_id + 3 * rep) % 7 - 3) / 100.0::DOUBLE, 9) AS score FROM rec, unnest(range(3)) AS g(rep))"


def t3(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rows = rows.withColumn("score", F.round(F.col("confidence_sdc") + ((F.col("sample_id") + 3 * F.col("repeat")) % 7 - 3) / F.lit(100.0), 9))
    per, span = T.average_repeats(rows, KEY, COND, "score", "risk_dice")
    return per.groupBy(*COND).agg(F.avg("mean").alias("mean"), F.avg("sd").alias("mean_sd")).join(span, COND)


add("t3_average_repeats", t3, f"{REC}, {HARM}, {REP}, pp AS (SELECT {K}, avg(score) AS mean, stddev_pop(score) AS sd FROM rp GROUP BY {K}), {area('ar', 'rp', C + ', rep', 'score', 'risk_dice')}, sp AS (SELECT {C}, max(aurc) - min(aurc) AS aurc_range FROM ar GROUP BY {C}), p2 AS (SELECT {C}, avg(mean) AS mean, avg(sd) AS mean_sd FROM pp GROUP BY {C}) SELECT {C}, {r('mean', 'mean')}, {r('mean_sd', 'mean_sd')}, {r('aurc_range', 'aurc_range')} FROM p2 JOIN sp USING ({C})", ("mean", "mean_sd", "aurc_range"))


def t4(spark, sf_dir):
    g = gammas(spark, sf_dir).withColumn("variant", F.concat(F.lit("gamma="), F.col("gamma").cast("string")))
    return T.robustness(g, g.where("gamma = 0.5").drop("variant"), COND, "sdc", "risk")


add("t4_robustness", t4, f"{PX}, {HARM}, {gamma_sql()}, gv AS (SELECT *, 'gamma=' || CAST(gamma AS VARCHAR) AS variant FROM gam), gp AS (SELECT * FROM gam WHERE gamma = 0.5), {summed('v', 'gv', C + ', variant', 'sdc', 'risk')}, {area('p', 'gp', C, 'sdc', 'risk')} SELECT {C}, variant, {r('v.aurc', 'aurc')}, {r('excess', 'excess')}, {r('p.aurc', 'primary_aurc')}, {r('v.aurc - p.aurc', 'change')} FROM v JOIN p USING ({C})", ("aurc", "excess", "primary_aurc", "change"))


def safety(x: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {C}) > 1 THEN ({ranked(x, C)} - 1) / (count(*) OVER (PARTITION BY {C}) - 1) ELSE 0 END"


add("x1_safety_rank", lambda s, d: M.safety_ranks(written(records(s, d).select(*KEY, "confidence_sdc"), "scores"), COND, {"confidence_sdc": "rank"}).select(*KEY, "rank"), f"{REC} SELECT {K}, {r(safety('confidence_sdc'), 'rank')} FROM rec", ("rank",))
DIS = f"ds AS (SELECT {K}, {safety('confidence_sdc')} AS left_rank, {safety('confidence_dice_m32')} AS right_rank FROM rec)"
add("x2_rank_disagreement", lambda s, d: M.rank_disagreement(records(s, d), COND, "sample_id", "confidence_sdc", "confidence_dice_m32"), f"{REC}, {DIS} SELECT {K}, {r('left_rank', 'left_rank')}, {r('right_rank', 'right_rank')}, {r('abs(left_rank - right_rank)', 'gap')} FROM ds", ("left_rank", "right_rank", "gap"))
LOSSES = {"risk_dice": "confidence_dice_m32", "risk_nhd": "confidence_nhd_m32"}
ACT = "act AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS action FROM lineitem GROUP BY l_orderkey)"
FAIL = f"""{ACT}, ro AS (SELECT {K}, action, loss, risk, score FROM (SELECT {K}, 'risk_dice' AS loss, risk_dice AS risk, confidence_dice_m32 AS score FROM rec UNION ALL SELECT {K}, 'risk_nhd', risk_nhd, confidence_nhd_m32 FROM rec) JOIN act ON l_orderkey = sample_id),
 fl AS (SELECT {K}, 'confident_failure' AS kind, loss, risk, risk + score AS value FROM ro UNION ALL SELECT {K}, 'empty_action', loss, risk, risk FROM ro WHERE action = 0)"""


def acted(spark, sf_dir):
    """Score records with action: the order's returned lines, none for an empty action."""
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("action"))
    return records(spark, sf_dir).join(a, "sample_id")


add("x3_failures", lambda s, d: M.failures(acted(s, d), COND, "sample_id", LOSSES, "action"), f"{REC}, {FAIL} SELECT {K}, kind, loss, {r('risk', 'risk')}, {r('value', 'value')} FROM fl", ("risk", "value"))
KINDS = ("dice_against_sdc", "nhd_against_sdc", "empty_action", "confident_failure", "absent")
TIES = ["condition", "sample_id", "loss"]


def x4(spark, sf_dir):
    rec = acted(spark, sf_dir)
    every = M.failures(rec, COND, "sample_id", LOSSES, "action").drop("risk")
    for kind, left in zip(KINDS[:2], ("confidence_dice_m32", "confidence_nhd_m32"), strict=True):
        one = M.rank_disagreement(rec, COND, "sample_id", left, "confidence_sdc")
        every = every.unionByName(one.select(*KEY, F.lit(kind).alias("kind"), F.lit("").alias("loss"), F.col("gap").alias("value")))
    path = scratch(spark, "cases")
    every.withColumn("value", F.round("value", 9)).write.parquet(path)
    return M.pick_cases(spark.read.parquet(path), ["dataset"], "sample_id", list(KINDS), TIES)


PICK = f"""d1 AS (SELECT {K}, {safety('confidence_dice_m32')} AS l, {safety('confidence_sdc')} AS rr FROM rec), d2 AS (SELECT {K}, {safety('confidence_nhd_m32')} AS l, {safety('confidence_sdc')} AS rr FROM rec),
 cd AS (SELECT {K}, kind, loss, round(value, 9) AS value FROM fl UNION ALL SELECT {K}, '{KINDS[0]}', '', round(abs(l - rr), 9) FROM d1 UNION ALL SELECT {K}, '{KINDS[1]}', '', round(abs(l - rr), 9) FROM d2)"""
for i, kind in enumerate(KINDS):
    used = " OR ".join(f"EXISTS (SELECT 1 FROM k{j} u WHERE u.dataset = cd.dataset AND u.sample_id = cd.sample_id)" for j in range(i)) or "false"
    PICK += f", k{i} AS (SELECT {K}, loss, value, fallback FROM (SELECT cd.*, CAST({used} AS INT) AS fallback FROM cd WHERE kind = '{kind}') QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY fallback, value DESC, condition, sample_id, loss) = 1)"
PICKED = " UNION ALL ".join(
    f"SELECT g.dataset, '{k}' AS kind, CASE WHEN fallback IS NULL THEN 'unavailable' ELSE 'selected' END AS status, CASE WHEN fallback IS NULL THEN 'no candidate of kind {k}' END AS reason, coalesce(fallback, 0) AS fallback, value, condition, sample_id, loss FROM (SELECT DISTINCT dataset FROM cd) g LEFT JOIN k{i} USING (dataset)"
    for i, k in enumerate(KINDS)
)
add("x4_pick_cases", x4, f"{REC}, {FAIL}, {PICK} {PICKED}")

# --- contracts; faults are planted by rules on ids ---


def v1(spark, sf_dir):
    px = pixels(spark, sf_dir)
    faulty = px.withColumn("p", F.when((F.col("sample_id") % 97 == 0) & (F.col("x") == 3), 1.5).otherwise(F.col("p"))).where("not (sample_id % 89 = 0 and y = 2 and x = 5)")
    return V.check_maps(faulty, KEY)


add("v1_check_maps", v1, f"{PX}, f AS (SELECT {K}, y, x, CASE WHEN sample_id % 97 = 0 AND x = 3 THEN 1.5 ELSE p END AS p, truth FROM px WHERE NOT (sample_id % 89 = 0 AND y = 2 AND x = 5)), c AS (SELECT {K}, 0::BIGINT AS missing, CAST(sum(CASE WHEN p < 0 OR p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS outside, CAST(sum(CASE WHEN truth IN (0, 1) THEN 0 ELSE 1 END) AS BIGINT) AS bad_truth, CAST((max(y) + 1) * (max(x) + 1) - count(DISTINCT (y, x)) AS BIGINT) AS gaps, count(*) - count(DISTINCT (y, x)) AS repeated FROM f GROUP BY {K}) SELECT * FROM c WHERE missing + outside + bad_truth + gaps + repeated > 0")
UNIT = ["risk_dice", "risk_nhd", "confidence_sdc"]
BADREC = f"br AS (SELECT {C}, CASE WHEN sample_id % 101 = 0 THEN 7 ELSE sample_id END AS sample_id, risk_dice, CASE WHEN sample_id % 53 = 0 THEN NULL ELSE risk_nhd END AS risk_nhd, confidence_sdc + CASE WHEN sample_id % 31 = 0 THEN 1 ELSE 0 END AS confidence_sdc FROM rec)"


def v2(spark, sf_dir):
    rec = records(spark, sf_dir).selectExpr("dataset", "condition", "CASE WHEN sample_id % 101 = 0 THEN 7 ELSE sample_id END AS sample_id", "risk_dice", "CASE WHEN sample_id % 53 = 0 THEN NULL ELSE risk_nhd END AS risk_nhd", "confidence_sdc + CASE WHEN sample_id % 31 = 0 THEN 1 ELSE 0 END AS confidence_sdc")
    return V.check_records(rec, COND, "sample_id", UNIT)


add("v2_check_records", v2, f"{REC}, {BADREC} SELECT {C}, count(*) - count(DISTINCT sample_id) AS repeated, CAST(sum(CASE WHEN risk_nhd IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(" + " + ".join(f"sum(CASE WHEN {c} < 0 OR {c} > 1 THEN 1 ELSE 0 END)" for c in UNIT) + f" AS BIGINT) AS outside FROM br GROUP BY {C}")


def two_sides(s, d, step):
    rec = records(s, d).select(*KEY, "risk_dice", "confidence_sdc")
    left = rec.where("sample_id % 97 <> 0")
    right = rec.where("sample_id % 89 <> 0").withColumn("confidence_sdc", F.col("confidence_sdc") + F.when(F.col("sample_id") % 83 == 0, step).when(F.col("sample_id") % 79 == 0, 1e-14).otherwise(0.0))
    return left, right


def sides_sql(cond: str) -> str:
    return f"""lf AS (SELECT {K}, risk_dice, confidence_sdc FROM rec WHERE sample_id % 97 <> 0), rt AS (SELECT {K}, risk_dice, confidence_sdc + CASE WHEN sample_id % 83 = 0 THEN 1e-6::DOUBLE WHEN sample_id % 79 = 0 THEN 1e-14::DOUBLE ELSE 0.0 END AS confidence_sdc FROM rec WHERE sample_id % 89 <> 0)
  SELECT {K}, CASE WHEN l.risk_dice IS NULL THEN 'only right' WHEN q.risk_dice IS NULL THEN 'only left' ELSE 'confidence_sdc' END AS wrong FROM lf l FULL JOIN rt q USING ({K}) WHERE l.risk_dice IS NULL OR q.risk_dice IS NULL OR {cond}"""


add("v3_exact_join", lambda s, d: V.differences(*two_sides(s, d, 1e-6), KEY, ["risk_dice", "confidence_sdc"]), f"{REC}, {sides_sql('l.confidence_sdc <> q.confidence_sdc')}")
add("v4_tolerant_join", lambda s, d: V.tolerant_differences(*two_sides(s, d, 1e-6), KEY, ["risk_dice", "confidence_sdc"]), f"{REC}, {sides_sql('abs(l.confidence_sdc - q.confidence_sdc) > greatest(2e-12 * greatest(abs(l.confidence_sdc), abs(q.confidence_sdc)), 2e-12)')}")


def v5(spark, sf_dir):
    rec = records(spark, sf_dir)
    expected = rec.groupBy(*COND).agg(F.count("*").alias("expected"))
    return V.complete_conditions(rec.where("not (condition = 'P' and sample_id % 11 = 0) and sample_id % 97 <> 0"), expected, COND)


add("v5_completeness", v5, f"{REC}, e AS (SELECT {C}, count(*) AS expected FROM rec GROUP BY {C}), n AS (SELECT {C}, count(*) AS n FROM rec WHERE NOT (condition = 'P' AND sample_id % 11 = 0) AND sample_id % 97 <> 0 GROUP BY {C}) SELECT {C}, expected, coalesce(n, 0) AS n, CAST(coalesce(n, 0) >= 0.95 * expected AS INT) AS kept FROM e LEFT JOIN n USING ({C})")


def v6(spark, sf_dir):
    all_ = records(spark, sf_dir).select(*COND).distinct()
    got = all_.where("not (dataset = '1-URGENT' and condition = 'F')").unionByName(all_.where("condition = 'O'"))
    declared = all_.where("not (dataset = '5-LOW' and condition = 'P')")
    return V.condition_matrix(got, declared, COND)


add("v6_condition_matrix", v6, f"{REC}, a AS (SELECT DISTINCT {C} FROM rec), g AS (SELECT * FROM a WHERE NOT (dataset = '1-URGENT' AND condition = 'F') UNION ALL SELECT * FROM a WHERE condition = 'O'), d AS (SELECT * FROM a WHERE NOT (dataset = '5-LOW' AND condition = 'P')) SELECT {C}, 'missing' AS wrong FROM d WHERE ({C}) NOT IN (SELECT ({C}) FROM g) UNION ALL SELECT DISTINCT {C}, 'undeclared' FROM g WHERE ({C}) NOT IN (SELECT ({C}) FROM d) UNION ALL SELECT {C}, 'repeated' FROM g GROUP BY {C} HAVING count(*) > 1")


def v7(spark, sf_dir):
    """Quantiles of each condition's scores as threshold rules: those with ties or outside (0, 1) are no rules."""
    w = F.expr("explode(sequence(0, 7))").alias("k")
    eighths = {f"q{i}": i / 7 for i in range(8)}
    q = quantiles(records(spark, sf_dir), COND, F.col("confidence_sdc"), eighths).select(*COND, F.array(*eighths).alias("q"))
    n = q.select(F.concat_ws("/", *COND).alias("rule"), "q", w).select("rule", "k", F.get("q", F.col("k")).alias("t"), (F.lit(1.0) / F.when(F.col("rule").endswith("F"), 8).otherwise(9)).alias("w"))
    return V.check_rules(n, "rule")


add("v7_check_rules", v7, f"{REC}, n AS (SELECT dataset || '/' || condition AS rule, CAST(k AS INT) AS k, q[k + 1] AS t, 1.0::DOUBLE / CASE WHEN condition = 'F' THEN 8 ELSE 9 END AS w FROM (SELECT {C}, quantile_cont(confidence_sdc, [" + ", ".join(repr(i / 7) for i in range(8)) + f"]) AS q FROM rec GROUP BY {C}), unnest(range(8)) AS g(k)), f AS (SELECT *, coalesce(t <= lag(t) OVER (PARTITION BY rule ORDER BY k), FALSE) AS flat FROM n), c AS (SELECT rule, CAST(sum(CASE WHEN flat THEN 1 ELSE 0 END) AS BIGINT) AS not_rising, CAST(sum(CASE WHEN t <= 0 OR t >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS outside, 0::BIGINT AS negative, CAST(abs(sum(w) - 1) > 1e-9 AS INT) AS bad_sum FROM f GROUP BY rule) SELECT * FROM c WHERE not_rising + outside + negative + bad_sum > 0")
DIGEST = f"dg AS (SELECT {C}, count(*) AS num_rows, sha256(string_agg(CAST(sample_id AS VARCHAR), chr(10) ORDER BY sample_id)) AS sample_id_sha256 FROM rec GROUP BY {C})"


def v8(spark, sf_dir):
    rec = records(spark, sf_dir)
    return V.bind_to_cohort(io.cohort_digest(rec.where("not (condition = 'P' and sample_id % 97 = 0)"), COND, "sample_id"), io.cohort_digest(rec, COND, "sample_id"), COND, ["num_rows", "sample_id_sha256"])


add("v8_bind_to_cohort", v8, f"{REC}, {DIGEST}, d2 AS (SELECT {C}, count(*) AS n2, sha256(string_agg(CAST(sample_id AS VARCHAR), chr(10) ORDER BY sample_id)) AS h2 FROM rec WHERE NOT (condition = 'P' AND sample_id % 97 = 0) GROUP BY {C}) SELECT {C}, w AS wrong FROM (SELECT {C}, unnest(CASE WHEN n2 IS NULL THEN ['only right'] ELSE list_filter([CASE WHEN n2 <> num_rows THEN 'num_rows' END, CASE WHEN h2 <> sample_id_sha256 THEN 'sample_id_sha256' END], lambda q: q IS NOT NULL) END) AS w FROM dg LEFT JOIN d2 USING ({C}))")

# --- sources and sinks: what is written is read again ---


def s1(spark, sf_dir):
    path = scratch(spark, "maps")
    io.write_maps(pixels(spark, sf_dir), path)
    return io.read_maps(spark, path)


add("s1_s2_maps", s1, f"{PX} SELECT {K}, y, x, {r('CAST(CAST(p AS FLOAT) AS DOUBLE)', 'p')}, truth FROM px", ("p",))


def s3(spark, sf_dir):
    path = scratch(spark, "records")
    io.write_records(records(spark, sf_dir), path)
    return io.read_records(spark, path)


RCOLS = ("risk_dice", "risk_nhd", "confidence_dice_m32", "confidence_nhd_m32", "confidence_sdc")
add("s3_s4_records", s3, f"{REC} SELECT {C}, sample_id, cluster_id, seed, " + ", ".join(r(c, c) for c in RCOLS) + " FROM rec", RCOLS)


def s5(spark, sf_dir):
    path = scratch(spark, "manifests")
    io.write_manifests(io.cohort_digest(records(spark, sf_dir), COND, "sample_id").withColumns({"split": F.lit("test"), "model": F.lit("m")}), path)
    return io.read_manifests(spark, path).select(*COND, "num_rows", "sample_id_sha256", F.col("file").endswith("/manifest.json").cast("int").alias("found"))


add("s5_manifests", s5, f"{REC}, {DIGEST} SELECT {C}, num_rows, sample_id_sha256, 1 AS found FROM dg")


#: Labels of the long table, and the method that is held against a numerical reference.
RISK_LABELS, METHOD_LABELS = {"risk_dice": "Dice", "risk_nhd": "nHD"}, {"confidence_dice_m32": "Dice, 32 nodes", "confidence_nhd_m32": "nHD, 32 nodes", "confidence_sdc": "soft Dice"}
CHECKED, REFERENCE = "confidence_sdc", "confidence_dice_m32"
NUMBERS = ("aurc", "oracle_aurc", "random_aurc", "excess_aurc", "normalized_aurc", "absolute_error_mean", "absolute_error_median", "absolute_error_p95", "absolute_error_max", "spearman_rho", "kendall_tau_b", "exact_match_fraction")


def long_table(rec):
    """The 22 columns of every condition, risk and method; the numerical columns are null but for one method's Dice rows."""
    named = lambda c, labels: F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col(c))
    m = S.matrix(rec, COND, "sample_id", METHODS, RISKS).withColumnsRenamed({"risk_name": "risk", "oracle": "oracle_aurc", "random": "random_aurc", "excess": "excess_aurc", "normalized": "normalized_aurc"}).drop("n")
    size = rec.groupBy(*COND).agg(F.count("*").alias("num_rows"), F.countDistinct("cluster_id").alias("num_image_clusters"))
    error = A.error_to_reference(rec, COND, CHECKED, REFERENCE).withColumnsRenamed({"mean": "absolute_error_mean", "median": "absolute_error_median", "p95": "absolute_error_p95", "largest": "absolute_error_max", "equal_share": "exact_match_fraction"})
    agreed = A.spearman(rec, COND, CHECKED, REFERENCE).select(*COND, F.col("rho").alias("spearman_rho")).join(A.kendall(rec, COND, CHECKED, REFERENCE).withColumnRenamed("tau", "kendall_tau_b"), COND)
    checked = error.join(agreed, COND).withColumns({"risk": F.lit("risk_dice"), "method": F.lit(CHECKED), "numerical_reference": F.lit(REFERENCE)})
    wide = m.join(size, COND).join(checked, [*COND, "risk", "method"], "left")
    wide = wide.withColumns({"split": F.lit("test"), "risk_label": named("risk", RISK_LABELS), "method_label": named("method", METHOD_LABELS)})
    return wide.select(*COND, "split", "num_rows", "num_image_clusters", "risk", "risk_label", "method", "method_label", *NUMBERS[:5], "numerical_reference", *NUMBERS[5:])


def s6(spark, sf_dir):
    path = scratch(spark, "results")
    table = long_table(records(spark, sf_dir))
    io.write_results(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


def label_sql(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in labels.items())} END"


add("s6_result_table", s6, f"""{REC}, {HARM}, {LONG}, {summed('z', 'lg', C + ', risk_name, method', 'score', 'risk')}, nr AS (SELECT {C}, count(*) AS num_rows, count(DISTINCT cluster_id) AS num_image_clusters FROM rec GROUP BY {C}),
  er AS (SELECT {C}, avg(abs({CHECKED} - {REFERENCE})) AS mean, quantile_cont(abs({CHECKED} - {REFERENCE}), 0.5) AS median, quantile_cont(abs({CHECKED} - {REFERENCE}), 0.95) AS p95, max(abs({CHECKED} - {REFERENCE})) AS largest, avg(CASE WHEN {CHECKED} = {REFERENCE} THEN 1.0 ELSE 0.0 END) AS same FROM rec GROUP BY {C}),
  {rho('q', 'rec', C, CHECKED, REFERENCE)}, {tau('t', 'rec', C, CHECKED, REFERENCE)}, ck AS (SELECT {C}, 'risk_dice' AS risk_name, '{CHECKED}' AS method, '{REFERENCE}' AS ref, mean, median, p95, largest, rho, tau, same FROM er JOIN q USING ({C}) JOIN t USING ({C}))
  SELECT {C}, 'test' AS split, num_rows, num_image_clusters, risk_name AS risk, {label_sql('risk_name', RISK_LABELS)} AS risk_label, method, {label_sql('method', METHOD_LABELS)} AS method_label, ref AS numerical_reference, """ + ", ".join(r(v, n) for v, n in zip(("aurc", "oracle", "random", "excess", "normalized", "mean", "median", "p95", "largest", "rho", "tau", "same"), NUMBERS)) + f" FROM z JOIN nr USING ({C}) LEFT JOIN ck USING ({C}, risk_name, method)", NUMBERS)


def s7(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    images = d.where("doc_id % 13 <> 0").selectExpr("concat('img', doc_id % 900, '.png') AS name", "n_chars AS size")
    masks = d.where("doc_id % 17 <> 0").selectExpr("concat('img', doc_id, '.mask') AS name", "n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS size")
    return io.pair_by_stem(images, masks)


add("s7_pair_by_stem", s7, "i AS (SELECT 'img' || doc_id % 900 AS stem, count(*) AS i_n, max(n_chars) AS i_size FROM documents WHERE doc_id % 13 <> 0 GROUP BY 1), m AS (SELECT 'img' || doc_id AS stem, count(*) AS m_n, max(n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END) AS m_size FROM documents WHERE doc_id % 17 <> 0 GROUP BY 1) SELECT stem, CASE WHEN i_n IS NULL THEN 'no image' WHEN m_n IS NULL THEN 'no mask' WHEN i_n > 1 OR m_n > 1 THEN 'several' WHEN i_size <> m_size THEN 'size' ELSE 'paired' END AS state FROM i FULL JOIN m USING (stem)")


def s8(spark, sf_dir):
    px = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sample_id", "l_linenumber AS x", "CAST(l_quantity AS INT) % 3 + 1 AS c0", "CAST(l_quantity * 5 AS INT) AS c1", "CAST(l_discount * 100 AS INT) AS c2")
    a = io.binarise(px, "trimap", ["c0"]).groupBy("x").agg(F.sum("truth").alias("trimap"))
    b = io.binarise(px, "max_channel", ["c1", "c2"]).groupBy("x").agg(F.sum("truth").alias("max_channel"))
    c = io.binarise(px, "any_channel", ["c2"]).groupBy("x").agg(F.sum("truth").alias("any_channel"))
    return a.join(b, "x").join(c, "x")


add("s8_binarise", s8, "p AS (SELECT l_linenumber AS x, CAST(floor(l_quantity) AS INT) % 3 + 1 AS c0, CAST(floor(l_quantity * 5) AS INT) AS c1, CAST(floor(l_discount * 100) AS INT) AS c2 FROM lineitem) SELECT x, CAST(sum(CASE WHEN c0 IN (1, 3) THEN 1 ELSE 0 END) AS BIGINT) AS trimap, CAST(sum(CASE WHEN greatest(c1, c2) >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS max_channel, CAST(sum(CASE WHEN c2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS any_channel FROM p GROUP BY x")
add("s9_hash_split", lambda s, d: io.hash_split(records(s, d), ["dataset"], "sample_id").select(*KEY, "split"), f"{REC} SELECT {K}, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY sha256(CAST(sample_id AS VARCHAR)), sample_id) <= floor(count(*) OVER (PARTITION BY dataset) * 4 / 5) THEN 'train' ELSE 'test' END AS split FROM rec")


def s10(spark, sf_dir):
    """The documents as files of their own: a listing of all, held against one with changes."""
    now = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    stored = now.where("name not like '%77'").withColumn("sha256", F.when(F.col("name").like("%33"), F.lit("0")).otherwise(F.col("sha256")))
    return io.audit(now.where("name not like '%55'"), stored)


def s10_files(spark, sf_dir):
    """The files of the given folder against a listing in which one is changed, one is lost and one more is known."""
    now = io.listing(spark, sf_dir, "*.parquet")
    stored = now.where("name <> 'region.parquet'").withColumn("sha256", F.when(F.col("name") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256")))
    gone = read(spark, sf_dir, "region").limit(1).select(F.lit("gone.parquet").alias("name"), F.lit(1).cast("long").alias("size"), F.lit("0").alias("sha256"))
    return io.audit(now, stored.unionByName(gone))


add("s10_audit_files", s10_files, None)


def s7_files(spark, sf_dir):
    """Files of two folders by stem: a mask for each image of a region, one region's mask lost, another's with more rows."""
    path = scratch(spark, "pairs")
    nations = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), "n_name")
    for side, rows in (("images", nations), ("masks", nations.where("r <> 3").union(nations.where("r = 4")))):
        rows.repartition("r").write.partitionBy("r").csv(f"{path}/{side}")
    each = lambda side: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(f"{path}/{side}").select(F.concat(F.regexp_extract("path", "/(r=[^/]*)/", 1), F.lit(".csv")).alias("name"), F.col("length").alias("size"))
    return io.pair_by_stem(each("images"), each("masks"))


add("s7_pair_files", s7_files, "x AS (SELECT DISTINCT n_regionkey AS k FROM nation) SELECT 'r=' || k AS stem, CASE k WHEN 3 THEN 'no mask' WHEN 4 THEN 'size' ELSE 'paired' END AS state FROM x")
add("s10_audit", s10, "n AS (SELECT 'doc' || doc_id AS name FROM documents) SELECT name, CASE WHEN name LIKE '%55' THEN 'missing' WHEN name LIKE '%77' THEN 'extra' ELSE 'changed' END AS wrong FROM n WHERE name LIKE '%55' OR name LIKE '%77' OR name LIKE '%33'")
add("s11_cohort_digest", lambda s, d: io.cohort_digest(records(s, d), COND, "sample_id"), f"{REC}, {DIGEST} SELECT {C}, num_rows, sample_id_sha256 FROM dg")


def s12(spark, sf_dir):
    images = read(spark, sf_dir, "documents").selectExpr("lang AS condition", "doc_id AS sample_id", "n_chars AS pixels")
    return io.size_panel(images, ["condition"], "sample_id", 16)


add("s12_size_panel", s12, "d AS (SELECT lang AS condition, doc_id AS sample_id, n_chars AS pixels, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT condition, sample_id, pixels, rank FROM d WHERE rank IN (SELECT k * (n - 1) // 15 FROM range(16) AS g(k))")
add("s13_content_id", lambda s, d: records(s, d).select(*KEY, io.content_id("dataset", "condition", "sample_id").alias("id")), f"""{REC} SELECT {K}, substr(sha256('{{"condition":"' || condition || '","dataset":"' || dataset || '","sample_id":' || sample_id || '}}'), 1, 16) AS id FROM rec""")

# --- streaming ---


def st1(spark, sf_dir):
    """The monitor as a batch: what the stream gives for closed windows."""
    acc = monitor.windowed(stream_rows(read(spark, sf_dir, "events")))
    return monitor.report(acc).select(F.col("start").cast("date").cast("string").alias("day"), "n", "brier", "ece")


STB = "sb AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, least(floor(p * 15), 14) AS bin, count(*) AS n, sum(p) AS sp, sum(truth) AS stt, sum((p - truth) * (p - truth)) AS sq FROM st GROUP BY 1, 2)"
add("st1_monitor", st1, f"{STREAM}, {STB} SELECT day, CAST(sum(n) AS BIGINT) AS n, {r('sum(sq) / sum(n)', 'brier')}, {r('sum(abs(stt - sp)) / sum(n)', 'ece')} FROM sb GROUP BY day", ("brier", "ece"))


def st1_stream(spark, sf_dir):
    """The monitor over the events as a stream of files; windows that the watermark has not closed are not out yet."""
    schema = read(spark, sf_dir, "events").schema
    stream = stream_rows(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    closed = monitor.run_once(spark, stream, scratch(spark, "closed"), checkpoint=scratch(spark, "stream"))
    return monitor.report(closed).select(F.col("start").cast("date").cast("string").alias("day"), "n", "brier", "ece")


add("st1_monitor_stream", st1_stream, f"{STREAM}, {STB}, top AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM st) SELECT day, CAST(sum(n) AS BIGINT) AS n, {r('sum(sq) / sum(n)', 'brier')}, {r('sum(abs(stt - sp)) / sum(n)', 'ece')} FROM sb, top WHERE CAST(day AS DATE) + INTERVAL 1 DAY <= w GROUP BY day", ("brier", "ece"))
