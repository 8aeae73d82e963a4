"""Registered queries over score records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import hash_seed, rounded
from ..functions.shared import written
from ..operators import agreement as A
from ..operators import inference as I  # noqa: E741
from ..operators import selective as S
from ..sources.views import COND, documents_risk, records
from .base_sql import DOC, REC, r, unit

C = "dataset, condition"
REGISTRY: dict[str, tuple] = {}
METHODS = ["confidence_dice_m32", "confidence_nhd_m32", "confidence_sdc"]
RISKS = ["risk_dice", "risk_nhd"]
HARM = "harm AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE 1.0::DOUBLE / i END) OVER (ORDER BY i) AS h FROM range(0, 300000) AS g(i))"


def add(name: str, run, sql: str | None, digits: tuple[str, ...] = (), places: int = 9) -> None:
    def query(spark, sf_dir):
        df = run(spark, sf_dir)
        return df.withColumns({c: rounded(F.col(c), places) for c in digits}) if digits else df

    REGISTRY[name] = (query, sql and "WITH " + sql)


def area(name: str, src: str, group: str, score: str, risk: str, w: str = "1") -> str:
    return f"""{name}_t AS (SELECT {group}, {score} AS score, sum({w}) AS g, sum({w} * {risk}) AS s FROM {src} GROUP BY {group}, {score}),
 {name}_w AS (SELECT *, coalesce(sum(g) OVER w, 0) AS bf, coalesce(sum(s) OVER w, 0) AS sm FROM {name}_t WINDOW w AS (PARTITION BY {group} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 {name} AS (SELECT {group}, sum(s + (sm - bf * s / g) * (h2.h - h1.h)) / sum(g) AS aurc, CAST(sum(g) AS BIGINT) AS n FROM {name}_w JOIN harm h1 ON h1.i = bf JOIN harm h2 ON h2.i = bf + g GROUP BY {group})"""


def summed(name: str, src: str, group: str, score: str, risk: str) -> str:
    return f"""{area(name + 'a', src, group, score, risk)}, {area(name + 'o', src, group, '-' + risk, risk)}, {name}m AS (SELECT {group}, avg({risk}) AS random FROM {src} GROUP BY {group}),
 {name} AS (SELECT {group}, a.n, a.aurc, o.aurc AS oracle, random, a.aurc - o.aurc AS excess, CASE WHEN abs(random - o.aurc) <= 1e-15 THEN NULL ELSE (a.aurc - o.aurc) / (random - o.aurc) END AS normalized FROM {name}a a JOIN {name}o o USING ({group}) JOIN {name}m USING ({group}))"""


SUM = ("aurc", "oracle", "random", "excess", "normalized")
SUMS = ", ".join(r(c, c) for c in SUM)
add("r1_aurc", lambda s, d: S.aurc(records(s, d), COND, "confidence_sdc", "risk_dice"), f"{REC}, {HARM}, {area('a', 'rec', C, 'confidence_sdc', 'risk_dice')} SELECT {C}, {r('aurc', 'aurc')}, n FROM a", ("aurc",))
add("r2_summary", lambda s, d: S.summary(records(s, d), COND, "confidence_sdc", "risk_dice"), f"{REC}, {HARM}, {summed('z', 'rec', C, 'confidence_sdc', 'risk_dice')} SELECT {C}, n, {SUMS} FROM z", SUM)
add("r2_constant_risk", lambda s, d: S.summary(documents_risk(s, d), COND, "confidence", "risk"), f"{DOC}, {HARM}, {summed('z', 'doc', C, 'confidence', 'risk')} SELECT {C}, n, {SUMS} FROM z", SUM)
add("r3_plain_aurc", lambda s, d: S.plain_aurc(records(s, d), COND, "confidence_sdc", "risk_dice", "sample_id"), f"{REC}, m AS (SELECT {C}, avg(risk_dice) OVER (PARTITION BY {C} ORDER BY confidence_sdc DESC, sample_id ROWS UNBOUNDED PRECEDING) AS m FROM rec) SELECT {C}, {r('avg(m)', 'aurc')} FROM m GROUP BY {C}", ("aurc",))
CURVE = """{n}_t AS (SELECT {g}, {s} AS score, count(*) AS g_, sum({k}) AS s_ FROM rec GROUP BY {g}, {s}),
 {n}_w AS (SELECT *, coalesce(sum(g_) OVER w, 0) AS bf, coalesce(sum(s_) OVER w, 0) AS sm, sum(g_) OVER (PARTITION BY {g}) AS nn FROM {n}_t WINDOW w AS (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 {n} AS (SELECT {g}, CAST(bf + i AS BIGINT) AS j, (bf + i) / nn AS coverage, (sm + i * s_ / g_) / (bf + i) AS risk FROM (SELECT *, unnest(range(1, g_ + 1)) AS i FROM {n}_w))"""


def r4(spark, sf_dir):
    """The curve of a score beside those of the oracle and of a random order."""
    rec = written(records(spark, sf_dir).select(*COND, "confidence_sdc", "risk_dice"), "records")
    own = S.curve(rec, COND, "confidence_sdc", "risk_dice")
    oracle = S.curve(rec.withColumn("o", -F.col("risk_dice")), COND, "o", "risk_dice").select(*COND, "j", F.col("risk").alias("oracle"))
    mean = rec.groupBy(*COND).agg(F.avg("risk_dice").alias("random"))
    return own.hint("merge").join(oracle.hint("merge"), [*COND, "j"]).join(mean, COND)  # a few ties may stand for many rows


add("r4_risk_coverage", r4, f"{REC}, " + CURVE.format(n="a", g=C, s="confidence_sdc", k="risk_dice") + ", " + CURVE.format(n="b", g=C, s="-risk_dice", k="risk_dice") + f", m AS (SELECT {C}, avg(risk_dice) AS random FROM rec GROUP BY {C}) SELECT {C}, j, {r('a.coverage', 'coverage')}, {r('a.risk', 'risk')}, {r('b.risk', 'oracle')}, {r('random', 'random')} FROM a JOIN b USING ({C}, j) JOIN m USING ({C})", ("coverage", "risk", "oracle", "random"))


def shares(name: str, score: str, src: str = "rec", group: str = C, key: str = "sample_id") -> str:
    return f"""{name}_t AS (SELECT {group}, {score} AS score, count(*) AS g FROM {src} GROUP BY {group}, {score}),
 {name}_w AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY {group} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(g) OVER (PARTITION BY {group}) AS nn FROM {name}_t),
 {name} AS (SELECT {group}, {key}, coverage, least(1.0, greatest(0.0, (coverage * nn - bf) / g)) AS w FROM {src} JOIN {name}_w USING ({group}) CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(coverage) WHERE {score} = {name}_w.score)"""


COVER = [0.25, 0.5, 0.75]
add("r5_accepted_shares", lambda s, d: S.accepted(records(s, d), COND, "confidence_sdc", COVER, "sample_id"), f"{REC}, {shares('a', 'confidence_sdc')} SELECT {C}, sample_id, coverage, {r('w', 'w')} FROM a", ("w",))


def r6(spark, sf_dir):
    rec = records(spark, sf_dir)
    a, b = (S.accepted(rec, COND, m, COVER, "sample_id") for m in ("confidence_sdc", "confidence_dice_m32"))
    return S.accepted_jaccard(a, b, [*COND, "sample_id", "coverage"], [*COND, "coverage"])


add("r6_accepted_jaccard", r6, f"{REC}, {shares('a', 'confidence_sdc')}, {shares('b', 'confidence_dice_m32')} SELECT {C}, coverage, {r('sum(least(a.w, b.w)) / sum(greatest(a.w, b.w))', 'jaccard')} FROM a JOIN b USING ({C}, sample_id, coverage) GROUP BY {C}, coverage", ("jaccard",))
LONG = f"""lm AS (UNPIVOT (SELECT {C}, sample_id, cluster_id, seed, risk_dice, risk_nhd, confidence_dice_m32, confidence_nhd_m32, confidence_sdc FROM rec) ON confidence_dice_m32, confidence_nhd_m32, confidence_sdc INTO NAME method VALUE score),
 lg AS (UNPIVOT lm ON risk_dice, risk_nhd INTO NAME risk_name VALUE risk)"""
add("r7_matrix", lambda s, d: S.matrix(records(s, d), COND, "sample_id", METHODS, RISKS), f"{REC}, {HARM}, {LONG}, {summed('z', 'lg', C + ', risk_name, method', 'score', 'risk')} SELECT {C}, risk_name, method, n, {SUMS} FROM z", SUM)


def r8(spark, sf_dir):
    m = S.matrix(records(spark, sf_dir), COND, "sample_id", METHODS, RISKS).withColumn("aurc", F.round("aurc", 9))
    return S.best(m, [*COND, "risk_name"]).select(*COND, "risk_name", "method", F.col("best").cast("int").alias("best"))


add("r8_best_method", r8, f"{REC}, {HARM}, {LONG}, {area('z', 'lg', C + ', risk_name, method', 'score', 'risk')} SELECT {C}, risk_name, method, CAST(round(aurc, 9) = min(round(aurc, 9)) OVER (PARTITION BY {C}, risk_name) AS INT) AS best FROM z")
add("r9_regret", lambda s, d: S.regret(records(s, d), COND, F.col("sample_id") % 4, "confidence_sdc", "risk_dice"), f"{REC}, {HARM}, rb AS (SELECT *, sample_id % 4 AS batch FROM rec), {summed('z', 'rb', C + ', batch', 'confidence_sdc', 'risk_dice')} SELECT {C}, {r('avg(excess)', 'regret')}, {r('stddev_samp(excess) / sqrt(count(*))', 'standard_error')}, count(*) AS batches FROM z GROUP BY {C}", ("regret", "standard_error"))

# --- agreement ---


def ranked(x: str, group: str) -> str:
    return f"(rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1) / 2.0::DOUBLE)"


def rho(name: str, src: str, group: str, x: str, y: str) -> str:
    return f"""{name}r AS (SELECT {group}, {x} AS x, {y} AS y, {ranked(x, group)} AS rx, {ranked(y, group)} AS ry FROM {src}),
 {name} AS (SELECT {group}, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho, count(*) AS n FROM {name}r GROUP BY {group})"""


def tau(name: str, src: str, group: str, x: str, y: str) -> str:
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in group.split(","))
    ag = ", ".join(f"a.{c.strip()}" for c in group.split(","))
    return f"""{name}d AS (SELECT {group}, {x} AS x, {y} AS y, count(*) AS c FROM {src} GROUP BY {group}, {x}, {y}),
 {name}p AS (SELECT {ag}, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) AS cd FROM {name}d a JOIN {name}d b ON {on} AND a.x < b.x GROUP BY {ag}),
 {name}n AS (SELECT {group}, sum(c) * (sum(c) - 1) / 2 AS alls FROM {name}d GROUP BY {group}),
 {name}x AS (SELECT {group}, sum(c * (c - 1) / 2) AS tx FROM (SELECT {group}, x, sum(c) AS c FROM {name}d GROUP BY {group}, x) GROUP BY {group}),
 {name}y AS (SELECT {group}, sum(c * (c - 1) / 2) AS ty FROM (SELECT {group}, y, sum(c) AS c FROM {name}d GROUP BY {group}, y) GROUP BY {group}),
 {name} AS (SELECT {group}, CASE WHEN alls > tx AND alls > ty THEN coalesce(cd, 0) / (sqrt(alls - tx) * sqrt(alls - ty)) END AS tau FROM {name}n JOIN {name}x USING ({group}) JOIN {name}y USING ({group}) LEFT JOIN {name}p USING ({group}))"""


add("a1_spearman", lambda s, d: A.spearman(records(s, d), COND, "confidence_sdc", "risk_dice"), f"{REC}, {rho('z', 'rec', C, 'confidence_sdc', 'risk_dice')} SELECT {C}, {r('rho', 'rho')}, n FROM z", ("rho",))
add("a1_spearman_constant", lambda s, d: A.spearman(documents_risk(s, d), COND, "confidence", "risk"), f"{DOC}, {rho('z', 'doc', C, 'confidence', 'risk')} SELECT {C}, {r('rho', 'rho')}, n FROM z", ("rho",))
add("a2_kendall", lambda s, d: A.kendall(records(s, d), COND, "confidence_sdc", "risk_dice"), f"{REC}, {tau('z', 'rec', C, 'confidence_sdc', 'risk_dice')} SELECT {C}, {r('tau', 'tau')} FROM z", ("tau",))
PAIR = f"pr AS (SELECT a.dataset, a.condition, a.sample_id, a.method AS lft, b.method AS rgt, a.score AS x, b.score AS y FROM lm a JOIN lm b ON a.dataset = b.dataset AND a.condition = b.condition AND a.sample_id = b.sample_id AND a.method < b.method)"
JACC = """jc AS (SELECT a.dataset, a.condition, a.method AS lft, b.method AS rgt, coverage, sum(least(a.w, b.w)) / sum(greatest(a.w, b.w)) AS j FROM aw a JOIN aw b USING (dataset, condition, sample_id, coverage) WHERE a.method < b.method GROUP BY a.dataset, a.condition, a.method, b.method, coverage),
 jp AS (SELECT dataset, condition, lft, rgt, max(j) FILTER (coverage = 0.25) AS j25, max(j) FILTER (coverage = 0.5) AS j50, max(j) FILTER (coverage = 0.75) AS j75 FROM jc GROUP BY dataset, condition, lft, rgt)"""
add("a3_score_agreement", lambda s, d: A.score_agreement(records(s, d), COND, "sample_id", METHODS, COVER), f"{REC}, {LONG}, {PAIR}, {rho('q', 'pr', C + ', lft, rgt', 'x', 'y')}, {tau('t', 'pr', C + ', lft, rgt', 'x', 'y')}, {shares('aw', 'lm.score', 'lm', C + ', method')}, {JACC} SELECT {C}, lft AS \"left\", rgt AS \"right\", {r('rho', 'rho')}, {r('tau', 'tau')}, {r('j25', 'jaccard_25')}, {r('j50', 'jaccard_50')}, {r('j75', 'jaccard_75')} FROM q JOIN t USING ({C}, lft, rgt) JOIN jp USING ({C}, lft, rgt)", ("rho", "tau", "jaccard_25", "jaccard_50", "jaccard_75"))


def a4(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("safety", -F.col("risk_dice"))
    return A.spearman(rec, COND, "confidence_dice_m32", "safety").join(A.kendall(rec, COND, "confidence_dice_m32", "safety"), COND)


add("a4_safety_agreement", a4, f"{REC}, sf AS (SELECT *, -risk_dice AS safety FROM rec), {rho('q', 'sf', C, 'confidence_dice_m32', 'safety')}, {tau('t', 'sf', C, 'confidence_dice_m32', 'safety')} SELECT {C}, {r('rho', 'rho')}, n, {r('tau', 'tau')} FROM q JOIN t USING ({C})", ("rho", "tau"))
add("a5_error_to_reference", lambda s, d: A.error_to_reference(records(s, d), COND, "confidence_nhd_m32", "confidence_dice_m32"), f"{REC}, e AS (SELECT {C}, abs(confidence_nhd_m32 - confidence_dice_m32) AS e, CASE WHEN confidence_nhd_m32 = confidence_dice_m32 THEN 1.0 ELSE 0.0 END AS q FROM rec) SELECT {C}, {r('avg(e)', 'mean')}, {r('quantile_cont(e, 0.5)', 'median')}, {r('quantile_cont(e, 0.95)', 'p95')}, {r('max(e)', 'largest')}, {r('avg(q)', 'equal_share')} FROM e GROUP BY {C}", ("mean", "median", "p95", "largest", "equal_share"))


def a6(spark, sf_dir):
    """Differences of four rank correlations within a condition."""
    rec = records(spark, sf_dir)
    pairs = [("confidence_dice_m32", "risk_dice"), ("confidence_sdc", "risk_dice"), ("confidence_nhd_m32", "risk_nhd"), ("confidence_sdc", "risk_nhd")]
    out = None
    for i, (x, y) in enumerate(pairs):
        one = A.spearman(rec, COND, x, y).select(*COND, F.col("rho").alias(f"rho{i}"))
        out = one if out is None else out.join(one, COND)
    return out.select(*COND, (F.col("rho0") - F.col("rho1")).alias("dice_gain"), (F.col("rho2") - F.col("rho3")).alias("nhd_gain"))


add("a6_correlation_differences", a6, f"{REC}, {rho('q0', 'rec', C, 'confidence_dice_m32', 'risk_dice')}, {rho('q1', 'rec', C, 'confidence_sdc', 'risk_dice')}, {rho('q2', 'rec', C, 'confidence_nhd_m32', 'risk_nhd')}, {rho('q3', 'rec', C, 'confidence_sdc', 'risk_nhd')} SELECT {C}, {r('q0.rho - q1.rho', 'dice_gain')}, {r('q2.rho - q3.rho', 'nhd_gain')} FROM q0 JOIN q1 USING ({C}) JOIN q2 USING ({C}) JOIN q3 USING ({C})", ("dice_gain", "nhd_gain"))
add("a9_wasserstein", lambda s, d: A.wasserstein(records(s, d), COND, "risk_dice", "risk_nhd"), f"{REC}, a AS (SELECT {C}, risk_dice AS a, row_number() OVER (PARTITION BY {C} ORDER BY risk_dice) AS r FROM rec), b AS (SELECT {C}, risk_nhd AS b, row_number() OVER (PARTITION BY {C} ORDER BY risk_nhd) AS r FROM rec) SELECT {C}, {r('avg(abs(a - b))', 'distance')}, count(*) AS n FROM a JOIN b USING ({C}, r) GROUP BY {C}", ("distance",))

# --- inference; the queries named _few are the same functions with few replicates, so that SQL can follow ---
REPS, FULL = 30, 10_000


def mixed(x: str, out: str) -> str:
    """Columns that end in ``out``: the 32-bit finaliser of ``x``."""
    m, w = "4294967295::UBIGINT", lambda v, k: f"xor({v}, {v} >> {k}::UBIGINT)"
    return f"({w(f'({x})', 16)} * 2246822507::UBIGINT) & {m} AS {out}1, ({w(out + '1', 13)} * 3266489909::UBIGINT) & {m} AS {out}2, {w(out + '2', 16)} AS {out}"


def boot(name: str, left: str, right: str, seed: str) -> str:
    return f"""{name}c AS (SELECT {C}, cluster_id, row_number() OVER (PARTITION BY {C} ORDER BY cluster_id) - 1 AS i, count(*) OVER (PARTITION BY {C}) AS m FROM (SELECT DISTINCT {C}, cluster_id FROM rec)),
 {name}k AS (SELECT {C}, m, rep, {mixed(f"xor(rep::UBIGINT, ({seed})::UBIGINT)", 'u')}, {mixed('u', 'k')}, {mixed('xor(k, 2654435769::UBIGINT)', 'l')} FROM (SELECT DISTINCT {C}, m FROM {name}c), unnest(range({REPS})) AS g(rep)),
 {name}h AS (SELECT {C}, rep, k.m, {mixed('xor(c.i::UBIGINT, k.k)', 'v')}, {mixed('((v + l) & 4294967295::UBIGINT)', 'h')} FROM {name}k k JOIN {name}c c USING ({C})),
 {name}d AS (SELECT {C}, rep, CAST((h * m::UBIGINT) >> 32::UBIGINT AS BIGINT) AS i, count(*) AS weight FROM {name}h GROUP BY ALL),
 {name}r AS (SELECT rec.*, rep, weight FROM rec JOIN {name}c USING ({C}, cluster_id) JOIN {name}d USING ({C}, i)),
 {area(name + 'l', name + 'r', C + ', rep', left, 'risk_dice', 'weight')}, {area(name + 'q', name + 'r', C + ', rep', right, 'risk_dice', 'weight')},
 {name} AS (SELECT {C}, rep, l.aurc AS lft, q.aurc AS rgt, l.aurc - q.aurc AS d FROM {name}l l JOIN {name}q q USING ({C}, rep))"""


SEED = "CAST(('0x' || substr(sha256('0|' || dataset || '|' || condition || '|confidence_dice_m32|confidence_sdc|risk_dice'), 1, 8))::BIGINT AS VARCHAR)"
TAIL = "least(1.0, 2 * least((1 + sum(CASE WHEN d <= 0 THEN 1 ELSE 0 END)) / (count(*) + 1), (1 + sum(CASE WHEN d >= 0 THEN 1 ELSE 0 END)) / (count(*) + 1)))"
CONTRAST = f"""{boot('b', 'confidence_dice_m32', 'confidence_sdc', SEED)}, {area('x', 'rec', C, 'confidence_dice_m32', 'risk_dice')}, {area('y', 'rec', C, 'confidence_sdc', 'risk_dice')},
 ci AS (SELECT {C}, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, {TAIL} AS p_value FROM b GROUP BY {C}),
 con AS (SELECT {C}, x.aurc - y.aurc AS difference, low, high, p_value FROM x JOIN y USING ({C}) JOIN ci USING ({C}))"""


def contrasts(spark, sf_dir, resamples=FULL):
    return I.contrast(records(spark, sf_dir), COND, "confidence_dice_m32", "confidence_sdc", "risk_dice", "cluster_id", resamples)


def adjusted(spark, sf_dir, resamples=FULL):
    c = contrasts(spark, sf_dir, resamples).withColumn("p_value", F.round("p_value", 9))
    return I.holm(c, ["dataset"], tie="condition").select(*COND, "p_value", "adjusted")


def margins(spark, sf_dir, resamples=FULL):
    return I.percent_margin(records(spark, sf_dir), COND, "confidence_sdc", "confidence_dice_m32", "risk_dice", "cluster_id", resamples)


add("i1_bootstrap", lambda s, d: contrasts(s, d).drop("p_value"), None, ("difference", "low", "high"))
add("i2_tail_area", lambda s, d: contrasts(s, d).select(*COND, "p_value"), None, ("p_value",))
add("i3_holm", adjusted, None, ("adjusted",))
add("i5_percent_margin", margins, None, ("margin", "low", "high"))


add("i1_bootstrap_few", lambda s, d: contrasts(s, d, REPS).drop("p_value"), f"{REC}, {HARM}, {CONTRAST} SELECT {C}, {r('difference', 'difference')}, {r('low', 'low')}, {r('high', 'high')} FROM con", ("difference", "low", "high"))
add("i2_tail_area_few", lambda s, d: contrasts(s, d, REPS).select(*COND, "p_value"), f"{REC}, {HARM}, {CONTRAST} SELECT {C}, {r('p_value', 'p_value')} FROM con", ("p_value",))
add("i3_holm_few", lambda s, d: adjusted(s, d, REPS), f"{REC}, {HARM}, {CONTRAST}, h AS (SELECT {C}, round(p_value, 9) AS p_value, round(p_value, 9) * (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY round(p_value, 9), condition) + 1) AS st FROM con) SELECT {C}, p_value, {r('least(1.0, max(st) OVER (PARTITION BY dataset ORDER BY p_value, condition ROWS UNBOUNDED PRECEDING))', 'adjusted')} FROM h", ("adjusted",))
BIN_SEED = "('0x' || substr(sha256('0|' || dataset || '|' || condition || '|' || bin), 1, 8))::BIGINT"
REL = f"""rb AS (SELECT {C}, sample_id, 1 - confidence_sdc AS p, risk_dice AS o, CAST(ntile(10) OVER (PARTITION BY {C} ORDER BY 1 - confidence_sdc, sample_id) AS INT) AS bin FROM rec),
 ri AS (SELECT *, row_number() OVER (PARTITION BY {C}, bin ORDER BY p, sample_id) - 1 AS i, count(*) OVER (PARTITION BY {C}, bin) AS m FROM rb),
 rk AS (SELECT {C}, bin, m, rep, {mixed(f"xor(rep::UBIGINT, ({BIN_SEED})::UBIGINT)", 'u')}, {mixed('u', 'k')}, {mixed('xor(k, 2654435769::UBIGINT)', 'l')} FROM (SELECT DISTINCT {C}, bin, m FROM ri), unnest(range({REPS})) AS g(rep)),
 rh AS (SELECT {C}, bin, rep, k.m, {mixed('xor(c.i::UBIGINT, k.k)', 'v')}, {mixed('((v + l) & 4294967295::UBIGINT)', 'h')} FROM rk k JOIN ri c USING ({C}, bin)),
 rd AS (SELECT {C}, bin, rep, CAST((h * m::UBIGINT) >> 32::UBIGINT AS BIGINT) AS i, count(*) AS weight FROM rh GROUP BY ALL),
 rm AS (SELECT {C}, bin, rep, sum(weight * o) / sum(weight) AS mean FROM rd JOIN ri USING ({C}, bin, i) GROUP BY {C}, bin, rep),
 rc AS (SELECT {C}, bin, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM rm GROUP BY {C}, bin)"""
BINS = ("mean_predicted", "least_predicted", "largest_predicted", "mean_observed", "low", "high")


def reliability(spark, sf_dir, resamples=FULL):
    return I.equal_count_reliability(records(spark, sf_dir).withColumn("predicted", 1 - F.col("confidence_sdc")), COND, "predicted", "risk_dice", "sample_id", resamples)


add("i4_reliability", reliability, None, BINS)
add("i4_reliability_few", lambda s, d: reliability(s, d, REPS), f"{REC}, {REL} SELECT {C}, bin, count(*) AS n, {r('avg(p)', 'mean_predicted')}, {r('min(p)', 'least_predicted')}, {r('max(p)', 'largest_predicted')}, {r('avg(o)', 'mean_observed')}, {r('max(low)', 'low')}, {r('max(high)', 'high')} FROM rb JOIN rc USING ({C}, bin) GROUP BY {C}, bin", BINS)
add("i5_percent_margin_few", lambda s, d: margins(s, d, REPS), f"{REC}, {HARM}, {boot('b', 'confidence_sdc', 'confidence_dice_m32', chr(39) + '0' + chr(39))}, {area('x', 'rec', C, 'confidence_sdc', 'risk_dice')}, {area('y', 'rec', C, 'confidence_dice_m32', 'risk_dice')}, ci AS (SELECT {C}, quantile_cont(100 * d / lft, 0.025) AS low, quantile_cont(100 * d / lft, 0.975) AS high FROM b GROUP BY {C}) SELECT {C}, {r('100 * (x.aurc - y.aurc) / x.aurc', 'margin')}, {r('low', 'low')}, {r('high', 'high')} FROM x JOIN y USING ({C}) JOIN ci USING ({C})", ("margin", "low", "high"))
add("i6_seeds", lambda s, d: records(s, d).select(*COND, hash_seed(F.lit("base"), F.col("dataset"), F.col("condition")).alias("seed")).distinct(), f"{REC} SELECT DISTINCT {C}, ('0x' || substr(sha256('base|' || dataset || '|' || condition), 1, 8))::BIGINT AS seed FROM rec")


def i7(spark, sf_dir):
    rec = records(spark, sf_dir)
    a = S.aurc(rec, COND, "confidence_dice_m32", "risk_dice").select(*COND, F.col("aurc").alias("a"))
    b = S.aurc(rec, COND, "confidence_sdc", "risk_dice").select(*COND, F.col("aurc").alias("b"))
    return I.gate(a.join(b, COND).withColumn("difference", F.round(F.col("a") - F.col("b"), 9)), ["dataset"])


add("i7_gate", i7, f"{REC}, {HARM}, {area('x', 'rec', C, 'confidence_dice_m32', 'risk_dice')}, {area('y', 'rec', C, 'confidence_sdc', 'risk_dice')}, d AS (SELECT dataset, round(x.aurc - y.aurc, 9) AS d FROM x JOIN y USING ({C})), g AS (SELECT dataset, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties, avg(d) AS mean_difference, quantile_cont(d, 0.5) AS median_difference FROM d GROUP BY dataset) SELECT dataset, wins, losses, ties, {r('mean_difference', 'mean_difference')}, {r('median_difference', 'median_difference')}, CAST(wins > losses AND mean_difference < 0 AS INT) AS passes FROM g", ("mean_difference", "median_difference"))
