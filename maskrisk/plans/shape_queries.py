"""Registered queries over surfaces, components, partitions and ensembles, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, assembly, geometry, selective, summaries
from ..operators import components as CC
from ..operators import ensemble as E
from ..operators import pixels as P
from ..functions.scores import rounded
from ..functions.shared import written
from ..sources.views import COND, KEY, large_pixels, members
from .base_sql import DISC, ENS, nats, r, unit
from .record_queries import HARM, area, rho, tau

K = "dataset, condition, sample_id"
REGISTRY: dict[str, tuple] = {}


def add(name: str, run, sql: str | None, digits: tuple[str, ...] = (), places: int = 9) -> None:
    def query(spark, sf_dir):
        df = run(spark, sf_dir)
        return df.withColumns({c: rounded(F.col(c), places) for c in digits}) if digits else df

    REGISTRY[name] = (query, sql and "WITH " + sql)


def surf(name: str, src: str, mask: str, group: str = K) -> str:
    near = ", ".join(f"coalesce({f}({mask}) OVER (PARTITION BY {group}, {a} ORDER BY {b}), 0)" for a, b in (("y", "x"), ("x", "y")) for f in ("lag", "lead"))
    return f"{name} AS (SELECT {group}, y, x FROM (SELECT {group}, y, x, {mask} AS m, least({near}) AS low FROM {src}) WHERE m = 1 AND low = 0)"


def pooled(name: str, left: str, right: str, group: str = K) -> str:
    def one(a, b):
        on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
        ag = ", ".join(f"a.{g.strip()}" for g in group.split(","))
        return f"SELECT {ag}, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d2 FROM {a} a JOIN {b} b ON {on} GROUP BY {ag}, a.y, a.x"

    return f"{name}p AS ({one(left, right)} UNION ALL {one(right, left)}), {name} AS (SELECT {group}, sqrt(max(d2)) AS m, quantile_cont(sqrt(d2), 0.95) AS q FROM {name}p GROUP BY {group})"


def capped(v: str) -> str:
    return f"CASE WHEN ls = 0 AND rs = 0 THEN 0.0 WHEN ls = 0 OR rs = 0 THEN 1.0 ELSE least(1.0, {v} / diagonal) END"


MASKS = "mk AS (SELECT *, CAST(p >= 0.5 AS INT) AS a FROM disc)"
TWO = f"{DISC}, {MASKS}, {surf('sa', 'mk', 'a')}, {surf('st', 'mk', 'truth')}, {pooled('pd', 'st', 'sa')}, sz AS (SELECT {K}, sqrt((max(y) + 1) * (max(y) + 1) + (max(x) + 1) * (max(x) + 1)) AS diagonal, sum(truth) AS ls, sum(a) AS rs FROM mk GROUP BY {K})"


def masks(s, d):
    return large_pixels(s, d).withColumn("a", (F.col("p") >= 0.5).cast("int"))


add("m3_surface", lambda s, d: geometry.surface(masks(s, d), KEY, "a"), f"{DISC}, {MASKS}, {surf('sa', 'mk', 'a')} SELECT {K}, y, x FROM sa")


def m4(spark, sf_dir):
    px = masks(spark, sf_dir)
    return geometry.nearest(geometry.surface(px, KEY, "truth"), geometry.surface(px, KEY, "a"), KEY)


add("m4_nearest_surface", m4, f"{DISC}, {MASKS}, {surf('sa', 'mk', 'a')}, {surf('st', 'mk', 'truth')} SELECT {K.replace('dataset', 'a.dataset').replace('condition', 'a.condition').replace('sample_id', 'a.sample_id')}, a.y, a.x, CAST(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d2 FROM st a JOIN sa b ON a.dataset = b.dataset AND a.condition = b.condition AND a.sample_id = b.sample_id GROUP BY ALL")
for name, col, v in (("m5_nhd", "nhd", "m"), ("m6_nhd95", "nhd95", "q")):
    add(name, lambda s, d, c=col: geometry.mask_distances(masks(s, d), KEY, "truth", "a").select(*KEY, c), f"{TWO} SELECT {K}, {r(capped(v), col)} FROM sz LEFT JOIN pd USING ({K})", (col,))
add("m7_pixel_distances", lambda s, d: geometry.mask_distances(masks(s, d), KEY, "truth", "a").select(*KEY, "hd", "hd95"), f"{TWO} SELECT {K}, {r('(' + capped('m') + ') * diagonal', 'hd')}, {r('(' + capped('q') + ') * diagonal', 'hd95')} FROM sz LEFT JOIN pd USING ({K})", ("hd", "hd95"))


def levels(m: int, name: str) -> str:
    g = f"{K}, k"
    return f"""{name}v AS (SELECT {K}, y, x, k, CAST(p >= (k + 0.5::DOUBLE) / {m} AS INT) AS v, CAST(p >= 0.5 AS INT) AS a FROM disc, unnest(range({m})) AS g(k)),
 {surf(name + 'l', name + 'v', 'v', g)}, {surf(name + 'a', name + 'v', 'a', g)}, {pooled(name + 'd', name + 'l', name + 'a', g)},
 {name}s AS (SELECT {g}, sqrt((max(y) + 1) * (max(y) + 1) + (max(x) + 1) * (max(x) + 1)) AS diagonal, sum(v) AS ls, sum(a) AS rs FROM {name}v GROUP BY {g}),
 {name} AS (SELECT {K}, -avg({capped('m')}) AS nhd, -avg({capped('q')}) AS nhd95 FROM {name}s LEFT JOIN {name}d USING ({g}) GROUP BY {K})"""


for name, col in (("q4_nhd_ladder", "nhd"), ("q5_nhd95_ladder", "nhd95")):
    cols = tuple(f"confidence_{col}_m{m}" for m in (2, 8, 32))
    add(
        name, lambda s, d, c=cols: geometry.distance_ladder(large_pixels(s, d), KEY, [2, 8, 32]).select(*KEY, *c),
        f"{DISC}, {levels(2, 'x')}, {levels(8, 'z')}, {levels(32, 'v')} SELECT {K}, {r('x.' + col, cols[0])}, {r('z.' + col, cols[1])}, {r('v.' + col, cols[2])} FROM x JOIN z USING ({K}) JOIN v USING ({K})", cols,
    )


def nhd_loss(masks, key):
    return geometry.mask_distances(masks, key, "level", "action").select(*key, F.col("nhd").alias("loss"))


KT = f"{K}, t"
add("q2_mask_loss", lambda s, d: P.mask_risk(large_pixels(s, d), KEY, {0.25: 0.25, 0.75: 0.75}, nhd_loss),
    f"""{DISC}, qv AS (SELECT {K}, y, x, t, w, CAST(p >= t AS INT) AS v, CAST(p >= 0.5 AS INT) AS a FROM disc, (VALUES (0.25::DOUBLE, 0.25::DOUBLE), (0.75::DOUBLE, 0.75::DOUBLE)) AS g(t, w)),
 {surf('ql', 'qv', 'v', KT)}, {surf('qa', 'qv', 'a', KT)}, {pooled('qd', 'ql', 'qa', KT)},
 qs AS (SELECT {KT}, max(w) AS w, sqrt((max(y) + 1) * (max(y) + 1) + (max(x) + 1) * (max(x) + 1)) AS diagonal, sum(v) AS ls, sum(a) AS rs FROM qv GROUP BY {KT})
 SELECT {K}, {r('sum(w * ' + capped('m') + ')', 'risk')} FROM qs LEFT JOIN qd USING ({KT}) GROUP BY {K}""", ("risk",))  # fmt: skip


def q8(spark, sf_dir):
    """Scores of the fine and of the working grid, and their difference, for each image."""
    px = written(large_pixels(spark, sf_dir), "pixels")
    dice = P.dice_ladder(px, KEY, [32, 128])
    nhd = geometry.distance_ladder(px, KEY, [32, 128])
    return dice.join(nhd, KEY).select(*KEY, "confidence_dice_m32", "confidence_dice_m128", (F.col("confidence_dice_m32") - F.col("confidence_dice_m128")).alias("dice_error"), (F.col("confidence_nhd_m32") - F.col("confidence_nhd_m128")).alias("nhd_error"), (F.col("confidence_nhd95_m32") - F.col("confidence_nhd95_m128")).alias("nhd95_error"))


def dice_mean(m: int, name: str) -> str:
    return f"""{name}c AS (SELECT {K}, k, sum(CASE WHEN p >= 0.5 AND p >= (k + 0.5::DOUBLE) / {m} THEN 1 ELSE 0 END) AS z, sum(CASE WHEN p >= (k + 0.5::DOUBLE) / {m} THEN 1 ELSE 0 END) AS s, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS a FROM disc, unnest(range({m})) AS g(k) GROUP BY {K}, k),
 {name} AS (SELECT {K}, -avg(CASE WHEN s + a = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * z / (s + a) END) AS c FROM {name}c GROUP BY {K})"""


add("q8_fine_grid", q8, f"{DISC}, {dice_mean(32, 'a32')}, {dice_mean(128, 'a128')}, {levels(32, 'x')}, {levels(128, 'z')} SELECT {K}, {r('a32.c', 'confidence_dice_m32')}, {r('a128.c', 'confidence_dice_m128')}, {r('a32.c - a128.c', 'dice_error')}, {r('x.nhd - z.nhd', 'nhd_error')}, {r('x.nhd95 - z.nhd95', 'nhd95_error')} FROM a32 JOIN a128 USING ({K}) JOIN x USING ({K}) JOIN z USING ({K})", ("confidence_dice_m32", "confidence_dice_m128", "dice_error", "nhd_error", "nhd95_error"))

LOSSES = ("dice", "nhd", "nhd95")


def fine(spark, sf_dir):
    """(key, loss, coarse, fine, risk): the scores of both grids and the realised loss, for each of the three losses."""
    px = written(masks(spark, sf_dir), "pixels")
    own = geometry.mask_distances(px, KEY, "truth", "a").join(P.image_scores(px, KEY).select(*KEY, F.col("dice_loss").alias("dice")), KEY)
    both = P.dice_ladder(px, KEY, [32, 128]).join(geometry.distance_ladder(px, KEY, [32, 128]), KEY).join(own, KEY)
    place = F.explode(F.array(*[F.struct(F.lit(c).alias("loss"), F.round(f"confidence_{c}_m32", 9).alias("coarse"), F.round(f"confidence_{c}_m128", 9).alias("fine"), F.round(c, 9).alias("risk")) for c in LOSSES]))
    return both.select(*KEY, place.alias("l")).select(*KEY, "l.*")


CL = "dataset, condition, loss"
FINE = ("mean", "median", "p95", "largest", "equal_share", "rho", "tau", "aurc_gap")
OWN = f"dl AS (SELECT {K}, CASE WHEN sum(a) + sum(truth) = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * sum(a * truth) / (sum(a) + sum(truth)) END AS dice FROM mk GROUP BY {K}), own AS (SELECT {K}, dice, {capped('m')} AS nhd, {capped('q')} AS nhd95 FROM sz LEFT JOIN pd USING ({K}) JOIN dl USING ({K}))"
add("w9_fine_grid", lambda s, d: summaries.fine_grid(fine(s, d), [*COND, "loss"], "coarse", "fine", "risk"),
    f"""{TWO}, {HARM}, {OWN}, {dice_mean(32, 'a32')}, {dice_mean(128, 'a128')}, {levels(32, 'x')}, {levels(128, 'z')},
    fg AS (SELECT {K}, 'dice' AS loss, round(a32.c, 9) AS a, round(a128.c, 9) AS b, round(own.dice, 9) AS dl FROM a32 JOIN a128 USING ({K}) JOIN own USING ({K})
      UNION ALL SELECT {K}, 'nhd', round(x.nhd, 9), round(z.nhd, 9), round(own.nhd, 9) FROM x JOIN z USING ({K}) JOIN own USING ({K})
      UNION ALL SELECT {K}, 'nhd95', round(x.nhd95, 9), round(z.nhd95, 9), round(own.nhd95, 9) FROM x JOIN z USING ({K}) JOIN own USING ({K})),
    fe AS (SELECT {CL}, avg(abs(a - b)) AS mean, quantile_cont(abs(a - b), 0.5) AS median, quantile_cont(abs(a - b), 0.95) AS p95, max(abs(a - b)) AS largest, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS equal_share FROM fg GROUP BY {CL}),
    {rho('q', 'fg', CL, 'a', 'b')}, {tau('t', 'fg', CL, 'a', 'b')}, {area('one', 'fg', CL, 'a', 'dl')}, {area('two', 'fg', CL, 'b', 'dl')}
    SELECT {CL}, """ + ", ".join(r(c, c) for c in FINE[:-1]) + f", {r('one.aurc - two.aurc', 'aurc_gap')} FROM fe JOIN q USING ({CL}) JOIN t USING ({CL}) JOIN one USING ({CL}) JOIN two USING ({CL})", FINE)  # fmt: skip
WIDE = ("sdc", "dice", "nhd", "nhd95", *(f"confidence_{c}_m{m}" for m in (2, 8, 32) for c in LOSSES))


def t1(spark, sf_dir):
    """The wide row of each image: common scores and losses, and a table of three scores for each rule, of one cohort."""
    px = written(masks(spark, sf_dir), "pixels")
    common = P.image_scores(px, KEY).select(*KEY, "n", "sdc", F.col("dice_loss").alias("dice")).join(geometry.mask_distances(px, KEY, "truth", "a").select(*KEY, "nhd", "nhd95"), KEY)
    count = px.groupBy(*KEY).agg(F.count("*").alias("n"))
    ladders = written(count.join(P.dice_ladder(px, KEY, [2, 8, 32]), KEY).join(geometry.distance_ladder(px, KEY, [2, 8, 32]), KEY), "ladders")
    rules = [ladders.select(*KEY, "n", *(f"confidence_{c}_m{m}" for c in LOSSES)) for m in (2, 8, 32)]
    for i, rule in enumerate(rules):
        common = assembly.assemble(common, [rule if i == 0 else rule.drop("n")], KEY, ["n"] if i == 0 else [])
    return common.select(*KEY, "n", *WIDE)


add("t1_assemble", t1, f"""{TWO}, {OWN}, {", ".join(dice_mean(m, f'a{m}') for m in (2, 8, 32))}, {levels(2, 'x')}, {levels(8, 'z')}, {levels(32, 'v')},
  sd AS (SELECT {K}, count(*) AS n, CASE WHEN sum(p) + sum(a) = 0 THEN 0 ELSE 2 * sum(CASE WHEN a = 1 THEN p ELSE 0 END) / (sum(p) + sum(a)) END AS sdc FROM mk GROUP BY {K})
  SELECT {K}, n, {r('sdc', 'sdc')}, {r('own.dice', 'dice')}, {r('own.nhd', 'nhd')}, {r('own.nhd95', 'nhd95')}, """ + ", ".join(r(v, n) for m, t in ((2, "x"), (8, "z"), (32, "v")) for v, n in ((f"a{m}.c", f"confidence_dice_m{m}"), (f"{t}.nhd", f"confidence_nhd_m{m}"), (f"{t}.nhd95", f"confidence_nhd95_m{m}"))) + f" FROM own JOIN sd USING ({K}) " + " ".join(f"JOIN {t} USING ({K})" for t in ("a2", "a8", "a32", "x", "z", "v")), WIDE)

# --- components ---


def comp(cut: float, name: str = "cmp") -> str:
    return f"""{name}v AS (SELECT *, CAST(p >= {cut} AS INT) AS v FROM disc),
 {name}g AS (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, y ORDER BY x) AS rn FROM (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY {K}, y ORDER BY x), TRUE) AS ch FROM {name}v)),
 {name}r AS (SELECT {K}, y, rn, min(x) AS x0, max(x) AS x1, max(v) AS v, CAST(y AS BIGINT) * 4294967296 + min(x) AS node FROM {name}g GROUP BY {K}, y, rn),
 {name}e AS (SELECT a.dataset, a.condition, a.sample_id, a.node AS u, b.node AS w FROM {name}r a JOIN {name}r b ON a.dataset = b.dataset AND a.condition = b.condition AND a.sample_id = b.sample_id AND abs(b.y - a.y) = 1 AND a.v = b.v AND a.x0 <= b.x1 AND b.x0 <= a.x1),
 {name}c(dataset, condition, sample_id, u, w) AS (SELECT {K}, node, node FROM {name}r UNION SELECT c.dataset, c.condition, c.sample_id, c.u, e.w FROM {name}c c JOIN {name}e e ON e.dataset = c.dataset AND e.condition = c.condition AND e.sample_id = c.sample_id AND e.u = c.w),
 {name}o AS (SELECT {K}, u AS node, min(w) AS root FROM {name}c GROUP BY {K}, u),
 {name}l AS (SELECT {K}, node, CAST(dense_rank() OVER (PARTITION BY {K} ORDER BY root) - 1 AS INT) AS label FROM {name}o),
 {name} AS (SELECT {K}, y, x, p, truth, label FROM {name}g JOIN {name}r USING ({K}, y, rn) JOIN {name}l USING ({K}, node))"""


def grid_sql(name: str, src: str, labels: str) -> str:
    return f"""{name}t AS (SELECT {K}, max(label) + 1 AS tg, max(y) + 1 AS h, max(x) + 1 AS w FROM {labels} GROUP BY {K}),
 {name}f AS (SELECT *, list_filter(range(least(h, greatest(1, CAST(round_even(sqrt(tg * h / w), 0) AS INT)), tg), least(h, tg) + 1), lambda q: ceil(tg / q) <= w)[1] AS rs FROM {name}t),
 {name}q AS (SELECT s.dataset, s.condition, s.sample_id, s.y, s.x, s.p, s.truth, tg, w, rs, list_max(list_filter(range(0, rs), lambda i: i * h // rs <= s.y)) AS ro FROM {src} s JOIN {name}f USING ({K})),
 {name}z AS (SELECT *, tg // rs + CASE WHEN ro < tg % rs THEN 1 ELSE 0 END AS cs FROM {name}q),
 {name} AS (SELECT {K}, y, x, p, truth, CAST(ro * (tg // rs) + least(ro, tg % rs) + list_max(list_filter(range(0, cs), lambda i: i * w // cs <= x)) AS INT) AS label FROM {name}z)"""


def labelled(coupling, threshold=None):
    return lambda s, d: CC.partition(large_pixels(s, d), KEY, coupling, threshold=threshold).select(*KEY, "y", "x", F.col("label").cast("int").alias("label"))


LAB = f"SELECT {K}, y, x, label FROM"
add("c6_components", labelled("action_components"), f"RECURSIVE {DISC}, {comp(0.5)} {LAB} cmp")
add("c7_balanced_grid", labelled("action_grid"), f"RECURSIVE {DISC}, {comp(0.5)}, {grid_sql('gr', 'disc', 'cmp')} {LAB} gr")
add("c8_proposal_grid", labelled("proposal_grid", 0.25), f"RECURSIVE {DISC}, {comp(0.25)}, {grid_sql('gr', 'disc', 'cmp')} {LAB} gr")
DRAWS, REPEATS, SEED = 256, 4, 20260721


def estimates(px):
    return CC.partition_dice(CC.partition(px, KEY, "action_components"), KEY, "action_components", DRAWS, REPEATS, SEED)


EST = f"""cl AS (SELECT {K}, label, p, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN p >= 0.5 THEN 0 ELSE 1 END) AS o FROM cmp GROUP BY {K}, label, p),
 ac AS (SELECT {K}, sum(i) AS action FROM cl GROUP BY {K}),
 dr AS (SELECT {K}, label, rep, draw, half, CASE WHEN half = 0 THEN u ELSE 1 - u END AS u FROM (SELECT *, {unit(f"'{SEED}|' || sample_id || '|action_components|' || rep || '|' || draw || '|' || label")} AS u FROM (SELECT DISTINCT {K}, label FROM cl), unnest(range({REPEATS})) AS a(rep), unnest(range({DRAWS // 2})) AS b(draw)), unnest(range(2)) AS c(half)),
 ev AS (SELECT {K}, label, p AS v, 0 AS drawn, i, o, CAST(NULL AS BIGINT) AS rep, CAST(NULL AS BIGINT) AS draw, CAST(NULL AS BIGINT) AS half FROM cl UNION ALL SELECT {K}, label, u, 1, 0, 0, rep, draw, half FROM dr),
 ru AS (SELECT {K}, rep, draw, half, drawn, sum(i) OVER w AS z, sum(o) OVER w AS w FROM ev WINDOW w AS (PARTITION BY {K}, label ORDER BY v DESC, drawn ROWS UNBOUNDED PRECEDING)),
 ds AS (SELECT {K}, rep, draw, half, sum(z) AS z, sum(w) AS w FROM ru WHERE drawn = 1 GROUP BY {K}, rep, draw, half),
 es AS (SELECT {K}, rep, -avg(CASE WHEN z + w + action = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * z / (z + w + action) END) AS confidence FROM ds JOIN ac USING ({K}) GROUP BY {K}, rep)"""
add("c9_partition_dice", lambda s, d: estimates(large_pixels(s, d)), f"RECURSIVE {DISC}, {comp(0.5)}, {EST} SELECT {K}, CAST(rep AS INT) AS \"repeat\", {r('confidence', 'confidence')} FROM es", ("confidence",))
add("c10_partition_diagnostics", lambda s, d: CC.partition_diagnostics(CC.partition(large_pixels(s, d), KEY, "action_components"), KEY), f"RECURSIVE {DISC}, {comp(0.5)}, b AS (SELECT {K}, label, count(*) AS c FROM cmp GROUP BY {K}, label) SELECT {K}, count(*) AS num_blocks, {r('max(c) / sum(c)', 'largest_block_fraction')} FROM b GROUP BY {K}", ("largest_block_fraction",))


def c11(spark, sf_dir):
    """Mean and deviation over repeats, by condition: mean deviation, range of the repeats' areas, least rank agreement with the mean."""
    px = written(large_pixels(spark, sf_dir), "pixels")
    est = written(estimates(px), "estimates")
    risk = P.image_scores(px, KEY).select(*KEY, "dice_loss")
    one = CC.repeat_summary(est, KEY)
    areas = selective.aurc(est.withColumn("confidence", F.round("confidence", 9)).join(risk, KEY), [*COND, "repeat"], "confidence", "dice_loss")
    each = est.withColumn("c", F.round("confidence", 9)).join(one.select(*KEY, F.round("mean", 9).alias("m")), KEY)
    rank = agreement.spearman(each, [*COND, "repeat"], "c", "m").groupBy(*COND).agg(F.min("rho").alias("least_rho"))
    span = areas.groupBy(*COND).agg((F.max("aurc") - F.min("aurc")).alias("aurc_range"))
    return one.groupBy(*COND).agg(F.avg("mean").alias("mean"), F.avg("sd").alias("mean_sd")).join(span, COND).join(rank, COND)


C = "dataset, condition"
add("c11_repeat_summary", c11, f"""RECURSIVE {DISC}, {HARM}, {comp(0.5)}, {EST}, ri AS (SELECT {K}, CASE WHEN sum(CAST(p >= 0.5 AS INT)) + sum(truth) = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * sum(CAST(p >= 0.5 AS INT) * truth) / (sum(CAST(p >= 0.5 AS INT)) + sum(truth)) END AS risk FROM disc GROUP BY {K}),
  me AS (SELECT {K}, avg(confidence) AS mean, stddev_pop(confidence) AS sd FROM es GROUP BY {K}), er AS (SELECT {K}, rep, round(confidence, 9) AS c, round(mean, 9) AS m, risk FROM es JOIN me USING ({K}) JOIN ri USING ({K})),
  {area('ar', 'er', C + ', rep', 'c', 'risk')}, {rho('rr', 'er', C + ', rep', 'c', 'm')}, s1 AS (SELECT {C}, max(aurc) - min(aurc) AS aurc_range FROM ar GROUP BY {C}), s2 AS (SELECT {C}, min(rho) AS least_rho FROM rr GROUP BY {C}), s0 AS (SELECT {C}, avg(mean) AS mean, avg(sd) AS mean_sd FROM me GROUP BY {C})
  SELECT {C}, {r('mean', 'mean')}, {r('mean_sd', 'mean_sd')}, {r('aurc_range', 'aurc_range')}, {r('least_rho', 'least_rho')} FROM s0 JOIN s1 USING ({C}) JOIN s2 USING ({C})""", ("mean", "mean_sd", "aurc_range", "least_rho"))  # fmt: skip

# --- ensembles ---
MEAN = f"mn AS (SELECT {K}, y, x, CAST(CAST(avg(p) AS FLOAT) AS DOUBLE) AS p, max(truth) AS truth FROM ens GROUP BY {K}, y, x)"


def mean(s, d):
    return E.mean_map(members(s, d), KEY, 3)


add("e1_mean_map", mean, f"{ENS}, {MEAN} SELECT {K}, y, x, {r('p', 'p')}, truth FROM mn", ("p",))
LOW = "0.2689414213699951::DOUBLE"
add("e2_iou_stability", lambda s, d: E.threshold_iou_stability(mean(s, d), KEY), f"{ENS}, {MEAN} SELECT {K}, {r(f'CASE WHEN sum(CASE WHEN p >= {LOW} THEN 1 ELSE 0 END) = 0 THEN 1 ELSE sum(CASE WHEN p >= 1 - {LOW} THEN 1 ELSE 0 END) / sum(CASE WHEN p >= {LOW} THEN 1 ELSE 0 END) END', 'stability')} FROM mn GROUP BY {K}", ("stability",))
JOINED = f"{MEAN}, jm AS (SELECT e.dataset, e.condition, e.sample_id, e.member, y, x, CAST(e.p >= 0.5 AS INT) AS m, CAST(mn.p >= 0.5 AS INT) AS a FROM ens e JOIN mn USING ({K}, y, x))"
KM = f"{K}, member"
add("e3_member_scores", lambda s, d: E.member_scores(members(s, d), KEY, 3),
    f"""{ENS}, {JOINED}, dc AS (SELECT {KM}, CASE WHEN sum(m) + sum(a) = 0 THEN 0 ELSE 1 - 2.0::DOUBLE * sum(m * a) / (sum(m) + sum(a)) END AS dl, sqrt((max(y) + 1) * (max(y) + 1) + (max(x) + 1) * (max(x) + 1)) AS diagonal, sum(m) AS ls, sum(a) AS rs FROM jm GROUP BY {KM}),
    {surf('sm', 'jm', 'm', KM)}, {surf('sa', 'jm', 'a', KM)}, {pooled('pd', 'sm', 'sa', KM)}
    SELECT {K}, {r('-avg(dl)', 'confidence_q_dice')}, {r(f"-avg({capped('m')})", 'confidence_q_nhd')}, {r(f"-avg({capped('q')})", 'confidence_q_nhd95')} FROM dc LEFT JOIN pd USING ({KM}) GROUP BY {K}""", ("confidence_q_dice", "confidence_q_nhd", "confidence_q_nhd95"))  # fmt: skip
add("e4_all_member_iou", lambda s, d: E.all_member_iou(members(s, d), KEY), f"{ENS}, a AS (SELECT {K}, y, x, min(CAST(p >= 0.5 AS INT)) AS lo, max(CAST(p >= 0.5 AS INT)) AS hi FROM ens GROUP BY {K}, y, x) SELECT {K}, {r('CASE WHEN sum(hi) = 0 THEN 1 ELSE sum(lo) / sum(hi) END', 'iou')} FROM a GROUP BY {K}", ("iou",))
add("e5_pairwise_dice", lambda s, d: E.pairwise_dice(members(s, d), KEY), f"{ENS}, b AS (SELECT *, CAST(p >= 0.5 AS INT) AS m FROM ens), s AS (SELECT a.dataset, a.condition, a.sample_id, a.member AS i, b.member AS j, CASE WHEN sum(a.m) + sum(b.m) = 0 THEN 1 ELSE 2.0::DOUBLE * sum(a.m * b.m) / (sum(a.m) + sum(b.m)) END AS sim FROM b a JOIN b ON a.dataset = b.dataset AND a.condition = b.condition AND a.sample_id = b.sample_id AND a.y = b.y AND a.x = b.x AND a.member < b.member GROUP BY ALL) SELECT {K}, {r('avg(sim)', 'similarity')} FROM s GROUP BY {K}", ("similarity",))
add("e6_mutual_information", lambda s, d: E.mutual_information(members(s, d), KEY), f"{ENS}, a AS (SELECT {K}, y, x, avg(p) AS p, avg({nats('p')}) AS h FROM ens GROUP BY {K}, y, x) SELECT {K}, {r('-greatest(0.0, avg(' + nats('p') + ' - h))', 'negative_mutual_information')} FROM a GROUP BY {K}", ("negative_mutual_information",))
add("e7_probability_variance", lambda s, d: E.probability_variance(members(s, d), KEY), f"{ENS}, a AS (SELECT {K}, y, x, var_pop(p) AS v FROM ens GROUP BY {K}, y, x) SELECT {K}, {r('-avg(v)', 'negative_variance')} FROM a GROUP BY {K}", ("negative_variance",))
