"""Small cases with known answers, and that results do not depend on row order or partitions."""

import gzip
import hashlib
from collections import Counter
from itertools import permutations
from math import hypot, log2, sqrt

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskrisk.functions.scores import dice_loss, hash_unit
from maskrisk.operators import agreement, calibration, cardinality, components, ensemble, geometry, inference, pixels, ranks, selective, summaries, validate
from maskrisk.sources import io

KEY = ["s"]


def image(spark, p, truth=None, s=1):
    p = np.asarray(p, float)
    t = np.zeros(p.shape, int) if truth is None else np.asarray(truth, int)
    rows = [(s, y, x, float(p[y, x]), int(t[y, x])) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "s int, y int, x int, p double, truth int")


def scores(spark, pairs):
    return spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "cond string, id long, score double, risk double")


def test_dice_conventions(spark):
    got = spark.range(1).select(dice_loss(F.lit(1), F.lit(2), F.lit(2)).alias("a"), dice_loss(F.lit(0), F.lit(0), F.lit(0)).alias("b"), dice_loss(F.lit(0), F.lit(3), F.lit(0)).alias("c")).first()
    assert tuple(got) == (0.5, 0.0, 1.0)


def test_weighted_level_set_risk(spark):
    px = image(spark, [[0.9, 0.6], [0.4, 0.1]])
    assert pixels.level_set_risk(px, KEY, {0.25: 0.25, 0.75: 0.75}, dice_loss, gamma=0.5000001).first()["risk"] == pytest.approx(0.25 * 0.2 + 0.75 / 3)
    with pytest.raises(ValueError):
        pixels.level_set_risk(px, KEY, {0.0: 1.0}, dice_loss)


@pytest.mark.parametrize("p, want", [([[0.9, 0.6], [0.4, 0.1]], -(0.1 + 0.3 / 3 + 0 + 0.3 * 0.2 + 0.1 / 3)), ([[0.8, 0.8], [0.2, 0.2]], -(0.2 + 0.2 / 3))])
def test_exact_dice(spark, p, want):
    assert pixels.exact_dice(image(spark, p), KEY).first()["confidence_dice_exact"] == pytest.approx(want)


def test_soft_dice_and_baselines(spark):
    s = pixels.image_scores(image(spark, [[0.8, 0.6], [0.4, 0.0]]), KEY).first()
    assert s["sdc"] == pytest.approx(2.8 / 3.8)
    zero = pixels.image_scores(image(spark, np.zeros((2, 2))), KEY).first()
    assert (zero["sdc"], zero["mmmc"], zero["foreground_entropy"], zero["dice_loss"]) == (0, 0, -1, 0)
    flat = image(spark, np.full((10, 10), 0.1))
    h = -(0.1 * log2(0.1) + 0.9 * log2(0.9))
    assert pixels.quantile_foreground_ratio(flat, KEY).first()["qfr"] == pytest.approx(-h)
    assert pixels.patch_maximum(image(spark, np.full((11, 12), 0.5)), KEY, 10).first()["plm"] == pytest.approx(-1)


def test_a_pixel_at_a_node_is_inside(spark):
    z = pixels.count_ladders(image(spark, [[0.75, 0.25], [0.5, 0.0]]), KEY, pixels.nodes(2)).first()
    assert (z["z"], z["w"]) == ([2, 1], [1, 0])


def test_surface_distances(spark):
    a, b = np.zeros((6, 8), int), np.zeros((6, 8), int)
    a[2, 2] = b[2, 4] = 1
    px = image(spark, a, b).withColumn("a", F.col("p").cast("int"))
    d = geometry.mask_distances(px, KEY, "a", "truth").first()
    assert (d["nhd"], d["nhd95"], d["hd"]) == pytest.approx((2 / hypot(6, 8), 2 / hypot(6, 8), 2))
    empty = image(spark, np.zeros((3, 3)), np.zeros((3, 3), int)).withColumn("a", F.lit(0))
    assert geometry.mask_distances(empty, KEY, "a", "truth").first()["nhd"] == 0
    one = image(spark, np.zeros((3, 3)), np.ones((3, 3), int)).withColumn("a", F.lit(0))
    assert geometry.mask_distances(one, KEY, "a", "truth").first()["nhd"] == 1


def test_level_surfaces_match_erosion(spark):
    rng = np.random.default_rng(4)
    p = rng.random((9, 11))
    got = {(r.t, r.y, r.x) for r in geometry.level_surfaces(image(spark, p), KEY, [0.25, 0.5, 0.75]).collect()}
    want = set()
    for t in (0.25, 0.5, 0.75):
        m = np.pad(p >= t, 1)
        inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
        want |= {(t, int(y), int(x)) for y, x in np.argwhere((p >= t) & ~inner)}
    assert got == want


def test_components(spark):
    p = [[1, 0, 1], [1, 0, 0], [0, 0, 0]]
    got = {(r.y, r.x): r.label for r in components.components(image(spark, p).withColumn("m", F.col("p").cast("int")), KEY, "m").collect()}
    assert [got[k] for k in ((0, 0), (1, 0), (0, 1), (2, 2), (0, 2))] == [0, 0, 1, 1, 2]
    snake = np.ones((7, 7))
    snake[1, :-1] = snake[3, 1:] = snake[5, :-1] = 0
    assert components.partition_diagnostics(components.components(image(spark, snake).withColumn("m", F.col("p").cast("int")), KEY, "m"), KEY).first()["num_blocks"] == 4


@pytest.mark.parametrize("target", [1, 2, 3, 5, 7, 12, 24])
def test_grid_has_the_blocks_asked_for(spark, target):
    px = image(spark, np.zeros((4, 6)))
    g = components.grid(px, KEY, spark.createDataFrame([(1, target)], "s int, target int"))
    assert sorted(r.label for r in g.select("label").distinct().collect()) == list(range(target))


def test_cardinality_bounds(spark):
    want = [(0, 0.2), (0.2, 0.2), (0.2, 0.7), (0.7, 1)]
    for k, w in enumerate(want):
        truth = [[int(i < k) for i in range(3)]]
        r = cardinality.cdf_bounds(image(spark, [[0.8, 0.8, 0.3]], truth), KEY).first()
        assert (r["lower"], r["upper"]) == pytest.approx(w)


def test_hash_unit(spark):
    for text in ("1", "病例-17"):
        digits = int(hashlib.sha256(f"pit|20260720|{text}".encode()).hexdigest()[:13], 16)
        assert spark.range(1).select(hash_unit(F.lit("pit"), F.lit(20260720), F.lit(text))).first()[0] == (digits + 0.5) / 2**52


def test_aurc(spark):
    assert selective.aurc(scores(spark, [(1, 0), (1, 2), (0, 3)]), ["cond"], "score", "risk").first()["aurc"] == pytest.approx(11 / 9)
    s = selective.summary(scores(spark, [(1, 0), (0, 1)]), ["cond"], "score", "risk").first()
    assert (s["aurc"], s["excess"]) == (0.25, 0)
    s = selective.summary(scores(spark, [(1, 1), (0, 0)]), ["cond"], "score", "risk").first()
    assert (s["aurc"], s["normalized"]) == pytest.approx((0.75, 2))
    assert selective.summary(scores(spark, [(1, 0.5), (0, 0.5)]), ["cond"], "score", "risk").first()["normalized"] is None


def test_aurc_is_the_mean_over_orders_of_ties(spark):
    rows = [(2, 0.1), (1, 0.9), (1, 0.2), (1, 0.4), (0, 0.3)]
    tied = [r for _, r in rows[1:4]]
    areas = [np.mean(np.cumsum([0.1, *o, 0.3]) / np.arange(1, 6)) for o in permutations(tied)]
    assert selective.aurc(scores(spark, rows), ["cond"], "score", "risk").first()["aurc"] == pytest.approx(np.mean(areas))


def test_harmonic_is_continuous(spark):
    got = [r[0] for r in spark.range(60, 70).select(selective.harmonic(F.col("id"))).collect()]
    assert got == pytest.approx([sum(1 / i for i in range(1, n + 1)) for n in range(60, 70)], rel=1e-14)


def test_accepted_sets(spark):
    a = selective.accepted(scores(spark, [(1, 0), (1, 0), (0, 0), (0, 0)]), ["cond"], "score", [0.25], "id")
    b = selective.accepted(scores(spark, [(1, 0), (0, 0), (0, 0), (0, 0)]), ["cond"], "score", [0.25], "id")
    assert sorted(r.w for r in a.collect()) == [0, 0, 0.5, 0.5]
    assert selective.accepted_jaccard(a, b, ["cond", "id"], ["cond"]).first()["jaccard"] == pytest.approx(1 / 3)


def test_holm(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p_value double")
    assert [r.adjusted for r in inference.holm(rows, ["family"]).orderBy("name").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_curve_writes_its_ties_and_is_never_broadcast(spark, sf):
    """The plan of both curves does not repeat the records, and joins by sorting: few ties may stand for many rows."""
    from maskrisk.plans import REGISTRY

    plan = REGISTRY["r4_risk_coverage"][0](spark, sf)._jdf.queryExecution()
    logical, physical = plan.optimizedPlan().toString(), plan.executedPlan().toString()
    assert "lineitem" not in logical and "l_orderkey" not in logical
    assert "SortMergeJoin" in physical


def test_bootstrap_of_equal_scores_is_zero(spark):
    rows = scores(spark, [(i % 3, i % 2) for i in range(12)]).withColumn("other", F.col("score"))
    r = inference.contrast(rows, ["cond"], "score", "other", "risk", "id", resamples=20).first()
    assert (r["difference"], r["low"], r["high"], r["p_value"]) == (0, 0, 0, 1)


def test_bootstrap_weights_sum_to_clusters(spark):
    rows = scores(spark, [(i, 0) for i in range(30)]).withColumn("cluster", F.col("id") % 7)
    w = inference.cluster_weights(rows, ["cond"], "cluster", 5, F.lit(1)).groupBy("rep").agg(F.sum("weight").alias("w"))
    assert [r.w for r in w.collect()] == [7] * 5


def test_draws_of_many_clusters_and_kinds(spark):
    """Draws in pieces are those of the formula; a condition of 70,000 records is one stretch, whose clusters are drawn once."""
    m, reps = 2 * inference.DRAWS + 5, np.array([3, 4])
    c = spark.range(m).select(F.lit("c").alias("cond"), F.col("id").alias("cluster"))
    want = np.zeros((5, m), int)
    for r in inference.cluster_weights(c, ["cond"], "cluster", 5, F.lit(9)).where("rep >= 3").collect():
        want[r.rep, r.cluster] = r.weight
    assert (inference.drawn_weights(9, m, reps) == want[3:]).all()
    assert inference.STRETCH >= 70_000
    left, right, risk = np.array([1.0, 2.0, np.nan, 1.0, np.nan]), np.array([5.0, 4.0, 4.0, 5.0, 4.0]), np.array([0.5, 1.0, 0.0, 0.5, 0.0])
    kinds = inference.Kinds([risk, left, right], np.array([0, 1, 2, 2, 0]), np.array([1, 2, 1, 1, 1]))
    assert len(kinds.first) == 3  # rows 0 and 3, and rows 2 and 4, are alike
    g, s = inference.Ties(left[kinds.first], risk[kinds.first], np.arange(3)).sums(kinds.weights(np.array([1.0, 2.0, 3.0])))
    assert (g.tolist(), s.tolist()) == ([4, 4, 4], [4.0, 2.0, 0.0])


@pytest.mark.parametrize("clusters", [7, inference.DRAWS + 9, 2 * inference.LOW + 5])
@pytest.mark.parametrize("alike", [3, 1 << 30])
def test_draws_of_classes_are_those_of_clusters(clusters, alike):
    """Clusters whose records agree are one class, however many there are, and its draws give each kind the same weight."""
    cluster = np.r_[np.arange(clusters - 1), np.arange(0, clusters - 1, 2), np.full(inference.LONGEST + 1, 2)].astype(np.int32)  # the last has no record
    risk, copies = (cluster % alike).astype(float), 1 + cluster.astype(np.int64) % 2
    score = risk + (np.arange(len(cluster)) >= clusters - 1)
    plain, classed = (inference.Kinds([risk, score], cluster, copies) for _ in range(2))
    of, classes = classed.classed(clusters)
    assert of[clusters - 1] == 0 and len(of) == clusters
    assert (classes <= 9) if alike == 3 else (classes == clusters)
    reps = np.array([2, 5, 11])
    for weights, counts in zip(inference.drawn_weights(3, clusters, reps), inference.counted(3, clusters, reps, of, classes), strict=True):
        assert counts.sum() == clusters
        assert (plain.weights(weights.astype(float)) == classed.weights(counts.astype(float))).all()


@pytest.mark.parametrize("clusters", [inference.SORTED + 2 * inference.LOW + 5, inference.CACHED + 1])
def test_sorted_draws_are_those_of_the_hash(clusters):
    """Counts of draws that are sorted in pieces, with classes and without, against those of ``drawn``."""
    reps, of = np.array([4]), (np.arange(clusters) * 7 % 5000).astype(np.uint16)
    picks = np.concatenate([p[0] for _, p in inference.drawn(3, clusters, reps)])
    assert (next(inference.counted(3, clusters, reps)) == np.bincount(picks, minlength=clusters)).all()
    assert (next(inference.counted(3, clusters, reps, of, 5000)) == np.bincount(of[picks], minlength=5000)).all()


def test_bootstrap_packs_records_before_blocks(spark):
    """Records reach a task once for each stretch; blocks of replicates share what was worked out from them."""
    rows = scores(spark, [(i % 3, i % 2) for i in range(12)]).withColumn("other", F.col("id") % 5)
    plan = inference.bootstrap_differences(rows, ["cond"], "score", "other", "risk", "id", 3, F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(") < plan.rindex("FlatMapGroupsInArrow")


@pytest.mark.parametrize("stretch", [5, 1 << 16])
def test_bootstrap_areas_against_drawn_rows(spark, monkeypatch, stretch):
    """Areas by stretches and blocks are those of the rows drawn by ``cluster_weights``; ties, repeats and a null score."""
    monkeypatch.setattr(inference, "STRETCH", stretch)
    monkeypatch.setattr(inference, "BLOCK", 3)
    rng = np.random.default_rng(7)
    data = [(["u", "v"][i % 2], int(i % 9), float(rng.integers(0, 12)), float(rng.integers(0, 30)), float(rng.integers(0, 5)) / 4) for i in range(80)]
    rows = spark.createDataFrame([*data, data[0], ("u", 3, None, 2.0, 0.5)], "cond string, cluster int, a double, b double, risk double")
    got = inference.bootstrap_differences(rows, ["cond"], "a", "b", "risk", "cluster", 7, F.lit(11))
    drawn = rows.join(inference.cluster_weights(rows, ["cond"], "cluster", 7, F.lit(11)), ["cond", "cluster"]).collect()

    def area(cond, rep, side):
        each = [(-(getattr(r, side) if getattr(r, side) is not None else -1e9), r.risk) for r in drawn if (r.cond, r.rep) == (cond, rep) for _ in range(r.weight)]
        mean = {s: np.mean([k for t, k in each if t == s]) for s, _ in each}
        in_order = [mean[s] for s, _ in sorted(each)]  # the expected risk of a place within ties is their mean
        return np.mean(np.cumsum(in_order) / np.arange(1, len(each) + 1))

    got = got.collect()
    assert len(got) == 14
    for r in got:
        assert (r.left, r.right) == pytest.approx((area(r.cond, r.rep, "a"), area(r.cond, r.rep, "b")))


@pytest.mark.parametrize("radix", [2, 4, 16])
def test_kendall_against_all_pairs(spark, radix):
    rng = np.random.default_rng(radix)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(60) for j in range(i)]
    want = sum(a * b for a, b in s) / sqrt(sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s))
    assert agreement.kendall(scores(spark, zip(x, y)), ["cond"], "score", "risk", radix).first()["tau"] == pytest.approx(want)


def test_grouped_reliability(spark):
    rows = spark.createDataFrame([("c", i, p, o) for i, (p, o) in enumerate([(0.1, 0.0), (0.2, 0.4), (0.8, 0.6), (0.9, 1.0)])], "cond string, id int, p double, o double")
    r = summaries.grouped_reliability(rows, ["cond"], "p", "o", "id", 2).first()
    assert (r["bias"], r["mae"], r["rmse"], r["ece"]) == pytest.approx((0, 0.15, sqrt(0.025), 0.05))


def test_threshold_stability(spark):
    assert ensemble.threshold_iou_stability(image(spark, np.zeros((2, 2))), KEY).first()["stability"] == 1
    assert ensemble.threshold_iou_stability(image(spark, [[0.1, 0.3], [0.8, 0.9]]), KEY).first()["stability"] == pytest.approx(2 / 3)


def test_mean_map_needs_all_members(spark):
    a = image(spark, [[0.2, 0.4]]).withColumn("member", F.lit(0))
    with pytest.raises(Exception, match="differ"):
        ensemble.mean_map(a, KEY, 2).collect()


def test_strict_map_check(spark):
    px = image(spark, [[0.2, 1.4]])
    assert validate.check_maps(px, KEY).first()["outside"] == 1
    with pytest.raises(Exception, match="bad map"):
        validate.check_maps(px, KEY, strict=True).collect()


def test_maps_are_never_overwritten(spark, tmp_path):
    px = image(spark, [[0.25, 0.5]]).selectExpr("'d' AS dataset", "'c' AS condition", "s AS sample_id", "y", "x", "p", "truth")
    io.write_maps(px, str(tmp_path / "m"))
    assert sorted((r.x, r.p) for r in io.read_maps(spark, str(tmp_path / "m")).collect()) == [(0, 0.25), (1, 0.5)]
    with pytest.raises(Exception, match="exist"):
        io.write_maps(px, str(tmp_path / "m"))


def test_a_record_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"dataset": "d", "sample_id": "no number"}\n')
    with pytest.raises(Exception):
        io.read_records(spark, str(tmp_path)).collect()


def test_manifests_and_listing(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "manifest.json").write_text('{"dataset": "d",\n "condition": "c", "num_rows": 3}')
    r = io.read_manifests(spark, str(tmp_path)).first()
    assert (r["dataset"], r["num_rows"]) == ("d", 3) and r["file"].endswith("manifest.json")
    now = io.listing(spark, str(tmp_path))
    assert now.first()["sha256"] == hashlib.sha256((tmp_path / "a" / "b" / "manifest.json").read_bytes()).hexdigest()
    assert io.audit(now, now).count() == 0


def test_empty_bins_are_kept(spark):
    t = calibration.reliability_table(image(spark, [[0.0, 1.0]]).withColumn("cond", F.lit("c")), ["cond"], 4).orderBy("bin").collect()
    assert [r.n for r in t] == [1, 0, 0, 1] and t[1].mean_p is None


def test_row_order_and_partitions_do_not_matter(spark, sf):
    from maskrisk.sources.views import KEY as K
    from maskrisk.sources.views import pixels as read

    px = read(spark, sf)
    a = pixels.common_scores(px, K, patch=3).orderBy(*K).collect()
    b = pixels.common_scores(px.orderBy(F.rand(3)).repartition(7), K, patch=3).orderBy(*K).collect()
    assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_components_over_many_bands(spark):
    """A spiral and a comb of a thousand rows: one component each, and few rounds over the borders of bands."""
    n = 1000
    spiral, (y, x), (dy, dx), seen = np.zeros((n, 40), int), (0, 0), (0, 1), set()
    for turn in range(40):  # a path two pixels from itself, inward
        length = 0
        while 0 <= y + dy < n and 0 <= x + dx < 40 and (not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < 40) or not spiral[y + 2 * dy, x + 2 * dx]):
            spiral[y, x] = 1
            y, x, length = y + dy, x + dx, length + 1
        spiral[y, x] = 1
        dy, dx = dx, -dy
        if not length:
            break
    comb = np.zeros((n, 40), int)
    comb[:, ::2], comb[-1, :] = 1, 1
    rows = [(i, int(a), int(b), int(m[a, b])) for i, m in enumerate((spiral, comb)) for a in range(n) for b in range(40)]
    px = spark.createDataFrame(rows, "s int, y int, x int, m int")
    got = components.components(px, ["s"], "m", band_rows=64)
    found = {(r.s, r.m): r.n for r in got.groupBy("s", "m").agg(F.countDistinct("label").alias("n")).collect()}
    assert found[0, 1] == 1 and found[1, 1] == 1 and found[1, 0] == 20
    chain = spark.createDataFrame([(0, i, i + 1) for i in range(2000)], "s int, u long, v long")
    assert components.contracted(chain, ["s"]).agg(F.max("root")).first()[0] == 0


@pytest.mark.parametrize("shape", [(9, 7), (5, 90), (40, 3)])
def test_distances_against_all_pairs(spark, shape):
    rng = np.random.default_rng(sum(shape))
    p = rng.random(shape).round(2)
    p[-1, shape[1] // 2 :] = np.nan  # a last row that ends early
    rows = [(y, x, float(p[y, x])) for y in range(shape[0]) for x in range(shape[1]) if p[y, x] == p[y, x]]
    px = spark.createDataFrame([(0, *r) for r in rows], "s int, y int, x int, p double").withColumn("a", (F.col("p") >= 0.5).cast("int"))
    nodes = [0.1, 0.5, 0.9, 0.999]

    def edge(on):
        return {(y, x) for y, x in on if any((y + a, x + b) not in on for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}

    fixed = edge({(y, x) for y, x, v in rows if v >= 0.5})
    want = Counter()
    for k, t in enumerate(nodes):
        level = edge({(y, x) for y, x, v in rows if v >= t})
        for a, b in ((level, fixed), (fixed, level)):
            want.update((k, min((y - q) ** 2 + (x - r) ** 2 for q, r in b)) for y, x in a if b)
    assert {(r.k, r.d2): r.n for r in geometry.pooled_distances(px, ["s"], "p", "a", nodes).collect()} == dict(want)
    points = spark.createDataFrame([(0, y, x) for y, x in sorted(fixed)], "s int, y int, x int")
    other = spark.createDataFrame([(0, y, x) for y, x in sorted(edge({(y, x) for y, x, v in rows if v >= 0.9}))], "s int, y int, x int")
    got = {(r.y, r.x): r.d2 for r in geometry.nearest(points, other, ["s"]).collect()}
    assert got == {(y, x): min((y - q.y) ** 2 + (x - q.x) ** 2 for q in other.collect()) for y, x in fixed}


def test_places_over_many_ranges(spark):
    """One condition has most rows; places, bins and ties are those of windows over whole conditions."""
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else "cold", float(rng.integers(0, 40)), i) for i in range(3000)] + [("one", None, 1)]
    df = spark.createDataFrame(rows, "c string, v double, id int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ranks.equal_bins(ranks.places(df, ["c"], ["v", "id"]), ["c"], ["v", "id"], 7)
        w = W.partitionBy("c").orderBy("v", "id")
        want = df.withColumns({"place": F.row_number().over(w), "of": F.count("*").over(W.partitionBy("c")), "bin": F.ntile(7).over(w)})
        key = lambda x: sorted(x.select("c", "id", "place", "of", "bin").collect())
        assert key(got) == key(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cohort_digest_over_ranges(spark):
    rows = [("a", i) for i in np.random.default_rng(1).permutation(500).tolist()] + [("b", 7), ("b", None), ("c", None), (None, 3)]
    got = {r.c: (r.num_rows, r.sample_id_sha256) for r in io.cohort_digest(spark.createDataFrame(rows, "c string, id long").repartition(5), ["c"], "id").collect()}
    sha = lambda ids: hashlib.sha256("\n".join(map(str, ids)).encode()).hexdigest()
    assert got == {"a": (500, sha(range(500))), "b": (2, sha([7])), "c": (1, sha([])), None: (1, sha([3]))}
    assert io.cohort_digest(spark.createDataFrame([], "c string, id long"), ["c"], "id").count() == 0


@pytest.mark.parametrize("stretches", [2, 7, 64])
def test_quantiles_are_those_of_percentile(spark, stretches):
    """One condition with most rows, ties, nulls and NaN, and conditions of one row and of nulls alone."""
    rng = np.random.default_rng(8)
    v = [("big", float(x)) for x in np.round(rng.normal(size=3000), 2)] + [("big", 0.5)] * 2000 + [("big", float("nan"))] * 3 + [("big", None)] * 9
    v += [("few", float(x)) for x in (3, -1, 3, float("inf"))] + [("one", 7.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    rows = spark.createDataFrame(v, "c string, v double").repartition(5)
    wanted = {"q0": 0.0, "q10": 0.1, "q33": 1 / 3, "q50": 0.5, "q95": 0.95, "q999": 0.9999, "q100": 1.0}
    got = ranks.quantiles(rows, ["c"], F.col("v"), wanted, stretches)
    want = rows.groupBy("c").agg(*[F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()])
    assert got.columns == want.columns
    assert {str(tuple(r)) for r in got.collect()} == {str(tuple(r)) for r in want.collect()}  # bit for bit
    assert ranks.quantiles(rows.limit(0), ["c"], F.col("v"), wanted, stretches).count() == 0


def test_quantiles_keep_no_condition_in_one_task(spark):
    rows = spark.range(20_000).select(F.lit("c").alias("c"), F.col("id").cast("double").alias("v"))
    plan = ranks.quantiles(rows, ["c"], F.col("v"), {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line and "_v#" in line]
    assert windows and all("_stretch#" in line for line in windows)


def test_safety_ranks_share_ties(spark):
    s = [0.3, 0.1, None, 0.3, float("nan"), None, 0.9]
    rows = spark.createDataFrame([("c", i, x) for i, x in enumerate(s)] + [("one", 0, 5.0)], "c string, id int, s double")
    got = {(r.c, r.id): r["rank"] for r in summaries.safety_ranks(rows, ["c"], {"s": "rank"}).collect()}
    assert got == {("c", 2): 0.5 / 6, ("c", 5): 0.5 / 6, ("c", 1): 2 / 6, ("c", 0): 3.5 / 6, ("c", 3): 3.5 / 6, ("c", 6): 5 / 6, ("c", 4): 1.0, ("one", 0): 0.0}


def test_plain_area_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("big", i, float(np.round(rng.random(), 1)), float(rng.random())) for i in range(4000)]
    rows += [("big", 5000, None, 0.7), ("big", 5001, float("nan"), 0.2), ("big", 5002, 0.4, None), ("one", 1, 0.5, 0.25)]
    df = spark.createDataFrame(rows, "c string, id int, s double, x double").repartition(6)
    w = W.partitionBy("c").orderBy(F.desc("s"), "id").rowsBetween(W.unboundedPreceding, 0)
    want = {r.c: r.a for r in df.withColumn("m", F.avg("x").over(w)).groupBy("c").agg(F.avg("m").alias("a")).collect()}
    got = {r.c: r.aurc for r in selective.plain_aurc(df, ["c"], "s", "x", "id").collect()}
    assert got == pytest.approx(want)


def test_bootstrap_reads_its_records_once(spark):
    """Areas and replicates come from one written table, whatever the records cost; so do those of several stretches."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = scores(spark, [(i % 3, i % 2) for i in range(12)]).withColumn("other", F.col("id") % 5).withColumn("risk", counted("risk"))
    inference.contrast(rows, ["cond"], "score", "other", "risk", "id", resamples=3).collect()
    inference.percent_margin(rows, ["cond"], "score", "other", "risk", "id", resamples=3).collect()
    assert seen.value == 24


def test_a_single_stretch_asks_for_no_quantiles(spark):
    rows = scores(spark, [(i % 3, i % 2) for i in range(12)]).withColumn("other", F.col("id") % 5)
    plan = inference.bootstrap_differences(rows, ["cond"], "score", "other", "risk", "id", 3, F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and "CoGroup" not in plan


def test_large_files_are_hashed_by_ranges(spark, tmp_path):
    """Each byte of a file counts, in ranges that no setting of the session moves; files up to a range have their own SHA-256."""
    rng = np.random.default_rng(3)
    whole = 1000
    feeds = bytes(rng.integers(8, 14, 5000, dtype=np.uint8))  # \n, \r\n and \r among others
    some = {"a.bin": rng.bytes(40_000), "b+c %d.bin": feeds, "long.bin": b"x" * 2500 + b"\n" + b"y" * 1700, "edge.bin": (b"z" * 499 + b"\n") * 6, "mark.bin": b"\xef\xbb\xbf" + feeds, "small.bin": b"\r\n\n", "even.bin": b"q" * whole}
    some["tail.bin"] = some["edge.bin"][:-1] + b"z"
    some["packed.gz"] = gzip.compress(rng.bytes(3000))

    def want(name, data):
        if len(data) <= whole or name.endswith(".gz"):
            return hashlib.sha256(data).hexdigest()
        ranges, at = {}, 0
        for line in data.removeprefix(b"\xef\xbb\xbf").removesuffix(b"\n").split(b"\n"):
            place = at + 3 * data.startswith(b"\xef\xbb\xbf") if at else 0
            ranges.setdefault(max(0, -(-place // whole) - 1), []).append(line + b"\n")
            at += len(line) + 1
        each = [hashlib.sha256(b"".join(x)).hexdigest() for _, x in sorted(ranges.items())]
        return hashlib.sha256("\n".join([str(len(data)), *each]).encode()).hexdigest()

    for name, data in some.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        now = io.listing(spark, str(tmp_path), whole=whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["name"]: (r["size"], r["sha256"]) for r in now.collect()} == {n: (len(d), want(n, d)) for n, d in some.items()}
    (tmp_path / "a.bin").write_bytes(some["a.bin"][:-1] + bytes([some["a.bin"][-1] ^ 1]))
    assert [(r["name"], r["wrong"]) for r in io.audit(io.listing(spark, str(tmp_path), whole=whole), now).collect()] == [("a.bin", "changed")]


def test_member_scores_deal_the_pixels_once(spark):
    """The same as by mean map, Dice and distances apart; members are evaluated once, and missing ones are an error."""
    rng = np.random.default_rng(2)
    each = [image(spark, np.round(rng.random((4, 3)), 1)).withColumn("member", F.lit(j)).withColumn("truth", F.lit(1)).withColumnRenamed("s", "k") for j in range(3)]
    ens = each[0].unionByName(each[1]).unionByName(each[2])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(p):
        seen.add(1)
        return p

    got = ensemble.member_scores(ens.withColumn("p", counted("p")), ["k"], 3).collect()
    mean = ensemble.mean_map(ens, ["k"], 3)
    want = ensemble.member_dice(ens, mean, ["k"]).join(ensemble.member_distances(ens, mean, ["k"]), ["k"]).collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want] and seen.value == 36
    with pytest.raises(Exception, match="differ"):
        ensemble.member_scores(each[0].unionByName(each[1]), ["k"], 3).collect()
