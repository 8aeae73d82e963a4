"""Quality rules whose cutoffs carry an exact bound on the share of good documents that they reject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Whole percentages that a rule may reject from above.
RULES = ("symbol_pct", "dup_line_pct", "repeat_pct", "upper_pct", "bang_pct")
#: All rules together may reject this share of a stratum's good documents; the bounds of all strata hold at once with
#: probability 1 - DELTA.
ALPHA, DELTA = 0.01, 0.05


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` refers to it, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as an array: runs of characters other than ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that the text has twice or more, the first ones included."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def shared(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: (F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        return let(pairs, shared)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h))))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(count(w)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (the language), the base counts, the rules' percentages, and copy (equal for equal texts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    read = read.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = read.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count("text", F.lit("!")).alias("bang"),
        F.md5("text").alias("copy"),
    )

    def pct(part: Column | str, whole: Column | str) -> Column:
        part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
        return F.least(F.floor(F.lit(100) * part / F.greatest(whole, F.lit(1))), F.lit(100)).cast("int")

    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
        pct("n_symbols", "word_chars").alias("symbol_pct"),
        pct("lines.dup", "lines.n").alias("dup_line_pct"),
        pct("n_repeat_words", "n_words").alias("repeat_pct"),
        pct("upper", "word_chars").alias("upper_pct"),
        pct("bang", "n_words").alias("bang_pct"), "copy",
    )


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(at most ``k`` of ``n``) at chance ``share`` for each; summed exactly from its terms' logarithms."""
    from math import log

    start = F.struct((n * F.lit(log(1 - share))).cast("double").alias("t"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        after = a["t"] + F.log((n - i) / (i + 1.0)) + F.lit(log(share / (1 - share)))
        return F.struct(F.when(i < n, after).otherwise(a["t"]).alias("t"), (a["sum"] + F.exp(a["t"])).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda a: a["sum"])


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column of each rule): the percentage from which the rule rejects, or null where it never does.

    Labelled texts of a stratum are halved by a hash, copies of a text counting once. On the first half each rule
    takes the percentage from which it rejects most bad texts less good ones (the laxest of equals; none if that is not
    above 0, or where it rejects more than ``alpha`` of the good ones), and rules are ordered by that gain. On the second
    half they are certified in this order: the exact binomial bound must say that the rules so far together reject less
    than ``alpha`` of the stratum's good documents, at ``delta`` divided by the number of strata. The first rule that
    fails ends the sequence, so a fixed order needs no further correction, and what is promised holds for all rules of
    a stratum jointly. Near copies count as texts of their own. A text with labels of both kinds has the larger one.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = feats.join(known, "doc_id").groupBy("stratum", "copy").agg(F.max("quality").alias("quality"), *[F.first(r).alias(r) for r in RULES])
    seen = seen.select("stratum", "copy", (F.col("quality") == 1).alias("good"), (F.substr("copy", F.lit(1), F.lit(1)) < "8").alias("chooses"), *RULES)
    seen = written(seen, "labelled")
    long = seen.where("chooses").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("m")) for r in RULES])).alias("x"))
    by_value = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.m").alias("m")).agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad")
    )  # at most 101 rows for each stratum and rule
    w = W.partitionBy("stratum", "rule")
    down = w.orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, 0)
    tried = by_value.select("stratum", "rule", "m", F.sum("good").over(w).alias("n"), F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("g"))
    useful = tried.where((F.col("g") > F.col("k")) & (F.col("k") <= F.col("n") * alpha))
    best = useful.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("g") - F.col("k")).alias("gain"), F.col("m").alias("m"))).alias("b"))
    order = W.partitionBy("stratum").orderBy(F.desc("b.gain"), "rule")
    chosen = best.select("stratum", "rule", F.col("b.m").alias("m"), F.row_number().over(order).alias("place"))  # a row for each stratum and rule
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.struct("m", "place"))).alias(f"_{r}") for r in RULES])
    first = F.least(*[F.when(F.col(r) >= F.col(f"_{r}.m"), F.col(f"_{r}.place")).otherwise(len(RULES) + 1) for r in RULES])
    alike = seen.where("good and not chooses").groupBy("stratum", *RULES).agg(F.count("*").alias("c"))  # before the join, as one stratum may have most rows
    met = alike.join(wide, "stratum").select("stratum", first.alias("place"), "c")
    lost = met.groupBy("stratum").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col("place") <= i, F.col("c")).otherwise(0)).alias(f"k{i}") for i in range(1, len(RULES) + 1)])
    tests = seen.agg(F.count_distinct("stratum").alias("tests"))  # one row

    def bound(k: Column) -> Column:
        return F.when(k <= F.col("n") * alpha, binomial_tail(k, F.col("n"), alpha)).otherwise(F.lit(1.0)) <= F.lit(delta) / F.greatest("tests", F.lit(1))

    depth = F.lit(0)
    for i in range(1, len(RULES) + 1):  # what is rejected grows with the place, so the bounds fail from some place on
        depth = depth + bound(F.col(f"k{i}")).cast("int")
    certified = lost.join(F.broadcast(tests)).select("stratum", depth.alias("depth"))
    cut = [F.when(F.col(f"_{r}.place") <= F.col("depth"), F.col(f"_{r}.m")).alias(r) for r in RULES]
    return wide.join(certified, "stratum").select("stratum", *cut)


def judge_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of ``docs``.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: neither that nor rejected
    by a rule at the cutoff of the document's stratum. Null and empty texts have no words and fail; a null language is
    a stratum of its own; strata with too few labels for the bound get no cutoffs, so nothing but the base rejects
    there; repeated rows are judged each.
    """
    feats = written(features(docs), "features")
    cuts = written(cutoffs(feats, labels, alpha, delta), "cutoffs")  # a row for each stratum with enough labels
    cuts = cuts.select("stratum", *[F.col(r).alias(f"_{r}") for r in RULES])
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col(f"_{r}"), F.lit(False))
    return feats.join(cuts, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~hit).alias("kept"))
