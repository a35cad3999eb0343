"""Agreement metrics (X1-X23, A1-A14): labels, contingency tables, frames, scores, speech detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.functions.scalars import safe_divide
from voxloom.operators.ordered import bucket_of, carried, exact_quantiles


def contingency(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Counts of each (y, p) pair, by keys: y, p, n. Everything else here works on this small table. Pairs with a null are left out."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(keys or []), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_report(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """True positives, support, predicted, precision, recall, F1 of each label that occurs on either side; 0 for 0/0."""
    k = keys or []
    sides = table.select(*k, F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"))
    sides = sides.unionByName(table.select(*k, F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))
    got = sides.groupBy(*k, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p, r = safe_divide(F.col("tp"), F.col("predicted")), safe_divide(F.col("tp"), F.col("support"))
    return got.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def accuracy_macro(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, accuracy, and precision, recall, F1 as macro and support-weighted means, by keys."""
    rep = class_report(table, keys)
    total = F.sum("support")
    return rep.groupBy(*(keys or [])).agg(
        total.alias("n"), F.round(F.sum("tp") / total, 6).alias("accuracy"), *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[F.round(F.sum(F.col(c) * F.col("support")) / total, 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def confusion(table: DataFrame) -> DataFrame:
    """The confusion matrix in long form with its totals (null label = total)."""
    return table.groupBy("y", "p").agg(F.sum("n").alias("n")).cube("y", "p").agg(F.sum("n").alias("n"))


def accuracy_by_file(df: DataFrame, file: str, y: str, p: str) -> DataFrame:
    """Rows and accuracy of each file and overall (null file), in one rollup."""
    hit = F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)
    got = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(file).isNotNull())
    return got.rollup(file).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def distribution_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, min, quartiles (linear interpolation), max; nulls and NaN don't count."""
    x, k = F.col(value).cast("double"), keys or []
    rows = checkpoint(df.where(x.isNotNull() & ~F.isnan(x)).select(*k, x.alias("__x")))
    q = exact_quantiles(rows, k, "__x", [0.25, 0.5, 0.75]).select(*[F.col(c).alias(f"__q{i}") for i, c in enumerate(k)], "q")
    got = rows.groupBy(*k).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("std"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    same = F.lit(True)
    for i, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"__q{i}"))
    both = got.join(q, same) if k else got.join(F.broadcast(q), F.lit(True), "left")  # one row each without keys
    return both.select(*k, "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def label_entropy(df: DataFrame, label: str, keys: list[str] | None = None, base: float | None = None) -> DataFrame:
    """Shannon entropy of the labels (natural, or to `base`) and its share of the maximum, by keys; nulls don't count."""
    k = keys or []
    n = df.where(F.col(label).isNotNull()).groupBy(*k, label).agg(F.count("*").alias("n"))
    # entropy = ln N - sum(n ln n) / N, so one aggregation does
    got = n.groupBy(*k).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_labels"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    h = F.ln("n_rows") - F.col("s") / F.col("n_rows")
    scale = F.ln(F.lit(float(base))) if base else F.lit(1.0)
    return got.select(*k, "n_rows", "n_labels", F.round(h / scale, 6).alias("entropy"), F.round(F.when(F.col("n_labels") > 1, h / F.ln("n_labels")).otherwise(0.0), 6).alias("normalized"))


def majority(table: DataFrame, of: str = "p", by: str = "y", keys: list[str] | None = None) -> DataFrame:
    """The `by` label most frequent with each `of` label (ties: smaller), as column `major`."""
    k = keys or []
    return table.groupBy(*k, of).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(by).alias("v")))["v"].alias("major"))


def purity(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of rows that carry the most frequent truth of their cluster."""
    k = keys or []
    best = table.groupBy(*k, "p").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.groupBy(*k).agg(F.sum("n").alias("n"), F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))


def bcubed(table: DataFrame, cluster_size: DataFrame | None = None, truth_size: DataFrame | None = None) -> DataFrame:
    """B-cubed precision and recall as count-weighted sums over the contingency table.

    Cluster and truth sizes may be given (p, size / y, size) where they also count rows without a partner.
    """
    cs = cluster_size if cluster_size is not None else table.groupBy("p").agg(F.sum("n").alias("size"))
    ts = truth_size if truth_size is not None else table.groupBy("y").agg(F.sum("n").alias("size"))
    both = table.join(cs.withColumnRenamed("size", "c"), "p").join(ts.withColumnRenamed("size", "t"), "y")
    sq = F.col("n").cast("double") * F.col("n")
    return both.agg(F.sum("n").alias("n"), F.round(F.sum(sq / F.col("c")) / F.sum("n"), 6).alias("b3_precision"), F.round(F.sum(sq / F.col("t")) / F.sum("n"), 6).alias("b3_recall"))


def pair_scores(table: DataFrame) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic) and Fowlkes-Mallows, in closed form from the counts."""
    side = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("m")).select(F.lit(name).alias("of"), "m")
    counts = table.groupBy("y", "p").agg(F.sum("n").alias("m")).select(F.lit("cell").alias("of"), "m").union(side("y", "y")).union(side("p", "p"))
    m = F.col("m").cast("double")
    part = lambda name, x: F.sum(F.when(F.col("of") == name, x))
    pairs, nln = m * (m - 1) / 2, m * F.ln(m)
    one = counts.agg(*[part(s, pairs).alias(f"c_{s}") for s in ("cell", "y", "p")], *[part(s, nln).alias(f"l_{s}") for s in ("cell", "y", "p")], part("cell", F.col("m")).alias("n"))
    n = F.col("n").cast("double")
    expect = F.col("c_y") * F.col("c_p") / (n * (n - 1) / 2)
    top = (F.col("c_y") + F.col("c_p")) / 2
    hy, hp, hj = (F.ln(n) - F.col(c) / n for c in ("l_y", "l_p", "l_cell"))
    return one.where("n > 1").select(
        "n", F.round(F.when(top == expect, 1.0).otherwise((F.col("c_cell") - expect) / (top - expect)), 6).alias("ari"),
        F.round(F.when(hy + hp == 0, 1.0).otherwise((hy + hp - hj) / ((hy + hp) / 2)), 6).alias("nmi"),
        F.round(F.when(F.col("c_y") * F.col("c_p") == 0, 0.0).otherwise(F.col("c_cell") / F.sqrt(F.col("c_y") * F.col("c_p"))), 6).alias("fmi"),
    )


def speaker_report(table: DataFrame) -> DataFrame:
    """Of each truth its primary cluster (ties: smaller), precision, recall and F1 with respect to it, and its rows."""
    primary = majority(table, of="y", by="p").withColumnRenamed("major", "primary_p")
    cells = table.groupBy("y", "p").agg(F.sum("n").alias("tp"))
    rows, cols = table.groupBy("y").agg(F.sum("n").alias("total")), table.groupBy("p").agg(F.sum("n").alias("ptotal"))
    got = primary.join(cells, (primary.y == cells.y) & (primary.primary_p == cells.p)).select(primary.y, "primary_p", "tp").join(rows, "y").join(cols, F.col("primary_p") == cols.p)
    p, r = F.col("tp") / F.col("ptotal"), F.col("tp") / F.col("total")
    return got.select("y", "primary_p", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"), "total")


def frame_report(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Frame precision, recall and error with each cluster read as its majority truth, by key.

    `truth`, `pred`: keys, frame, label. A cluster without a common frame has no majority.
    """
    both = truth.select(*keys, "frame", F.col("label").alias("y")).join(pred.select(*keys, "frame", F.col("label").alias("p")), [*keys, "frame"], "full")
    table = both.groupBy(*keys, "y", "p").agg(F.count("*").alias("n"))
    major = majority(table.where("y is not null and p is not null"), keys=keys)
    got = table.join(major, [*keys, "p"], "left")
    hit = F.sum(F.when(F.col("major") == F.col("y"), F.col("n")).otherwise(0))
    gt, pr = F.sum(F.when(F.col("y").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0))
    rep = got.groupBy(*keys).agg(gt.alias("gt_frames"), pr.alias("pred_frames"), hit.alias("hits"))
    return rep.select("*", F.round(safe_divide(F.col("hits"), F.col("pred_frames")), 6).alias("precision"), F.round(safe_divide(F.col("hits"), F.col("gt_frames")), 6).alias("recall"), F.round(safe_divide(F.col("gt_frames") - F.col("hits"), F.col("gt_frames")), 6).alias("der"))


def frame_speakers(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Frames, precision, recall and error of each true speaker of each key under the majority reading."""
    t, q = truth.select(*keys, "frame", F.col("label").alias("y")), pred.select(*keys, "frame", F.col("label").alias("p"))
    table = t.join(q, [*keys, "frame"]).groupBy(*keys, "y", "p").agg(F.count("*").alias("n"))
    major = majority(table, keys=keys)
    tp = table.join(major, [*keys, "p"]).where("major = y").groupBy(*keys, "y").agg(F.sum("n").alias("tp"))
    claimed = q.groupBy(*keys, "p").agg(F.count("*").alias("n")).join(major, [*keys, "p"]).groupBy(*keys, F.col("major").alias("y")).agg(F.sum("n").alias("claimed"))
    got = t.groupBy(*keys, "y").agg(F.count("*").alias("frames")).join(tp, [*keys, "y"], "left").join(claimed, [*keys, "y"], "left").na.fill(0, ["tp", "claimed"])
    return got.select(*keys, "y", "frames", F.round(safe_divide(F.col("tp"), F.col("claimed")), 6).alias("precision"), F.round(F.col("tp") / F.col("frames"), 6).alias("recall"), F.round((F.col("frames") - F.col("tp")) / F.col("frames"), 6).alias("der"))


def purity_coverage(table: DataFrame, cluster_ms: DataFrame, speaker_ms: DataFrame, keys: list[str]) -> DataFrame:
    """Duration-weighted cluster purity, speaker coverage and their F1 by key.

    `table`: keys, y, p, n = common milliseconds; `cluster_ms`: keys, p, ms; `speaker_ms`: keys, y, ms.
    """
    best = table.groupBy(*keys, "p").agg(F.max("n").alias("m"))
    clusters = cluster_ms.join(best, [*keys, "p"], "left").groupBy(*keys).agg((F.sum(F.coalesce("m", F.lit(0))) / F.sum("ms")).alias("purity"))
    cover = table.groupBy(*keys, "y").agg(F.sum("n").alias("m"))
    speakers = speaker_ms.join(cover, [*keys, "y"], "left").groupBy(*keys).agg((F.sum(F.coalesce("m", F.lit(0))) / F.sum("ms")).alias("coverage"))
    f1 = F.when(F.col("purity") + F.col("coverage") > 0, 2 * F.col("purity") * F.col("coverage") / (F.col("purity") + F.col("coverage"))).otherwise(0.0)
    return clusters.join(speakers, keys).select(*keys, F.round("purity", 6).alias("purity"), F.round("coverage", 6).alias("coverage"), F.round(f1, 6).alias("f1"))


def equal_error_rate(df: DataFrame, score: str, label: str, scale: int = 10_000) -> DataFrame:
    """X11: equal error rate, its threshold, and the smallest detection costs at priors 0.01 and 0.001.

    `label` is 1 for target trials, 0 else. Scores are read to 1 / `scale`, so the curve has a bounded number
    of points and is accumulated on counts, not rows. The threshold accepts scores at or above it.
    """
    s = F.round(F.col(score) * scale).cast("bigint")
    pts = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isin(0, 1)).groupBy(s.alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    w = Window.partitionBy().orderBy(F.desc("s"))
    tot = Window.partitionBy()
    curve = pts.select("s", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(tot).alias("np"), F.sum("neg").over(tot).alias("nn")).where("np > 0 and nn > 0")
    fpr, fnr = F.col("fp") / F.col("nn"), 1 - F.col("tp") / F.col("np")
    curve = curve.select("s", fpr.alias("fpr"), fnr.alias("fnr"))
    return curve.agg(
        F.min(F.struct(F.round(F.abs(F.col("fnr") - F.col("fpr")), 9).alias("d"), (-F.col("s")).alias("neg"), F.round("fpr", 6).alias("fpr"))).alias("e"),
        F.round(F.min(100 * (0.01 * F.col("fnr") + 0.99 * F.col("fpr"))), 6).alias("dcf01"), F.round(F.min(1000 * (0.001 * F.col("fnr") + 0.999 * F.col("fpr"))), 6).alias("dcf001"),
    ).select(F.col("e.fpr").alias("eer"), F.round(-F.col("e.neg") / scale, 6).alias("threshold"), "dcf01", "dcf001")


def speech_detection(gt: DataFrame, pred: DataFrame, keys: list[str], durations: DataFrame | None = None) -> DataFrame:
    """Detection quality by interval coverage: covered milliseconds of truth, hypothesis and both, miss, false alarm,
    precision, recall, error rate (miss and false alarm over truth; null without truth).

    Speech is the union of the intervals (start_ms, end_ms) whoever speaks. One sweep counts both sides: events of one
    instant are added up, the running counts tell for each stretch whether either side is active. With `durations`
    (keys, duration_ms) intervals are cut to [0, duration] and accuracy (right stretches of speech and silence over the
    duration; null if unknown) is added.
    """

    def side(df: DataFrame, g: int, p: int) -> DataFrame:
        rows = df.select(*keys, "start_ms", "end_ms")
        if durations is not None:
            rows = rows.join(durations.select(*keys, "duration_ms"), keys, "left").select(*keys, F.greatest("start_ms", F.lit(0)).alias("start_ms"), F.least("end_ms", F.coalesce("duration_ms", "end_ms")).alias("end_ms"))
        rows = rows.where("end_ms > start_ms").dropna(subset=keys)
        at = lambda c, s: F.struct(F.col(c).alias("t"), F.lit(s * g).alias("g"), F.lit(s * p).alias("p"))
        return rows.select(*keys, F.explode(F.array(at("start_ms", 1), at("end_ms", -1))).alias("v"))

    events = side(gt, 1, 0).unionByName(side(pred, 0, 1)).groupBy(*keys, F.col("v.t").alias("t")).agg(F.sum("v.g").alias("g"), F.sum("v.p").alias("p")).withColumn("b", bucket_of(F.col("t")))
    run = carried(checkpoint(events), keys, "b", ["t"], {"in_g": ("sum", F.col("g")), "in_p": ("sum", F.col("p")), "next": ("lead", F.col("t"))})
    spent = lambda when: F.coalesce(F.sum(F.when(when, F.col("next") - F.col("t"))), F.lit(0).cast("bigint"))
    g, p = F.col("in_g") > 0, F.col("in_p") > 0
    got = run.groupBy(*keys).agg(spent(g).alias("gt_ms"), spent(p).alias("pred_ms"), spent(g & p).alias("both_ms"))
    miss, false = F.col("gt_ms") - F.col("both_ms"), F.col("pred_ms") - F.col("both_ms")
    got = got.select("*", miss.alias("miss_ms"), false.alias("false_alarm_ms"), F.round(safe_divide(F.col("both_ms"), F.col("pred_ms")), 6).alias("precision"), F.round(safe_divide(F.col("both_ms"), F.col("gt_ms")), 6).alias("recall"))
    if durations is None:
        return got
    whole = got.join(durations.select(*keys, "duration_ms"), keys, "left")
    right = F.col("duration_ms") - F.col("miss_ms") - F.col("false_alarm_ms")
    return whole.select("*", F.round(F.when(F.col("gt_ms") > 0, (F.col("miss_ms") + F.col("false_alarm_ms")) / F.col("gt_ms")), 6).alias("error_rate"), F.round(F.when(F.col("duration_ms") > 0, right / F.col("duration_ms")), 6).alias("accuracy"))


def file_report(df: DataFrame, file: str, y: str, p: str) -> DataFrame:
    """What `accuracy_macro` says of each file and overall (null file), from one table of counts."""
    table = checkpoint(contingency(df.where(F.col(file).isNotNull()), y, p, [file]))
    whole = table.groupBy("y", "p").agg(F.sum("n").alias("n"))
    return accuracy_macro(table, [file]).unionByName(accuracy_macro(whole).withColumn(file, F.lit(None).cast(dict(df.dtypes)[file])))


def label_entropies(df: DataFrame, labels: dict[str, str], keys: list[str], base: float | None = None) -> DataFrame:
    """Entropy and its share of the maximum of several label columns side by side: `labels` maps a name to a column."""
    got = None
    for name, column in labels.items():
        one = label_entropy(df, column, keys, base).select(*keys, F.col("entropy").alias(f"{name}_entropy"), F.col("normalized").alias(f"{name}_normalized"))
        got = one if got is None else got.join(one, keys, "full")
    return got


def episode_accuracy(df: DataFrame, episode: str, right: Column) -> DataFrame:
    """Accuracy of each episode, then mean, deviation (sample) and half width of the 95 % interval over the episodes."""
    each = df.where(F.col(episode).isNotNull() & right.isNotNull()).groupBy(episode).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("a"))
    n = F.count("*")
    return each.agg(n.alias("n_episodes"), F.round(F.avg("a"), 6).alias("accuracy"), F.round(F.stddev("a"), 6).alias("std"), F.round(1.96 * F.stddev("a") / F.sqrt(n), 6).alias("ci95"))


def threshold_split(df: DataFrame, prob: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """the rows at or above a threshold and those below it, each with the confidence of that decision (p or 1 - p); rows
    without a score are in neither."""
    p = F.col(prob).cast("double")
    rows = df.where(p.isNotNull() & ~F.isnan(p))
    return rows.where(p >= threshold).withColumn("confidence", p), rows.where(p < threshold).withColumn("confidence", 1 - p)


def detector_report(df: DataFrame, prob: str, truth: Column, threshold: float = 0.5) -> DataFrame:
    """Outcome counts of a binary detector at a threshold with mean confidence p or 1 - p of each outcome; null scores drop out."""
    p = F.col(prob).cast("double")
    hit = p >= threshold
    outcome = F.when(hit & truth, "TP").when(hit, "FP").when(truth, "FN").otherwise("TN")
    rows = df.where(p.isNotNull() & ~F.isnan(p) & truth.isNotNull())
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, p).otherwise(1 - p)), 6).alias("confidence"))


def speaker_totals(df: DataFrame, label: str, right: Column) -> DataFrame:
    """Rows, right ones and their ratio for each label, by a full join of the two counts."""
    all_ = df.where(F.col(label).isNotNull())
    good = all_.where(right).groupBy(label).agg(F.count("*").alias("n_right"))
    bad = all_.where(~right).groupBy(label).agg(F.count("*").alias("n_wrong"))
    both = good.join(bad, label, "full").na.fill(0, ["n_right", "n_wrong"])
    return both.select(label, "n_right", "n_wrong", F.round(F.col("n_right") / (F.col("n_right") + F.col("n_wrong")), 6).alias("ratio"))
