"""Classifier evaluation (ML3-8, ML10-13, TOP2, AGG16, JOI5-6).

Everything starts from a ``groupBy`` (per (label, prediction) cell or per
distinct score), so the rows that feed the finishing steps are already
aggregated. Exact ROC / PR curves use a distributed running sum over the
distinct scores (range partitions plus per-partition offsets), not a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statfold.operators.position import _partitions, _ranged, running_sum, with_position


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def cutoff(prob: Column | str, cut: float = 0.5) -> Column:
    """ML3: class 1 when the probability is strictly above ``cut``."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p > F.lit(cut)).cast("int")


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """ML5: long confusion matrix over every (true, predicted) class pair, with zeros and row shares.

    The class spine (k x k cells) is built from the collected class list of
    a one-row aggregate; k is the number of classes, not the data size.
    """
    cells = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.agg(F.array_sort(F.array_distinct(F.concat(F.collect_set(label), F.collect_set(pred))))
                        .alias("_k"))
    spine = classes.select(F.explode("_k").alias("label"), "_k").select("label", F.explode("_k").alias("pred"))
    full = (spine.join(cells.withColumnRenamed(label, "label").withColumnRenamed(pred, "pred"), ["label", "pred"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))
    rows = full.groupBy("label").agg(F.sum("n").alias("_row"))
    return (full.join(rows, "label")
            .withColumn("row_share", F.when(F.col("_row") > 0, F.col("n") / F.col("_row")).otherwise(F.lit(0.0)))
            .drop("_row"))


def per_class(conf: DataFrame) -> DataFrame:
    """Per-class tp, predicted, support, precision, recall, f1 (zero division -> 0)."""
    c = conf
    agg = c.groupBy(F.col("label").alias("cls")).agg(
        F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pred = c.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = agg.join(pred, "cls", "full").fillna(0, ["tp", "support", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """ML6: per class plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    pc = per_class(confusion(df, label, pred))
    classes = pc.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    tot = pc.agg(F.sum("tp").alias("tp"), F.sum("support").alias("s"), F.avg("precision").alias("mp"),
                 F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("s")).alias("f1"),
                 F.col("s").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("s").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("s").cast("long").alias("support")))).alias("r")
    ).select("r.*")
    return classes.unionByName(summary)


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """ML7."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def averaged_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """ML8: macro and micro precision / recall / F1, with both macro-F1 definitions.

    ``macro_f1_of_means`` = harmonic mean of macro precision and macro recall;
    ``macro_f1_mean`` = mean of the per-class F1 values.
    """
    pc = per_class(confusion(df, label, pred))
    a = pc.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
               F.avg("f1").alias("macro_f1_mean"), F.sum("tp").alias("_tp"), F.sum("support").alias("_s"),
               F.sum("predicted").alias("_p"))
    hm = F.when(F.col("macro_precision") + F.col("macro_recall") > 0,
                2 * F.col("macro_precision") * F.col("macro_recall") / (F.col("macro_precision") + F.col("macro_recall"))
                ).otherwise(F.lit(0.0))
    micro_p = F.col("_tp") / F.col("_p")
    micro_r = F.col("_tp") / F.col("_s")
    return a.select("macro_precision", "macro_recall", hm.alias("macro_f1_of_means"), "macro_f1_mean",
                    micro_p.alias("micro_precision"), micro_r.alias("micro_recall"),
                    (2 * micro_p * micro_r / (micro_p + micro_r)).alias("micro_f1"))


def matthews(df: DataFrame, label: str, pred: str) -> DataFrame:
    """ML12: multi-class Matthews correlation from the confusion margins."""
    pc = per_class(confusion(df, label, pred))
    a = pc.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"),
               F.sum(F.col("predicted") * F.col("support")).alias("pt"),
               F.sum(F.col("predicted") * F.col("predicted")).alias("pp"),
               F.sum(F.col("support") * F.col("support")).alias("tt"))
    num = F.col("c") * F.col("s") - F.col("pt")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")).cast("double")) * F.sqrt(
        (F.col("s") * F.col("s") - F.col("tt")).cast("double"))
    return a.select(F.when(den > 0, num / den).otherwise(F.lit(0.0)).alias("mcc"))


def _score_table(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == F.lit(positive)).cast("long")).alias("pos"),
        F.sum((F.col(label) != F.lit(positive)).cast("long")).alias("neg"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """ML10: every distinct score as a threshold (descending) with fpr / tpr, plus the (0, 0) start."""
    t = _score_table(df, label, score, positive)
    t = running_sum(t, [F.col("score").desc()], ["pos", "neg"], ["tp", "fp"])
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = _one(t).join(F.broadcast(_one(tot)), "_one")
    pts = j.select(F.col("score").alias("threshold"), F.try_divide(F.col("fp"), F.col("N")).alias("fpr"),
                   F.try_divide(F.col("tp"), F.col("P")).alias("tpr"), F.col("tp").cast("long").alias("tp"),
                   F.col("fp").cast("long").alias("fp"))
    start = tot.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                       F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    return start.unionByName(pts)


def _rank_sums(batches):
    """mapInArrow body: the rank sum of the positives of one sorted range partition, counted from its start."""
    import pyarrow as pa
    from pyspark import TaskContext
    done = positives = 0
    ranks = 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        pos, neg = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        both = pos + neg
        first = done + np.cumsum(both) - both
        ranks += float(np.sum(pos * (first + (both + 1) / 2.0)))
        done += int(both.sum())
        positives += int(pos.sum())
    if done:
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ranks]),
            pa.array([positives], pa.int64()), pa.array([done - positives], pa.int64())], names=["_pid", "rs", "P", "N"])


def auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """ML10: exact AUC = Mann-Whitney U with average ranks for ties (equals the ROC trapezoid).

    The distinct scores are range-partitioned and sorted once; each partition returns the rank sum of its positives and
    its counts (one row per partition), and the rows of earlier partitions are added from that small table.
    """
    t = _score_table(df, label, score, positive).fillna(0, ["pos", "neg"])
    keys = [F.col("score")]
    parts = _ranged(t, keys, _partitions(t, None), False).select("pos", "neg").mapInArrow(
        _rank_sums, "_pid int, rs double, P long, N long")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifted = parts.withColumn("_off", F.coalesce(F.sum(F.col("P") + F.col("N")).over(before), F.lit(0)))
    a = shifted.agg(F.sum(F.col("rs") + F.col("P") * F.col("_off").cast("double")).alias("rs"), F.sum("P").alias("P"),
                    F.sum("N").alias("N"))
    u = F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0
    # one-class input has no AUC: null rather than a division error
    return a.select(F.try_divide(u, F.col("P") * F.col("N")).alias("auc"), F.col("P").alias("n_pos"),
                    F.col("N").alias("n_neg"))


def pr_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """ML11: precision / recall at each distinct threshold plus the (recall 0, precision 1) end point."""
    roc = roc_curve(df, label, score, positive).where(F.col("threshold") != float("inf"))
    tot = roc.agg(F.max("tp").alias("P"))
    j = _one(roc).join(F.broadcast(_one(tot)), "_one")
    pts = j.select("threshold", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                   F.try_divide(F.col("tp"), F.col("P")).alias("recall"))
    end = tot.select(F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _segment_areas(x: str, y: str):
    """mapInPandas body: trapezoids between consecutive points of one sorted range partition,
    plus the partition's first and last point (state kept across batches)."""
    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        area, n, first, last = 0.0, 0, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            xs, ys = pdf[x].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
            if last is not None:
                xs, ys = np.concatenate([[last[0]], xs]), np.concatenate([[last[1]], ys])
            elif first is None:
                first = (xs[0], ys[0])
            area += float(np.sum((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2))
            last = (xs[-1], ys[-1])
            n += len(pdf)
        if n:
            yield pd.DataFrame({"_pid": [pid], "_area": [area], "_fx": [first[0]], "_fy": [first[1]],
                                "_lx": [last[0]], "_ly": [last[1]]})
    return run


def curve_area(points: DataFrame, x: str, y: str, order_by=None) -> DataFrame:
    """Trapezoid area under a curve (``metrics.auc``) with points taken in ``order_by``
    (default: threshold descending, the order the curve is traced in).

    Points are range-partitioned and sorted once; each sorted partition
    returns its own trapezoid sum with its first and last point (one row per
    partition), and the seams between neighbouring partitions are added from
    that small table. ``order_by`` must be a total order.
    """
    order = order_by if order_by is not None else [F.col("threshold").desc()]
    keys = [F.col(c) if isinstance(c, str) else c for c in (order if isinstance(order, list) else [order])]
    ranged = _ranged(points, keys, _partitions(points, None), False)
    parts = ranged.select(x, y).mapInPandas(
        _segment_areas(x, y), "_pid int, _area double, _fx double, _fy double, _lx double, _ly double")
    prev = Window.orderBy("_pid")
    seams = parts.select("_area", "_fx", "_fy", F.lag("_lx").over(prev).alias("_px"), F.lag("_ly").over(prev).alias("_py"))
    seam = F.coalesce((F.col("_fx") - F.col("_px")) * (F.col("_fy") + F.col("_py")) / 2, F.lit(0.0))
    return seams.agg(F.coalesce(F.sum(F.col("_area") + seam), F.lit(0.0)).alias("area"))


def compare_distributions(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """ML13 / JOI2: class counts of two tables side by side, missing classes as 0."""
    ca = a.groupBy(label).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(label).agg(F.count(F.lit(1)).alias("n_b"))
    return ca.join(cb, label, "full").fillna(0, ["n_a", "n_b"])


def topk_accuracy(df: DataFrame, label: str, probs: str, ks: Sequence[int] = range(1, 8)) -> DataFrame:
    """TOP2: share of rows whose true class is among the k most probable (k = 1 is "Top 0" in the reference).

    Rank of the true class = 1 + #(p > p_true) + #(p == p_true at a higher index),
    which reproduces the tie order of ``np.argsort``.
    """
    p_true = F.element_at(F.col(probs), F.col(label) + 1)
    idx = F.sequence(F.lit(0), F.size(probs) - 1)
    above = F.size(F.filter(F.arrays_zip(F.col(probs).alias("p"), idx.alias("i")),
                            lambda z: (z["p"] > p_true) | ((z["p"] == p_true) & (z["i"] > F.col(label)))))
    ranked = df.withColumn("_rank", above + 1)
    return ranked.agg(*[F.avg((F.col("_rank") <= k).cast("double")).alias(f"top{k}") for k in ks])


def batch_accuracy(df: DataFrame, label: str, pred: str, order_by: str, batch_size: int) -> DataFrame:
    """AGG16: mean of per-batch accuracies (sequential batches) next to the overall accuracy."""
    pos = with_position(df.select(order_by, label, pred), [order_by], "_p")
    b = pos.withColumn("_b", F.floor((F.col("_p") - 1) / batch_size))
    per = b.groupBy("_b").agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"),
                             F.sum((F.col(label) == F.col(pred)).cast("long")).alias("hit"),
                             F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("acc").alias("mean_batch_accuracy"), (F.sum("hit") / F.sum("n")).alias("overall_accuracy"),
                   F.count(F.lit(1)).alias("batches"))


def align_predictions(truth: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """JOI5: real and predicted labels in one row through an equi-join on the id."""
    return truth.join(preds, key, "inner")


def append_batches(parts: Sequence[DataFrame]) -> DataFrame:
    """JOI6: union of per-batch result tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
