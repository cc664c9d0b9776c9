"""Model evaluation and lifecycle rules as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.numbering import numbered, running
from telemill.session import materialize


def regression_metrics(scored: DataFrame, by: str | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """n, MAE, RMSE, R2 (null for one row or no variance), for all rows or per key."""
    error = F.col(predicted) - F.col(actual)
    base = scored.groupBy(by) if by else scored.groupBy()
    out = base.agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(actual).alias("var"))
    r2 = F.when((F.col("n") > 1) & (F.col("var") > 0), 1 - F.col("mse") / F.col("var"))
    return out.select(*([by] if by else []), "n", F.round("mae", 6).alias("mae"), F.round(F.sqrt("mse"), 6).alias("rmse"), F.round(r2, 6).alias("r2"))


def _by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score; written, as it is read more than once."""
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return materialize(known.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg")), "scores")


def classification_metrics(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Precision, recall, F1 (0 where undefined) at a threshold, and ROC-AUC by rank sums over distinct scores (null with one class).

    Rows without a score or a label are left out.
    """
    scored = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    hit = F.col(score) >= threshold
    counts = scored.agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"),
        F.sum(label).alias("p"),
    )
    groups = running(_by_score(scored, label, score), (), ("s",), {"_below": ("sum", F.col("neg"))}, exclusive=True)
    wins = groups.withColumn("w", F.col("pos") * (F.coalesce("_below", F.lit(0)) + F.col("neg") / 2)).agg(F.sum("w").alias("wins"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.crossJoin(F.broadcast(wins)).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round(f1, 6).alias("f1"), F.round(F.when(pairs > 0, F.col("wins") / pairs), 6).alias("auc"))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """True and false positive rates at each distinct score as the cut-off; rows without a score or a label are left out."""
    groups = _by_score(scored, label, score).withColumn("_down", -F.col("s"))
    totals = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    cum = running(groups, (), ("_down",), {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}).crossJoin(F.broadcast(totals))
    return cum.select(F.col("s").alias("threshold"), "tp", "fp", F.round(F.col("tp") / F.col("p"), 6).alias("tpr"), F.round(F.col("fp") / F.col("n"), 6).alias("fpr"))


def best_f1_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The cut-off (a score that occurs) with the highest F1 (the lowest one on ties); 0.5 and 0 without positives."""
    roc = roc_points(scored, label, score)
    p = roc.agg(F.max("tp").alias("_p"))
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("_p")), 9)
    best = roc.crossJoin(F.broadcast(p)).withColumn("f1", f1).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"), F.max("_p").alias("_p"))
    none = F.coalesce(F.col("_p"), F.lit(0)) == 0
    return best.select(F.when(none, 0.5).otherwise(F.col("b.threshold")).alias("threshold"), F.when(none, 0.0).otherwise(F.round("b.f1", 6)).alias("f1"))


def group_mean(train: DataFrame, test: DataFrame, key: str, value: str, out: str = "baseline") -> DataFrame:
    """The mean of ``value`` per key in train, for each row of test; an unseen key gets the mean of all."""
    means = train.groupBy(key).agg(F.avg(value).alias("_m"))
    whole = train.agg(F.avg(value).alias("_g"))
    return test.join(means, key, "left").crossJoin(F.broadcast(whole)).withColumn(out, F.coalesce("_m", "_g")).drop("_m", "_g")


def _cuts_before(rows: DataFrame, order: str, tie: str, cuts: list[int], n: int) -> Column | None:
    """How many of the places ``cuts`` (from 0, by ``order``, then ``tie``, nulls first) lie at or before a row of ``n``; null where rows that agree in both lie on both sides of one.

    Only both columns are dealt and numbered, and the driver gets two rows for each cut, so wide rows stay where they are.
    """
    inner = [c for c in cuts if 0 < c < n]
    found = {}
    if inner:
        at = numbered(rows.select(order, tie), order, "_at", tie=(tie,))
        found = {r["_at"]: (r[order], r[tie]) for r in at.where(F.col("_at").isin([*inner, *[c - 1 for c in inner]])).collect()}
    if any(found[c] == found[c - 1] for c in inner):
        return None
    types = [rows.schema[c].dataType for c in (order, tie)]
    from_cut = lambda c: F.struct(order, tie) >= F.struct(*[F.lit(v).cast(t).alias(x) for v, t, x in zip(found[c], types, (order, tie), strict=True)])
    return sum((from_cut(c).cast("int") if c in inner else F.lit(int(c <= 0)) for c in cuts), F.lit(0))


def time_split(rows: DataFrame, order: str, tie: str, type_out: Column, pattern_out: Column, share: float = 0.8) -> DataFrame:
    """split: holdout_type, holdout_pattern (type wins), and by time train up to round(n x share) (half to even) and test. Reads ``rows`` more than once."""
    held = rows.withColumn("split", F.when(type_out, "holdout_type").when(pattern_out, "holdout_pattern"))
    rest = held.where("split is null")
    n, cut = rest.agg(F.count("*"), F.bround(F.count("*") * share).cast("long")).collect()[0]
    later = _cuts_before(rest, order, tie, [cut], n)
    if later is not None:
        return held.withColumn("split", F.coalesce("split", F.when(later == 0, "train").otherwise("test")))
    at = numbered(rest, order, "_at", tie=(tie,))
    return held.where("split is not null").unionByName(at.withColumn("split", F.when(F.col("_at") < cut, "train").otherwise("test")).drop("_at"))


def ts_cv_folds(rows: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The fold (1 to k) in which a row is validated, 0 for rows that only train; the last k blocks of n // (k + 1) rows. Reads ``rows`` more than once."""
    n = rows.count()
    block = n // (k + 1)
    first = n - k * block
    fold = _cuts_before(rows, order, tie, [first + i * block for i in range(k)], n) if block else F.lit(0)
    if fold is not None:
        return rows.withColumn("fold", fold.cast("int"))
    at = numbered(rows, order, "_at", tie=(tie,))
    fold = F.floor((F.col("_at") - first) / block) + 1
    return at.withColumn("fold", F.when(F.col("_at") < first, 0).otherwise(fold).cast("int")).drop("_at")


def select_model(scores: DataFrame, margin: float, lower_better: bool = True) -> DataFrame:
    """The simplest family (lowest order) whose score beats the best baseline by the margin, else the best baseline.

    ``scores`` has name, kind (baseline or model), order, score.
    """
    best = scores.where("kind = 'baseline'").agg((F.min_by if lower_better else F.max_by)(F.struct("name", "score"), "score").alias("b"))
    joined = scores.where("kind = 'model'").crossJoin(F.broadcast(best))
    b = F.col("b.score")
    passes = F.col("score") <= (1 - margin) * b if lower_better else F.when(b <= 0, F.col("score") >= margin).otherwise(F.col("score") >= (1 + margin) * b)
    won = joined.where(passes).agg(F.min_by(F.struct("name", "score"), "order").alias("m"))
    out = best.crossJoin(won)
    return out.select(F.coalesce("m.name", "b.name").alias("chosen"), F.round(F.coalesce("m.score", "b.score"), 6).alias("score"), F.col("b.name").alias("baseline"))


def cold_start(rows: DataFrame) -> DataFrame:
    """pred_ms and cold_start: an unseen type takes its running mean, else its prior mean (with a count), else the global mean; only values over 0."""
    positive = lambda c: F.when(c > 0, c)
    stand_in = F.coalesce(positive(F.col("type_mean")), F.when(F.col("prior_count") > 0, positive(F.col("prior_mean"))), F.col("global_mean"))
    return rows.withColumn("cold_start", ~F.col("seen")).withColumn("pred_ms", F.when(F.col("seen"), F.col("model_ms")).otherwise(stand_in))


def shadow_pairs(log: DataFrame, actuals: DataFrame) -> DataFrame:
    """Live and shadow predictions of one record joined on (task, worker) with the actual time; the first record of a pair wins.

    ``log`` has at (order of records), task_id, live and shadow (arrays of worker_id, pred).
    """
    live = log.select("at", "task_id", F.inline("live")).withColumnRenamed("pred", "live")
    shadow = log.select("at", "task_id", F.inline("shadow")).withColumnRenamed("pred", "shadow")
    both = live.join(shadow, ["at", "task_id", "worker_id"]).join(actuals, ["task_id", "worker_id"])
    first = F.min_by(F.struct("live", "shadow", "actual"), "at")
    return both.groupBy("task_id", "worker_id").agg(first.alias("x")).select("task_id", "worker_id", "x.*")


def shadow_compare(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("live") - F.col("actual"))), 6).alias("live_mae"), F.round(F.avg(F.abs(F.col("shadow") - F.col("actual"))), 6).alias("shadow_mae"))


def promotion_gate(compared: DataFrame, margin: float, least: int) -> DataFrame:
    """allowed, and every reason against: no comparison, too few pairs, no gain beyond the margin."""
    none = F.col("n").isNull() | (F.col("n") == 0)
    reasons = F.filter(
        F.array(
            F.when(none, "no comparison"), F.when(~none & (F.col("n") < least), "too few pairs"),
            F.when(~none & (F.col("shadow_mae") > (1 - margin) * F.col("live_mae")), "no gain"),
        ),
        lambda x: x.isNotNull(),
    )
    return compared.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("allowed", F.size(reasons) == 0)
