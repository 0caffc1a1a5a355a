"""Evaluation of scores against labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.text import normalize_text


def prf(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1; a measure with an empty denominator is 0. One pass for all thresholds."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    at = df.select(F.col(label).alias("l"), F.col(score).alias("s"), F.explode(marks).alias("threshold"))
    n = at.groupBy("threshold").agg(*[F.count_if(F.expr(e)).alias(k) for k, e in (("tp", "s >= threshold and l = 1"), ("fp", "s >= threshold and l = 0"), ("fn", "s < threshold and l = 1"))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence of the scores within [0, 1]; the last bin is closed."""
    inside = df.where(F.col(score).between(0.0, 1.0))
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(label).alias("accuracy"), F.avg(score).alias("confidence"))


def expected_calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    return calibration_bins(df, label, score, bins).agg(F.coalesce(F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"))


def agreements(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with agree_<field>: both sides (field1, field2) are equal and not empty after normalisation."""
    out = df
    for f in fields:
        a, b = normalize_text(F.col(f"{f}1")), normalize_text(F.col(f"{f}2"))
        out = out.withColumn(f"agree_{f}", (a != "") & (a == b))
    return out


def m_u(df: DataFrame, fields: list[str], label: str) -> DataFrame:
    """field, m, u: shares of agreement among same and different pairs, with one added to each count; half where there are none."""
    rows = agreements(df, fields).select(F.col(label).alias("l"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"agree_{f}").alias("a")) for f in fields])))
    n = rows.groupBy("field").agg(*[F.count_if((F.col("l") == v) & c).alias(k) for k, v, c in (("da", 1, F.col("a")), ("d", 1, F.lit(True)), ("sa", 0, F.col("a")), ("s", 0, F.lit(True)))])
    rate = lambda a, b: F.when(F.col(b) > 0, (F.col(a) + 1) / (F.col(b) + 2)).otherwise(0.5)
    return n.select("field", rate("da", "d").alias("m"), rate("sa", "s").alias("u"))


def pair_weights(df: DataFrame, fields: list[str], estimates: DataFrame, low: float, high: float) -> DataFrame:
    """df with weight (sum of log2 of the odds of what its fields show) and class. estimates has a row per field."""
    wide = estimates.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("m", "u")))).alias("e"))
    rows = agreements(df, fields).crossJoin(F.broadcast(wide))  # one row: a value for each field
    total: Column = F.lit(0.0)
    for f in fields:
        m, u = F.col("e")[f]["m"], F.col("e")[f]["u"]
        total = total + F.when(F.col(f"agree_{f}"), F.log2(m / u)).otherwise(F.log2((1 - m) / (1 - u)))
    out = rows.withColumn("weight", total).drop("e")
    return out.withColumn("class", F.when(F.col("weight") >= high, "HIGH").when(F.col("weight") >= low, "MIDDLE").otherwise("LOW"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def platt_fit(df: DataFrame, label: str, score: str, steps: int = 300, rate: float = 0.5, digits: int = 6) -> tuple[float, float]:
    """(a, b) of sigmoid(a x + b) by gradient descent on the log loss.

    Scores are clipped to [0, 1] and aggregated to distinct (score, label, number); rounding at ``digits`` bounds them to
    2 * (10**digits + 1) points whatever the number of rows (32 MB at six). The descent runs over those on the driver.
    """
    x = F.round(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)), digits)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(x.alias("x"), F.col(label).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n")).orderBy("x", "y").collect()
    points = np.array([(r.x, r.y, r.n) for r in rows], float).reshape(-1, 3)
    xs, ys, ns = points.T
    total = max(1.0, float(ns.sum()))
    a, b = 1.0, 0.0
    for _ in range(steps):
        off = ns * (1.0 / (1.0 + np.exp(-(a * xs + b))) - ys)
        a -= rate * float((off * xs).sum()) / total
        b -= rate * float(off.sum()) / total
    return a, b


PAIR_FIELDS = ["title", "company", "location", "description", "apply_url_direct"]


def labelled_pairs(rows: DataFrame, key: str, seed: int = 42, buckets: int = 64) -> DataFrame:
    """a, b (structs of PAIR_FIELDS), label, notes: each row with a rewritten copy of itself (1), and with the next other row in an order by hash (0).

    What is rewritten, and which rows meet, follows from a hash of key and seed, so a run is repeated by its seed. Rows of one hash
    bucket are put in order, so nothing is sorted as a whole. Rows without title make no pairs.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in PAIR_FIELDS]
    base = rows.where(F.coalesce(F.col("title"), F.lit("")) != "").select(F.col(key).alias("k"), h.alias("h"), F.struct(*own).alias("a"))
    kind = F.pmod("h", F.lit(4))
    words = F.split("a.description", " ")
    shorter = F.array_join(F.transform(words, lambda w, i: F.when(i % 11 != F.pmod(F.col("h"), F.lit(11)), w)), " ")
    copy = F.struct(
        F.when(kind == 0, F.concat(F.lit("Senior "), F.col("a.title"))).when(kind == 1, F.upper("a.title")).otherwise(F.col("a.title")).alias("title"),
        F.when((kind == 2) & (F.col("a.company") != ""), F.concat("a.company", F.lit(" Inc"))).otherwise(F.col("a.company")).alias("company"),
        F.when((kind == 3) & (F.col("a.location") != ""), F.concat("a.location", F.lit(" (Remote)"))).otherwise(F.col("a.location")).alias("location"),
        shorter.alias("description"), F.when(F.col("a.apply_url_direct") != "", F.concat("a.apply_url_direct", F.lit("?utm_source=x"))).otherwise("").alias("apply_url_direct"),
    )
    note = F.element_at(F.array(*[F.lit(x) for x in ("level added", "title in capitals", "company suffix", "remote added")]), (kind + 1).cast("int"))
    same = base.select("a", copy.alias("b"), F.lit(1).alias("label"), note.alias("notes"))
    after = F.lead("a").over(Window.partitionBy(F.pmod("h", F.lit(buckets))).orderBy("h", "k"))
    other = base.select("a", after.alias("b")).where("b is not null")
    differs = (normalize_text(F.col("a.title")) != normalize_text(F.col("b.title"))) | (normalize_text(F.col("a.company")) != normalize_text(F.col("b.company")))
    return same.unionByName(other.where(differs).select("a", "b", F.lit(0).alias("label"), F.lit("another posting").alias("notes")))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """label and score of labelled pairs (a, b, label), by the composite similarity; employers' domains aren't part of the pairs."""
    from millrace.operators.blocking import scored

    sides = [F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in PAIR_FIELDS]
    none = [F.lit("").alias(f"employer_domain{i}") for i in (1, 2)]
    return scored(pairs.select("label", *sides, *none)).select("label", "score")
