"""Per-trace explanations from long (trace, feature) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracegraph.functions import fixed


def long_features(df: DataFrame, features: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    keep = [c for c in ("trace_id", "y") if c in df.columns]
    return df.select(*keep, F.explode(arr).alias("f")).select(*keep, "f.*")


def attribution(df: DataFrame, importance: DataFrame, scale: DataFrame, features: list[str], top: int = 10) -> DataFrame:
    """importance * (1 + |z|) normalised per trace, best ``top``; tables of importance and scale hold one row per feature."""
    j = long_features(df, features).join(F.broadcast(importance), "feature").join(F.broadcast(scale), "feature")
    w = F.col("importance") * (1 + F.abs((F.col("value") - F.col("mean")) / F.col("std")))
    per = Window.partitionBy("trace_id")  # one row per feature in each trace
    a = j.withColumn("w", w).withColumn("attribution", F.col("w") / (F.sum("w").over(per) + 1e-10))
    rank = F.row_number().over(per.orderBy(F.desc(F.round("attribution", 9)), "feature"))
    return a.withColumn("place", rank).filter(F.col("place") <= top).select("trace_id", "place", "feature", "value", "attribution")


def category_contrib(attributions: DataFrame) -> DataFrame:
    expr = None
    for cat, cols in fixed.ITG_CATEGORIES.items():
        cond = F.col("feature").isin(cols)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    c = attributions.groupBy("trace_id", expr.alias("category")).agg(F.sum("attribution").alias("s"))
    total = F.sum("s").over(Window.partitionBy("trace_id")) + 1e-10  # at most five categories per trace
    return c.select("trace_id", "category", (F.col("s") / total).alias("share"))


def category_share(contrib: DataFrame) -> DataFrame:
    """Mean share per category, normalised to one."""
    m = contrib.groupBy("category").agg(F.avg(F.abs("share")).alias("m"))
    return m.select("category", (F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).alias("share"))  # five rows


def contrastive(df: DataFrame, prototype: DataFrame, features: list[str], top: int = 8) -> DataFrame:
    """Features more than one deviation from the benign mean, by relative distance."""
    j = long_features(df, features).join(F.broadcast(prototype), "feature")
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    gap = F.abs(F.col("value") - F.col("mean")) / F.greatest(F.lit(0.001), F.abs("mean"))
    k = j.withColumn("z", z).filter("z > 1").withColumn("gap", gap)
    k = k.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc(F.round("gap", 9)), "feature")))
    text = F.format_string("%s is %.1fx std %s than benign average (sample=%.3g, benign_avg=%.3g)", "feature", "z",
                           F.when(F.col("value") > F.col("mean"), "higher").otherwise("lower"), "value", "mean")
    return k.filter(F.col("place") <= top).select("trace_id", "place", "feature", "value", F.col("mean").alias("benign_avg"), "z", text.alias("description"))


def explain(tr: DataFrame, scored: DataFrame, attributions: DataFrame, contrib: DataFrame, paths: DataFrame, contrasts: DataFrame) -> DataFrame:
    """One explanation row and sentence per trace; every list holds at most ten entries."""
    tops = attributions.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "attribution"))).alias("top_features"))
    cats = contrib.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "share"))).alias("categories"),
                                           F.max_by(F.struct("category", "share"), F.struct("share", "category")).alias("main"))
    first = contrasts.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value", "benign_avg", "description"))).alias("contrasts"))
    j = tr.select("trace_id", "url").join(scored, "trace_id").join(tops, "trace_id").join(cats, "trace_id").join(
        paths, "trace_id", "left").join(first, "trace_id", "left")
    factors = F.array_join(F.transform(F.slice("top_features", 1, 3), lambda x: F.format_string("%s (%.1f%%)", x["feature"], x["attribution"] * 100)), ", ")
    text = F.concat_ws(
        "; ", F.format_string("%s: %s, %.1f%% sure, score %.0f of 100", "url", "label", F.col("confidence") * 100, F.col("prob_phishing") * 100),
        F.concat(F.lit("led by "), factors),
        F.format_string("group with most weight: %s, %.0f%%", "main.category", F.col("main.share") * 100),
        F.concat(F.lit("path: "), "description"),
        F.concat(F.lit("furthest from benign: "), F.try_element_at("contrasts", F.lit(1))["description"]))
    return j.select("trace_id", "url", F.col("label").alias("prediction"), "confidence", (F.col("prob_phishing") * 100).alias("risk_score"),
                    "top_features", "categories", F.col("path").alias("critical_path"), "contrasts", text.alias("summary"))


def explain_report(explained: DataFrame, positives: int = 5, negatives: int = 3) -> DataFrame:
    """A few sample explanations per class (the report's own limit)."""
    a = explained.filter("prediction = 'phishing'").orderBy(F.desc("risk_score"), "trace_id").limit(positives)
    b = explained.filter("prediction = 'benign'").orderBy("risk_score", "trace_id").limit(negatives)
    return a.unionByName(b)
