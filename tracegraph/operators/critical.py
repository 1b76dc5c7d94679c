"""Node suspicion, critical paths and pruning checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions.text import any_word
from tracegraph.operators.paths import distances_from, numbered, unfolded
from tracegraph.session import land

PATH_SEP = "\x1f"


def suspicion() -> Column:
    a, t = F.col("attr"), F.col("node_type")

    def part(cond, value):
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    return (part(any_word(a, ["password", "pwd", "pass"]), 3.0) + part(any_word(a, ["email", "mail", "login"]), 2.0)
            + part(any_word(a, ["ssn", "social", "card", "credit", "cvv"]), 3.0) + part(t.isin("submit", "form_submit"), 2.5)
            + part(t == "form_input", 1.5) + part((t == "url") & ~F.col("is_root"), 1.0))


def node_scores(nodes: DataFrame) -> DataFrame:
    label = F.when(F.col("is_root"), "root").when(F.col("node_type") == "url", "redirect").otherwise(
        F.concat_ws(":", "node_type", "element_tag"))
    return nodes.select("trace_id", "node", "node_seq", "node_type", "is_root", "attr", label.alias("label"),
                        suspicion().alias("score"))


def _rooted(scores: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between node numbers, and the hop distance (trace_id, t, d) of every node that the root reaches."""
    links = land(numbered(scores, edges), "links")
    return links, distances_from(scores.filter("is_root").select("trace_id", F.col("node_seq").alias("t")), links)


def critical_nodes(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (trace_id, target, path, reachable): labels on the shortest path from the root to the node with the best score (the first of equals).

    Of equally near predecessors the one that stands first in the trace is taken. Where the root doesn't reach the target, the five best nodes stand in for the path.
    """
    scores = land(scores, "scores")
    links, reached = _rooted(scores, edges)
    target = scores.groupBy("trace_id").agg(F.max_by(F.struct(F.col("node_seq").alias("t"), "label"), F.struct("score", -F.col("node_seq"))).alias("b"))
    target = land(target.select("trace_id", "b.t", F.col("b.label").alias("target")).join(reached.withColumnRenamed("d", "depth"), ["trace_id", "t"], "left"), "targets")
    near = links.join(reached.withColumnsRenamed({"t": "s", "d": "before"}), ["trace_id", "s"]).join(reached, ["trace_id", "t"])
    parents = near.filter("d = before + 1").groupBy("trace_id", "t").agg(F.min("s").alias("p"))
    on = unfolded(target.filter("depth IS NOT NULL"), parents)
    steps = on.join(reached, ["trace_id", "t"]).join(scores.select("trace_id", F.col("node_seq").alias("t"), "label"), ["trace_id", "t"])
    path = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("d", "label"))).alias("l"))
    found = target.filter("depth IS NOT NULL").join(path, "trace_id").select("trace_id", "target", F.array_join("l.label", PATH_SEP).alias("path"), F.lit(True).alias("reachable"))
    lost = target.filter("depth IS NULL").select("trace_id", "target")
    if lost.isEmpty():
        return found
    top, best = scores.join(lost, "trace_id", "left_semi"), None
    for _ in range(5):  # five rounds of "next best" keep every group an aggregate
        rest = top if best is None else top.join(best.select("trace_id", "node"), ["trace_id", "node"], "left_anti")
        nxt = rest.groupBy("trace_id").agg(F.max_by(F.struct("node", "label", "score", "node_seq"), F.struct("score", -F.col("node_seq"))).alias("r"))
        nxt = nxt.select("trace_id", "r.*")
        best = land(nxt if best is None else best.unionByName(nxt), "top-nodes")
    tail = best.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "node_seq", "label"))).alias("l"))
    return found.unionByName(lost.join(tail, "trace_id").select("trace_id", "target", F.array_join("l.label", PATH_SEP).alias("path"), F.lit(False).alias("reachable")))


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest path from the root to the most suspicious node, as labels and as text."""
    raw = critical_nodes(node_scores(nodes), edges)
    parts = F.split("path", PATH_SEP)
    n = F.size(parts)
    steps = F.transform(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x))
    target = F.when(n > 1, F.array(F.concat(F.lit("Target: "), F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("Entry: "), parts[0])), steps, target), " -> ")
    size = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("k"))
    short = F.col("k") <= 1
    return raw.join(size, "trace_id").select(
        "trace_id", "target", F.when(short, "").otherwise(F.array_join(parts, " > ")).alias("path"),
        F.when(short, "Insufficient interaction data for path analysis.").otherwise(text).alias("description"))


def prune_reachability(nodes: DataFrame, edges: DataFrame, threshold: float = 0.3, credential: float = 0.5) -> DataFrame:
    """Credential nodes the root reaches before and after dropping low-score nodes (the root always stays)."""
    scores = land(node_scores(nodes).withColumn("score", F.least(F.lit(1.0), F.col("score") / 6.0)), "scores")
    links = numbered(scores, edges)
    kept = scores.filter(F.col("is_root") | (F.col("score") >= threshold)).select("trace_id", F.col("node_seq").alias("t"))
    both = links.withColumn("cut", F.lit(False)).unionByName(links.join(kept, ["trace_id", "t"], "left_semi").withColumn("cut", F.lit(True)))
    roots = scores.filter("is_root").select("trace_id", F.col("node_seq").alias("t"), F.explode(F.array(F.lit(False), F.lit(True))).alias("cut"))
    met = distances_from(roots, both, ["trace_id", "cut"])
    hits = scores.filter(F.col("score") >= credential).select("trace_id", F.col("node_seq").alias("t")).join(met, ["trace_id", "t"])
    counts = hits.groupBy("trace_id").agg(F.count_if(~F.col("cut")).alias("credentials_before"), F.count_if("cut").alias("credentials_after"))
    return scores.filter("is_root").select("trace_id").join(counts, "trace_id", "left").na.fill(0)


def branching_reduction(nodes: DataFrame, edges: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Effective branching per trace: mean out-degree times the kept share of each pruning rule."""
    s = node_scores(nodes).withColumn("score", F.least(F.lit(1.0), F.col("score") / 6.0))
    n = F.count(F.lit(1))
    a = s.groupBy("trace_id").agg(
        n.alias("n"), (F.count_if((F.col("score") < threshold) & ~F.col("is_root")) / n).alias("r_score"),
        (F.count_if(F.col("node_type") == "link_detected") / n).alias("r_link"))
    m = edges.groupBy("trace_id").agg(F.count(F.lit(1)).alias("m"))
    j = a.join(m, "trace_id", "left").na.fill(0, ["m"])
    kept = F.array(1 - F.col("r_score"), 1 - F.col("r_link"))
    prod = F.aggregate(kept, F.lit(1.0), lambda acc, x: acc * x)
    return j.select("trace_id", (F.col("m") / F.col("n")).alias("branching"), "r_score", "r_link",
                    (F.col("m") / F.col("n") * prod).alias("effective_branching"))
