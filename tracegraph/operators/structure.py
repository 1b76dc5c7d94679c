"""Structural fingerprints of trace graphs: label refinement, spectrum moments, random walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import ordered
from tracegraph.functions.text import div, short_md5
from tracegraph.operators.dedup import bag_digest, code48
from tracegraph.session import land


def start_label() -> Column:
    return F.concat_ws("|", "node_type", "element_tag", F.col("has_sensitive").cast("int").cast("string"))


def wl_labels(nodes: DataFrame, bag: DataFrame, rounds: int = 5) -> DataFrame:
    """Counts of refined labels (trace_id, round, label, n) over all rounds.

    A node's next label folds its own label with a digest of the bag of its
    out-neighbours' labels. The digest is a sum, so neighbours of a hub combine
    before and during the shuffle and no sorted neighbour list is ever built.
    """
    keys = ["trace_id", "node"]
    cur = land(nodes.select(*keys, start_label().alias("label")), "wl")
    step = bag.select("trace_id", "src", F.col("dst").alias("node"))
    tables = []
    for r in range(rounds + 1):
        tables.append(cur.groupBy("trace_id", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("round", F.lit(r)))
        if r < rounds:
            told = step.join(cur, keys).groupBy("trace_id", F.col("src").alias("node")).agg(
                bag_digest(F.col("label")).alias("digest"))
            cur = land(cur.join(told, keys, "left").select(*keys, short_md5(
                F.concat_ws("||", "label", F.coalesce("digest", F.lit("0:0")))).alias("label")), "wl")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("trace_id", "round", "label", "n")


def vocab_top_k(labels: DataFrame, k: int = 256) -> DataFrame:
    """The k most frequent labels, ties by label."""
    freq = labels.groupBy("label").agg(F.sum("n").alias("freq"))
    return freq.orderBy(F.desc("freq"), "label").limit(k)


def wl_vectors(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse L2-normalised label counts; the vocabulary has at most its fixed k rows."""
    per = labels.groupBy("trace_id", "label").agg(F.sum("n").alias("n")).join(F.broadcast(vocab.select("label")), "label")
    norm = per.groupBy("trace_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return per.join(norm, "trace_id").select("trace_id", "label", (F.col("n") / F.col("norm")).alias("weight"))


def spectral_moments(nodes: DataFrame, bag: DataFrame) -> DataFrame:
    """Mean, variance and energy of the normalised-Laplacian spectrum from traces of L and L squared."""
    sym = bag.select("trace_id", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                                                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    sym = land(sym.select("trace_id", "e.*").distinct(), "symmetric")
    deg = sym.groupBy("trace_id", "a").agg(F.count(F.lit(1)).cast("double").alias("d"))
    w = sym.join(deg, ["trace_id", "a"]).join(deg.toDF("trace_id", "b", "db"), ["trace_id", "b"])
    self_loop = F.col("a") == F.col("b")
    entry = 1.0 / F.sqrt(F.col("d") * F.col("db"))
    off = w.groupBy("trace_id").agg(
        F.sum(F.when(self_loop, entry).otherwise(0.0)).alias("loops"),
        F.sum(F.when(self_loop, (1 - entry) * (1 - entry) - 1).otherwise(entry * entry)).alias("squares"))
    n = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(off, "trace_id", "left").na.fill(0.0)
    nn = F.col("n")
    mean = (nn - F.col("loops")) / nn
    energy = nn + F.col("squares")
    return j.select("trace_id", mean.alias("spectrum_mean"), (energy / nn - mean * mean).alias("spectrum_variance"),
                    energy.alias("spectrum_energy"))


def walk_steps(nodes: DataFrame, bag: DataFrame, walks: int = 50, length: int = 10) -> DataFrame:
    """Deterministic truncated walks (trace_id, walk, step, node); choices come from md5 instead of a generator."""
    seq = ordered.sequence(nodes.select("trace_id", "node", "node_seq"), ["trace_id"], ["node_seq"],
                           F.floor(F.col("node_seq") / 4096), "idx")
    size = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    adj = bag.select("trace_id", "src", "dst", code48(F.col("dst")).cast("long").alias("h"))
    adj = land(ordered.sequence(adj, ["trace_id", "src"], ["h", "dst"], F.floor(F.col("h") / F.lit(2 ** 40)), "rank"), "adjacency")
    out = land(adj.groupBy("trace_id", "src").agg(F.count(F.lit(1)).alias("outdeg")), "outdegree")
    start = size.select("trace_id", "n", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    start = start.withColumn("idx", F.pmod(code48(F.concat_ws("|", "trace_id", "walk")).cast("long"), F.col("n")))
    cur = land(start.join(seq, ["trace_id", "idx"]).select("trace_id", "walk", F.lit(0).alias("step"), "node"), "walk")
    steps = [cur]
    for s in range(1, length):
        here = cur.select("trace_id", "walk", F.col("node").alias("src")).join(out, ["trace_id", "src"])
        pickd = F.pmod(code48(F.concat_ws("|", "trace_id", "walk", F.lit(str(s)), "src")).cast("long"), F.col("outdeg"))
        cur = land(here.withColumn("rank", pickd).join(adj.select("trace_id", "src", "rank", "dst"), ["trace_id", "src", "rank"])
                   .select("trace_id", "walk", F.lit(s).alias("step"), F.col("dst").alias("node")), "walk")
        steps.append(cur)
    u = steps[0]
    for s in steps[1:]:
        u = u.unionByName(s)
    return u


def random_walk_stats(nodes: DataFrame, bag: DataFrame, walks: int = 50, length: int = 10, type_bins: int = 8,
                      return_bins: int = 5) -> DataFrame:
    """Eighteen walk statistics per trace: type shares, first-return shares, completion, coverage, entropy, sizes."""
    steps = land(walk_steps(nodes, bag, walks, length), "walks")
    vocab = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_type").limit(type_bins - 1)
    bins = F.broadcast(vocab.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "node_type"))).alias("v"))
                       .select(F.posexplode("v.node_type").alias("bin", "node_type")))  # at most 7 rows
    typed = nodes.select("trace_id", "node", "node_type").join(bins, "node_type", "left").select(
        "trace_id", "node", F.coalesce("bin", F.lit(type_bins - 1)).alias("bin"))
    visits = steps.join(typed, ["trace_id", "node"])
    per_node = visits.groupBy("trace_id", "node", "bin").agg(F.count(F.lit(1)).alias("n"))
    types = per_node.groupBy("trace_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("seen"), *[
        F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"t{b}") for b in range(type_bins)])
    start = steps.filter("step = 0").select("trace_id", "walk", F.col("node").alias("origin"))
    back = steps.filter("step > 0").join(start, ["trace_id", "walk"]).filter("node = origin").groupBy("trace_id", "walk").agg(
        F.min("step").alias("first")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("returns"), *[
            F.count_if(F.least(F.col("first") - 1, F.lit(return_bins - 1)) == b).alias(f"r{b}") for b in range(return_bins)])
    size = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).join(
        bag.groupBy("trace_id").agg(F.count(F.lit(1)).alias("m")), "trace_id", "left").na.fill(0)
    j = size.join(types, "trace_id").join(back, "trace_id", "left").na.fill(0)
    share = [F.col(f"t{b}") / F.col("total") for b in range(type_bins)]
    ent = None
    for p in share:
        e = F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
        ent = e if ent is None else ent + e
    return j.select("trace_id", *[p.alias(f"type_{b}") for b, p in enumerate(share)],
                    *[div(F.col(f"r{b}"), F.col("returns")).alias(f"return_{b}") for b in range(return_bins)],
                    (F.col("total") / (walks * length)).alias("completion"), (F.col("seen") / F.col("n")).alias("coverage"),
                    ent.alias("type_entropy"), F.log1p("n").alias("log_nodes"), F.log1p("m").alias("log_edges"))
