"""Attacked copies of the positive traces, all transforms in one pass.

As in the studies that are followed, only positive, successfully recorded traces are attacked; the other rows keep their clean verdict. A copy is a
trace of its own, ``trace_id * CODES + code``, so graphs and views of all copies are built together. Code 0 stands for clean traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegraph.functions import ordered
from tracegraph.operators import events, fits, graph, learn, paths, perturb, rules, stats, views
from tracegraph.session import land
from tracegraph.sources.adapter import Tables

CODES = 16
TRACES = ["inject_nodes", "rewire_edges", "inflate_graph", "combined_structural", "decoy_links", "decoy_navigation", "url_camouflage", "form_step_split",
          "split_forms", "combined"]
FEATURES = ["benign_replacement", "benign_replacement_half", "mean_substitution"]  # of the URL columns
NAMES = ["clean", *TRACES, *FEATURES]


def attacked_tables(t: Tables) -> dict[str, DataFrame]:
    """The tables tr, ev, rq and rd of all copies; event order is given by time and event id."""
    tr = land(t.tr.filter("success AND y = 1"), "positives")
    mine = tr.select("trace_id")
    ev, rq, rd = (df.join(mine, "trace_id", "left_semi") for df in (t.ev, t.rq, t.rd))
    ev, rq = land(ev, "positive-events"), land(rq, "positive-requests")
    o = {"order": t.sequence}
    navigated, requests = perturb.decoy_navigation(tr, ev, rq, **o)
    hidden = land(perturb.url_camouflage(tr), "camouflaged")
    evs = {"inject_nodes": perturb.inject_nodes(tr, ev, **o), "rewire_edges": perturb.rewire_edges(ev), "inflate_graph": perturb.inflate_graph(tr, ev, **o),
           "combined_structural": perturb.combined_structural(tr, ev, **o), "decoy_links": perturb.decoy_links(tr, ev, **o), "decoy_navigation": navigated,
           "url_camouflage": rooted(hidden, ev), "form_step_split": perturb.form_step_split(ev, **o), "split_forms": split_events(ev, **o),
           "combined": perturb.form_step_split(rooted(hidden, navigated), **o)}
    moved = {"url_camouflage": hidden, "combined": hidden}
    busier = {"decoy_navigation": requests, "combined": requests}

    def copies(of: dict[str, DataFrame], plain: DataFrame) -> DataFrame:
        """One copy per attack; ``plain`` where the attack leaves the table alone."""
        same = [i for i, name in enumerate(TRACES, 1) if name not in of]
        parts = [plain.withColumn("_code", F.explode(F.array(*[F.lit(i) for i in same])))] if same else []
        parts += [of[name].select(*plain.columns).withColumn("_code", F.lit(i)) for i, name in enumerate(TRACES, 1) if name in of]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("trace_id", F.col("trace_id") * CODES + F.col("_code")).drop("_code")

    return {"tr": land(copies(moved, tr), "attacked-traces"), "ev": land(copies(evs, ev), "attacked-events"), "rq": copies(busier, rq), "rd": land(copies({}, rd), "attacked-hops")}


def rooted(tr: DataFrame, ev: DataFrame) -> DataFrame:
    """Events that start from the URL of their trace, so that the first edge leaves the root."""
    return ev.drop("root_url").join(tr.select("trace_id", F.col("url").alias("root_url")), "trace_id").select(*ev.columns)


def split_events(ev: DataFrame, order: perturb.Order = ordered.sequence) -> DataFrame:
    """Submitted forms become one input event per field; a form with a field also asks for an email address, as in ``split_forms``."""
    fields = F.when((F.col("event_type") == "submit") & (F.col("form_field") != ""), F.array_distinct(F.array("form_field", F.lit("email")))).otherwise(F.array("form_field"))
    s = perturb.split_forms(perturb.spread_ids(ev).withColumn("form_fields", fields)).withColumn("_f", F.col("form_fields")[0])
    s = s.withColumn("event_id", F.col("event_id") + (F.col("_f") != F.col("form_field")).cast("int")).withColumn("form_field", F.col("_f"))
    return perturb.renumber(s.select(*ev.columns), order)


def attacked_itg(t: Tables, a: dict[str, DataFrame]) -> DataFrame:
    """Graph features of all copies."""
    large = None if t.large is None else t.large.select((F.col("trace_id") * CODES + F.explode(F.sequence(F.lit(1), F.lit(len(TRACES))))).alias("trace_id"))

    def order(df, keys, by, slice_expr, index="idx", previous=None, first=None):
        return ordered.sequence_by_size(df, keys, by, slice_expr, large, index, previous, first)

    seq = land(events.event_sequence(a["ev"], order), "attacked-seq")
    nodes, edges = land(graph.itg_nodes(a["tr"], a["ev"], a["rd"], seq), "attacked-nodes"), land(graph.itg_edges(a["ev"], a["rd"], seq), "attacked-edges")
    return land(views.itg_view(nodes, edges, paths.path_metrics(nodes, edges, shapes=True)), "attacked-itg")


def rule_verdicts(itg: DataFrame) -> DataFrame:
    """Rows (model, trace_id, code, pred)."""
    return rules.heuristic_verdict(itg).select(
        F.lit("rules").alias("model"), F.floor(F.col("trace_id") / CODES).alias("trace_id"), (F.col("trace_id") % CODES).cast("int").alias("code"), F.col("is_phishing").alias("pred"))


def model_verdicts(t: Tables, a: dict[str, DataFrame], itg: DataFrame) -> DataFrame:
    """Rows (model, trace_id, code, pred) of forests fitted on the training rows: all views, all but the URL, the URL and the graph alone."""
    sets = {v: views.view_columns(t.views, v) for v in views.VIEW_PREFIX}
    every, url = [c for cs in sets.values() for c in cs], sets["url"]
    split = land(stats.stratified_split(t.views.select("trace_id", "y", *every)), "split")
    coded = lambda df, code, fold: df.select((F.col("trace_id") * CODES + code).alias("trace_id"), "y", fold.cast("int").alias("fold"), *every)
    test = split.filter("is_train = 0 AND y = 1").select(F.col("trace_id").alias("_t"), "y")
    full = views.all_views(a["tr"], a["ev"], a["rq"], a["rd"], itg).withColumn("_t", F.floor(F.col("trace_id") / CODES)).join(test, "_t")
    # benign rows to blend with come from the training rows
    pool = split.filter("(is_train = 1 AND y = 0) OR (is_train = 0 AND y = 1)").select("trace_id", "y", *every)
    moved = [perturb.benign_replacement(pool, url), perturb.benign_replacement(pool, url, 0.5), perturb.mean_substitution(pool, url)]
    rows = coded(split, 0, F.col("is_train")).unionByName(full.select("trace_id", "y", F.lit(0).alias("fold"), *every))
    for i, df in enumerate(moved, len(TRACES) + 1):
        rows = rows.unionByName(coded(df.filter("y = 1"), i, F.lit(0)))
    cases = {"full": (every, fits.forest()), "non_url": ([c for c in every if c not in url], fits.forest()), "url": (url, fits.forest(200)), "itg": (sets["itg"], fits.forest())}
    return learn.train_and_score(rows, cases).select(
        F.col("method").alias("model"), F.floor(F.col("trace_id") / CODES).alias("trace_id"), (F.col("trace_id") % CODES).cast("int").alias("code"), "pred")


def report(verdicts: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Accuracy, F1 and evasion per attack and model: attacked positives beside the clean rows of the others. ``names`` by code, from 0."""
    v = land(verdicts.join(labels, "trace_id"), "verdicts")
    clean, hit = v.filter("code = 0"), v.filter("code > 0")
    asked = hit.select("model", "code").distinct()
    others = clean.filter("y <> 1").drop("code").join(F.broadcast(asked), "model")  # one row per model and attack
    rows = clean.unionByName(hit).unionByName(others.select(*v.columns))
    m = stats.binary_metrics(rows, ["model", "code"]).select("model", "code", "accuracy", "f1")
    pair = clean.filter("y = 1").select("model", "trace_id", "y", F.col("pred").alias("clean_pred")).join(
        v.filter("y = 1").select("model", "trace_id", "code", F.col("pred").alias("attacked_pred")), ["model", "trace_id"])
    attack = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("code") + 1).alias("attack")
    return m.join(stats.evasion_rate(pair, ["model", "code"]), ["model", "code"]).select(attack, "model", "accuracy", "f1", "detected", "evaded", "evasion_rate")
