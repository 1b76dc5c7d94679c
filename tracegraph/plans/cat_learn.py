"""Learning, evaluation and explanation.

Linear studies run to the optimum in ten folds. ``clf_rf``, ``clf_mlp``, ``stacked_smve``, ``stack_concat`` and ``baseline_suite`` take the whole learners of
``operators/fits.py``; the other studies of forests, boosted trees and networks use fewer trees, rounds and folds than the defaults of ``operators/learn.py``.
"""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tracegraph.functions import fixed
from tracegraph.operators import critical, embed, events, explain, fits, graph, learn, paths, perturb, rules, stats, structure, views
from tracegraph.plans.base_sql import G_ALL, IN, R, sql
from tracegraph.plans.cat_stats import strata
from tracegraph.plans.cat_views import ITG_CTE
from tracegraph.plans.registry import query
from tracegraph.session import land, scratch_path

FOLDS = 3
RF, GBM, LR, MLP = learn.rf(20, 10), learn.gbm(10, 4), learn.lr(1.0, 50), learn.mlp(32, 16, rounds=50)
G = [f"g_{c}" for c in fixed.ITG_COLS]


def cols(t, *names):
    return views.view_columns(t.views, *names)


def view_sets(t):
    return {v: cols(t, v) for v in views.VIEW_PREFIX}


def cv(name, maker, subset=None):
    def run(t):
        return learn.cross_validate(t.views, subset or cols(t, "itg"), maker, FOLDS, name)

    query(name)(run)


cv("clf_gbm", GBM)


@query("clf_rf")
def _(t):
    return learn.evaluate(t.views, {"clf_rf": (cols(t, "itg"), fits.forest())})


@query("clf_mlp")
def _(t):
    return learn.evaluate(t.views, {"clf_mlp": (cols(t, "itg"), fits.network(128, 64))})


@query("clf_lr")
def _(t):
    return learn.linear_compare(t.views, {"clf_lr": cols(t, "itg")})


@query("clf_svm")
def _(t):
    df, names = learn.fourier_features(t.views.select("trace_id", "y", *G), G)
    return learn.cross_validate(df, names, learn.svm(10.0, 30), FOLDS, "svm")


@query("cross_validate")
def _(t):
    return learn.linear_compare(t.views, {"lr_125": cols(t, *views.VIEW_PREFIX)})


@query("soft_vote_mve")
def _(t):
    return learn.soft_vote_mve(t.views, view_sets(t), {v: LR for v in views.VIEW_PREFIX}, FOLDS)


@query("stacked_smve")
def _(t):
    boosted = fits.boosted(200, 5, subsample=0.8)
    learners = {"url": boosted, "network": fits.forest(300), "redirect": boosted, "interaction": fits.forest(200), "itg": fits.forest(300, least=3),
                "cross": fits.boosted(150, 4)}
    return learn.stacked_whole(t.views, {v: (c, learners[v]) for v, c in view_sets(t).items()}, [fits.logistic(balanced=False), fits.boosted(100, 3)],
                               cols(t, "url"), "stacked")


@query("stack_concat")
def _(t):
    return learn.stack_concat(t.views, cols(t, *views.VIEW_PREFIX), {"rf": fits.forest(300), "gbm": fits.boosted(300, 5, subsample=0.8), "mlp": fits.network(128, 64)})


@query("view_ablation")
def _(t):
    return learn.compare(t.views, {v: (c, RF) for v, c in view_sets(t).items()}, FOLDS)


@query("feature_group_ablation")
def _(t):
    full = views.full_feature_matrix(t.itg).join(t.tr.filter("success").select("trace_id", "y"), "trace_id")
    base, eng, drp = fixed.ITG_COLS, list(views.engineered_columns()), list(views.drp_columns())
    rest = [c for c in full.columns if c not in (*base, *eng, *drp, "trace_id", "y")]
    return learn.linear_compare(land(full, "groups"), {"base": list(base), "+eng": [*base, *eng], "+drp": [*base, *eng, *drp], "full": [*base, *eng, *drp, *rest]})


@query("cross_layer_ablation")
def _(t):
    no = cols(t, "url", "network", "redirect", "interaction", "itg")
    return learn.linear_compare(t.views, {"without_cross": no, "with_cross": no + cols(t, "cross")})


@query("same_subset_compare")
def _(t):
    d = t.views.filter("itg_available = 1")
    return learn.linear_compare(d, {"url": cols(t, "url"), "network": cols(t, "network"), "redirect": cols(t, "redirect"),
                                    "non_url": cols(t, "network", "redirect", "interaction", "itg"), "all": cols(t, *views.VIEW_PREFIX)})


@query("stratified_eval")
def _(t):
    d = t.views.join(strata(t).select("trace_id", "stratum"), "trace_id")
    d = land(d, "strata")
    sizes = {r["stratum"]: r["least"] for r in d.groupBy("stratum").agg(F.least(
        F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).alias("least")).collect()}  # three rows
    out = None
    for s, least in {**sizes, "all": 10}.items():
        if least < 10:
            continue  # too few of one class, as reported by the study itself
        part = d if s == "all" else d.filter(F.col("stratum") == s)
        r = learn.linear_compare(part, {"url": cols(t, "url"), "non_url": cols(t, "network", "redirect", "interaction", "itg")}).withColumn("stratum", F.lit(s))
        out = r if out is None else out.unionByName(r)
    return out


@query("information_gain")
def _(t):
    return learn.information_gain(t.views, view_sets(t))


def leveled(t):
    """All truncation levels at once: (trace, level) pairs are traces of their own."""
    levels = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(e).alias("me"), F.lit(r).alias("mr")) for i, (_, e, r) in enumerate(fixed.TRUNCATION_LEVELS)])

    def wide(df):
        return df.withColumn("l", F.explode(levels)).withColumn("trace_id", F.col("trace_id") * 10 + F.col("l.k"))

    ev = wide(events.event_sequence(t.ev).drop("node", "prev_node", "nav")).filter("idx < l.me").select(*t.ev.columns)
    rd = wide(t.rd).filter("pos < l.mr").select(*t.rd.columns)
    return wide(t.tr.filter("success")).select(*t.tr.columns), land(ev, "level-events"), land(rd, "level-hops")


@query("depth_ablation")
def _(t):
    tr, ev, rd = leveled(t)
    nodes, edges = land(graph.itg_nodes(tr, ev, rd), "level-nodes"), land(graph.itg_edges(ev, rd), "level-edges")
    itg = land(views.itg_view(nodes.join(tr.select("trace_id"), "trace_id", "left_semi"), edges.join(tr.select("trace_id"), "trace_id", "left_semi")).join(
        tr.select("trace_id", "y"), "trace_id"), "level-itg")
    out = None
    for k, (name, _, _) in enumerate(fixed.TRUNCATION_LEVELS):
        part = itg.filter(F.col("trace_id") % 10 == k)
        size = part.agg(F.avg("num_nodes").alias("avg_nodes"), F.avg("num_edges").alias("avg_edges")).withColumn("method", F.lit(name))
        r = learn.linear_compare(part, {name: list(fixed.ITG_COLS)}).join(size, "method")
        out = r if out is None else out.unionByName(r)
    return out


@query("baseline_suite")
def _(t):
    """Eight baselines shaped after the literature on columns of the graph, five on views of their own."""
    balanced = fits.boosted(150, 5, balanced=True)
    learners = {"crp_mlp": fits.network(64, 32, rounds=500), "redirect_gbm": fits.boosted(200, 5, balanced=True), "url_rf": fits.forest(100, depth=10),
                "visual_mlp": fits.network(128, 64, 32, rounds=600), "all_rf": fits.forest(100), "behaviour_gbm": balanced}
    voters = {"rf": fits.forest(100), "gbm": fits.boosted(100, 5, balanced=True), "lr": fits.logistic()}
    d = land(t.itg.join(t.tr.filter("success").select("trace_id", "y"), "trace_id"), "baselines")
    keys = {f"vote:{v}": (list(fixed.METHOD_COLUMNS["vote_all"]), learner) for v, learner in voters.items()}
    oof = learn.out_of_fold_whole(d, {m: (list(fixed.METHOD_COLUMNS[m]), learner) for m, learner in learners.items()} | keys)
    single = learn.fold_metrics(oof.filter("method NOT LIKE 'vote:%'"), ["method"])
    # soft vote of a forest, a boosted ensemble and a linear model over the same columns
    p = oof.filter("method LIKE 'vote:%'").groupBy("trace_id", "y", "fold").agg(F.avg("score").alias("score"))
    voted = learn.fold_metrics(p.select("*", (F.col("score") > 0.5).cast("int").alias("pred"), F.lit("vote_all").alias("method")), ["method"])
    # the radial kernel's features in front of the linear machine
    wide, names = learn.fourier_features(d.select("trace_id", "y", *fixed.METHOD_COLUMNS["topology_svm"]), list(fixed.METHOD_COLUMNS["topology_svm"]))
    radial = learn.cross_validate(wide, names, learn.svm(10.0), stats.fold_count(d), "topology_svm")
    content = views.prefixed(views.content_view(t.tr, t.ev), "c_")
    v = land(t.views.select("trace_id", "y", *cols(t, "url", "network", "redirect")).join(content, "trace_id"), "view-baselines")
    u, r, n, c = cols(t, "url"), cols(t, "redirect"), cols(t, "network"), [x for x in content.columns if x != "trace_id"]
    own = learn.evaluate(v, {"view_url_rf": (u, fits.forest(200)), "view_redirect_gbm": (r, fits.boosted(200, 5)), "view_network_rf": (n, fits.forest(200)),
                             "view_content_lr": (c, fits.logistic())})
    every = [*u, *r, *n, *c]
    stack = learn.stacked_whole(v, {"rf": (every, fits.forest(100)), "gbm": (every, fits.boosted(100, 5)), "lr": (every, fits.logistic())},
                                [fits.logistic(balanced=False)], [], "view_stack", 10, 5)
    out = single
    for part in (radial, voted, own, stack):
        out = out.unionByName(part.select(single.columns))
    return out


@query("graph_embed_eval")
def _(t):
    e = embed.gcn_embed(embed.node_features_16(t.tr, t.ev), embed.gcn_graph(t.ev))
    names = [c for c in e.columns if c != "trace_id"]
    d = land(e.join(t.tr.filter("success").select("trace_id", "y"), "trace_id"), "embedded")
    m = learn.compare(d, {"rf": (names, RF), "lr": (names, LR)}, FOLDS)
    return m.orderBy(F.desc("f1"), "method").limit(1)


@query("graph_hybrid_clf")
def _(t):
    """Labels, spectrum and walks; the label vocabulary comes from the training rows only."""
    split = stats.stratified_split(t.tr.filter("success").select("trace_id", "y"))
    split = land(split, "split")
    train = split.filter("is_train = 1").select("trace_id")
    vocab = land(structure.vocab_top_k(t.wl.join(train, "trace_id", "left_semi")), "vocabulary")
    labels = [r["label"] for r in vocab.select("label").collect()]  # at most 256
    w = structure.wl_vectors(t.wl, vocab).groupBy("trace_id").pivot("label", labels).agg(F.max("weight")).na.fill(0.0)
    names = [f"wl_{i}" for i in range(len(labels))]
    w = w.select("trace_id", *[F.col(f"`{lab}`").alias(n) for lab, n in zip(labels, names)])
    s = structure.spectral_moments(t.nodes, t.bag)
    r = structure.random_walk_stats(t.nodes, t.bag)
    d = land(split.join(w, "trace_id", "left").join(s, "trace_id").join(r, "trace_id").na.fill(0.0), "hybrid")
    x = [c for c in d.columns if c not in ("trace_id", "y", "is_train")]
    model = learn.fit(learn.prepare(d.filter("is_train = 1"), x, 2), GBM, len(x))
    test = VectorAssembler(inputCols=x, outputCol="raw").transform(d.filter("is_train = 0"))
    p = learn.predict(model, test, ["trace_id", "y"]).withColumn("method", F.lit("hybrid"))
    return stats.binary_metrics(p, ["method"])


@query("train_score")
def _(t):
    split = land(stats.stratified_split(t.views.select("trace_id", "y", *G)), "split")
    return learn.train_score(split.filter("is_train = 1"), split.filter("is_train = 0"), G, RF, scratch_path(t.spark, "model"))


@query("feature_importance")
def _(t):
    return learn.feature_importance(t.views, cols(t, "itg"), RF)


@query("gradient_perturb")
def _(t):
    pick = [f"u_{c}" for c in fixed.URL_COLS]
    d = land(stats.stratified_split(t.views.select("trace_id", "y", *pick)), "split")
    z = land(stats.standard_scale(d.filter("is_train = 1"), d, pick), "scaled")
    train = VectorAssembler(inputCols=pick, outputCol="x").transform(stats.balanced_weights(z.filter("is_train = 1")))
    model = learn.landed_model(Pipeline(stages=[LR(1000, len(pick))]).fit(train.select("y", "x", "weight")))
    test = z.filter("is_train = 0")
    p = learn.gradient_perturb(test, model, pick, [0.01, 0.05, 0.1, 0.2, 0.5])
    clean = learn.predict(model, VectorAssembler(inputCols=pick, outputCol="x").transform(test), ["trace_id", "y"])
    pair = p.select("trace_id", "y", "epsilon", F.col("pred").alias("attacked_pred")).join(
        clean.select("trace_id", F.col("pred").alias("clean_pred")), "trace_id")
    return stats.evasion_rate(pair, ["epsilon"])


@query("progressive_corruption")
def _(t):
    """Six view models; views turn benign one after the other, in order, for the positives of the test rows."""
    sets = view_sets(t)
    every = [c for cs in sets.values() for c in cs]
    d = land(stats.stratified_split(t.views.select("trace_id", "y", *every)), "split")
    train, test = d.filter("is_train = 1"), d.filter("is_train = 0")
    attacked = land(perturb.benign_replacement(test, every), "attacked")
    sides = {"clean": test, "bad": attacked}
    out = test.select("trace_id", "y")
    for v, cs in sets.items():
        model = learn.fit(learn.prepare(train, cs, 2), LR, len(cs))
        for side, df in sides.items():
            x = VectorAssembler(inputCols=cs, outputCol="raw", handleInvalid="keep").transform(df)
            out = out.join(learn.predict(model, x, ["trace_id"]).select("trace_id", F.col("score").alias(f"{side}_{v}")), "trace_id")
    out = land(out, "corruption")
    names = list(sets)
    rows = out.select("trace_id", "y", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("n_corrupted"), *[f"{s}_{v}" for s in sides for v in names])
    score = sum((F.when(F.col("n_corrupted") > i, F.col(f"bad_{v}")).otherwise(F.col(f"clean_{v}")) for i, v in enumerate(names)), F.lit(0.0)) / len(names)
    clean = sum((F.col(f"clean_{v}") for v in names), F.lit(0.0)) / len(names)
    p = rows.select("trace_id", "y", "n_corrupted", (score >= 0.5).cast("int").alias("pred"), (score >= 0.5).cast("int").alias("attacked_pred"),
                    (clean >= 0.5).cast("int").alias("clean_pred"))
    m = stats.binary_metrics(p, ["n_corrupted"]).select("n_corrupted", "f1")
    return m.join(stats.evasion_rate(p, ["n_corrupted"]), "n_corrupted")


# ---------------------------------------------------------------- explanation
EXP = ITG_CTE + """,
lf AS (SELECT trace_id, y, feature, value::DOUBLE AS value FROM (SELECT itg.trace_id, y, unnest(['""" + "', '".join(fixed.ITG_COLS) + """']) AS feature,
   unnest([""" + ", ".join(f"{c}::DOUBLE" for c in fixed.ITG_COLS) + """]) AS value FROM itg JOIN tr USING (trace_id))),
im0 AS (SELECT feature, abs(covar_pop(value, y)) AS c, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS std FROM lf GROUP BY 1),
im AS (SELECT feature, mean, std, (c / std) / (SELECT sum(c / std) FROM im0) AS importance FROM im0),
at0 AS (SELECT trace_id, feature, value, importance * (1 + abs((value - mean) / std)) AS w FROM lf JOIN im USING (feature)),
at1 AS (SELECT *, w / (sum(w) OVER (PARTITION BY trace_id) + 1e-10) AS attribution FROM at0),
att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY round(attribution, 9) DESC, feature) AS place FROM at1) WHERE place <= 10),
cat0 AS (SELECT trace_id, CASE """ + " ".join(f"WHEN feature IN {IN(c)} THEN '{k}'" for k, c in fixed.ITG_CATEGORIES.items()) + """ END AS category, sum(attribution) AS s FROM att GROUP BY 1, 2),
cats AS (SELECT trace_id, category, s / (sum(s) OVER (PARTITION BY trace_id) + 1e-10) AS share FROM cat0),
pro AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS std FROM lf WHERE y = 0 GROUP BY 1),
con0 AS (SELECT trace_id, feature, value, mean, abs(value - mean) / std AS z, abs(value - mean) / greatest(0.001, abs(mean)) AS gap FROM lf JOIN pro USING (feature)),
con AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY round(gap, 9) DESC, feature) AS place FROM con0 WHERE z > 1) WHERE place <= 8)"""


def labelled_itg(t):
    return t.itg.join(t.tr.select("trace_id", "y"), "trace_id")


def feature_table(t):
    """Importance (absolute correlation with the label, normalised) with mean and deviation, one row per feature."""
    d = labelled_itg(t)
    one = d.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.covar_pop(c, "y")).alias("c"), F.avg(c).alias("mean"),
                                   F.stddev_pop(c).alias("s")) for c in fixed.ITG_COLS]).alias("a"))
    f = one.select(F.explode("a").alias("a")).select("a.*").withColumn("std", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    from pyspark.sql import Window
    f = f.withColumn("importance", F.col("c") / F.col("std")).withColumn("importance", F.col("importance") / F.sum("importance").over(Window.partitionBy(F.lit(1))))
    return land(f.select("feature", "importance", "mean", "std"), "importance")


def attributions(t):
    f = feature_table(t)
    return explain.attribution(labelled_itg(t), f.select("feature", "importance"), f.select("feature", "mean", "std"), fixed.ITG_COLS)


@query("attribution", sql(G_ALL + EXP, f"SELECT trace_id, place, feature, {R('value')} AS value, {R('attribution')} AS attribution FROM att"))
def _(t):
    return attributions(t)


@query("top_features", sql(G_ALL + EXP, "SELECT trace_id, string_agg(feature, ', ' ORDER BY place) AS factors FROM att WHERE place <= 3 GROUP BY 1"))
def _(t):
    a = attributions(t).filter("place <= 3").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("f"))
    return a.select("trace_id", F.array_join("f.feature", ", ").alias("factors"))


@query("category_contrib", sql(G_ALL + EXP, f"SELECT trace_id, category, {R('share')} AS share FROM cats"))
def _(t):
    return explain.category_contrib(attributions(t))


@query("category_share", sql(G_ALL + EXP, f"SELECT category, {R('m / sum(m) OVER ()')} AS share FROM (SELECT category, avg(share) AS m FROM cats GROUP BY 1)"))
def _(t):
    return explain.category_share(explain.category_contrib(attributions(t)))


@query("contrastive", sql(G_ALL + EXP, f"SELECT trace_id, place, feature, {R('value')} AS value, {R('mean')} AS benign_avg, {R('z')} AS z FROM con"))
def _(t):
    d = labelled_itg(t)
    return explain.contrastive(d, stats.benign_prototype(d, fixed.ITG_COLS), fixed.ITG_COLS).drop("description")


def explanations(t):
    d = labelled_itg(t)
    v = rules.heuristic_verdict(t.itg)
    scored = v.select("trace_id", F.when(F.col("is_phishing") == 1, "phishing").otherwise("benign").alias("label"), "confidence",
                      F.col("risk_score").alias("prob_phishing"))
    a = land(attributions(t), "attributions")
    con = explain.contrastive(d, stats.benign_prototype(d, fixed.ITG_COLS), fixed.ITG_COLS)
    return explain.explain(t.tr, scored, a, explain.category_contrib(a), critical.critical_path(t.nodes, t.edges), con)


@query("explain")
def _(t):
    e = explanations(t)
    return e.select("trace_id", "url", "prediction", "confidence", "risk_score", F.size("top_features").alias("n_features"), "critical_path", "summary")


@query("summary_text")
def _(t):
    return explanations(t).select("trace_id", "summary")


@query("explain_report")
def _(t):
    return explain.explain_report(explanations(t)).select("trace_id", "prediction", "risk_score", "summary")
