"""Folds, metrics, windows and robustness transforms."""

from pyspark.sql import functions as F

from tracegraph.functions import fixed, ordered
from tracegraph.operators import attacks, domains, events, perturb, rules, stats, views
from tracegraph.plans.base_sql import ALL, DIV, DOM, G_ALL, HOSTS, I, LIST, R, SERP, sql
from tracegraph.plans.cat_rules import C48, DS, RISK_CTE, SS
from tracegraph.plans.cat_views import (BASE4, CLEAN_SQL, CROSS_CTE, ENG_EXPR, ITG_CTE, NET_CTE, S8, URL_CTE)
from tracegraph.plans.registry import query

# ---------------------------------------------------------------- scored methods
FOLD = """,
lab AS MATERIALIZED (SELECT trace_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42|' || trace_id), trace_id) - 1) AS pos,
   count(*) OVER (PARTITION BY y) AS ny FROM tr WHERE success)"""
METHODS = RISK_CTE + URL_CTE + FOLD + f""",
ms AS MATERIALIZED (SELECT trace_id, y, pos % 10 AS fold, unnest(['risk', 'invariant', 'lexical', 'forms']) AS method,
   unnest([risk_score, ((num_forms > 0 AND external_redirects > 0)::INT + (requests_sensitive_data > 0 AND num_redirects > 0)::INT
     + (num_forms >= 2 AND external_redirects > 0)::INT) / 3.0, 1 - {CLEAN_SQL}, least(1.0, form_to_node_ratio * 4)]::DOUBLE[]) AS score
   FROM lab JOIN risk USING (trace_id) JOIN uv USING (trace_id)),
sp AS MATERIALIZED (SELECT * REPLACE (round(score, 9) AS score), (round(score, 9) >= CASE method WHEN 'risk' THEN 0.4 WHEN 'invariant' THEN 0.5 WHEN 'lexical' THEN 0.3 ELSE 0.25 END)::INT AS pred FROM ms)"""
METRIC = lambda k: f"""SELECT {k}, tp, fp, fn, tn, {DIV('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {DIV('tp', 'tp + fp')} AS "precision", {DIV('tp', 'tp + fn')} AS recall,
  {DIV('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT {k}, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred <> 1) AS fn, count(*) FILTER (y <> 1 AND pred <> 1) AS tn FROM sp GROUP BY {k})"""
MET = METHODS + f",\nmm AS ({METRIC('method')}),\nmf AS ({METRIC('method, fold')})"


def method_scores(t):
    """(trace_id, y, fold, method, score, pred) of four transparent scorers."""
    c = F.col
    base = stats.stratified_folds(t.tr.filter("success").select("trace_id", "y"))
    inv = rules.invariants(t.itg)
    risk = rules.risk_patterns(t.itg).select("trace_id", "risk_score")
    lex = views.url_view(t.tr).select("trace_id", (1 - views.url_cleanliness()).alias("lexical"))
    j = base.join(risk, "trace_id").join(inv, "trace_id").join(lex, "trace_id").join(
        t.itg.select("trace_id", "form_to_node_ratio"), "trace_id")
    pairs = [("risk", c("risk_score"), 0.4), ("invariant", (c("i1").cast("int") + c("i2").cast("int") + c("i3").cast("int")) / 3.0, 0.5),
             ("lexical", c("lexical"), 0.3), ("forms", F.least(F.lit(1.0), c("form_to_node_ratio") * 4), 0.25)]
    arr = F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("score"), (F.round(s, 9) >= cut).cast("int").alias("pred")) for m, s, cut in pairs])
    return j.select("trace_id", "y", "fold", F.explode(arr).alias("m")).select("trace_id", "y", "fold", "m.*")


@query("stratified_folds", sql(ALL + FOLD, "SELECT trace_id, y::BIGINT AS y, pos % 10 AS fold FROM lab"))
def _(t):
    d = t.tr.filter("success").select("trace_id", "y")
    return stats.stratified_folds(d, stats.fold_count(d))


@query("stratified_split", sql(ALL + FOLD, "SELECT trace_id, y::BIGINT AS y, (pos < round(ny * 0.7))::BIGINT AS is_train FROM lab"))
def _(t):
    return stats.stratified_split(t.tr.filter("success").select("trace_id", "y")).select("trace_id", "y", "is_train")


@query("balanced_weights", sql(ALL + FOLD, f"SELECT y::BIGINT AS y, {R('(SELECT count(*) FROM lab) / (2 * count(*))')} AS weight, count(*) AS n FROM lab GROUP BY 1"))
def _(t):
    return stats.balanced_weights(t.tr.filter("success").select("trace_id", "y")).groupBy("y", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("method_scores", sql(G_ALL + METHODS, f"SELECT trace_id, y::BIGINT AS y, fold, method, {R('score')} AS score, pred::BIGINT AS pred FROM sp"))
def _(t):
    return method_scores(t)


@query("binary_metrics", sql(G_ALL + MET, f"""SELECT method, tp, fp, fn, tn, {R('accuracy')} AS accuracy, {R('"precision"')} AS "precision", {R('recall')} AS recall, {R('f1')} AS f1 FROM mm"""))
def _(t):
    return stats.binary_metrics(method_scores(t), ["method"])


@query("roc_auc", sql(G_ALL + METHODS, f"""SELECT method, {R('(sum(CASE WHEN y = 1 THEN rk END) - p * (p + 1) / 2) / (p * n)')} AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS rk,
  count(*) FILTER (y = 1) OVER (PARTITION BY method) AS p, count(*) FILTER (y <> 1) OVER (PARTITION BY method) AS n FROM sp) GROUP BY method, p, n"""))
def _(t):
    return stats.roc_auc(method_scores(t), ["method"])


@query("fold_metric_summary", sql(G_ALL + MET, f"""SELECT method, {R('avg(f1)')} AS f1, {R('stddev_pop(f1)')} AS f1_std, {R('avg(accuracy)')} AS accuracy,
  {R('stddev_pop(accuracy)')} AS accuracy_std FROM mf GROUP BY 1"""))
def _(t):
    return stats.fold_metric_summary(stats.binary_metrics(method_scores(t), ["method", "fold"]), ["method"], ["f1", "accuracy"])


@query("leaderboard", sql(G_ALL + MET, f"SELECT method, {R('f1')} AS f1, row_number() OVER (ORDER BY mm.f1 DESC, method) AS place FROM mm"))
def _(t):
    m = stats.binary_metrics(method_scores(t), ["method"])
    from pyspark.sql import Window
    return m.select("method", "f1", F.row_number().over(Window.orderBy(F.desc("f1"), "method")).alias("place"))  # a few methods


@query("best_baseline_gain", sql(G_ALL + MET, f"""SELECT {R('a.f1')} AS f1, b.method AS best_baseline, {R('b.f1')} AS baseline_f1,
  {R(DIV('(a.f1 - b.f1) * 100', 'b.f1'))} AS gain_pct FROM (SELECT f1 FROM mm WHERE method = 'risk') a, (SELECT * FROM mm WHERE method <> 'risk' ORDER BY f1 DESC, method DESC LIMIT 1) b"""))
def _(t):
    return stats.best_baseline_gain(stats.binary_metrics(method_scores(t), ["method"]), "risk")


@query("welch_t", sql(G_ALL + MET + """,
fs AS (SELECT method, avg(f1) AS m, stddev_pop(f1) AS s, count(*) AS n FROM mf GROUP BY 1), r AS (SELECT * FROM fs WHERE method = 'risk')""",
    f"""SELECT fs.method, {R('r.m - fs.m')} AS delta, {R(DIV('(r.m - fs.m)', 'sqrt(power(greatest(r.s, 1e-6), 2) / fs.n + fs.s * fs.s / fs.n)'))} AS t FROM fs, r WHERE fs.method <> 'risk'"""))
def _(t):
    return stats.welch_t(stats.binary_metrics(method_scores(t), ["method", "fold"]), "risk")


PAIRS = MET + """,
pr AS (SELECT b.method, a.fold, a.f1 AS a, b.f1 AS b FROM mf a JOIN mf b ON a.fold = b.fold AND a.method = 'risk' AND b.method <> 'risk')"""


def fold_pairs(t):
    f = stats.binary_metrics(method_scores(t), ["method", "fold"]).select("method", "fold", "f1")
    a = f.filter("method = 'risk'").select("fold", F.col("f1").alias("a"))
    return f.filter("method <> 'risk'").select("method", "fold", F.col("f1").alias("b")).join(a, "fold").select("method", "fold", "a", "b")


@query("experiment_pair_join", sql(G_ALL + PAIRS, f"SELECT method, fold, {R('a')} AS a, {R('b')} AS b FROM pr"))
def _(t):
    return fold_pairs(t)


@query("wilcoxon_signed_rank", sql(G_ALL + PAIRS, f"""SELECT method, {R('sum(CASE WHEN d > 0 THEN rk ELSE 0 END)')} AS w_plus, {R('sum(CASE WHEN d < 0 THEN rk ELSE 0 END)')} AS w_minus,
  {R('least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))')} AS statistic FROM (
  SELECT *, rank() OVER (PARTITION BY method ORDER BY m) + (count(*) OVER (PARTITION BY method, m) - 1) / 2 AS rk FROM (
    SELECT method, a - b AS d, round(abs(a - b), 12) AS m FROM pr WHERE a <> b)) GROUP BY 1"""))
def _(t):
    return stats.wilcoxon_signed_rank(fold_pairs(t), ["method"])


# ---------------------------------------------------------------- strata
STR = URL_CTE + f""",
cle AS MATERIALIZED (SELECT trace_id, {CLEAN_SQL} AS cleanliness FROM uv),
cut AS (SELECT quantile_cont(cleanliness, 0.333) AS t33, quantile_cont(cleanliness, 0.667) AS t67 FROM cle),
stt AS MATERIALIZED (SELECT trace_id, cleanliness, CASE WHEN cleanliness <= t33 THEN 'dirty' WHEN cleanliness <= t67 THEN 'medium' ELSE 'clean' END AS stratum FROM cle, cut)"""


def strata(t):
    return stats.tertile_strata(views.url_view(t.tr).select("trace_id", views.url_cleanliness().alias("cleanliness")))


@query("exact_percentiles", sql(ALL + STR, f"SELECT {R('t33')} AS t33, {R('t67')} AS t67 FROM cut"))
def _(t):
    c = views.url_view(t.tr).select("trace_id", views.url_cleanliness().alias("cleanliness"))
    return ordered.exact_percentiles(c, "cleanliness", {"t33": 0.333, "t67": 0.667})


@query("tertile_strata", sql(ALL + STR, f"SELECT trace_id, {R('cleanliness')} AS cleanliness, stratum FROM stt"))
def _(t):
    return strata(t)


@query("invariance_ratio", sql(G_ALL + METHODS + STR.replace(URL_CTE, "") + f""",
sps AS (SELECT sp.*, stratum FROM sp JOIN stt USING (trace_id) UNION ALL SELECT *, 'all' FROM sp),
sm AS (SELECT method, stratum, {DIV("2 * count(*) FILTER (y = 1 AND pred = 1)", "count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)")} AS f1 FROM sps GROUP BY 1, 2),
ir AS (SELECT method, max(f1) FILTER (stratum = 'clean') AS c, max(f1) FILTER (stratum = 'all') AS a, max(f1) FILTER (stratum = 'medium') AS m FROM sm GROUP BY 1)""",
    f"SELECT method, {R('c / greatest(a, 1e-6)')} AS invariance, {R(DIV('c', 'm'))} AS clean_to_medium FROM ir"))
def _(t):
    s = method_scores(t).join(strata(t).select("trace_id", "stratum"), "trace_id")
    both = s.select("trace_id", "y", "pred", "method", F.explode(F.array("stratum", F.lit("all"))).alias("stratum"))
    return stats.invariance_ratio(stats.binary_metrics(both, ["method", "stratum"]), ["method"])


@query("class_means", sql(ALL + URL_CTE, "SELECT y::BIGINT AS y, " + ", ".join(f"{R(f'avg({c})')} AS {c}" for c in fixed.URL_COLS) + " FROM uv JOIN tr USING (trace_id) GROUP BY 1"))
def _(t):
    return views.url_view(t.tr).join(t.tr.select("trace_id", "y"), "trace_id").groupBy("y").agg(*[F.avg(c).alias(c) for c in fixed.URL_COLS])


@query("benign_prototype", sql(G_ALL + ITG_CTE + """,
bp AS (SELECT itg.* FROM itg JOIN tr USING (trace_id) WHERE y = 0)""", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'avg({c})')} AS mean, {R(f'CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END')} AS std FROM bp" for c in fixed.ITG_COLS)))
def _(t):
    return stats.benign_prototype(t.itg.join(t.tr.select("trace_id", "y"), "trace_id"), fixed.ITG_COLS)


def scaled_sql(c: str) -> str:
    return R(f"({c} - (SELECT avg({c}) FROM nt WHERE is_train)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM nt WHERE is_train)")


@query("standard_scale", sql(ALL + NET_CTE + FOLD + """,
nt AS MATERIALIZED (SELECT nv.*, pos < round(ny * 0.7) AS is_train FROM nv JOIN lab USING (trace_id))""",
    "SELECT trace_id, " + ", ".join(f"{scaled_sql(c)} AS {c}" for c in fixed.NETWORK_COLS) + " FROM nt"))
def _(t):
    n = views.network_view(views.request_stats(t.tr, t.rq)).select("trace_id", *fixed.NETWORK_COLS)
    d = stats.stratified_split(t.tr.filter("success").select("trace_id", "y")).join(n, "trace_id")
    return stats.standard_scale(d.filter("is_train = 1"), d, fixed.NETWORK_COLS).select("trace_id", *fixed.NETWORK_COLS)


FEATS = {"url": [f"u_{c}" for c in fixed.URL_COLS], "network": [f"n_{c}" for c in fixed.NETWORK_COLS],
         "redirect": [f"r_{c}" for c in fixed.REDIRECT_COLS], "interaction": [f"i_{c}" for c in fixed.CONTENT_COLS],
         "itg": [f"g_{c}" for c in (*fixed.ITG_COLS, *ENG_EXPR)], "cross": [f"x_{c}" for c in views.CROSS_COLS]}
VTAB = CROSS_CTE + ITG_CTE + FOLD + """,
vt AS MATERIALIZED (SELECT tr.trace_id, tr.y, lab.pos % 5 AS fold, """ + ", ".join(
    [f"{a}.{c} AS {p}{c}" for a, p, cs in (("u", "u_", fixed.URL_COLS), ("n", "n_", fixed.NETWORK_COLS), ("r", "r_", fixed.REDIRECT_COLS),
                                           ("i", "i_", fixed.CONTENT_COLS), ("x", "x_", views.CROSS_COLS)) for c in cs]
    + [f"CASE WHEN g.num_nodes >= 2 THEN round(CAST(g.{c} AS DOUBLE), 9) ELSE 0.0 END AS g_{c}" for c in (*fixed.ITG_COLS, *ENG_EXPR)]) + """
   FROM (SELECT * FROM tr WHERE success) tr JOIN lab ON lab.trace_id = tr.trace_id JOIN uv u ON u.trace_id = tr.trace_id JOIN nv n ON n.trace_id = tr.trace_id
   JOIN rv r ON r.trace_id = tr.trace_id JOIN iv i ON i.trace_id = tr.trace_id JOIN xv x ON x.trace_id = tr.trace_id
   JOIN (SELECT *, """ + ", ".join(f"{e} AS {c}" for c, e in ENG_EXPR.items()) + """ FROM itg) g ON g.trace_id = tr.trace_id)"""


def six_views(t):
    """The view columns; graph features to nine digits, so that no engine's last digit moves a bin."""
    return t.views.withColumns({c: F.round(c, 9) for c in FEATS["itg"]})


MI_SQL = ",\nml AS (" + " UNION ALL ".join(
    f"SELECT y, '{v}' AS view, '{c}' AS f, floor(({c} - (min({c}) OVER () - 1e-8)) / ((max({c}) OVER () + 1e-8) - (min({c}) OVER () - 1e-8)) * 20) AS b FROM vt"
    for v, cs in FEATS.items() for c in cs) + """),
mc AS (SELECT view, f, b, y, count(*)::DOUBLE AS n FROM ml GROUP BY ALL),
mh AS (SELECT view, f, sum(-(ny / t) * log2(ny / t + 1e-12)) AS hy FROM (SELECT view, f, y, sum(n) AS ny, sum(sum(n)) OVER (PARTITION BY f) AS t FROM mc GROUP BY 1, 2, 3) GROUP BY 1, 2),
mb AS (SELECT view, f, sum(nb / t * (-(n / nb) * log2(n / nb + 1e-12))) AS hyb FROM (SELECT *, sum(n) OVER (PARTITION BY f, b) AS nb, sum(n) OVER (PARTITION BY f) AS t FROM mc) GROUP BY 1, 2)"""


@query("mutual_information", sql(G_ALL + VTAB + MI_SQL, f"SELECT view, {R('sum(greatest(0.0, hy - hyb))')} AS mutual_information FROM mh JOIN mb USING (view, f) GROUP BY 1"))
def _(t):
    return stats.mutual_information(six_views(t), FEATS)


def red_sql() -> str:
    from itertools import combinations
    parts = []
    for a, b in combinations(FEATS, 2):
        cells = ", ".join(f"corr({x}, {y})" for x in FEATS[a] for y in FEATS[b])
        parts.append(f"SELECT '{a}' AS view_a, '{b}' AS view_b, [{cells}] AS c FROM vt")
    return ",\nrc AS (" + " UNION ALL ".join(parts) + "),\nrdn AS (SELECT view_a, view_b, coalesce(list_avg(list_transform(list_filter(c, lambda x: x IS NOT NULL AND NOT isnan(x)), lambda x: abs(x))), 0.0) AS redundancy FROM rc)"


@query("view_redundancy", sql(G_ALL + VTAB + red_sql(), f"SELECT view_a, view_b, {R('redundancy')} AS redundancy FROM rdn"))
def _(t):
    return stats.view_redundancy(six_views(t), FEATS)


@query("avg_redundancy_per_view", sql(G_ALL + VTAB + red_sql(), f"""SELECT view, {R('avg(redundancy)')} AS avg_redundancy FROM (SELECT view_a AS view, redundancy FROM rdn
  UNION ALL SELECT view_b, redundancy FROM rdn) GROUP BY 1"""))
def _(t):
    return stats.avg_redundancy_per_view(stats.view_redundancy(six_views(t), FEATS))


# ---------------------------------------------------------------- view order by out-of-fold scores
VO = VTAB + f""",
vl AS MATERIALIZED (SELECT trace_id, y, fold, unnest({LIST([v for v, cs in FEATS.items() for _ in cs])}) AS view, unnest({LIST([c for cs in FEATS.values() for c in cs])}) AS f,
   unnest([{", ".join(f"{c}::DOUBLE" for cs in FEATS.values() for c in cs)}]) AS x FROM vt),
mo AS MATERIALIZED (SELECT f, fold, y, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM vl GROUP BY ALL),
me AS (SELECT f, y, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM mo GROUP BY ALL),
mk AS (SELECT d.f, d.fold, e.y, e.n - coalesce(o.n, 0) AS n, e.s - coalesce(o.s, 0) AS s, e.q - coalesce(o.q, 0) AS q FROM (SELECT DISTINCT f, fold FROM mo) d
   JOIN me e ON e.f = d.f LEFT JOIN mo o ON o.f = d.f AND o.fold = d.fold AND o.y = e.y),
mv AS (SELECT f, fold, y, s / n AS m, greatest(0.0, q / n - (s / n) * (s / n)) + 1e-6 AS v FROM mk WHERE n > 0),
mb2 AS (SELECT f, fold, max(m) FILTER (y = 0) AS m0, max(v) FILTER (y = 0) AS v0, max(m) FILTER (y = 1) AS m1, max(v) FILTER (y = 1) AS v1 FROM mv GROUP BY 1, 2),
od AS MATERIALIZED (SELECT trace_id, y, view, sum(coalesce(-(ln(v1) + (x - m1) * (x - m1) / v1) / 2 + (ln(v0) + (x - m0) * (x - m0) / v0) / 2, 0.0)) AS llr
   FROM vl JOIN mb2 USING (f, fold) GROUP BY ALL),
vo AS (SELECT view, {DIV("2 * count(*) FILTER (y = 1 AND llr > 0)", "count(*) FILTER (y = 1) + count(*) FILTER (llr > 0)")} AS f1 FROM od GROUP BY 1),
vr AS MATERIALIZED (SELECT view, f1, row_number() OVER (ORDER BY round(f1, 9) DESC, view) AS view_rank FROM vo),
gs AS (SELECT trace_id, y, k.view_rank, sum(llr) AS llr FROM od JOIN vr USING (view) JOIN (SELECT view_rank FROM vr) k ON vr.view_rank <= k.view_rank GROUP BY ALL),
gf AS (SELECT view_rank, {DIV("2 * count(*) FILTER (y = 1 AND llr > 0)", "count(*) FILTER (y = 1) + count(*) FILTER (llr > 0)")} AS f1 FROM gs GROUP BY 1)"""


@query("view_order", sql(G_ALL + VO, f"SELECT view, {R('f1')} AS f1, view_rank FROM vr"))
def _(t):
    return stats.view_order(six_views(t), FEATS)[0]


@query("running_view_gain", sql(G_ALL + VO, f"""SELECT view, gf.view_rank, {R('gf.f1')} AS f1,
  {R('gf.f1 - lag(gf.f1, 1, 0.5) OVER (ORDER BY gf.view_rank)')} AS gain FROM gf JOIN vr USING (view_rank)"""))
def _(t):
    return stats.running_view_gain(stats.view_order(six_views(t), FEATS)[1]).select("view", "view_rank", "f1", "gain")


# ---------------------------------------------------------------- runs, sources, pools
RUNS = SS + """,
runs AS (SELECT 'q' || (page_id % 23) AS query, page_id // 23 AS run, (score >= 0.25)::INT AS found, score AS toxicity FROM sc)"""


def runs(t):
    s = domains.serp_score(t.serp)
    return s.select(F.concat(F.lit("q"), (F.col("page_id") % 23).cast("string")).alias("query"), F.floor(F.col("page_id") / 23).alias("run"),
                    (F.col("score") >= 0.25).cast("int").alias("found"), F.col("score").alias("toxicity"))


@query("query_history", sql(RUNS, f"""SELECT query, count(*) AS runs, {I('sum(found)')} AS total_found, {R('avg(toxicity)')} AS avg_toxicity, min(run) AS first_run, max(run) AS last_run FROM runs GROUP BY 1"""))
def _(t):
    return stats.query_history(runs(t))


@query("running_mean_toxicity", sql(RUNS, f"SELECT query, run, {R('avg(toxicity) OVER (PARTITION BY query ORDER BY run ROWS UNBOUNDED PRECEDING)')} AS running_mean FROM runs"))
def _(t):
    return stats.running_mean_toxicity(runs(t))


@query("cycle_stats", sql(ALL, """SELECT n_week, count(*) AS processed, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed,
  count(*) FILTER (success AND y = 1) AS phishing, count(*) FILTER (success AND y = 0) AS benign, count(*) FILTER (elements_interacted = 0) AS dead
  FROM (SELECT *, trace_id % 100 AS n_week FROM tr) GROUP BY 1"""))
def _(t):
    return t.tr.groupBy((F.col("trace_id") % 100).alias("n_week")).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success") & (F.col("y") == 1)).alias("phishing"), F.count_if(F.col("success") & (F.col("y") == 0)).alias("benign"),
        F.count_if(F.col("elements_interacted") == 0).alias("dead"))


@query("source_label_counts", sql(ALL, f"""SELECT coalesce(source, 'all') AS source, coalesce(label, 'all') AS label, count(*) AS n FROM (SELECT {DOM('url')}[-3:] AS source,
  CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END AS label FROM tr) GROUP BY CUBE (source, label)"""))
def _(t):
    from tracegraph.functions import urls
    d = t.tr.select(F.substring(urls.domain_of("url"), -3, 3).alias("source"), F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"))
    return d.cube("source", "label").agg(F.count(F.lit(1)).alias("n")).na.fill("all", ["source", "label"])


SV = """,
sv AS (SELECT resource_type AS source, coalesce('http_' || status, 'no_answer') AS reason, coalesce(status, 0) BETWEEN 200 AND 399 AS valid FROM rq),
sr AS (SELECT source, reason, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, reason) AS rk FROM sv WHERE NOT valid GROUP BY 1, 2),
sst AS (SELECT source, count(*) AS total, count(*) FILTER (valid) AS n_valid FROM sv GROUP BY 1)"""


@query("source_validation_summary", sql(ALL + SV, f"""SELECT sst.source, total, n_valid, {R('n_valid * 100 / greatest(1, total)')} AS valid_rate, reason, n, rk
  FROM sst JOIN sr ON sr.source = sst.source WHERE rk <= 15"""))
def _(t):
    from pyspark.sql import Window
    s = F.coalesce("status", F.lit(0))
    d = t.rq.select(F.col("resource_type").alias("source"), F.coalesce(F.concat(F.lit("http_"), F.col("status").cast("string")), F.lit("no_answer")).alias("reason"),
                    ((s >= 200) & (s <= 399)).alias("valid"))
    total = d.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("n_valid"))
    why = d.filter("NOT valid").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    why = why.withColumn("rk", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "reason"))).filter("rk <= 15")
    return total.join(why, "source").select("source", "total", "n_valid", (F.col("n_valid") * 100 / F.greatest(F.lit(1), F.col("total"))).alias("valid_rate"), "reason", "n", "rk")


@query("experiment_status", sql(ALL, """SELECT CASE WHEN success THEN 'OK' ELSE 'FAILED' END AS status, count(*) AS n, round(sum(end_us - start_us) / 1e6 + 3e-9, 3)::DOUBLE AS seconds FROM tr GROUP BY 1"""))
def _(t):
    return t.tr.groupBy(F.when(F.col("success"), "OK").otherwise("FAILED").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end_us") - F.col("start_us")) / 1e6 + 3e-9, 3).alias("seconds"))


@query("rank_pool_sort", sql(HOSTS, "SELECT domain, coalesce(rnk, 99999) AS pool_rank FROM (SELECT domain, min(CASE WHEN source = 'observed' THEN page_id END) AS rnk FROM hosts GROUP BY 1) ORDER BY 2, 1"))
def _(t):
    p = t.hosts.groupBy("domain").agg(F.min(F.when(F.col("source") == "observed", F.col("page_id"))).alias("r"))
    return p.select("domain", F.coalesce("r", F.lit(99999)).alias("pool_rank")).orderBy("pool_rank", "domain")


@query("pool_shuffle", sql(HOSTS, "SELECT url, md5('42|' || url) AS shuffle_key FROM (SELECT DISTINCT url FROM hosts) ORDER BY 2, 1"))
def _(t):
    p = t.hosts.select("url").distinct().withColumn("shuffle_key", ordered.hash_order(42, "url"))
    return p.orderBy("shuffle_key", "url")


@query("feature_vector", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {R(' + '.join(f'{k + 1} * {c}' for k, c in enumerate(fixed.ITG_COLS)))} AS weighted FROM itg"))
def _(t):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=fixed.ITG_COLS, outputCol="v").transform(t.itg).withColumn("a", vector_to_array("v"))
    total = F.lit(0.0)
    for k in range(len(fixed.ITG_COLS)):
        total = total + (k + 1) * F.col("a")[k]
    return v.select("trace_id", total.alias("weighted"))


@query("feature_subset", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {', '.join(f'{R(c)} AS {c}' for c in fixed.METHOD_COLUMNS['behaviour_gbm'])} FROM itg"))
def _(t):
    return t.itg.select("trace_id", *fixed.METHOD_COLUMNS["behaviour_gbm"])


@query("truncate_trace", sql(G_ALL, """SELECT level, count(*) AS n_traces, sum(n)::BIGINT AS n_events, sum(m)::BIGINT AS n_redirects FROM (
  SELECT tr.trace_id, level, least(me, coalesce(e.n, 0)) AS n, least(mr, coalesce(r.n, 0)) AS m FROM tr, (VALUES ('0-evt', 0, 0), ('1-evt', 1, 0), ('3-evt', 3, 1),
    ('8-evt', 8, 1), ('15-evt', 15, 1), ('all', 4611686018427387904, 4611686018427387904)) l(level, me, mr)
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM en GROUP BY 1) e ON e.trace_id = tr.trace_id LEFT JOIN (SELECT trace_id, count(*) AS n FROM rd GROUP BY 1) r ON r.trace_id = tr.trace_id) GROUP BY 1"""))
def _(t):
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(e).alias("me"), F.lit(r).alias("mr")) for n, e, r in fixed.TRUNCATION_LEVELS])
    e = events.event_sequence(t.ev).select("trace_id", "idx", F.explode(levels).alias("l")).filter("idx < l.me")
    r = t.rd.select("trace_id", "pos", F.explode(levels).alias("l")).filter("pos < l.mr")
    base = t.tr.select("trace_id", F.explode(levels).alias("l")).groupBy("l.level").agg(F.count(F.lit(1)).alias("n_traces"))
    ne = e.groupBy("l.level").agg(F.count(F.lit(1)).alias("n_events"))
    nr = r.groupBy("l.level").agg(F.count(F.lit(1)).alias("n_redirects"))
    return base.join(ne, "level", "left").join(nr, "level", "left").na.fill(0)


@query("pending_targets", sql(HOSTS, """SELECT DISTINCT source, url FROM hosts
  WHERE substr(md5(url), 1, 12) NOT IN (SELECT substr(md5(url), 1, 12) FROM pages WHERE starts_with(url, 'http://'))"""))
def _(t):
    from tracegraph.functions.text import short_md5
    done = t.pages.filter("url LIKE 'http://%'").select(short_md5("url").alias("hash")).distinct()
    return t.hosts.select("source", "url").distinct().withColumn("hash", short_md5("url")).join(done, "hash", "left_anti").select("source", "url")


# ---------------------------------------------------------------- robustness transforms
INJ = f""",
wide AS (SELECT *  REPLACE (event_id * 1000 AS event_id) FROM ev),
spot AS (SELECT trace_id, url, i, {C48("'inject|' || url || '|' || i")} % greatest(1, n_events) AS raw_idx FROM (SELECT *, unnest(range(5)) AS i FROM tr)),
inj0 AS (SELECT trace_id, tus, event_id, event_type, url_after, 'nav' AS tag FROM wide WHERE false UNION ALL SELECT trace_id, tus, event_id, event_type, url_after, element_tag FROM wide
   UNION ALL SELECT s.trace_id, w.tus, w.event_id - 500 + s.i, 'link_detected', s.url, 'a' FROM spot s JOIN wide w ON w.trace_id = s.trace_id AND w.raw_idx = s.raw_idx),
inj AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY tus, event_id) - 1 AS raw_idx FROM inj0)"""
SHOW = "SELECT trace_id, raw_idx, event_type, url_after FROM "


def shown(ev):
    return ev.select("trace_id", "raw_idx", "event_type", "url_after")


@query("inject_nodes", sql(ALL + INJ, SHOW + "inj"))
def _(t):
    return shown(perturb.inject_nodes(t.tr, t.ev))


REW = f""",
rw AS (SELECT a.trace_id, a.raw_idx, a.event_type, CASE WHEN {C48("'rewire|' || a.root_url || '|' || (a.raw_idx // 2)")} / 281474976710656.0 < 0.2 AND b.raw_idx IS NOT NULL
   THEN b.url_after ELSE a.url_after END AS url_after FROM ev a LEFT JOIN ev b ON b.trace_id = a.trace_id AND b.raw_idx // 2 = a.raw_idx // 2 AND b.raw_idx <> a.raw_idx)"""


@query("rewire_edges", sql(ALL + REW, SHOW + "rw"))
def _(t):
    return shown(perturb.rewire_edges(t.ev))


@query("inflate_graph", sql(ALL, SHOW + """(SELECT trace_id, raw_idx, event_type, url_after FROM ev UNION ALL
  SELECT trace_id, n_events + unnest(range(9)), 'navigation', url FROM tr)"""))
def _(t):
    return shown(perturb.inflate_graph(t.tr, t.ev))


@query("combined_structural", sql(ALL + INJ + f""",
cb AS (SELECT i.*, t.url AS root FROM inj i JOIN tr t USING (trace_id)),
cw AS (SELECT a.trace_id, a.raw_idx, a.event_type, CASE WHEN {C48("'rewire|' || a.root || '|' || (a.raw_idx // 2)")} / 281474976710656.0 < 0.2 AND b.raw_idx IS NOT NULL
   THEN b.url_after ELSE a.url_after END AS url_after FROM cb a LEFT JOIN cb b ON b.trace_id = a.trace_id AND b.raw_idx // 2 = a.raw_idx // 2 AND b.raw_idx <> a.raw_idx)""",
   SHOW + "(SELECT * FROM cw UNION ALL SELECT trace_id, n_events + 5 + unnest(range(9)), 'navigation', url FROM tr)"))
def _(t):
    return shown(perturb.combined_structural(t.tr, t.ev))


@query("decoy_links", sql(ALL, SHOW + f"""(SELECT trace_id, raw_idx, event_type, url_after FROM ev UNION ALL
  SELECT trace_id, n_events + i, {LIST([k for _, _, k in fixed.DECOY_KINDS])}[i % 5 + 1], url FROM (SELECT *, unnest(range(10)) AS i FROM tr))"""))
def _(t):
    return shown(perturb.decoy_links(t.tr, t.ev))


@query("split_forms", sql(ALL, """SELECT trace_id, event_type, field, count(*) AS n FROM (SELECT trace_id,
  CASE WHEN form_field NOT IN ('', 'email') AND event_type = 'submit' THEN 'form_input' ELSE event_type END AS event_type,
  unnest(CASE WHEN event_type = 'submit' AND form_field NOT IN ('', 'email') THEN [form_field, 'email'] WHEN event_type = 'submit' AND form_field = 'email' THEN ['email']
    WHEN form_field <> '' THEN [form_field] ELSE [''] END) AS field FROM ev) GROUP BY 1, 2, 3"""))
def _(t):
    fields = F.when((F.col("event_type") == "submit") & (F.col("form_field") != ""), F.array_distinct(F.array("form_field", F.lit("email")))).otherwise(F.array("form_field"))
    s = perturb.split_forms(t.ev.withColumn("form_fields", fields))
    return s.select("trace_id", "event_type", F.col("form_fields")[0].alias("field")).groupBy("trace_id", "event_type", "field").agg(F.count(F.lit(1)).alias("n"))


@query("decoy_navigation", sql(ALL, """SELECT trace_id, max(ne)::BIGINT AS n_events, max(nr)::BIGINT AS n_requests, max(nav)::BIGINT AS n_navigation FROM (
  SELECT trace_id, n_events + 10 AS ne, 0 AS nr, 5 AS nav FROM tr UNION ALL SELECT trace_id, 0, count(*) + 20, 0 FROM rq GROUP BY 1) GROUP BY 1"""))
def _(t):
    e, r = perturb.decoy_navigation(t.tr, t.ev, t.rq)
    a = e.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "navigation").alias("n_navigation"))
    return a.join(r.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_requests")), "trace_id")


@query("url_camouflage", sql(ALL, f"""SELECT trace_id, 'https://' || {LIST(fixed.CLEAN_HOSTS)}[{C48("'camouflage|' || url")} % 3 + 1] || '/auth/verify' AS url FROM tr"""))
def _(t):
    return perturb.url_camouflage(t.tr).select("trace_id", "url")


PW = """,
pw AS (SELECT trace_id, min(raw_idx) AS first_pw FROM ev WHERE contains(lower(element_class || element_id || form_field), 'password') GROUP BY 1)"""


@query("form_step_split", sql(ALL + PW, SHOW + """(
  SELECT trace_id, raw_idx + (first_pw IS NOT NULL AND raw_idx >= first_pw)::INT AS raw_idx, event_type, url_after FROM ev LEFT JOIN pw USING (trace_id)
  UNION ALL SELECT trace_id, first_pw, 'navigation', '' FROM pw)"""))
def _(t):
    return shown(perturb.form_step_split(t.ev))


BEN = URL_CTE + """,
bl AS (SELECT uv.*, y FROM uv JOIN tr USING (trace_id) WHERE success),
pool AS (SELECT row_number() OVER (ORDER BY md5('7|' || trace_id), trace_id) - 1 AS slot, """ + ", ".join(f"{c} AS b_{c}" for c in fixed.URL_COLS) + " FROM bl WHERE y = 0)"


def blend_sql(k: float) -> str:
    cols = ", ".join(f"{R(f'CASE WHEN slot IS NULL THEN {c} ELSE {k} * b_{c} + (1 - {k}) * {c} END')} AS {c}" for c in fixed.URL_COLS)
    return f"""SELECT trace_id, {cols} FROM bl
  LEFT JOIN pool ON y = 1 AND slot = {C48("'benign|' || trace_id")} % (SELECT count(*) FROM pool)"""


def labelled_url(t):
    return views.url_view(t.tr).select("trace_id", *fixed.URL_COLS).join(t.tr.filter("success").select("trace_id", "y"), "trace_id")


@query("benign_replacement", sql(ALL + BEN, blend_sql(1.0)))
def _(t):
    return perturb.benign_replacement(labelled_url(t), fixed.URL_COLS).select("trace_id", *fixed.URL_COLS)


@query("benign_replacement_half", sql(ALL + BEN, blend_sql(0.5)))
def _(t):
    return perturb.benign_replacement(labelled_url(t), fixed.URL_COLS, 0.5).select("trace_id", *fixed.URL_COLS)


@query("mean_substitution", sql(ALL + BEN, "SELECT trace_id, " + ", ".join(
    f"{R(f'CASE WHEN y = 1 THEN (SELECT avg(b_{c}) FROM pool) ELSE {c} END')} AS {c}" for c in fixed.URL_COLS) + " FROM bl"))
def _(t):
    return perturb.mean_substitution(labelled_url(t), fixed.URL_COLS).select("trace_id", *fixed.URL_COLS)


def lexical(df):
    return df.withColumn("pred", ((F.col("url_len") > 30) & (F.col("domain_len") > 15)).cast("int"))


CVA = BEN + f""",
cv0 AS ({blend_sql(1.0)}),
cva AS (SELECT bl.trace_id, y, (bl.url_len > 30 AND bl.domain_len > 15)::BIGINT AS clean_pred, (cv0.url_len > 30 AND cv0.domain_len > 15)::BIGINT AS attacked_pred FROM bl JOIN cv0 USING (trace_id))"""


@query("clean_vs_attacked_join", sql(ALL + CVA, "SELECT trace_id, y::BIGINT AS y, clean_pred, attacked_pred FROM cva"))
def _(t):
    d = labelled_url(t)
    return stats.clean_vs_attacked(lexical(d), lexical(perturb.benign_replacement(d, fixed.URL_COLS)))


@query("evasion_rate", sql(ALL + CVA, f"""SELECT count(*) FILTER (y = 1 AND clean_pred = 1) AS detected, count(*) FILTER (y = 1 AND clean_pred = 1 AND attacked_pred = 0) AS evaded,
  {R('count(*) FILTER (y = 1 AND clean_pred = 1 AND attacked_pred = 0) / greatest(1, count(*) FILTER (y = 1 AND clean_pred = 1))')} AS evasion_rate FROM cva"""))
def _(t):
    d = labelled_url(t)
    return stats.evasion_rate(stats.clean_vs_attacked(lexical(d), lexical(perturb.benign_replacement(d, fixed.URL_COLS))))


@query("robustness_report")
def _(t):
    """Verdicts of the rules and of trained forests on clean and transformed traces: accuracy, F1 and evasion per transform and model."""
    a = attacks.attacked_tables(t)
    itg = attacks.attacked_itg(t, a)
    clean = attacks.rule_verdicts(t.itg.withColumn("trace_id", F.col("trace_id") * attacks.CODES))
    labels = t.tr.filter("success").select("trace_id", "y")
    return attacks.report(clean.unionByName(attacks.rule_verdicts(itg)).unionByName(attacks.model_verdicts(t, a, itg)), labels, attacks.NAMES)
