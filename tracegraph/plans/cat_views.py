"""Feature views and path metrics."""

from pyspark.sql import functions as F

from tracegraph.functions import fixed
from tracegraph.operators import events, graph, paths, views
from tracegraph.plans.base_sql import (ALL, ANY, CNT, DIV, DOM, ENDS, ENT, G_ALL, HITS, I, IN, NETLOC, PATH, QUERY, R,
                                       SCHEME, sql)
from tracegraph.plans.cat_graph import CLUST, DEG, SENS, URLN
from tracegraph.plans.registry import NUDGE, query

# ---------------------------------------------------------------- paths
DIST = """,
ie AS (SELECT e.trace_id, a.node_seq AS s, b.node_seq AS t, e.weight FROM edges e
   JOIN nodes a ON a.trace_id = e.trace_id AND a.node = e.src JOIN nodes b ON b.trace_id = e.trace_id AND b.node = e.dst),
reach(trace_id, s, t, d) USING KEY (trace_id, s, t) AS (
   SELECT trace_id, node_seq, node_seq, 0 FROM nodes
   UNION SELECT r.trace_id, r.s, e.t, min(r.d + 1) FROM reach r JOIN ie e ON e.trace_id = r.trace_id AND e.s = r.t
     WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.trace_id = r.trace_id AND x.s = r.s AND x.t = e.t)
     GROUP BY ALL)"""
SIGMA = DIST + """,
reachm AS MATERIALIZED (SELECT * FROM reach),
sg(trace_id, s, t, d, sig) AS (
   SELECT trace_id, node_seq, node_seq, 0, 1.0::DOUBLE FROM nodes
   UNION ALL SELECT g.trace_id, g.s, e.t, g.d + 1, sum(g.sig) FROM sg g JOIN ie e ON e.trace_id = g.trace_id AND e.s = g.t
     JOIN reachm r ON r.trace_id = g.trace_id AND r.s = g.s AND r.t = e.t AND r.d = g.d + 1 GROUP BY g.trace_id, g.s, e.t, g.d + 1)"""
UDIST = """,
iu AS (SELECT trace_id, s, t FROM ie UNION SELECT trace_id, t, s FROM ie),
ureach(trace_id, s, t, d) USING KEY (trace_id, s, t) AS (
   SELECT trace_id, node_seq, node_seq, 0 FROM nodes
   UNION SELECT r.trace_id, r.s, e.t, min(r.d + 1) FROM ureach r JOIN iu e ON e.trace_id = r.trace_id AND e.s = r.t
     WHERE NOT EXISTS (SELECT 1 FROM recurring.ureach x WHERE x.trace_id = r.trace_id AND x.s = r.s AND x.t = e.t)
     GROUP BY ALL),
ucomp AS (SELECT trace_id, s, min(t) AS comp, sum(d) AS sd, max(d) AS md FROM ureach GROUP BY 1, 2),
ucs AS (SELECT trace_id, comp, count(*) AS k, sum(sd) AS sd, max(md) AS md FROM ucomp GROUP BY 1, 2),
ubest AS (SELECT trace_id, count(*) AS num_connected_components, arg_min(k, (-k, comp)) AS k,
   arg_min(sd, (-k, comp)) AS sd, arg_min(md, (-k, comp)) AS diameter FROM ucs GROUP BY 1)"""
CLOSE = """,
nsz AS (SELECT trace_id, count(*) AS n FROM nodes GROUP BY 1),
cin AS (SELECT trace_id, t, count(*) AS r, sum(d) AS sd FROM reach GROUP BY 1, 2),
clo AS (SELECT trace_id, max(CASE WHEN sd > 0 THEN (r - 1.0) * (r - 1.0) / sd / greatest(n - 1, 1) ELSE 0.0 END) AS c
   FROM cin JOIN nsz USING (trace_id) GROUP BY 1)"""
BETW = """,
bt AS (SELECT a.trace_id, a.t AS v, sum(a.sig * b.sig / c.sig) AS b FROM sg a
   JOIN sg b ON b.trace_id = a.trace_id AND b.s = a.t JOIN sg c ON c.trace_id = a.trace_id AND c.s = a.s AND c.t = b.t
     AND c.d = a.d + b.d WHERE a.s <> a.t AND b.s <> b.t GROUP BY 1, 2),
bmax AS (SELECT trace_id, max(b) AS b FROM bt GROUP BY 1)"""


@query("all_pairs_dist", sql(G_ALL + SIGMA, f"""SELECT trace_id, {I('d')} AS d, count(*) AS n_pairs, {I('sum(sig)')} AS n_paths
  FROM sg GROUP BY trace_id, d"""))
def _(t):
    return paths.distance_histogram(t.nodes, t.edges)


@query("path_stats", sql(G_ALL + DIST + UDIST, f"""SELECT trace_id, {R(DIV('sd', 'k * (k - 1)'))} AS avg_path_length,
  {I('diameter')} AS diameter FROM ubest"""))
def _(t):
    return t.paths.select("trace_id", "avg_path_length", "diameter")


@query("wcc", sql(G_ALL + DIST + UDIST, f"""SELECT trace_id, {I('num_connected_components')} AS num_connected_components
  FROM ubest"""))
def _(t):
    return paths.weak_components(t.nodes, t.edges)


@query("closeness_max", sql(G_ALL + DIST + CLOSE, f"SELECT trace_id, {R('c')} AS closeness_centrality_max FROM clo"))
def _(t):
    return t.paths.select("trace_id", "closeness_centrality_max")


@query("betweenness_max", sql(G_ALL + SIGMA + CLOSE + BETW, f"""SELECT trace_id,
  {R("CASE WHEN n > 2 THEN coalesce(b, 0.0) / ((n - 1) * (n - 2)) ELSE 0.0 END")} AS betweenness_centrality_max
  FROM nsz LEFT JOIN bmax USING (trace_id)"""))
def _(t):
    return t.paths.select("trace_id", "betweenness_centrality_max")


@query("redirect_depth", sql(G_ALL + DIST, f"""SELECT r.trace_id, {I('max(d)')} AS max_redirect_depth FROM reach r
  JOIN nodes n ON n.trace_id = r.trace_id AND n.node_seq = r.s AND n.node_type = 'url' GROUP BY 1"""))
def _(t):
    return t.paths.select("trace_id", "max_redirect_depth")


PR = """,
rank_steps AS MATERIALIZED (SELECT trace_id, src, dst, weight / sum(weight) OVER (PARTITION BY trace_id, src) AS p, FALSE AS own FROM edges
   UNION ALL SELECT trace_id, node, node, 0.0, TRUE FROM nodes),
rank_start AS MATERIALIZED (SELECT trace_id, node, count(*) OVER (PARTITION BY trace_id) AS n, (trace_id, node) NOT IN (SELECT (trace_id, src) FROM edges) AS loose FROM nodes),
rank_walk AS (SELECT trace_id, node, n, loose, 1.0::DOUBLE / n AS x, 0 AS k, FALSE AS done FROM rank_start
   UNION ALL SELECT trace_id, node, n, loose, y, k + 1, sum(abs(y - x)) OVER (PARTITION BY trace_id) < n * 1e-6 FROM (
     SELECT c.trace_id, s.dst AS node, max(n) AS n, bool_or(loose) FILTER (own) AS loose, max(x) FILTER (own) AS x,
            0.85::DOUBLE * (sum(x * p) + max(lost) / max(n)) + 0.15::DOUBLE / max(n) AS y, max(k) AS k
     FROM (SELECT *, coalesce(sum(x) FILTER (loose) OVER (PARTITION BY trace_id), 0) AS lost FROM rank_walk WHERE NOT done AND k < 100) c
     JOIN rank_steps s ON s.trace_id = c.trace_id AND s.src = c.node GROUP BY 1, 2)),
rank_best AS MATERIALIZED (SELECT trace_id, max(x) AS pagerank_max FROM rank_walk WHERE done OR k = 100 GROUP BY 1)"""


@query("pagerank_max", sql(G_ALL + PR, f"SELECT trace_id, {R('pagerank_max')} AS pagerank_max FROM rank_best"))
def _(t):
    return t.paths.select("trace_id", "pagerank_max")


# ---------------------------------------------------------------- views
U_DOM = f"lower(split_part(CASE WHEN {NETLOC('url')} <> '' THEN {NETLOC('url')} ELSE {PATH('url')} END, ':', 1))"
URL0 = f""",
u0 AS (SELECT trace_id, url, final_url, lower(url) AS low, {U_DOM} AS d,
   CASE WHEN {PATH('url')} = '' THEN '/' ELSE {PATH('url')} END AS p, {QUERY('url')} AS q FROM tr)"""
PARAMS = ("len(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.+')), "
          "lambda x: split_part(x, '=', 1))))")
URL_EXPR = dict(zip(fixed.URL_COLS, [
    "length(url)", "length(d)", "length(p)", CNT("d", "."), CNT("d", "-"), CNT("url", "_"), CNT("p", "/"), CNT("url", "@"),
    "length(regexp_replace(d, '[^0-9]', '', 'g'))", "regexp_matches(d, '^\\d{1,3}(\\.\\d{1,3}){3}$')::INT",
    f"({SCHEME('url')} = 'https')::INT",
    f"(contains(d, '.') AND string_split(d, '.')[-1] IN {IN(fixed.VIEW_SUSPICIOUS_TLDS)})::INT",
    f"greatest(0, {CNT('d', '.')} - 1)", PARAMS, "contains(url, '%')::INT", ENT("d"), ENT("p"),
    ANY("low", fixed.URL_LOGIN_WORDS) + "::INT", ANY("low", fixed.URL_BRAND_WORDS) + "::INT",
    f"(d <> {DOM('final_url')})::INT", "len(string_split(p, '/')) - 1"]))
URL_CTE = URL0 + ",\nuv AS (SELECT trace_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in URL_EXPR.items()) + " FROM u0)"
RS = f""",
rq1 AS (SELECT *, {DOM('url')} AS d, trim(split_part(coalesce(content_type, ''), ';', 1)) AS ct, coalesce(status, 0) AS s FROM rq),
rs AS (SELECT t.trace_id, count(r.event_id) AS n, count(*) FILTER (resource_type = 'script') AS n_scripts,
   count(*) FILTER (resource_type = 'stylesheet') AS n_stylesheets, count(*) FILTER (resource_type = 'image') AS n_images,
   count(*) FILTER (resource_type IN ('xhr', 'fetch')) AS n_xhr, count(*) FILTER (resource_type = 'document') AS n_documents,
   count(*) FILTER (resource_type = 'font') AS n_fonts, count(DISTINCT d) FILTER (d <> '') AS unique_domains,
   count(*) FILTER (d <> '' AND d <> {DOM('t.final_url')}) AS ext, count(*) FILTER ({ANY('d', fixed.CDN_WORDS)}) AS cdn,
   count(*) FILTER (s BETWEEN 200 AND 299) AS n_2xx, count(*) FILTER (s BETWEEN 300 AND 399) AS n_3xx,
   count(*) FILTER (s BETWEEN 400 AND 499) AS n_4xx, count(*) FILTER (s BETWEEN 500 AND 599) AS n_5xx,
   count(DISTINCT ct) FILTER (ct <> '') AS content_type_diversity,
   CASE WHEN count(*) FILTER (tus > 0) >= 2 THEN (max(tus) - min(tus)) / 1e6 ELSE 0.0 END AS load_duration,
   count(*) FILTER (tus > 0) AS nt
   FROM tr t LEFT JOIN rq1 r USING (trace_id) GROUP BY t.trace_id, t.final_url)"""
NET_EXPR = dict(zip(fixed.NETWORK_COLS, [
    "n", *fixed.NETWORK_COLS[1:8], "ext / greatest(1, n)", "cdn / greatest(1, n)", "n_2xx", "n_4xx", "n_5xx",
    "content_type_diversity", "load_duration", "load_duration / greatest(1, nt - 1)", "n_scripts / greatest(1, n)",
    "n_xhr / greatest(1, n)"]))
NET_CTE = RS + ",\nnv AS (SELECT trace_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in NET_EXPR.items()) + " FROM rs)"
RD_FLAGS = (f"CASE WHEN {DOM('url')} <> '' AND {DOM('prev_url')} <> '' AND {DOM('url')} <> {DOM('prev_url')} THEN 1 ELSE 0 END",
            "CASE WHEN starts_with(prev_url, 'http://') AND starts_with(url, 'https://') THEN 1 ELSE 0 END")
RED0 = f""",
rds AS (SELECT trace_id, count(*) AS nr, count(DISTINCT CASE WHEN {DOM('url')} <> '' THEN {DOM('url')} END) AS ud,
   sum({RD_FLAGS[0]}) AS x, sum({RD_FLAGS[1]}) AS h FROM rd GROUP BY 1),
rj AS (SELECT t.trace_id, {DOM('t.url')} AS d0, {DOM('t.final_url')} AS d1, coalesce(nr, 0) AS nr, coalesce(ud, 0) AS ud,
   coalesce(x, 0) AS x, coalesce(h, 0) AS h, n, n_3xx, n_documents, ext FROM tr t JOIN rs USING (trace_id)
   LEFT JOIN rds USING (trace_id))"""
RED_EXPR = dict(zip(fixed.REDIRECT_COLS, [
    "nr", "ud", "x", "h", "(d0 <> d1)::INT", "n_3xx", "n_documents", "ext / greatest(1, n)", "greatest(nr, n_3xx)",
    ANY("d1", fixed.FREE_HOSTING) + "::INT", f"(d0 IN {IN(fixed.SHORTENERS)})::INT", "n", "ext", "greatest(0, nr - 1)"]))
RED_CTE = RED0 + ",\nrv AS (SELECT trace_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in RED_EXPR.items()) + " FROM rj)"
FT = "lower(element_class || element_id || form_field)"
COUNTS = """count(*) FILTER (event_type IN ('link_detected', 'login_link_follow')) AS n_links,
   count(*) FILTER (event_type IN ('button_detected', 'button_click')) AS n_buttons,
   count(*) FILTER (event_type IN ('input', 'form_input')) AS n_inputs,
   count(*) FILTER (event_type IN ('check', 'select')) AS n_checks,
   count(*) FILTER (event_type IN ('dual_submit_error', 'dual_submit_resubmit')) AS n_dual_submit"""


def page_cte(name: str, src: str, submits: str, total: str) -> str:
    ex = dict(zip(fixed.CONTENT_COLS, [
        ANY("title", fixed.TITLE_LOGIN_WORDS) + "::INT", ANY("title", fixed.TITLE_BRAND_WORDS) + "::INT",
        ANY("title", fixed.TITLE_URGENCY_WORDS) + "::INT", "length(title)", ENT("title"),
        *[f"coalesce({c}, 0)" for c in fixed.CONTENT_COLS[5:14]], "forms_submitted", "dual_submissions",
        "coalesce(n_dual_submit, 0)", "coalesce(n_inputs, 0) / greatest(1, coalesce(total_events, 0))"]))
    return f""",
{name}a AS (SELECT trace_id, {COUNTS}, {submits} AS n_submits, {total} AS total_events,
   max(contains({FT}, 'password')::INT) AS has_password_field, max({ANY(FT, ['email', 'mail', 'user'])}::INT) AS has_email_field,
   CASE WHEN count(*) >= 2 THEN (max(tus) - min(tus)) / 1e6 ELSE 0.0 END AS interaction_duration FROM {src} GROUP BY 1),
{name} AS (SELECT trace_id, {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in ex.items())}
   FROM (SELECT trace_id, lower(coalesce(page_title, '')) AS title, forms_submitted, dual_submissions FROM tr) x
   LEFT JOIN {name}a USING (trace_id))"""


INTER_SRC = """,
evi AS (SELECT * FROM ev WHERE event_type IS DISTINCT FROM 'screenshot' AND element_tag IS DISTINCT FROM 'page'),
evc AS (SELECT * REPLACE (CASE WHEN event_type NOT IN ('screenshot', 'page') THEN event_type END AS event_type) FROM ev)"""
INT_CTE = INTER_SRC + page_cte("iv", "evi", "count(*) FILTER (event_type IN ('submit', 'js_form_submit'))", "count(*)")
CON_CTE = INTER_SRC + page_cte("cvw", "evc", "count(*) FILTER (contains(event_type, 'submit'))", "count(event_type)")
ROUND = lambda cols: ", ".join(f"{R(c)} AS {c}" for c in cols)


@query("url_view", sql(ALL + URL_CTE, f"SELECT trace_id, {ROUND(fixed.URL_COLS)} FROM uv"))
def _(t):
    return views.url_view(t.tr)


@query("network_view", sql(ALL + NET_CTE, f"SELECT trace_id, {ROUND(fixed.NETWORK_COLS)} FROM nv"))
def _(t):
    return views.network_view(views.request_stats(t.tr, t.rq))


@query("redirect_view", sql(ALL + NET_CTE + RED_CTE, f"SELECT trace_id, {ROUND(fixed.REDIRECT_COLS)} FROM rv"))
def _(t):
    return views.redirect_view(t.tr, t.rd, views.request_stats(t.tr, t.rq))


@query("interaction_view", sql(ALL + INT_CTE, f"SELECT trace_id, {ROUND(fixed.CONTENT_COLS)} FROM iv"))
def _(t):
    return views.interaction_view(t.tr, t.ev)


@query("content_view", sql(ALL + CON_CTE, f"SELECT trace_id, {ROUND(fixed.CONTENT_COLS)} FROM cvw"))
def _(t):
    return views.content_view(t.tr, t.ev)


BASE4 = URL_CTE + NET_CTE + RED_CTE + INT_CTE
S8 = lambda c: f"greatest({c}, 1e-8)"
CROSS_EXPR = [
    "u.domain_entropy * n.total_requests", "u.has_suspicious_tld * n.ext_ratio", "u.domain_changed * r.domain_changed",
    "r.num_redirects * i.has_password_field", "r.uses_free_hosting * i.title_has_login",
    "r.cross_domain_redirects * (i.has_password_field + i.has_email_field)", "n.n_xhr * i.has_password_field",
    f"n.n_scripts / {S8('n.total_requests')} * i.total_events", "n.unique_domains * i.n_links",
    "(i.has_password_field + i.has_email_field + u.kw_login) * r.num_redirects", "u.has_suspicious_tld * r.uses_free_hosting",
    f"n.n_xhr / {S8('n.total_requests')} * u.domain_changed"]
CROSS_CTE = BASE4 + ",\nxv AS (SELECT trace_id, " + ", ".join(f"{e} AS cv{k + 1}" for k, e in enumerate(CROSS_EXPR)) + \
    " FROM uv u JOIN nv n USING (trace_id) JOIN rv r USING (trace_id) JOIN iv i USING (trace_id))"


@query("cross_view", sql(ALL + CROSS_CTE, f"SELECT trace_id, {ROUND(views.CROSS_COLS)} FROM xv"))
def _(t):
    return views.cross_view(views.base_views(t.tr, t.ev, t.rq, t.rd))


@query("view_join", sql(ALL + BASE4, "SELECT trace_id, " + ", ".join(
    [f"{R('u.' + c)} AS u_{c}" for c in fixed.URL_COLS] + [f"{R('n.' + c)} AS n_{c}" for c in fixed.NETWORK_COLS]
    + [f"{R('r.' + c)} AS r_{c}" for c in fixed.REDIRECT_COLS] + [f"{R('i.' + c)} AS i_{c}" for c in fixed.CONTENT_COLS])
    + " FROM uv u JOIN nv n USING (trace_id) JOIN rv r USING (trace_id) JOIN iv i USING (trace_id)"))
def _(t):
    return views.base_views(t.tr, t.ev, t.rq, t.rd)


ITG_CTE = PR + DEG + CLUST + SIGMA + UDIST + CLOSE + BETW + f""",
sens AS ({SENS}), urln AS ({URLN}),
tim AS (SELECT trace_id, count(tus) FILTER (tus > 0) AS kk, CASE WHEN count(tus) FILTER (tus > 0) >= 2
   THEN (max(tus) - min(tus)) / 1e6 ELSE 0.0 END AS tt FROM nodes GROUP BY 1),
rdep AS (SELECT r.trace_id, max(d) AS max_redirect_depth FROM reach r
  JOIN nodes n ON n.trace_id = r.trace_id AND n.node_seq = r.s AND n.node_type = 'url' GROUP BY 1),
itg AS (SELECT nn.trace_id, nn.n AS num_nodes, coalesce(m, 0) AS num_edges, {DIV('2 * coalesce(m, 0)', 'nn.n')} AS avg_degree,
   coalesce(maxd, 0) AS max_degree, {DIV('coalesce(m, 0)', 'nn.n * (nn.n - 1)')} AS graph_density, clustering_coefficient,
   num_connected_components, {DIV('sd', 'k * (k - 1)')} AS avg_path_length, diameter, num_forms, num_redirects,
   has_password_input, has_email_input, external_redirects, num_input_fields, num_buttons, num_links, max_redirect_depth,
   num_forms / nn.n AS form_to_node_ratio, tt AS total_interaction_time,
   CASE WHEN kk > 1 THEN tt / (kk - 1) ELSE 0.0 END AS avg_time_between_events,
   CASE WHEN tt > 0 THEN kk / tt ELSE 0.0 END AS event_frequency,
   CASE WHEN nn.n > 2 THEN coalesce(b, 0.0) / ((nn.n - 1) * (nn.n - 2)) ELSE 0.0 END AS betweenness_centrality_max,
   c AS closeness_centrality_max, coalesce(maxi, 0) AS in_degree_max, coalesce(maxo, 0) AS out_degree_max, pagerank_max,
   requests_sensitive_data, credential_fields_count, financial_fields_count
   FROM nn LEFT JOIN dg USING (trace_id) JOIN cl USING (trace_id) JOIN ubest USING (trace_id) JOIN clo USING (trace_id)
   LEFT JOIN bmax USING (trace_id) JOIN sens USING (trace_id) JOIN urln USING (trace_id) JOIN tim USING (trace_id)
   JOIN rdep USING (trace_id) JOIN rank_best USING (trace_id))"""


@query("itg_view", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {ROUND(fixed.ITG_COLS)} FROM itg"))
def _(t):
    return views.itg_view(t.nodes, t.edges, t.shapes)


@query("graph_available_mask", sql(G_ALL + DEG, f"""SELECT trace_id, {I('(n >= 2)::INT')} AS itg_available,
  {R('CASE WHEN n >= 2 THEN n ELSE 0 END')} AS num_nodes FROM tr JOIN nn USING (trace_id)"""))
def _(t):
    return views.graph_available_mask(t.tr, t.itg).select("trace_id", "itg_available", "num_nodes")


ENG_EXPR = {
    "density_x_form_ratio": "graph_density * form_to_node_ratio", "cluster_x_cred": "clustering_coefficient * credential_fields_count",
    "ext_redirect_ratio": f"external_redirects / {S8('num_redirects')}", "nodes_x_sensitive": "num_nodes * requests_sensitive_data",
    "between_x_time": "betweenness_centrality_max * total_interaction_time",
    "pagerank_x_freq": "pagerank_max * event_frequency", "closeness_x_cred": "closeness_centrality_max * credential_fields_count", "edge_node_ratio": f"num_edges / {S8('num_nodes')}",
    "diameter_x_depth": "diameter * max_redirect_depth",
    "degree_asymmetry": f"abs(in_degree_max - out_degree_max) / {S8('(in_degree_max + out_degree_max)')}",
    "auth_risk_score": "has_password_input + has_email_input + financial_fields_count",
    "nav_complexity": "avg_path_length * num_connected_components"}
# ratios over a floored denominator reach 1e8; they are compared to two digits
COARSE = {"ext_redirect_ratio": 2}
COARSE_ANY = COARSE | {"rw_6": 2, "rw_7": 2}
AS_ROUNDED = lambda ex: ", ".join(f"round(CAST({e} AS DOUBLE) + 3e-9, {COARSE_ANY.get(c, 6)}) AS {c}" for c, e in ex.items())


def coarse(df):
    return df.select(*[F.round(F.col(c) + NUDGE, COARSE_ANY[c]).alias(c) if c in COARSE_ANY else F.col(c) for c in df.columns])


@query("itg_engineered", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {AS_ROUNDED(ENG_EXPR)} FROM itg"))
def _(t):
    return coarse(views.itg_engineered(t.itg).select("trace_id", *ENG_EXPR))


PL = lambda p: f"({p}) * log2(greatest({p}, 1e-10))"
FN, LN = f"num_forms / {S8('num_nodes')}", f"num_links / {S8('num_nodes')}"
DRP_SQL = {
    "drp_depth_reached": "least(diameter + max_redirect_depth, 10)", "drp_unique_pages": "num_connected_components + num_redirects",
    "drp_url_transitions": "external_redirects + num_redirects",
    "drp_credential_depth": "CASE WHEN credential_fields_count > 0 THEN least(avg_path_length, 5.0) ELSE 0.0 END",
    "drp_form_diversity": "num_forms", "drp_pruning_ratio": f"least(num_nodes / {S8('num_edges')}, 1.0)",
    "drp_credential_paths_ratio": f"credential_fields_count / {S8('num_nodes')}", "drp_effective_branching": "avg_degree",
    "drp_funnel_width": "num_nodes * graph_density", "drp_navigation_entropy": f"-({PL(FN)} + {PL(LN)})",
    "drp_cred_concentration_early": "event_frequency * 0.5", "drp_cred_concentration_mid": "event_frequency * 0.3",
    "drp_cred_concentration_late": "event_frequency * 0.2",
    "drp_dual_submit_count": "CASE WHEN num_forms >= 2 AND credential_fields_count >= 2 THEN 1.0 ELSE 0.0 END",
    "drp_events_per_page": f"num_edges / {S8('(num_connected_components + num_redirects)')}"}


@query("drp_view", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {AS_ROUNDED(DRP_SQL)} FROM itg"))
def _(t):
    return views.drp_view(t.itg)


def proxy_sql() -> dict[str, str]:
    out = {}
    for i, (a, b) in enumerate(fixed.PROXY_PAIRS):
        out[f"wl_mul_{i}"], out[f"wl_dif_{i}"] = f"{a} * {b}", f"power({a} - {b}, 2)"
    topo = "num_nodes num_edges avg_degree max_degree graph_density clustering_coefficient avg_path_length diameter".split()
    for i, a in enumerate(topo):
        out[f"sp_sq_{i}"] = f"{a} * {a}"
        if i < 7:
            out[f"sp_mul_{i}"] = f"{a} * {topo[i + 1]}"
    ratios = [("in_degree_max", "max_degree"), ("out_degree_max", "max_degree"), ("num_forms", "num_nodes"), ("num_links", "num_nodes"),
              ("num_input_fields", "num_nodes"), ("num_buttons", "num_nodes"), ("credential_fields_count", "num_input_fields"), ("external_redirects", "num_redirects")]
    for i, (a, b) in enumerate(ratios):
        out[f"rw_{i}"] = f"{a} / {S8(b)}"
    out["rw_8"], out["rw_9"] = "ln(1 + num_nodes)", "ln(1 + num_edges)"
    out["rw_10"] = f"betweenness_centrality_max / {S8('closeness_centrality_max')}"
    out["rw_11"] = "event_frequency * total_interaction_time"
    return out


@query("structural_proxy_view", sql(G_ALL + ITG_CTE, f"SELECT trace_id, {AS_ROUNDED(proxy_sql())} FROM itg"))
def _(t):
    return coarse(views.structural_proxy_view(t.itg))


@query("full_feature_matrix", sql(G_ALL + ITG_CTE, "SELECT trace_id, " + AS_ROUNDED(
    {**{c: c for c in fixed.ITG_COLS}, **ENG_EXPR, **DRP_SQL, **proxy_sql()}) + " FROM itg"))
def _(t):
    return coarse(views.full_feature_matrix(t.itg))


@query("all_views", sql(G_ALL + CROSS_CTE + ITG_CTE, "SELECT tr.trace_id, " + ", ".join(
    [f"{R('u.' + c)} AS u_{c}" for c in fixed.URL_COLS] + [f"{R('n.' + c)} AS n_{c}" for c in fixed.NETWORK_COLS]
    + [f"{R('r.' + c)} AS r_{c}" for c in fixed.REDIRECT_COLS] + [f"{R('i.' + c)} AS i_{c}" for c in fixed.CONTENT_COLS]
    + [f"{R('x.' + c)} AS x_{c}" for c in views.CROSS_COLS]
    + [f"CASE WHEN g.num_nodes >= 2 THEN {R('g.' + c)} ELSE 0.0 END AS g_{c}" for c in [*fixed.ITG_COLS, *ENG_EXPR] if c not in COARSE]
    + [f"CASE WHEN g.num_nodes >= 2 THEN round(CAST(g.{c} AS DOUBLE) + 3e-9, {d}) ELSE 0.0 END AS g_{c}" for c, d in COARSE.items()])
    + """ FROM tr JOIN uv u USING (trace_id) JOIN nv n USING (trace_id) JOIN rv r USING (trace_id) JOIN iv i USING (trace_id)
    JOIN xv x USING (trace_id) JOIN (SELECT *, """ + ", ".join(f"{e} AS {c}" for c, e in ENG_EXPR.items()) + """ FROM itg) g USING (trace_id)"""))
def _(t):
    full = views.all_views(t.tr, t.ev, t.rq, t.rd, t.itg).drop("itg_available")
    return full.select(*[F.round(F.col(c) + NUDGE, COARSE[c[2:]]).alias(c) if c[2:] in COARSE and c.startswith("g_") else F.col(c) for c in full.columns])


URLS_SQL = f""",
us AS (SELECT trace_id, url, lower(url) AS low, split_part(CASE WHEN {NETLOC('url')} <> '' THEN {NETLOC('url')}
   ELSE {PATH('url')} END, ':', 1) AS d, CASE WHEN {PATH('url')} = '' THEN '/' ELSE {PATH('url')} END AS p, {QUERY('url')} AS q FROM tr),
us1 AS (SELECT *, len(list_filter(string_split(p, '/'), lambda s: s <> '')) AS seg, len(string_split(d, '.')) AS parts,
   {PARAMS} AS nq, (q <> '')::INT AS has_q, greatest(0, {CNT('d', '.')} - 1) AS subs FROM us),
us2 AS (SELECT *, greatest(2, 1 + parts + seg + nq) AS nn, seg + parts AS depth, length(url) / 20.0 AS tm FROM us1),
us3 AS (SELECT *, greatest(1, nn - 1 + has_q) AS m, CASE WHEN depth > 0 THEN depth / 2.0 ELSE 1.0 END AS apl,
   {ANY('low', ['password', 'pwd'])}::INT AS pw, {ANY('low', ['email', 'mail', 'login'])}::INT AS ml,
   (contains(url, '@'))::INT AS has_at FROM us2)"""
US_EXPR = dict(zip(fixed.ITG_COLS, [
    "nn", "m", "2.0 * m / nn", "least(nn - 1, seg + 2)", "m / (nn * (nn - 1))",
    "CASE WHEN nn <= 2 THEN 0.0 ELSE least(0.5, nq * 0.05) END", "1 + has_at", "apl", "depth", "0", "subs", "pw", "ml",
    "(subs > 2 OR has_at = 1 OR contains(url, '%'))::INT", "nq",
    ENDS("p", [".php", ".html", ".htm", ".asp", ".jsp", ".cgi"]) + "::INT", "greatest(1, seg)", "least(4, subs)", "0.0", "tm",
    "tm / greatest(1, nn)", "nn / greatest(0.1, tm)", "CASE WHEN nn > 2 THEN 1.0 / greatest(1, nn - 1) ELSE 0.0 END",
    "1.0 / greatest(1.0, apl)", "1.0 / greatest(1, nn) + 0.15 * (subs > 0)::INT", "greatest(1, least(nn - 1, parts))",
    "greatest(1, least(nn - 1, seg + 1))",
    "(" + ANY("low", ["login", "signin", "verify", "update", "secure", "account", "confirm", "banking", "paypal", "password", "credential"])
    + " OR " + ANY("lower(p)", ["apple", "microsoft", "google", "amazon", "facebook", "netflix", "paypal", "chase", "wellsfargo", "bank"]) + ")::INT",
    "pw + ml", ANY("low", ["bank", "pay", "credit", "card", "wallet"]) + "::INT"]))


@query("url_structural_view", sql(ALL + URLS_SQL, f"SELECT trace_id, {AS_ROUNDED(US_EXPR)} FROM us3"))
def _(t):
    return views.url_structural_view(t.tr)


CLEAN_SQL = ("(greatest(0.0, 1 - domain_len / 30) + greatest(0.0, 1 - domain_entropy / 4) + 1 - has_suspicious_tld + "
             "greatest(0.0, 1 - num_subdomains / 3) + greatest(0.0, 1 - num_digits_domain / 5) + 1 - has_ip + "
             "greatest(0.0, 1 - num_dashes / 3) + 1 - kw_login) / 8.0")


@query("url_cleanliness", sql(ALL + URL_CTE, f"SELECT trace_id, {R(CLEAN_SQL)} AS cleanliness FROM uv"))
def _(t):
    return views.url_view(t.tr).select("trace_id", views.url_cleanliness().alias("cleanliness"))


# ---------------------------------------------------------------- aggregates behind the views
@query("event_type_counts", sql(ALL + INTER_SRC, f"""SELECT trace_id, {COUNTS},
   count(*) FILTER (event_type IN ('submit', 'js_form_submit')) AS n_submits,
   count(*) FILTER (event_type = 'page_transition') AS n_page_transitions, count(*) AS total_events FROM evi GROUP BY 1"""))
def _(t):
    return events.event_type_counts(t.ev)


@query("resource_type_counts", sql(ALL + RS, f"""SELECT trace_id, {', '.join(I(c) + ' AS ' + c for c in fixed.NETWORK_COLS[1:7])} FROM rs"""))
def _(t):
    return views.request_stats(t.tr, t.rq).select("trace_id", *fixed.NETWORK_COLS[1:7])


@query("status_class_counts", sql(ALL + RS, "SELECT trace_id, n_2xx, n_3xx, n_4xx, n_5xx FROM rs"))
def _(t):
    return views.request_stats(t.tr, t.rq).select("trace_id", "n_2xx", "n_3xx", "n_4xx", "n_5xx")


@query("distinct_counts", sql(ALL + RS + RED0, f"""SELECT trace_id, unique_domains, content_type_diversity,
  {I('ud')} AS redirect_domains FROM rs JOIN rj USING (trace_id)"""))
def _(t):
    red = views.redirect_stats(t.rd).select("trace_id", F.col("unique_domains").alias("redirect_domains"))
    return views.request_stats(t.tr, t.rq).select("trace_id", "unique_domains", "content_type_diversity").join(
        red, "trace_id", "left").na.fill(0)


@query("ratio_aggs", sql(ALL + NET_CTE + INT_CTE, f"""SELECT trace_id, {ROUND(['ext_ratio', 'cdn_ratio', 'script_ratio', 'xhr_ratio', 'input_ratio'])}
  FROM nv JOIN iv USING (trace_id)"""))
def _(t):
    n = views.network_view(views.request_stats(t.tr, t.rq)).select("trace_id", "ext_ratio", "cdn_ratio", "script_ratio", "xhr_ratio")
    return n.join(views.interaction_view(t.tr, t.ev).select("trace_id", "input_ratio"), "trace_id")


@query("time_aggs", sql(ALL + INTER_SRC, f"""SELECT trace_id, n, {R('du')} AS duration,
  {R('CASE WHEN n > 1 THEN du / (n - 1) ELSE 0.0 END')} AS avg_gap, {R('CASE WHEN du > 0 THEN n / du ELSE 0.0 END')} AS frequency
  FROM (SELECT trace_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN (max(tus) - min(tus)) / 1e6 ELSE 0.0 END AS du FROM evi GROUP BY 1)"""))
def _(t):
    return events.time_aggs(t.ev)


@query("redirect_pairs", sql(ALL, f"""SELECT trace_id, pos, prev_url, url, {I(RD_FLAGS[0])} AS cross_domain, {I(RD_FLAGS[1])} AS upgrade
  FROM rd WHERE prev_url IS NOT NULL"""))
def _(t):
    return views.redirect_pairs(t.rd)


@query("redirect_adjacent", sql(ALL, f"""SELECT trace_id, count(*) AS n_pairs, {I(f'sum({RD_FLAGS[0]})')} AS n_cross,
  {I(f'sum({RD_FLAGS[1]})')} AS n_upgrade FROM rd WHERE prev_url IS NOT NULL GROUP BY 1"""))
def _(t):
    return views.redirect_pairs(t.rd).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("cross_domain").alias("n_cross"), F.sum("upgrade").alias("n_upgrade"))


@query("label_join", sql(ALL, "SELECT trace_id, user_id, url, y::BIGINT AS y, success::BIGINT AS success FROM tr"))
def _(t):
    return t.tr.select("trace_id", "user_id", "url", "y", "success")


@query("graph_left_join", sql(G_ALL + DEG, f"""SELECT trace_id, {I('CASE WHEN n >= 2 THEN m ELSE 0 END')} AS num_edges
  FROM tr JOIN nn USING (trace_id) LEFT JOIN dg USING (trace_id)"""))
def _(t):
    return views.graph_available_mask(t.tr, t.itg).select("trace_id", F.col("num_edges").cast("long").alias("num_edges"))


@query("nan_to_num", sql(ALL + NET_CTE, f"""SELECT trace_id, {R('CASE WHEN load_duration > 0 THEN total_requests / load_duration ELSE 0 END')} AS rate,
  {R('CASE WHEN n_4xx > 0 THEN ln(n_4xx) ELSE 0 END')} AS log_4xx FROM nv"""))
def _(t):
    from tracegraph.functions.text import clean_number
    v = views.network_view(views.request_stats(t.tr, t.rq))
    return v.select("trace_id", clean_number(F.expr("try_divide(total_requests, load_duration)")).alias("rate"),
                    clean_number(F.log("n_4xx")).alias("log_4xx"))
