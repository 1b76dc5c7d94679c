"""Feature views: one row of named columns per trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import fixed, urls
from tracegraph.functions.text import (any_word, clean_number, compute_once, count_char, count_digits, div, ends_with_any,
                                       entropy)
from tracegraph.operators import events, graph, paths


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def url_parts(df: DataFrame) -> DataFrame:
    """URL pieces computed once per row, for the expressions of url_columns."""
    raw = urls.path("url")
    return compute_once(df, {"_low": F.lower("url"), "_domain": urls.domain_or_path("url"), "_query": urls.query("url"),
                             "_path": F.when(raw == "", F.lit("/")).otherwise(raw), "_scheme": urls.scheme("url"),
                             "_final": urls.domain_of("final_url")})


def url_columns() -> dict[str, Column]:
    u, low, domain, path = F.col("url"), F.col("_low"), F.col("_domain"), F.col("_path")
    dots = count_char(domain, ".")
    return dict(zip(fixed.URL_COLS, [
        F.length(u), F.length(domain), F.length(path), dots, count_char(domain, "-"), count_char(u, "_"),
        count_char(path, "/"), count_char(u, "@"), count_digits(domain), flag(domain.rlike(urls.IP_RE)),
        flag(F.col("_scheme") == "https"), flag(urls.tld_of(domain).isin(fixed.VIEW_SUSPICIOUS_TLDS)),
        F.greatest(F.lit(0), dots - 1), urls.num_params("_query", parsed=True), flag(F.contains(u, F.lit("%"))), entropy(domain),
        entropy(path), flag(any_word(low, fixed.URL_LOGIN_WORDS)), flag(any_word(low, fixed.URL_BRAND_WORDS)),
        flag(domain != F.col("_final")), F.size(F.split(path, "/")) - 1]))


def url_view(tr: DataFrame) -> DataFrame:
    cols = {n: c.cast("double") for n, c in url_columns().items()}
    return compute_once(url_parts(tr.select("trace_id", "url", "final_url")), cols).select("trace_id", *cols)


def request_stats(tr: DataFrame, rq: DataFrame) -> DataFrame:
    """Request counts per trace; domains and content types are told apart by aggregates of their own, whose rows are narrow."""
    t, s = F.col("resource_type"), F.coalesce("status", F.lit(0))
    ctype = F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))
    one = rq.select("trace_id", urls.domain_of("url").alias("d"), ctype.alias("ct"), t.alias("t"), s.alias("s"), "tus")

    def n(cond):
        return F.count_if(cond)

    t = F.col("t")
    s = F.col("s")
    sums = one.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"), n(t == "script").alias("n_scripts"), n(t == "stylesheet").alias("n_stylesheets"),
        n(t == "image").alias("n_images"), n(t.isin("xhr", "fetch")).alias("n_xhr"), n(t == "document").alias("n_documents"),
        n(t == "font").alias("n_fonts"), n((s >= 200) & (s < 300)).alias("n_2xx"), n((s >= 300) & (s < 400)).alias("n_3xx"),
        n((s >= 400) & (s < 500)).alias("n_4xx"), n((s >= 500) & (s < 600)).alias("n_5xx"),
        F.min(F.when(F.col("tus") > 0, F.col("tus"))).alias("t0"), F.max("tus").alias("t1"),
        n(F.col("tus") > 0).alias("nt"))
    # a trace's final domain meets the counts by (trace, domain), so that they stay where they were counted
    final = tr.select("trace_id", urls.domain_of("final_url").alias("d"), F.lit(True).alias("own"))
    hosts = one.filter("d <> ''").groupBy("trace_id", "d").agg(F.count(F.lit(1)).alias("k")).join(final, ["trace_id", "d"], "left")
    hosts = hosts.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("unique_domains"), F.sum(F.when(F.col("own").isNull(), F.col("k")).otherwise(0)).alias("external"),
        F.sum(F.when(any_word("d", fixed.CDN_WORDS), F.col("k")).otherwise(0)).alias("cdn"))
    kinds = one.filter("ct <> ''").select("trace_id", "ct").distinct().groupBy("trace_id").agg(F.count(F.lit(1)).alias("content_type_diversity"))
    out = tr.select("trace_id", F.col("final_url").isNotNull().alias("_known"))
    out = out.join(sums, "trace_id", "left").join(hosts, "trace_id", "left").join(kinds, "trace_id", "left")
    # nothing is external to a trace without a final page
    return out.withColumn("external", F.when(F.col("_known"), F.col("external"))).drop("_known").na.fill(0)


def network_columns() -> dict[str, Column]:
    n = F.greatest(F.lit(1), F.col("n"))
    dur = F.when(F.col("nt") >= 2, (F.col("t1") - F.col("t0")) / 1e6).otherwise(0.0)
    return dict(zip(fixed.NETWORK_COLS, [
        F.col("n"), *[F.col(c) for c in fixed.NETWORK_COLS[1:8]], F.col("external") / n, F.col("cdn") / n,
        F.col("n_2xx"), F.col("n_4xx"), F.col("n_5xx"), F.col("content_type_diversity"), dur,
        dur / F.greatest(F.lit(1), F.col("nt") - 1), F.col("n_scripts") / n, F.col("n_xhr") / n]))


def network_view(stats: DataFrame) -> DataFrame:
    return stats.select("trace_id", *[c.cast("double").alias(k) for k, c in network_columns().items()])


def redirect_pairs(rd: DataFrame) -> DataFrame:
    """Adjacent redirect pairs with their cross-domain and http-to-https flags."""
    d, p = urls.domain_of("url"), urls.domain_of("prev_url")
    return rd.filter("prev_url IS NOT NULL").select(
        "trace_id", "pos", "prev_url", "url", flag((d != "") & (p != "") & (d != p)).alias("cross_domain"),
        flag(F.startswith("prev_url", F.lit("http://")) & F.startswith("url", F.lit("https://"))).alias("upgrade"))


def redirect_stats(rd: DataFrame) -> DataFrame:
    d, p = urls.domain_of("url"), urls.domain_of("prev_url")
    rows = rd.select("trace_id", d.alias("d"), flag((d != "") & (p != "") & (d != p)).alias("x"),
                     flag(F.startswith("prev_url", F.lit("http://")) & F.startswith("url", F.lit("https://"))).alias("h"))
    pre = rows.groupBy("trace_id", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("h").alias("h"))
    return pre.groupBy("trace_id").agg(F.sum("n").alias("num_redirects"), F.count_if(F.col("d") != "").alias("unique_domains"),
                                       F.sum("x").alias("cross_domain_redirects"), F.sum("h").alias("http_to_https"))


def redirect_rows(tr: DataFrame, rd: DataFrame, stats: DataFrame) -> DataFrame:
    """Request statistics joined with the chain statistics (prefix h_) and both end domains."""
    t = tr.select("trace_id", urls.domain_of("url").alias("d0"), urls.domain_of("final_url").alias("d1"))
    return t.join(prefixed(redirect_stats(rd), "h_"), "trace_id", "left").na.fill(0).join(stats, "trace_id")


def redirect_columns() -> dict[str, Column]:
    c = F.col
    return dict(zip(fixed.REDIRECT_COLS, [
        c("h_num_redirects"), c("h_unique_domains"), c("h_cross_domain_redirects"), c("h_http_to_https"),
        flag(c("d0") != c("d1")), c("n_3xx"), c("n_documents"), c("external") / F.greatest(F.lit(1), c("n")),
        F.greatest("h_num_redirects", "n_3xx"), flag(any_word(c("d1"), fixed.FREE_HOSTING)),
        flag(c("d0").isin(fixed.SHORTENERS)), c("n"), c("external"), F.greatest(F.lit(0), c("h_num_redirects") - 1)]))


def redirect_view(tr: DataFrame, rd: DataFrame, stats: DataFrame) -> DataFrame:
    j = redirect_rows(tr, rd, stats)
    return j.select("trace_id", *[v.cast("double").alias(k) for k, v in redirect_columns().items()])


def _page_view(tr: DataFrame, agg: DataFrame) -> DataFrame:
    title = F.lower(F.coalesce("page_title", F.lit("")))
    j = tr.select("trace_id", title.alias("title"), "forms_submitted", "dual_submissions").join(
        agg, "trace_id", "left").na.fill(0)
    c = F.col
    cols = dict(zip(fixed.CONTENT_COLS, [
        flag(any_word(c("title"), fixed.TITLE_LOGIN_WORDS)), flag(any_word(c("title"), fixed.TITLE_BRAND_WORDS)),
        flag(any_word(c("title"), fixed.TITLE_URGENCY_WORDS)), F.length("title"), entropy("title"),
        *[c(k) for k in fixed.CONTENT_COLS[5:14]], c("forms_submitted"), c("dual_submissions"), c("n_dual_submit"),
        c("n_inputs") / F.greatest(F.lit(1), c("total_events"))]))
    return j.select("trace_id", *[v.cast("double").alias(k) for k, v in cols.items()])


def interaction_view(tr: DataFrame, ev: DataFrame) -> DataFrame:
    a = events.interaction_filter(ev).groupBy("trace_id").agg(
        *events.type_counts(), *events.field_flags(), events.span_seconds().alias("interaction_duration"))
    return _page_view(tr, a)


def content_view(tr: DataFrame, ev: DataFrame) -> DataFrame:
    """Like interaction_view, but submits are any type containing ``submit`` and field flags see every event."""
    kept = ~F.coalesce("event_type", F.lit("")).isin("screenshot", "page")
    e = ev.withColumn("kept", kept.cast("int")).withColumn("event_type", F.when(kept, F.col("event_type")))
    counts = [c for c in events.type_counts(submit_any=True)][:-1]
    a = e.groupBy("trace_id").agg(*counts, F.sum("kept").alias("total_events"), *events.field_flags(),
                                  events.span_seconds().alias("interaction_duration"))
    return _page_view(tr, a)


def _local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _with_nodes(graph.degree_stats(nodes, edges).join(graph.clustering(nodes, edges), "trace_id"), nodes)


def _with_nodes(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    j = shapes.join(graph.sensitive_field_stats(nodes), "trace_id").join(graph.url_node_stats(nodes), "trace_id").join(
        graph.node_time_stats(nodes), "trace_id")
    return j.withColumn("form_to_node_ratio", div("num_forms", "num_nodes"))


def local_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph features that need no paths between distant nodes."""
    j = _local(nodes, edges)
    return j.select("trace_id", *[F.col(c).cast("double").alias(c) for c in fixed.ITG_COLS if c in j.columns])


def itg_view(nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """The 30 graph features of every trace; ``metrics`` are its path metrics, with degrees and clustering if they are at hand."""
    metrics = paths.path_metrics(nodes, edges) if metrics is None else metrics
    if set(paths.SHAPES) <= set(metrics.columns):
        j = _with_nodes(graph.with_ratios(metrics.withColumnRenamed("n_nodes", "num_nodes")), nodes)
    else:
        j = _local(nodes, edges).join(metrics, "trace_id")
    return j.select("trace_id", *[F.col(c).cast("double").alias(c) for c in fixed.ITG_COLS])


def graph_available_mask(tr: DataFrame, itg: DataFrame) -> DataFrame:
    """Traces with fewer than two nodes get zeros and a false mask."""
    ok = itg.filter("num_nodes >= 2").withColumn("itg_available", F.lit(1))
    return tr.select("trace_id").join(ok, "trace_id", "left").na.fill(0)


def floor8(c) -> Column:
    return F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(1e-8))


def engineered_columns() -> dict[str, Column]:
    c = F.col
    return {
        "density_x_form_ratio": c("graph_density") * c("form_to_node_ratio"),
        "cluster_x_cred": c("clustering_coefficient") * c("credential_fields_count"),
        "ext_redirect_ratio": c("external_redirects") / floor8("num_redirects"),
        "nodes_x_sensitive": c("num_nodes") * c("requests_sensitive_data"),
        "between_x_time": c("betweenness_centrality_max") * c("total_interaction_time"),
        "pagerank_x_freq": c("pagerank_max") * c("event_frequency"),
        "closeness_x_cred": c("closeness_centrality_max") * c("credential_fields_count"),
        "edge_node_ratio": c("num_edges") / floor8("num_nodes"),
        "diameter_x_depth": c("diameter") * c("max_redirect_depth"),
        "degree_asymmetry": F.abs(c("in_degree_max") - c("out_degree_max")) / floor8(c("in_degree_max") + c("out_degree_max")),
        "auth_risk_score": c("has_password_input") + c("has_email_input") + c("financial_fields_count"),
        "nav_complexity": c("avg_path_length") * c("num_connected_components"),
    }


def itg_engineered(itg: DataFrame) -> DataFrame:
    return itg.select("*", *[v.alias(k) for k, v in engineered_columns().items()])


CROSS_COLS = [f"cv{i}" for i in range(1, 13)]


def cross_columns() -> dict[str, Column]:
    """Twelve products across views; input columns carry the prefixes u_, n_, r_, i_."""
    c = F.col
    creds = c("i_has_password_field") + c("i_has_email_field")
    cols = [
        c("u_domain_entropy") * c("n_total_requests"), c("u_has_suspicious_tld") * c("n_ext_ratio"),
        c("u_domain_changed") * c("r_domain_changed"), c("r_num_redirects") * c("i_has_password_field"),
        c("r_uses_free_hosting") * c("i_title_has_login"), c("r_cross_domain_redirects") * creds,
        c("n_n_xhr") * c("i_has_password_field"), c("n_n_scripts") / floor8("n_total_requests") * c("i_total_events"),
        c("n_unique_domains") * c("i_n_links"), (creds + c("u_kw_login")) * c("r_num_redirects"),
        c("u_has_suspicious_tld") * c("r_uses_free_hosting"),
        c("n_n_xhr") / floor8("n_total_requests") * c("u_domain_changed")]
    return dict(zip(CROSS_COLS, cols))


def cross_view(joined: DataFrame) -> DataFrame:
    return joined.select("trace_id", *[v.alias(k) for k, v in cross_columns().items()])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[c if c == "trace_id" else f"{prefix}{c}" for c in df.columns])


def view_join(views: dict[str, DataFrame]) -> DataFrame:
    """Align views by trace; each side is already partitioned by trace_id from its own aggregate."""
    return reduce(lambda a, b: a.join(b, "trace_id"), [prefixed(v, p) for p, v in views.items()])


def base_views(tr: DataFrame, ev: DataFrame, rq: DataFrame, rd: DataFrame) -> DataFrame:
    """URL, network, redirect and interaction views side by side; requests are aggregated once for two of them."""
    nr = redirect_rows(tr, rd, request_stats(tr, rq)).select(
        "trace_id", *[c.cast("double").alias(f"n_{k}") for k, c in network_columns().items()],
        *[c.cast("double").alias(f"r_{k}") for k, c in redirect_columns().items()])
    return prefixed(url_view(tr), "u_").join(nr, "trace_id").join(prefixed(interaction_view(tr, ev), "i_"), "trace_id")


def all_views(tr: DataFrame, ev: DataFrame, rq: DataFrame, rd: DataFrame, itg: DataFrame) -> DataFrame:
    """The 125 columns of the six views."""
    graph_part = prefixed(itg_engineered(graph_available_mask(tr, itg)), "g_").withColumnRenamed("g_itg_available", "itg_available")
    full = base_views(tr, ev, rq, rd).join(graph_part, "trace_id")
    full = full.select("*", *[v.alias(f"x_{k}") for k, v in cross_columns().items()])
    keep = [c for c in full.columns if c not in ("trace_id", "itg_available")]
    return full.select("trace_id", "itg_available", *[clean_number(c).alias(c) for c in keep])


VIEW_PREFIX = {"url": "u_", "network": "n_", "redirect": "r_", "interaction": "i_", "itg": "g_", "cross": "x_"}


def view_columns(df: DataFrame, *views: str) -> list[str]:
    return [c for v in views for c in df.columns if c.startswith(VIEW_PREFIX[v])]


def url_cleanliness() -> Column:
    """Mean of eight clipped terms over the columns of url_view; higher is cleaner."""
    c = F.col

    def clip(x, top):
        return F.greatest(F.lit(0.0), 1.0 - c(x) / top)

    terms = [clip("domain_len", 30.0), clip("domain_entropy", 4.0), 1.0 - c("has_suspicious_tld"),
             clip("num_subdomains", 3.0), clip("num_digits_domain", 5.0), 1.0 - c("has_ip"), clip("num_dashes", 3.0),
             1.0 - c("kw_login")]
    return reduce(lambda a, b: a + b, terms) / 8.0


def drp_columns() -> dict[str, Column]:
    c = F.col
    forms, links = c("num_forms") / floor8("num_nodes"), c("num_links") / floor8("num_nodes")
    pages = c("num_connected_components") + c("num_redirects")

    def plogp(p):
        return p * F.log2(F.greatest(p, F.lit(1e-10)))

    return {
        "drp_depth_reached": F.least(c("diameter") + c("max_redirect_depth"), F.lit(10.0)),
        "drp_unique_pages": pages, "drp_url_transitions": c("external_redirects") + c("num_redirects"),
        "drp_credential_depth": F.when(c("credential_fields_count") > 0, F.least(c("avg_path_length"), F.lit(5.0))).otherwise(0.0),
        "drp_form_diversity": c("num_forms"),
        "drp_pruning_ratio": F.least(c("num_nodes") / floor8("num_edges"), F.lit(1.0)),
        "drp_credential_paths_ratio": c("credential_fields_count") / floor8("num_nodes"),
        "drp_effective_branching": c("avg_degree"), "drp_funnel_width": c("num_nodes") * c("graph_density"),
        "drp_navigation_entropy": -(plogp(forms) + plogp(links)),
        "drp_cred_concentration_early": c("event_frequency") * 0.5,
        "drp_cred_concentration_mid": c("event_frequency") * 0.3,
        "drp_cred_concentration_late": c("event_frequency") * 0.2,
        "drp_dual_submit_count": F.when((c("num_forms") >= 2) & (c("credential_fields_count") >= 2), 1.0).otherwise(0.0),
        "drp_events_per_page": c("num_edges") / floor8(pages),
    }


def drp_view(itg: DataFrame) -> DataFrame:
    return itg.select("trace_id", *[clean_number(v).alias(k) for k, v in drp_columns().items()])


def proxy_columns() -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    for i, (a, b) in enumerate(fixed.PROXY_PAIRS):
        out[f"wl_mul_{i}"] = c(a) * c(b)
        out[f"wl_dif_{i}"] = (c(a) - c(b)) * (c(a) - c(b))
    topo = "num_nodes num_edges avg_degree max_degree graph_density clustering_coefficient avg_path_length diameter".split()
    for i, a in enumerate(topo):
        out[f"sp_sq_{i}"] = c(a) * c(a)
        if i + 1 < len(topo):
            out[f"sp_mul_{i}"] = c(a) * c(topo[i + 1])
    ratios = [("in_degree_max", "max_degree"), ("out_degree_max", "max_degree"), ("num_forms", "num_nodes"),
              ("num_links", "num_nodes"), ("num_input_fields", "num_nodes"), ("num_buttons", "num_nodes"),
              ("credential_fields_count", "num_input_fields"), ("external_redirects", "num_redirects")]
    for i, (a, b) in enumerate(ratios):
        out[f"rw_{i}"] = c(a) / floor8(b)
    out["rw_8"] = F.log1p("num_nodes")
    out["rw_9"] = F.log1p("num_edges")
    out["rw_10"] = c("betweenness_centrality_max") / floor8("closeness_centrality_max")
    out["rw_11"] = c("event_frequency") * c("total_interaction_time")
    return out


def structural_proxy_view(itg: DataFrame) -> DataFrame:
    return itg.select("trace_id", *[clean_number(v).alias(k) for k, v in proxy_columns().items()])


def full_feature_matrix(itg: DataFrame) -> DataFrame:
    """42 + 15 + 59 columns."""
    cols = {**engineered_columns(), **drp_columns(), **proxy_columns()}
    return itg.select("trace_id", *[clean_number(c).alias(c) for c in fixed.ITG_COLS],
                      *[clean_number(v).alias(k) for k, v in cols.items()])


def url_structural_view(tr: DataFrame) -> DataFrame:
    """Thirty graph-shaped proxies read from the URL alone."""
    u = F.col("url")
    low = F.lower(u)
    loc = urls.netloc(u)
    domain = F.split_part(F.when(loc != "", loc).otherwise(urls.path(u)), F.lit(":"), F.lit(1))
    raw = urls.path(u)
    path = F.when(raw == "", F.lit("/")).otherwise(raw)
    base = tr.select(
        "trace_id", u.alias("url"), low.alias("low"), domain.alias("d"), path.alias("p"),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")).alias("seg"), F.size(F.split(domain, r"\.")).alias("parts"),
        urls.num_params(u).alias("q"), flag(urls.query(u) != "").alias("has_q"),
        F.greatest(F.lit(0), count_char(domain, ".") - 1).alias("subs"))
    c = F.col
    base = base.withColumn("nn", F.greatest(F.lit(2), 1 + c("parts") + c("seg") + c("q")))
    base = base.withColumn("m", F.greatest(F.lit(1), c("nn") - 1 + c("has_q"))).withColumn(
        "depth", c("seg") + c("parts")).withColumn("time", F.length("url") / 20.0)
    base = base.withColumn("apl", F.when(c("depth") > 0, c("depth") / 2.0).otherwise(1.0)).withColumn(
        "pwd", flag(any_word(c("low"), ["password", "pwd"]))).withColumn(
        "mail", flag(any_word(c("low"), ["email", "mail", "login"])))
    words = ["login", "signin", "verify", "update", "secure", "account", "confirm", "banking", "paypal", "password",
             "credential"]
    brands = ["apple", "microsoft", "google", "amazon", "facebook", "netflix", "paypal", "chase", "wellsfargo", "bank"]
    at, pct = F.contains("url", F.lit("@")), F.contains("url", F.lit("%"))
    vals = [
        c("nn"), c("m"), 2 * c("m") / c("nn"), F.least(c("nn") - 1, c("seg") + 2), c("m") / (c("nn") * (c("nn") - 1)),
        F.when(c("nn") <= 2, 0.0).otherwise(F.least(F.lit(0.5), c("q") * 0.05)), 1 + flag(at), c("apl"), c("depth"),
        F.lit(0), c("subs"), c("pwd"), c("mail"), flag((c("subs") > 2) | at | pct), c("q"),
        flag(ends_with_any("p", [".php", ".html", ".htm", ".asp", ".jsp", ".cgi"])), F.greatest(F.lit(1), c("seg")),
        F.least(F.lit(4), c("subs")), F.lit(0.0), c("time"), c("time") / F.greatest(F.lit(1), c("nn")),
        c("nn") / F.greatest(F.lit(0.1), c("time")), F.when(c("nn") > 2, 1.0 / F.greatest(F.lit(1), c("nn") - 1)).otherwise(0.0),
        1.0 / F.greatest(F.lit(1.0), c("apl")), 1.0 / F.greatest(F.lit(1), c("nn")) + 0.15 * flag(c("subs") > 0),
        F.greatest(F.lit(1), F.least(c("nn") - 1, c("parts"))), F.greatest(F.lit(1), F.least(c("nn") - 1, c("seg") + 1)),
        flag(any_word(c("low"), words) | any_word(F.lower(c("p")), brands)), c("pwd") + c("mail"),
        flag(any_word(c("low"), ["bank", "pay", "credit", "card", "wallet"]))]
    return base.select("trace_id", *[v.cast("double").alias(k) for k, v in zip(fixed.ITG_COLS, vals)])
