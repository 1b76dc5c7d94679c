"""Scans, feeds and sinks: rows of the given tables are landed in each format, then read back."""

from pyspark.sql import functions as F

from tracegraph.functions import fixed, urls
from tracegraph.operators import domains, stats
from tracegraph.plans.base_sql import ALL, ANY, DOM, ENDS, G_ALL, HOSTS, I, IN, LIST, LIT, NETLOC, PATH, R, SERP, sql
from tracegraph.plans.cat_rules import CT_SQL, DS, HOSTN, INTERESTING, PARTS, SUB, SUFFIX, ds_cte
from tracegraph.plans.cat_stats import MET, method_scores
from tracegraph.plans.cat_views import ITG_CTE
from tracegraph.plans.registry import query
from tracegraph.session import scratch_path
from tracegraph.sources import feeds, traces


def visit_docs(t):
    """Every recorded visit as one nested document: the event, its request, its hop."""
    e = t.ev.join(t.rq.select("trace_id", "event_id", "resource_type", "status", "content_type"), ["trace_id", "event_id"]).join(
        t.tr.select("trace_id", "y", "success"), "trace_id")
    event = F.struct((F.col("tus") / 1e6).alias("timestamp"), "event_type", "element_tag", "element_id", "element_class", "element_text",
                     "url_before", "url_after", F.when(F.col("form_field") != "", F.create_map("form_field", F.lit("x"))).alias("form_data"))
    request = F.struct(F.col("page_url").alias("url"), F.lit("GET").alias("method"), "resource_type", "status", "content_type",
                       (F.col("tus") / 1e6).alias("timestamp"))
    inner = F.struct(F.col("page_url").alias("url"), F.col("url_after").alias("final_url"), F.array("page_url").alias("redirects"),
                     F.array(event).alias("events"), F.array(request).alias("network_requests"))
    return e.select(F.col("page_url").alias("url"), F.md5(F.col("event_id").cast("string")).alias("hash"),
                    F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"), F.lit("events").alias("source"), "success",
                    urls.domain_of("page_url").alias("domain"), F.lit(1).alias("forms_submitted"), inner.alias("trace"))


CHUNK = 16  # events in one document; a trace of any length becomes several


def chunk_docs(t):
    """Documents of up to CHUNK neighbouring events of a trace, with missing members, null statuses, map fields and hops."""
    e = t.ev.join(t.rq.select("trace_id", "event_id", "resource_type", "status", "content_type"), ["trace_id", "event_id"])
    step = F.struct("raw_idx", "tus", "event_type", "element_tag", "element_id", "url_before", "url_after", "form_field", "page_url", "resource_type",
                    "status", "content_type")

    def members(x):
        at = (x["tus"] / 1e6).alias("timestamp")
        fields = F.when(x["form_field"] != "", F.create_map(x["form_field"], F.lit("x"))).alias("form_data")
        event = F.struct(at, *[x[c].alias(c) for c in ("event_type", "element_tag", "element_id", "url_before", "url_after")], fields)
        return F.struct(event.alias("e"), F.struct(x["page_url"].alias("url"), F.lit("GET").alias("method"), x["resource_type"].alias("resource_type"),
                                                   x["status"].alias("status"), x["content_type"].alias("content_type"), at).alias("r"))

    part = F.floor(F.col("raw_idx") / CHUNK)
    d = e.groupBy("trace_id", part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(step)), members).alias("s")).join(
        t.tr.select("trace_id", "y", "success"), "trace_id")
    pages = F.col("s.r.url")
    inner = F.struct(pages[0].alias("url"), F.col("s")[F.size("s") - 1]["e"]["url_after"].alias("final_url"), pages.alias("redirects"),
                     F.col("s.e").alias("events"), F.col("s.r").alias("network_requests"))
    # every third document keeps its members at the top, as some recorders write them
    flat = F.col("part") % 3 == 2
    return d.select(pages[0].alias("url"), F.md5(F.concat_ws("|", "trace_id", "part")).alias("hash"),
                    F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"), "success",
                    F.when(flat, F.col("s.e")).alias("events"), F.when(flat, F.col("s.r")).alias("network_requests"), F.when(flat, pages).alias("redirects"),
                    F.when(~flat, inner).alias("trace"))


def landed_docs(t):
    path = scratch_path(t.spark, "documents")
    docs = chunk_docs(t)
    for label in ("phishing", "benign"):
        docs.filter(F.col("label") == label).drop("label").write.json(f"{path}/{label}")
    return path


CHUNKS = """,
cd AS (SELECT e.*, raw_idx // 16 AS part, raw_idx % 16 AS pos, md5(trace_id || '|' || (raw_idx // 16)) AS hash FROM ev e)"""


@query("trace_scan", sql(ALL + CHUNKS, """SELECT hash, arg_min(page_url, raw_idx) AS url, any_value(y)::BIGINT AS y, count(*) AS n_events,
  string_agg(event_type, ',' ORDER BY raw_idx) AS kinds FROM cd JOIN (SELECT trace_id, y, success FROM tr) tr USING (trace_id) WHERE success GROUP BY hash"""))
def _(t):
    d = traces.trace_scan(t.spark, landed_docs(t)).withColumn("kinds", F.coalesce(F.col("trace.events.event_type"), F.col("events.event_type")))
    return d.select("hash", "url", "y", F.size("kinds").alias("n_events"), F.array_join("kinds", ",").alias("kinds"))


@query("trace_scan_all", sql(ALL + CHUNKS, """SELECT y::BIGINT AS y, success::BIGINT AS success, count(*) AS n, count(DISTINCT url) AS n_urls FROM (
  SELECT hash, any_value(y) AS y, any_value(success) AS success, arg_min(page_url, raw_idx) AS url FROM cd JOIN (SELECT trace_id, y, success FROM tr) tr USING (trace_id) GROUP BY hash) GROUP BY 1, 2"""))
def _(t):
    d = traces.trace_scan_all(t.spark, landed_docs(t))
    return d.groupBy("y", "success").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))


@query("trace_flatten", sql(ALL + CHUNKS, """SELECT hash AS trace_id, pos::BIGINT AS pos, event_type, url_after, resource_type, status::BIGINT AS status, form_field, page_url AS hop,
  lag(page_url) OVER (PARTITION BY hash ORDER BY raw_idx) AS prev_url
  FROM cd JOIN (SELECT trace_id, event_id, resource_type, status FROM rq) r USING (trace_id, event_id)"""))
def _(t):
    f = traces.trace_flatten(traces.trace_scan(t.spark, landed_docs(t), only_success=False))
    rq = f["rq"].select("trace_id", F.col("event_id").alias("pos"), "resource_type", "status")
    rd = f["rd"].select("trace_id", "pos", F.col("url").alias("hop"), "prev_url")
    ev = f["ev"].select("trace_id", F.col("raw_idx").alias("pos"), "event_type", "url_after", "form_field")
    return ev.join(rq, ["trace_id", "pos"]).join(rd, ["trace_id", "pos"])


def mixed_docs(t):
    """Documents whose form_data is an object of two keys, a text, null or a list, with events at the top or inside; some lines are no documents."""
    f = F.when(F.col("form_field") == "", "f").otherwise(F.col("form_field"))
    form = F.element_at(F.array(F.concat(F.lit('{"'), f, F.lit('":"x","extra":{"n":1}}')), F.concat(F.lit('"'), "form_field", F.lit('"')), F.lit("null"), F.lit('["a","b"]')),
                        (F.col("event_id") % 4 + 1).cast("int"))
    events = F.concat(F.lit('"events":[{"event_type":"'), "event_type", F.lit('","form_data":'), form, F.lit('}]'))
    whole = F.concat(F.lit('{"hash":"'), F.col("event_id").cast("string"), F.lit('",'), F.when(F.col("event_id") % 3 == 0, events).otherwise(
        F.concat(F.lit('"trace":{'), events, F.lit("}"))), F.lit("}"))
    return t.ev.select(F.explode(F.when(F.col("event_id") % 5 == 0, F.array(whole, F.lit("[1, 2]"), F.lit("{cut"))).otherwise(F.array(whole))).alias("value"))


@query("trace_scan_variant", sql(ALL, """SELECT event_id::VARCHAR AS hash, 0::BIGINT AS raw_idx, event_type, CASE event_id % 4
  WHEN 0 THEN array_to_string(list_sort([CASE WHEN form_field = '' THEN 'f' ELSE form_field END, 'extra']), ' ') WHEN 1 THEN form_field WHEN 2 THEN '' ELSE 'a b' END AS form_field FROM ev"""))
def _(t):
    path = scratch_path(t.spark, "mixed-documents")
    mixed_docs(t).write.text(path)
    return traces.variant_events(traces.variant_scan(t.spark, path))


@query("feature_scan", sql(G_ALL + ITG_CTE, "SELECT trace_id, " + ", ".join(f"{R(c)} AS {c}" for c in fixed.ITG_COLS) + ", CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END AS label FROM itg JOIN tr USING (trace_id)"))
def _(t):
    path = scratch_path(t.spark, "features")
    d = t.itg.join(t.tr.select("trace_id", "y"), "trace_id")
    d.select("trace_id", F.struct(*fixed.ITG_COLS).alias("features"), F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label")).write.json(path)
    return feeds.feature_scan(t.spark, path, fixed.ITG_COLS).select("trace_id", *fixed.ITG_COLS, "label")


@query("url_list_scan", sql(HOSTS, "SELECT source AS label, url, domain FROM hosts"))
def _(t):
    path = scratch_path(t.spark, "url-lists")
    t.hosts.select(F.col("source").alias("label"), F.array(F.struct("url", "domain", "source")).alias("urls")).write.json(path)
    return feeds.url_list_scan(t.spark, path).select("label", "url", "domain")


@query("source_fallback", sql(ALL, """SELECT CASE WHEN nf >= 100 THEN 'confirmed' WHEN nt >= 100 THEN 'traces' ELSE 'urls' END AS data_source,
  CASE WHEN nf >= 100 THEN nf WHEN nt >= 100 THEN nt ELSE np END AS n
  FROM (SELECT (SELECT count(*) FROM tr WHERE y = 1) AS nf, (SELECT count(*) FROM tr) AS nt, (SELECT count(*) FROM pages) AS np)"""))
def _(t):
    d = traces.source_fallback([("confirmed", t.tr.filter("y = 1").select("url")), ("traces", t.tr.select("url")), ("urls", t.pages.select("url"))])
    return d.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))


def landed(t, df, kind):
    path = scratch_path(t.spark, "feed")
    getattr(df.write, kind)(path)
    return path


WEB = lambda u: f"(NOT regexp_matches(lower({PATH(u)}), {LIT(fixed.BINARY_EXT_PATTERN)}) AND NOT regexp_matches({u}, {LIT(fixed.IP_SINGLE_LETTER_PATTERN)}))"


@query("feed_text_scan", sql(HOSTS, f"SELECT {HOSTN('url')} AS domain, url, 'openphish' AS source FROM hosts WHERE {WEB('url')} AND {HOSTN('url')} <> ''"))
def _(t):
    return feeds.feed_text_scan(t.spark, landed(t, t.hosts.select("url"), "text"))


@query("feed_json_scan", sql(HOSTS, f"SELECT {HOSTN('url')} AS domain, url, 'phishtank' AS source FROM hosts WHERE {WEB('url')} AND {HOSTN('url')} <> ''"))
def _(t):
    return feeds.feed_json_scan(t.spark, landed(t, t.hosts.select("url", F.col("page_id").cast("string").alias("phish_id")), "json"))


@query("feed_csv_scan", sql(HOSTS, f"SELECT {HOSTN('url')} AS domain, url, 'urlhaus' AS source FROM hosts WHERE {WEB('url')} AND {HOSTN('url')} <> ''"))
def _(t):
    rows = t.hosts.select(F.col("page_id").cast("string").alias("id"), F.lit("2024-01-01").alias("dateadded"), "url", F.lit("online").alias("status"))
    notes = t.hosts.select(F.lit("# exported").alias("id"), F.lit("").alias("dateadded"), F.lit("").alias("url"), F.lit("").alias("status")).limit(3)
    return feeds.feed_csv_scan(t.spark, landed(t, notes.unionByName(rows), "csv"))


@query("feed_ct_scan", sql(HOSTS, """SELECT DISTINCT domain, 'https://' || domain AS url, 'crt.sh' AS source FROM (SELECT domain FROM hosts UNION ALL SELECT 'www.' || domain FROM hosts) WHERE contains(domain, '.')"""))
def _(t):
    c = t.hosts.select(F.concat(F.lit("*."), "domain").alias("common_name"), F.concat(F.lit("*."), "domain", F.lit("\nwww."), "domain").alias("name_value"),
                       F.lit("issuer").alias("issuer_name"), F.lit("2024-01-01").alias("not_before"))
    return feeds.feed_ct_scan(t.spark, landed(t, c, "json"))


def scans(t):
    d = t.hosts.filter("source = 'lookalike'").select(
        F.col("page_id").cast("string").alias("_id"), F.struct("domain", "url", F.lit("US").alias("country")).alias("page"),
        F.struct(F.struct((F.col("page_id") % 3 == 0).alias("malicious"), (F.col("page_id") % 100).cast("int").alias("score")).alias("overall")).alias("verdicts"))
    return feeds.feed_scan_json(t.spark, landed(t, d, "json"))


@query("feed_scan_json", sql(HOSTS, "SELECT domain, url, (page_id % 3 = 0)::BIGINT AS malicious, page_id % 100 AS scan_score FROM hosts WHERE source = 'lookalike'"))
def _(t):
    return scans(t).select("domain", "url", "malicious", "scan_score")



@query("feed_points_boost", f"""SELECT domain, brand, points + boost AS points, malicious, scan_score FROM (SELECT *, (page_id % 3 = 0)::BIGINT AS malicious,
  page_id % 100 AS scan_score, (CASE WHEN page_id % 3 = 0 THEN 40 ELSE 0 END) + (CASE WHEN page_id % 100 >= 50 THEN 20 ELSE 0 END) + 10 AS boost
  FROM ({CT_SQL}) WHERE source = 'lookalike') WHERE points + boost > 0""")
def _(t):
    return feeds.points_boost(domains.domain_points_ct(scans(t))).select("domain", "brand", "points", "malicious", "scan_score")


@query("feed_nod_scan", sql(HOSTS, "SELECT lower(domain) AS domain, 'https://' || lower(domain) AS url, 'whoisds-nod' AS source FROM hosts"))
def _(t):
    return feeds.feed_nod_scan(t.spark, landed(t, t.hosts.select(F.concat(F.lit("."), "domain", F.lit(".")).alias("value")), "text"))


@query("feed_tagged_json_scan", sql(HOSTS, f"SELECT {NETLOC('url')} AS domain, url, page_id::VARCHAR AS id FROM hosts WHERE page_id % 3 <> 2"))
def _(t):
    entry = F.struct("url", F.when(F.col("page_id") % 3 == 0, "Phishing page").otherwise("malware_download").alias("threat"),
                     F.when(F.col("page_id") % 3 == 1, F.array(F.lit("exe"), F.lit("AntiPhish"))).otherwise(F.array(F.lit("exe"))).alias("tags"))
    lines = t.hosts.select(F.to_json(F.create_map(F.col("page_id").cast("string"), F.array(entry))).alias("value"))
    return feeds.feed_tagged_json_scan(t.spark, landed(t, lines, "text")).select("domain", "url", "id")


@query("rank_list_scan", sql(HOSTS, f"""SELECT 'https://' || domain AS url, domain, rank, 'tranco' AS source FROM (SELECT page_id + 1 AS rank,
  CASE WHEN page_id % 5 = 0 THEN 'edge.cloudfront' || page_id || '.net' ELSE domain END AS domain FROM hosts WHERE source = 'observed')
  WHERE rank <= 300 AND NOT {ANY('domain', fixed.RANKED_INFRA_WORDS)} ORDER BY rank LIMIT 100"""))
def _(t):
    d = t.hosts.filter("source = 'observed'").select((F.col("page_id") + 1).alias("rank"), F.when(
        F.col("page_id") % 5 == 0, F.concat(F.lit("edge.cloudfront"), F.col("page_id").cast("string"), F.lit(".net"))).otherwise(F.col("domain")).alias("domain"))
    return feeds.rank_list_scan(t.spark, landed(t, d, "csv"), 100)


@query("seed_query_scan", sql(SERP, "SELECT query, count(*) AS n FROM serp GROUP BY 1"))
def _(t):
    q = feeds.seed_query_scan(t.spark, landed(t, t.serp.select(F.concat(F.lit(" "), "query").alias("value")), "text"))
    return q.groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("known_url_scan", sql(HOSTS, f"SELECT DISTINCT url, {DOM('url')} AS domain FROM hosts"))
def _(t):
    return feeds.known_url_scan(t.spark, landed(t, t.hosts.select("url").unionByName(t.hosts.select(F.col("domain").alias("url"))), "text"))


@query("url_pool_merge", sql(HOSTS, """SELECT source, count(*) AS n FROM (SELECT url, source FROM hosts WHERE source = 'observed' AND starts_with(url, 'http://')
  UNION ALL SELECT url, CASE WHEN min(source_rank) = 0 THEN 'typosquat' ELSE 'observed' END FROM hosts
    WHERE url NOT IN (SELECT url FROM hosts WHERE source = 'observed' AND starts_with(url, 'http://')) GROUP BY url) GROUP BY 1"""))
def _(t):
    pool = t.hosts.filter("source = 'observed' AND url LIKE 'http://%'")
    return feeds.url_pool_merge(pool, t.hosts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("trace_promote", sql(ALL, """SELECT CASE WHEN y = 1 OR e.event_type = 'submit' THEN 'phishing' ELSE 'benign' END AS label, count(*) AS n FROM ev e JOIN tr USING (trace_id)
  WHERE success AND e.event_type <> 'screenshot' GROUP BY 1"""))
def _(t):
    kind = F.col("trace.events")[0]["event_type"]
    docs = visit_docs(t)
    new = traces.trace_promote(docs, docs.filter(kind == "screenshot"), kind == "submit")
    path = scratch_path(t.spark, "dataset")
    traces.append_by_label(new.select("hash", "url", "label"), path)
    return t.spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_sink", sql(HOSTS + DS, f"SELECT domain, source, count(*) AS n, {R('max(score)')} AS score FROM ds GROUP BY 1, 2"))
def _(t):
    path = scratch_path(t.spark, "candidates")
    s = domains.domain_score(t.hosts)
    for source in ("observed", "lookalike"):
        feeds.jsonl_sink(s.filter(F.col("source") == source).select("domain", "source", "score"), path)
    d = t.spark.read.schema("domain string, source string, score double").json(path)
    return d.groupBy("domain", "source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


@query("verdict_sink", sql(ALL, """SELECT source, verdict, count(*) AS n FROM (SELECT CASE WHEN starts_with(url, 'https://') THEN 'feed' ELSE 'list' END AS source,
  CASE WHEN NOT success THEN 'other' WHEN y = 1 THEN 'phishing' ELSE 'benign' END AS verdict FROM tr) GROUP BY 1, 2"""))
def _(t):
    path = scratch_path(t.spark, "verdicts")
    d = t.tr.select("trace_id", "url", F.when(F.startswith("url", F.lit("https://")), "feed").otherwise("list").alias("source"),
                    F.when(~F.col("success"), -2).otherwise(F.col("y")).alias("prediction"))
    traces.verdict_sink(d, path)
    return t.spark.read.parquet(path).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("confirmed_archive", sql(ALL, "SELECT DISTINCT substr(md5(url), 1, 12) AS hash FROM tr WHERE y = 1 AND url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'http://'))"))
def _(t):
    v = t.tr.select(traces.url_hash().alias("hash"), F.col("y").alias("prediction"))
    return traces.confirmed_archive(v, t.pages.filter("url LIKE 'http://%'").select(traces.url_hash().alias("hash")).distinct()).select("hash")


@query("manifest", sql(ALL, """SELECT CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END AS label, count(*) AS n, count(DISTINCT h) AS n_hashes, min(h) AS first_hash, max(h) AS last_hash,
  count(h)::VARCHAR || ':' || sum(CAST('0x' || substr(md5(h), 1, 12) AS BIGINT))::VARCHAR AS digest FROM (SELECT y, substr(md5(url), 1, 12) AS h FROM tr) GROUP BY 1"""))
def _(t):
    return traces.manifest(t.tr.select(F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"), traces.url_hash().alias("hash")))


@query("latest_snapshot", sql(ALL, f"SELECT page_id, url, 'url_dataset_valid_20240301' AS snapshot FROM pages WHERE ends_with({DOM('url')}, '.org')"))
def _(t):
    root = scratch_path(t.spark, "snapshots")
    for ending, day in ((".com", "20240101"), (".net", "20240201"), (".org", "20240301")):
        t.pages.filter(F.endswith(urls.domain_of("url"), F.lit(ending))).write.parquet(f"{root}/url_dataset_valid_{day}")
    return traces.latest_snapshot(t.spark, root, "url_dataset_valid_").select("page_id", "url", "snapshot")


@query("metrics_long", sql(G_ALL + MET, f"""SELECT upper(method[1]) || method[2:] || upper(m[1]) || m[2:] AS name, m AS metric, {R('v')} AS value, format('{{:.4f}}', v) AS text FROM (
  SELECT method, unnest(['accuracy', 'recall', 'f1']) AS m, unnest([accuracy, recall, f1]) AS v FROM mm)"""))
def _(t):
    m = stats.binary_metrics(method_scores(t), ["method"])
    return feeds.metrics_long(m, ["method"], ["accuracy", "recall", "f1"]).select("name", "metric", "value", "text")


@query("metrics_remap", sql(G_ALL + MET, f"""SELECT CASE method WHEN 'risk' THEN 'graph_rules' WHEN 'lexical' THEN 'url_only' ELSE method END AS view,
  {R('max(f1) FILTER (fold = 0)')} AS fold_0, {R('max(f1) FILTER (fold = 1)')} AS fold_1, {R('max(f1) FILTER (fold = 2)')} AS fold_2 FROM mf GROUP BY 1"""))
def _(t):
    f = stats.binary_metrics(method_scores(t), ["method", "fold"])
    name = F.when(F.col("method") == "risk", "graph_rules").when(F.col("method") == "lexical", "url_only").otherwise(F.col("method"))
    p = f.withColumn("view", name).groupBy("view").pivot("fold", [0, 1, 2]).agg(F.max("f1"))
    return p.select("view", *[F.col(str(k)).alias(f"fold_{k}") for k in (0, 1, 2)])


SRC = "CASE page_id % 5 WHEN 0 THEN 'openphish' WHEN 1 THEN 'phishtank' WHEN 2 THEN 'urlhaus' WHEN 3 THEN 'urlscan.io' ELSE 'crt.sh' END"


@query("feed_boost", sql(HOSTS + ds_cte(f"(SELECT * REPLACE ({SRC} AS source) FROM hosts)", "fb"), f"""SELECT page_id, domain, source, {R('score')} AS score,
  {R("CASE WHEN source IN ('openphish', 'phishtank') THEN greatest(score, 0.5) WHEN source = 'urlhaus' THEN greatest(score, 0.4) WHEN source = 'urlscan.io' THEN least(score + 0.3, 1.0) ELSE score END")} AS boosted,
  concat_ws('; ', nullif(reasons, ''), CASE source WHEN 'openphish' THEN 'openphish_confirmed' WHEN 'phishtank' THEN 'phishtank_verified' WHEN 'urlhaus' THEN 'urlhaus_flagged' WHEN 'urlscan.io' THEN 'urlscan_flagged' END) AS reasons FROM fb"""))
def _(t):
    src = (F.when(F.col("page_id") % 5 == 0, "openphish").when(F.col("page_id") % 5 == 1, "phishtank").when(F.col("page_id") % 5 == 2, "urlhaus")
           .when(F.col("page_id") % 5 == 3, "urlscan.io").otherwise("crt.sh"))
    b = feeds.feed_boost(domains.domain_score(t.hosts.withColumn("source", src)))
    return b.select("page_id", "domain", "source", "score", "boosted", F.array_join("reasons", "; ").alias("reasons"))


@query("feed_interest_scan", sql(HOSTS + PARTS, f"""SELECT min_by(url, page_id::VARCHAR) AS url, domain, 'urlscan_feed' AS source FROM dp1 WHERE source = 'lookalike' AND {INTERESTING}
  AND domain NOT IN (SELECT {DOM('url')} FROM pages) GROUP BY domain"""))
def _(t):
    return feeds.feed_interest_scan(scans(t), t.pages.select(urls.domain_of("url").alias("domain")))


@query("oof_join", sql(G_ALL + MET, f"""SELECT trace_id, {R('max(score) FILTER (method = $$risk$$)')} AS risk, {R('max(score) FILTER (method = $$lexical$$)')} AS lexical, max(fold) AS fold FROM sp GROUP BY 1"""))
def _(t):
    s = method_scores(t)
    parts = [s.filter((F.col("method") == "risk") & (F.col("fold") % 2 == k)).select("trace_id", "fold", F.col("score").alias("risk")) for k in (0, 1)]
    lex = s.filter("method = 'lexical'").select("trace_id", F.col("score").alias("lexical"))
    return parts[0].unionByName(parts[1]).join(lex, "trace_id").select("trace_id", "risk", "lexical", "fold")
