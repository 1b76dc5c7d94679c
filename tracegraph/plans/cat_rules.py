"""Quality, risk, verdicts, domains, de-duplication."""

from pyspark.sql import functions as F

from tracegraph.functions import fixed, ordered, suffixes, urls
from tracegraph.functions.text import compute_once
from tracegraph.operators import dedup, domains, events, rules
from tracegraph.plans.base_sql import (ALL, ANY, CNT, DOM, ENDS, ENT, G_ALL, HITS, HOSTS, I, IN, LIST, LIT, NETLOC, PATH, R,
                                       SERP, SUFFIX, sql)
from tracegraph.plans.cat_views import DEG, ITG_CTE
from tracegraph.plans.registry import query
from tracegraph.session import scratch_path


def joined(c):
    return F.array_join(c, "; ")


# ---------------------------------------------------------------- quality
PAT = lambda c, ps: "CASE " + " ".join(f"WHEN regexp_matches({c}, {LIT(p)}, 'i') THEN {i}" for i, p in enumerate(ps)) + " END"
QI = f""",
fds AS (SELECT trace_id, arg_min(status, (tus, event_id)) AS doc_status FROM rq WHERE resource_type = 'document'
   AND coalesce(status, 0) <> 0 GROUP BY 1),
nrq AS (SELECT trace_id, count(*) AS n_requests, string_agg(url, ' ' ORDER BY tus, event_id) AS rtext FROM rq GROUP BY 1),
hop AS (SELECT trace_id, count(*) AS n_redirects, count(DISTINCT url) AS n_hops FROM rd GROUP BY 1),
qi AS (SELECT tr.*, doc_status, coalesce(n_requests, 0) AS n_requests, coalesce(n_redirects, 0) AS n_redirects,
   coalesce(n_hops, 0) AS n_hops, {PAT('page_title', fixed.ERROR_PATTERNS)} AS err, {PAT('page_title', fixed.PARKING_PATTERNS)} AS park,
   {PAT("page_title || ' ' || coalesce(rtext, '')", fixed.CAPTCHA_PATTERNS)} AS captcha, (end_us - start_us) / 1e6 AS dur
   FROM tr LEFT JOIN fds USING (trace_id) LEFT JOIN nrq USING (trace_id) LEFT JOIN hop USING (trace_id)),
ql AS (SELECT *, list_filter([
     CASE WHEN NOT success THEN 'crawl_failed: the crawl did not succeed' END,
     CASE WHEN doc_status IN {IN(fixed.ERROR_STATUS)} THEN 'http_error: main document answered ' || doc_status END,
     CASE WHEN err IS NOT NULL THEN 'error_page_content: matched ''' || {LIST(fixed.ERROR_PATTERNS)}[err + 1] || '''' END,
     CASE WHEN park IS NOT NULL THEN 'parking_page: matched ''' || {LIST(fixed.PARKING_PATTERNS)}[park + 1] || '''' END,
     CASE WHEN n_redirects > 10 THEN 'redirect_loop: ' || n_redirects || ' hops, allowed 10' END,
     CASE WHEN n_redirects > 2 AND n_hops < n_redirects * 0.5 THEN 'circular_redirects: most hops lead to known URLs' END],
     lambda x: x IS NOT NULL) AS issues,
   list_filter([CASE WHEN doc_status IS NULL THEN 'no_doc_status: main document has no status' END,
     CASE WHEN captcha IS NOT NULL THEN 'captcha_detected: matched ''' || {LIST(fixed.CAPTCHA_PATTERNS)}[captcha + 1] || '''' END,
     CASE WHEN dur < 0.5 THEN 'very_fast_crawl: took ' || format('{{:.1f}}', dur) || ' s' END,
     CASE WHEN dur > 300 THEN 'very_slow_crawl: took ' || format('{{:.0f}}', dur) || ' s' END,
     CASE WHEN page_title = '' THEN 'empty_title: title is missing' END], lambda x: x IS NOT NULL) AS warnings,
   round(greatest(0.0, least(1.0, 1.0 - (CASE WHEN NOT success THEN 0.5 ELSE 0 END)
     - (CASE WHEN doc_status IN {IN(fixed.ERROR_STATUS)} THEN 0.6 ELSE 0 END) - (CASE WHEN err IS NOT NULL THEN 0.4 ELSE 0 END)
     - (CASE WHEN park IS NOT NULL THEN 0.5 ELSE 0 END) - (CASE WHEN n_redirects > 10 THEN 0.4 ELSE 0 END)
     - (CASE WHEN n_redirects > 2 AND n_hops < n_redirects * 0.5 THEN 0.4 ELSE 0 END)
     - (CASE WHEN captcha IS NOT NULL THEN 0.2 ELSE 0 END) - (CASE WHEN dur < 0.5 OR dur > 300 THEN 0.1 ELSE 0 END)
     - (CASE WHEN page_title = '' THEN 0.05 ELSE 0 END))), 6)::DOUBLE AS quality FROM qi),
qv AS (SELECT *, quality >= 0.3 AND len(issues) = 0 AS is_valid FROM ql)"""


def quality(t):
    return rules.trace_quality(rules.quality_inputs(t.tr, t.ev, t.rq, t.rd))


@query("trace_quality", sql(ALL + QI, f"""SELECT trace_id, {R('quality')} AS quality, is_valid::BIGINT AS is_valid,
  array_to_string(issues, '; ') AS issues, array_to_string(warnings, '; ') AS warnings FROM qv"""))
def _(t):
    return quality(t).select("trace_id", "quality", "is_valid", joined("issues").alias("issues"), joined("warnings").alias("warnings"))


@query("issue_distribution", sql(ALL + QI, """SELECT kind, code, count(*) AS n FROM (
  SELECT 'issue' AS kind, split_part(unnest(issues), ':', 1) AS code FROM qv
  UNION ALL SELECT 'warning', split_part(unnest(warnings), ':', 1) FROM qv) GROUP BY 1, 2"""))
def _(t):
    return rules.issue_distribution(quality(t))


VS = f"""SELECT {{label}} AS label, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid,
  {R('count(*) FILTER (is_valid) / greatest(1, count(*))')} AS valid_rate,
  {R('coalesce(avg(quality) FILTER (is_valid), 0.0)')} AS avg_quality_valid FROM qv"""


@query("validation_summary", sql(ALL + QI, VS.format(label="CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END") + " GROUP BY 1 UNION ALL "
                                 + VS.format(label="'overall'")))
def _(t):
    return rules.validation_summary(quality(t))


@query("grouping_sets", sql(ALL + QI, """SELECT coalesce(CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END, 'all') AS label,
  coalesce(code, 'all') AS code, n FROM (SELECT y, code, count(*) AS n FROM (SELECT y, split_part(unnest(issues), ':', 1) AS code FROM qv)
  GROUP BY GROUPING SETS ((y, code))) UNION ALL
  SELECT CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END, 'all', sum(len(issues))::BIGINT FROM qv GROUP BY y HAVING sum(len(issues)) > 0
  UNION ALL SELECT 'all', 'all', sum(len(issues))::BIGINT FROM qv"""))
def _(t):
    q = quality(t).select(F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"), F.explode("issues").alias("i"))
    r = q.withColumn("code", F.split_part("i", F.lit(":"), F.lit(1))).rollup("label", "code").agg(F.count(F.lit(1)).alias("n"))
    return r.na.fill("all", ["label", "code"])


@query("first_doc_status", sql(ALL + QI, "SELECT trace_id, doc_status::BIGINT AS doc_status FROM fds"))
def _(t):
    return rules.first_doc_status(t.rq)


@query("visible_text", sql(ALL, f"""SELECT trace_id, {I('length(page_title)')} AS n_chars,
  (regexp_matches(page_title, '(the|and)', 'i'))::BIGINT AS has_words FROM tr"""))
def _(t):
    v = rules.visible_text(t.tr, t.ev)
    return v.groupBy("trace_id").agg(F.sum(F.length("piece")).alias("n_chars"),
                                     F.max(F.col("piece").rlike("(?i)(the|and)").cast("int")).alias("has_words"))


@query("request_url_text", sql(ALL, f"""SELECT trace_id, count(*) AS n_pieces, {I('sum(length(url))')} AS n_chars FROM rq GROUP BY 1"""))
def _(t):
    p = rules.request_url_text(t.rq)
    own = F.length(F.substring_index("piece", " ", -1))
    return p.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(own).alias("n_chars"))


# ---------------------------------------------------------------- risk and verdict (flagship)
RISK = [("has_password_input > 0 AND has_email_input > 0", 0.25, "'asks for an email address and a password'"),
        ("num_redirects > 2", 0.15, "num_redirects || ' redirects'"),
        ("external_redirects > 1", 0.15, "external_redirects || ' redirects to other domains'"),
        ("num_forms >= 2", 0.1, "num_forms || ' forms'"),
        ("financial_fields_count > 0", 0.2, "financial_fields_count || ' payment fields'"),
        ("credential_fields_count >= 3", 0.1, "credential_fields_count || ' login fields'"),
        ("clustering_coefficient < 0.1 AND num_nodes > 3", 0.05, "'sparse graph'"),
        ("form_to_node_ratio > 0.15", 0.1, "'forms per node: ' || format('{:.2f}', form_to_node_ratio)")]
RISK_CTE = ITG_CTE + ",\nrisk AS MATERIALIZED (SELECT *, least(round(" + " + ".join(f"(CASE WHEN {c} THEN {w} ELSE 0.0 END)" for c, w, _ in RISK) + \
    ", 4), 1.0)::DOUBLE AS risk_score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, _, x in RISK) + \
    "], lambda x: x IS NOT NULL), '; ') AS risk_factors FROM itg)"


@query("risk_patterns", sql(G_ALL + RISK_CTE, f"""SELECT trace_id, {R('risk_score')} AS risk_score, risk_factors,
  ({RISK[0][0]})::BIGINT AS credential_harvesting, ({RISK[1][0]})::BIGINT AS multiple_redirects,
  ({RISK[3][0]})::BIGINT AS suspicious_form_count, ({RISK[4][0]})::BIGINT AS financial_data_theft,
  ({RISK[5][0]})::BIGINT AS excessive_inputs, ({RISK[6][0]})::BIGINT AS low_complexity FROM risk"""))
def _(t):
    return rules.risk_patterns(t.itg)


@query("heuristic_verdict", sql(G_ALL + RISK_CTE, f"""SELECT trace_id, {R('risk_score')} AS risk_score, risk_factors,
  (risk_score > 0.5)::BIGINT AS is_phishing, {R('CASE WHEN risk_score > 0.5 THEN risk_score ELSE 1 - risk_score END')} AS confidence,
  'heuristic' AS method FROM risk"""))
def _(t):
    return rules.heuristic_verdict(t.itg)


@query("invariants", sql(G_ALL + RISK_CTE, """SELECT trace_id, (num_forms > 0 AND external_redirects > 0)::BIGINT AS i1,
  (requests_sensitive_data > 0 AND num_redirects > 0)::BIGINT AS i2, (num_forms >= 2 AND external_redirects > 0)::BIGINT AS i3 FROM risk"""))
def _(t):
    return rules.invariants(t.itg)


FLAGS = """fl AS (SELECT trace_id, (credential_fields_count > 0 AND (has_password_input > 0 OR has_email_input > 0) AND
   requests_sensitive_data > 0 AND external_redirects > 0 AND num_forms > 0)::BIGINT AS credential_harvest,
   (credential_fields_count > 0 AND requests_sensitive_data > 0 AND num_forms >= 2 AND num_redirects >= 1)::BIGINT AS dual_submission,
   (financial_fields_count > 0 AND requests_sensitive_data > 0 AND num_forms > 0 AND external_redirects > 0)::BIGINT AS financial,
   (credential_fields_count > 0 AND (has_password_input > 0 OR has_email_input > 0) AND num_forms > 0 AND external_redirects = 0
     AND num_redirects <= 1)::BIGINT AS benign_login FROM itg)"""


@query("attack_class_flags", sql(G_ALL + ITG_CTE + ",\n" + FLAGS, f"""SELECT y::BIGINT AS y, {I('sum(credential_harvest)')} AS credential_harvest,
  {I('sum(dual_submission)')} AS dual_submission, {I('sum(financial)')} AS financial, {I('sum(benign_login)')} AS benign_login
  FROM fl JOIN tr USING (trace_id) GROUP BY 1"""))
def _(t):
    f = rules.attack_class_flags(t.itg)
    cols = [c for c in f.columns if c != "trace_id"]
    return f.join(t.tr.select("trace_id", "y"), "trace_id").groupBy("y").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in cols])


@query("feature_consistency", sql(G_ALL, "SELECT trace_id, node AS violation FROM nodes WHERE false"))
def _(t):
    return rules.feature_consistency(t.itg, t.nodes, t.edges)


@query("rule_vs_invariant", sql(G_ALL + RISK_CTE, """SELECT (risk_score > 0.5)::BIGINT AS rule, ((num_forms > 0 AND external_redirects > 0)
  OR (requests_sensitive_data > 0 AND num_redirects > 0))::BIGINT AS invariant, count(*) AS n FROM risk GROUP BY 1, 2"""))
def _(t):
    return rules.rule_vs_invariant(t.itg)


REG = lambda d: f"(CASE WHEN {SUFFIX(d)} = '' THEN '' ELSE string_split(left({d}, length({d}) - length({SUFFIX(d)}) - 1), '.')[-1] || '.' || {SUFFIX(d)} END)"
HOSTN = lambda c: f"regexp_replace(lower(regexp_replace({NETLOC(c)}, '^.*@', '')), ':\\d*$', '')"


@query("post_classify", sql(ALL, f"""SELECT trace_id, final_prediction, label FROM (SELECT *,
   CASE WHEN prediction <> 1 THEN prediction WHEN allowed THEN 0 WHEN err THEN -2 WHEN cont THEN 0 ELSE prediction END AS final_prediction,
   CASE WHEN prediction <> 1 THEN 'unchanged' WHEN allowed THEN 'false_positive' WHEN err THEN 'error_page'
     WHEN cont THEN 'content_page_fp' ELSE 'phishing' END AS label FROM (
   SELECT trace_id, y::BIGINT AS prediction, {HOSTN('final_url')} IN {IN(fixed.ALLOWED_DOMAINS)} AS allowed,
     (page_title <> '' AND regexp_matches(page_title, {LIT(fixed.POST_ERROR_PATTERN)}, 'i')) OR
       (n_events <= 2 AND forms_submitted = 0 AND n_events <= 3) AS err,
     forms_submitted = 0 AND n_events <= 5 AND forms_submitted = 0 AS cont FROM tr))"""))
def _(t):
    n_submit = t.ev.groupBy("trace_id").agg(F.count_if(F.col("event_type").isin("form_submit", "submit")).alias("n_submit_events"))
    n_req = t.rq.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_requests"))
    pred = t.tr.withColumn("prediction", F.col("y").cast("long")).join(n_submit, "trace_id").join(n_req, "trace_id")
    return rules.post_classify(pred).select("trace_id", "final_prediction", "label")


@query("success_error_text", sql(ALL, f"""SELECT page_id, {ANY('lower(html)', fixed.SUCCESS_PHRASES)}::BIGINT AS unconditional_accept,
  (NOT {ANY('lower(html)', fixed.SUCCESS_PHRASES)} AND {ANY('lower(html)', fixed.ERROR_PHRASES)})::BIGINT AS dual_submit_error FROM pages"""))
def _(t):
    return rules.success_error_text(t.raw("pages"), "html").select("page_id", "unconditional_accept", "dual_submit_error")


@query("login_link_match", sql(ALL, f"""SELECT page_id, count(*) AS n FROM (SELECT page_id, regexp_extract(l, 'href="([^"]*)"', 1) AS h,
   regexp_extract(l, '>([^<]*)$', 1) AS x FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"[^>]*>[^<]*')) AS l FROM pages))
  WHERE regexp_matches(concat_ws(' ', x, h), {LIT(fixed.LOGIN_LINK_PATTERN)}, 'i') GROUP BY 1"""))
def _(t):
    return rules.login_link_match(t.raw("pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


DUAL = """,
st AS (SELECT trace_id, tus, event_id,
   CASE WHEN event_type IN ('submit', 'js_form_submit') THEN 'S' WHEN event_type IN ('dual_submit_error', 'screenshot') THEN 'E'
     WHEN url_after <> '' AND url_before <> '' AND url_after <> url_before THEN 'A' ELSE '-' END AS step FROM ev),
s2 AS (SELECT *, lag(step, 1) OVER w AS p1, lag(step, 2) OVER w AS p2, lag(tus, 2) OVER w AS t2 FROM st WHERE step <> '-'
   WINDOW w AS (PARTITION BY trace_id ORDER BY tus, event_id)),
s3 AS (SELECT trace_id, count(*) FILTER (step = 'S' AND p1 = 'E' AND p2 = 'S' AND tus - t2 <= 86400000000) AS n_resubmits,
   count(*) FILTER (step = 'A' AND p1 = 'S' AND p2 = 'E') AS n_accepts, count(*) FILTER (step = 'S') AS n_submits FROM s2 GROUP BY 1)"""


@query("dual_submission_detect", sql(ALL + DUAL, "SELECT *, (n_resubmits > 0 AND n_accepts > 0)::BIGINT AS dual_submission FROM s3"))
def _(t):
    return events.dual_submission_detect(t.ev)


@query("request_response_match", sql(ALL, """SELECT a.trace_id, a.url, count(*) AS n_requests, count(b.nth) AS n_matched,
  count(*) FILTER (b.status = 200) AS n_ok FROM
  (SELECT *, row_number() OVER (PARTITION BY trace_id, url ORDER BY tus, event_id) AS nth FROM rq) a LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY trace_id, url ORDER BY tus, event_id) AS nth FROM rq WHERE status IS NOT NULL) b
  ON a.trace_id = b.trace_id AND a.url = b.url AND a.nth = b.nth GROUP BY 1, 2"""))
def _(t):
    m = events.request_response_match(t.rq, t.rq.filter("status IS NOT NULL"))
    return m.groupBy("trace_id", "url").agg(F.count(F.lit(1)).alias("n_requests"), F.count("response_status").alias("n_matched"),
                                            F.count_if(F.col("response_status") == 200).alias("n_ok"))


# ---------------------------------------------------------------- domains
D = "lower(trim(domain))"
LAB = f"split_part({D}, '.', 1)"
LONG = [b for b in fixed.TARGET_BRANDS if len(b) > 4]
DS_AXES = {
    "brand_impersonation": f"""CASE WHEN len(list_filter({LIST(LONG)}, lambda b: levenshtein(b, lab) <= 2 AND NOT (contains(lab, b) AND b <> lab))) > 0
      THEN 0.4 WHEN len(list_filter({LIST(fixed.TARGET_BRANDS)}, lambda b: contains(lab, b) AND b <> lab)) > 0 THEN 0.35
      WHEN {ANY('d', fixed.TARGET_BRANDS)} AND len(string_split(d, '.')) > 2 THEN 0.3 ELSE 0.0 END""",
    "suspicious_keywords": f"CASE WHEN {HITS('d', fixed.PHISH_KEYWORDS)} >= 3 THEN 0.2 WHEN {HITS('d', fixed.PHISH_KEYWORDS)} >= 2 THEN 0.15 "
                           f"WHEN {HITS('d', fixed.PHISH_KEYWORDS)} >= 1 THEN 0.08 ELSE 0.0 END",
    "high_risk_tld": f"CASE WHEN {ENDS('d', ['.' + x for x in fixed.HIGH_RISK_TLDS])} THEN 0.15 ELSE 0.0 END",
    "structural_anomaly": f"""least(0.15, (CASE WHEN len(string_split(d, '.')) > 4 THEN 0.08 ELSE 0 END) + (CASE WHEN length(d) > 50 THEN 0.05 ELSE 0 END)
      + (CASE WHEN {CNT('d', '-')} >= 3 THEN 0.07 ELSE 0 END)
      + (CASE WHEN regexp_matches(d, '\\d{{1,3}}[-\\.]\\d{{1,3}}[-\\.]\\d{{1,3}}') THEN 0.05 ELSE 0 END)
      + (CASE WHEN length(lab) > 8 AND {ENT('lab')} > 3.5 THEN 0.05 ELSE 0 END))""",
    "abused_hosting": f"CASE WHEN {ENDS('d', fixed.ABUSED_HOSTS)} THEN 0.1 ELSE 0.0 END"}


def ds_cte(src: str, name: str = "ds") -> str:
    return f""",
{name}0 AS MATERIALIZED (SELECT *, {D} AS d, {LAB} AS lab FROM {src}),
{name}1 AS MATERIALIZED (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in DS_AXES.items())} FROM {name}0),
{name} AS MATERIALIZED (SELECT *, least(1.0, round({' + '.join(DS_AXES)}, 6))::DOUBLE AS score, array_to_string(list_filter([
   {', '.join(f"CASE WHEN {k} > 0 THEN '{k}:' || format('{{:.2f}}', {k}) END" for k in DS_AXES)}], lambda x: x IS NOT NULL), '; ') AS reasons
   FROM {name}1)"""


DS = ds_cte("hosts")


@query("domain_score", sql(HOSTS + DS, f"SELECT page_id, source, domain, {R('score')} AS score, reasons FROM ds"))
def _(t):
    return domains.domain_score(t.hosts).select("page_id", "source", "domain", "score", joined("reasons").alias("reasons"))


@query("threshold_filter", sql(HOSTS + DS, f"SELECT page_id, domain, {R('score')} AS score FROM ds WHERE score >= 0.2"))
def _(t):
    return domains.domain_score(t.hosts).filter("score >= 0.20").select("page_id", "domain", "score")


@query("score_bands", sql(HOSTS + DS, """SELECT source, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n FROM ds GROUP BY 1, 2"""))
def _(t):
    return domains.domain_score(t.hosts).groupBy("source", domains.score_bands().alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_count", sql(HOSTS, f"SELECT page_id, source, {I(HITS('lower(domain)', fixed.PHISH_KEYWORDS))} AS n_keywords FROM hosts"))
def _(t):
    from tracegraph.functions.text import word_hits
    return t.hosts.select("page_id", "source", word_hits(F.lower("domain"), fixed.PHISH_KEYWORDS).alias("n_keywords"))


@query("brand_edit_join", sql(HOSTS, f"""SELECT page_id, source, label, brand FROM (SELECT page_id, source, split_part(lower(domain), '.', 1) AS label,
  unnest({LIST(LONG)}) AS brand FROM hosts) WHERE levenshtein(brand, label) <= 2"""))
def _(t):
    return domains.brand_edit(t.hosts).select("page_id", "source", "label", "brand")


SLD = lambda d: f"(CASE WHEN {SUFFIX(d)} = '' THEN {d} ELSE string_split(left({d}, length({d}) - length({SUFFIX(d)}) - 1), '.')[-1] END)"
SUB = lambda d: f"(CASE WHEN {SUFFIX(d)} = '' OR length({d}) - length({REG(d)}) - 1 <= 0 THEN '' ELSE left({d}, length({d}) - length({REG(d)}) - 1) END)"


def brand_case(brands) -> str:
    return "CASE " + " ".join(f"WHEN {ANY('sld', k)} OR {ANY('sub', k)} THEN {LIT(b)}" for b, k in brands) + " END"


PARTS = f""",
dp AS MATERIALIZED (SELECT *, replace(lower(domain), '*.', '') AS d FROM hosts),
dp1 AS MATERIALIZED (SELECT *, {SLD('d')} AS sld, {SUB('d')} AS sub, {SUFFIX('d')} AS sfx, {REG('d')} AS reg FROM dp)"""


def points_sql(brands, official, tlds, ind, ct: bool) -> str:
    off = " OR ".join(f"(brand = {LIT(b)} AND {ENDS('reg', e)})" for b, e in official.items())
    pts = f"""15 * least({HITS('d', ind)}, 3) + (CASE WHEN sfx IN {IN(tlds)} THEN 20 ELSE 0 END) + (CASE WHEN length(sld) > 20 THEN 10 ELSE 0 END)
      + (CASE WHEN {CNT('sld', '-')} >= 2 THEN 10 * least({CNT('sld', '-')}, 3) ELSE 0 END)
      + (CASE WHEN len(list_filter(string_split(sub, '.'), lambda s: s <> '')) >= 2 THEN 5 * len(list_filter(string_split(sub, '.'), lambda s: s <> '')) ELSE 0 END)"""
    if ct:
        score = f"""CASE WHEN brand IS NULL THEN 0 WHEN {off} THEN -1 ELSE 30 + {pts} + (CASE WHEN regexp_matches(sld, '[0-9]') THEN 10 ELSE 0 END)
          + (CASE WHEN {ANY('d', fixed.CT_HOSTING)} THEN 15 ELSE 0 END) END"""
    else:
        score = f"CASE WHEN brand IS NOT NULL AND ({off}) THEN -1 ELSE (CASE WHEN brand IS NOT NULL THEN 30 ELSE 0 END) + {pts} END"
    return sql(HOSTS + PARTS + f",\ndp2 AS MATERIALIZED (SELECT *, {brand_case(brands)} AS brand FROM dp1)",
               f"SELECT page_id, source, domain, brand, {I(score)} AS points FROM dp2")


CT_SQL = points_sql(fixed.CT_BRAND_KEYWORDS, fixed.CT_OFFICIAL, fixed.CT_TLDS, fixed.CT_INDICATORS, True)


@query("domain_points_ct", CT_SQL)
def _(t):
    return domains.domain_points_ct(t.hosts).select("page_id", "source", "domain", "brand", "points")


@query("domain_points_live", points_sql(fixed.LIVE_BRAND_KEYWORDS, fixed.LIVE_OFFICIAL, fixed.LIVE_TLDS, fixed.LIVE_INDICATORS, False))
def _(t):
    return domains.domain_points_live(t.hosts).select("page_id", "source", "domain", "brand", "points")


@query("brand_contains", sql(HOSTS + PARTS, f"SELECT page_id, source, brand FROM (SELECT *, {brand_case(fixed.CT_BRAND_KEYWORDS)} AS brand FROM dp1) WHERE brand IS NOT NULL"))
def _(t):
    return domains.domain_points_ct(t.hosts).filter("brand IS NOT NULL").select("page_id", "source", "brand")


@query("official_suffix", f"SELECT brand, count(*) AS n FROM ({CT_SQL}) WHERE points = -1 GROUP BY 1")
def _(t):
    return domains.domain_points_ct(t.hosts).filter("points = -1").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("registered_domain", sql(HOSTS + PARTS, "SELECT page_id, source, sld, sub, sfx AS suffix, reg AS registered FROM dp1"))
def _(t):
    d = compute_once(t.hosts, {"d": F.lower("domain")})
    return d.select("page_id", "source", urls.sld_of("d").alias("sld"), urls.subdomain_of("d").alias("sub"),
                    urls.suffix_of("d").alias("suffix"), urls.registered_of("d").alias("registered"))


@query("is_web_page_url", sql(HOSTS, f"""SELECT page_id, source, (NOT regexp_matches(lower({PATH('url')}), {LIT(fixed.BINARY_EXT_PATTERN)}) AND
  NOT regexp_matches(url, {LIT(fixed.IP_SINGLE_LETTER_PATTERN)}))::BIGINT AS ok FROM hosts"""))
def _(t):
    return t.hosts.select("page_id", "source", domains.is_web_page_url("url").alias("ok"))


@query("is_browsable_domain", sql(HOSTS, f"""SELECT page_id, source, (NOT regexp_matches({D}, {LIT(fixed.INFRA_PATTERN)}) AND
  NOT {ENDS(D, fixed.INFRA_SUFFIXES)})::BIGINT AS ok FROM hosts"""))
def _(t):
    return t.hosts.select("page_id", "source", domains.is_browsable_domain("domain").alias("ok"))


@query("is_browsable_ranked", sql(HOSTS, f"""SELECT page_id, source, (NOT {ANY(D, fixed.RANKED_INFRA_WORDS)} AND
  NOT {ENDS(D, ['.' + x for x in fixed.RANKED_INFRA_TLDS])} AND NOT regexp_matches({D}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$'))::BIGINT AS ok FROM hosts"""))
def _(t):
    return t.hosts.select("page_id", "source", domains.is_browsable_ranked("domain").alias("ok"))


INTERESTING = f"""(NOT (reg IN {IN(fixed.ALLOWED_DOMAINS)} OR d IN {IN(fixed.ALLOWED_DOMAINS)}) AND NOT {ENDS("('.' || sfx)", ['.' + s for s in fixed.OFFICIAL_SUFFIXES])}
  AND NOT contains(d, 'sslproxy.gateway') AND NOT contains(d, '.internal.') AND ({ANY("(sub || '.' || sld)", fixed.FEED_BRANDS)}
  OR (sfx IN {IN(fixed.FEED_TLDS)} AND {ANY("(sub || '.' || sld)", fixed.FEED_KEYWORDS)}) OR length(sub) > 30 OR {CNT('sld', '-')} >= 3))"""


@query("is_interesting", sql(HOSTS + PARTS, f"SELECT page_id, source, domain, {INTERESTING}::BIGINT AS ok FROM dp1"))
def _(t):
    return domains.is_interesting(t.hosts).select("page_id", "source", "domain", F.col("interesting").alias("ok"))


@query("allowlist_semi", sql(HOSTS + PARTS, f"SELECT page_id, source, domain FROM dp1 WHERE reg IN {IN(fixed.ALLOWED_DOMAINS)} OR d IN {IN(fixed.ALLOWED_DOMAINS)}"))
def _(t):
    return domains.allowlist_semi(t.hosts).select("page_id", "source", "domain")


# ---------------------------------------------------------------- search results and queries
SS = SERP + ds_cte("(SELECT * FROM serp)", "sd") + f""",
ss AS MATERIALIZED (SELECT * EXCLUDE (score), len(list_filter({LIST(fixed.TARGET_BRANDS)}, lambda b: contains(lower(title), b) AND NOT contains(lower(domain), b))) > 0 AS mm,
   score AS dpart FROM sd),
sc AS MATERIALIZED (SELECT *, least(1.0, round(dpart * 0.4 + least({HITS("lower(title || ' ' || snippet)", fixed.SNIPPET_PHRASES)} * 0.08, 0.25)
   + (CASE WHEN regexp_matches(lower(url), 'https?://\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') THEN 0.15 ELSE 0 END)
   + least({HITS('lower(url)', fixed.SERP_PATHS)} * 0.05, 0.15) + (CASE WHEN position > 10 THEN 0.05 WHEN position > 5 THEN 0.03 ELSE 0 END)
   + (CASE WHEN mm THEN 0.2 ELSE 0 END), 6))::DOUBLE AS score FROM ss)"""


@query("serp_score", sql(SS, f"SELECT page_id, query, url, engine, position, mm::BIGINT AS title_mismatch, {R('score')} AS score FROM sc"))
def _(t):
    return domains.serp_score(t.serp).select("page_id", "query", "url", "engine", "position", "title_mismatch", "score")


@query("brand_title_mismatch", sql(SS, "SELECT page_id, title FROM sc WHERE mm"))
def _(t):
    return domains.serp_score(t.serp).filter("title_mismatch = 1").select("page_id", "title")


TOX = SS + """,
tox AS (SELECT query, count(*) AS results, count(*) FILTER (score >= 0.25) AS suspicious, avg((score >= 0.25)::INT) AS toxicity FROM sc GROUP BY 1)"""


@query("query_toxicity", sql(TOX, f"SELECT query, results, suspicious, {R('toxicity')} AS toxicity FROM tox"))
def _(t):
    return domains.query_toxicity(domains.serp_score(t.serp))


@query("top_queries", sql(TOX, f"SELECT query, results, suspicious, {R('toxicity')} AS toxicity FROM tox WHERE results > 0 ORDER BY tox.toxicity DESC, query LIMIT 20"))
def _(t):
    return domains.query_toxicity(domains.serp_score(t.serp)).filter("results > 0").orderBy(F.desc("toxicity"), "query").limit(20)


@query("high_toxicity_queries", sql(TOX, f"""SELECT query, {R('toxicity * 0.8')} AS inherited FROM
  (SELECT * FROM tox WHERE toxicity > 0.3 ORDER BY toxicity DESC, query LIMIT 20)"""))
def _(t):
    q = domains.query_toxicity(domains.serp_score(t.serp)).filter("toxicity > 0.3").orderBy(F.desc("toxicity"), "query").limit(20)
    return q.select("query", (F.col("toxicity") * 0.8).alias("inherited"))


@query("crawl_targets", sql(SS, f"""SELECT url, 'serp_mining_' || engine AS source, {R('score')} AS score FROM sc WHERE score >= 0.25
"""))
def _(t):
    s = domains.serp_score(t.serp).filter("score >= 0.25")
    return s.select("url", F.concat(F.lit("serp_mining_"), F.col("engine")).alias("source"), "score")


@query("engine_distribution", sql(SS, "SELECT engine, count(*) AS n FROM sc WHERE score >= 0.25 GROUP BY 1"))
def _(t):
    return domains.serp_score(t.serp).filter("score >= 0.25").groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query("category_distribution", sql(SS, "SELECT split_part(query, ' ', 1) AS first_word, category, count(*) AS n FROM sc GROUP BY 1, 2"))
def _(t):
    return t.serp.groupBy(F.split_part("query", F.lit(" "), F.lit(1)).alias("first_word"), "category").agg(F.count(F.lit(1)).alias("n"))


@query("category_filter", sql(SERP, "SELECT page_id, query FROM serp WHERE category IN ('crypto_scam', 'financial_fraud')"))
def _(t):
    return t.serp.filter(F.col("category").isin("crypto_scam", "financial_fraud")).select("page_id", "query")


QS = f"""least(1.0, round((CASE category {' '.join(f"WHEN '{c}' THEN {w}" for c, w, _ in fixed.QUERY_CATEGORIES)} ELSE 1.0 END) * 0.1
  + least({HITS('lower(query)', fixed.QUERY_BRANDS)} * 0.15, 0.3) + least({HITS('lower(query)', fixed.QUERY_ACTIONS)} * 0.1, 0.2)
  + least({HITS('lower(query)', fixed.QUERY_URGENCY)} * 0.1, 0.2) + least({HITS('lower(query)', fixed.QUERY_TECHNICAL)} * 0.05, 0.1)
  + (CASE WHEN len(string_split(query, ' ')) >= 3 THEN 0.05 ELSE 0 END), 6))"""


@query("query_score", sql(SERP, f"SELECT page_id, query, category, {R(QS)} AS expected_toxicity FROM serp"))
def _(t):
    return domains.query_score(t.serp).select("page_id", "query", "category", "expected_toxicity")


def mined_brands(t):
    """Brand terms found in the table: the first word of each search query, ranked by name."""
    b = t.serp.select(F.regexp_extract("query", r"^(\S+)", 1).alias("brand")).distinct()
    return ordered.sequence(b.withColumn("one", F.lit(1)), ["one"], ["brand"], F.substring("brand", 1, 1), "brand_rank").drop("one")


BR = SERP + """,
br AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS brand_rank FROM (SELECT DISTINCT split_part(query, ' ', 1) AS brand FROM serp))"""


def gen_sql() -> str:
    parts = [f"SELECT brand || ' ' || p AS query, 'credential_harvest' AS category, 'brand_action_template' AS source, 0 AS s, brand_rank AS b, i FROM (SELECT *, unnest({LIST(fixed.QUERY_ACTIONS)}) AS p, unnest(range({len(fixed.QUERY_ACTIONS)})) AS i FROM br)",
             f"SELECT brand || ' ' || p, 'urgency_social_eng', 'brand_urgency_template', 1, brand_rank, i FROM (SELECT *, unnest({LIST(fixed.QUERY_URGENCY)}) AS p, unnest(range({len(fixed.QUERY_URGENCY)})) AS i FROM br WHERE brand_rank < 20)"]
    stage = 2
    for cat, _, templates in fixed.QUERY_CATEGORIES:
        for tp in templates:
            slot = "{urgency}" if "{urgency}" in tp else "{tech_pattern}" if "{tech_pattern}" in tp else ""
            fills = "['']"
            if slot:
                words = LIST(fixed.QUERY_URGENCY if slot == "{urgency}" else fixed.QUERY_TECHNICAL)
                fills = f"list_transform(list_sort(list_transform({words}, lambda w: md5(brand || '|' || w) || w))[:3], lambda h: h[33:])"
            text = f"replace({LIT(tp)}, '{{brand}}', brand)"
            if slot:
                text = f"replace({text}, '{slot}', p)"
            parts.append(f"SELECT {text}, '{cat}', 'category_template', {stage}, brand_rank, i FROM (SELECT *, unnest({fills}) AS p, unnest(range(len({fills}))) AS i FROM br)")
            stage += 1
    return ",\ngen0 AS (" + "\nUNION ALL ".join(parts) + """),
gen AS (SELECT lower(query) AS query_key, arg_max(query, (s, b, i)) AS query, arg_max(category, (s, b, i)) AS category,
  arg_max(source, (s, b, i)) AS source FROM gen0 GROUP BY 1)"""


@query("query_generate", sql(BR + gen_sql(), f"""SELECT query_key, query, category, source, {R(QS)} AS expected_toxicity FROM gen"""))
def _(t):
    return domains.query_generate(mined_brands(t))


@query("cartesian_expand", sql(BR, f"""SELECT brand, count(DISTINCT brand || ' ' || p) AS n_queries, max(brand || ' ' || p) AS last_query FROM
  (SELECT brand, unnest({LIST(fixed.QUERY_ACTIONS + fixed.QUERY_URGENCY)}) AS p FROM br) GROUP BY 1"""))
def _(t):
    e = mined_brands(t).select("brand", F.explode(domains.lit_array(fixed.QUERY_ACTIONS + fixed.QUERY_URGENCY)).alias("p"))
    q = F.concat_ws(" ", "brand", "p")
    return e.groupBy("brand").agg(F.countDistinct(q).alias("n_queries"), F.max(q).alias("last_query"))


@query("query_dedup", sql(SERP, """SELECT lower(query) AS query_key, arg_max(query, page_id) AS query, arg_max(category, page_id) AS category,
  arg_max(engine, page_id) AS source FROM serp GROUP BY 1"""))
def _(t):
    return domains.query_dedup(t.serp.select("query", "category", F.col("engine").alias("source"), F.col("page_id").alias("seq")))


SQG = BR + f""",
ce AS (SELECT regexp_replace(brand, '[^a-z0-9]', '', 'g') AS k, ind, tld FROM (SELECT brand, ind, unnest({LIST(fixed.SQUAT_TLDS)}) AS tld FROM
   (SELECT brand, unnest({LIST(fixed.SQUAT_INDICATORS)}) AS ind FROM br))),
cand AS (SELECT k AS keyword, k || '-' || ind || '.' || tld AS domain FROM ce UNION ALL SELECT k, ind || '-' || k || '.' || tld FROM ce
   UNION ALL SELECT k, k || ind || '.' || tld FROM ce)"""


def mined_keywords(t):
    return mined_brands(t).select(F.regexp_replace("brand", "[^a-z0-9]", "").alias("keyword"))


@query("squat_generate", sql(SQG, "SELECT keyword, domain FROM cand"))
def _(t):
    return domains.squat_generate(mined_keywords(t))


@query("squat_affixes", sql(BR, f"""SELECT keyword, name || '.' || tld AS domain FROM (SELECT keyword, name, unnest({LIST(fixed.AFFIX_TLDS)}) AS tld FROM
  (SELECT k AS keyword, unnest(list_concat(list_transform({LIST(fixed.AFFIX_PREFIXES)}, lambda p: p || k),
   list_transform({LIST(fixed.AFFIX_SUFFIXES)}, lambda s: k || s))) AS name FROM (SELECT regexp_replace(brand, '[^a-z0-9]', '', 'g') AS k FROM br)))"""))
def _(t):
    return domains.affix_generate(mined_keywords(t))


@query("squat_hits", sql(SQG + ",\n" + HOSTS.strip(), "SELECT page_id, domain FROM hosts WHERE domain IN (SELECT domain FROM cand)"))
def _(t):
    return domains.squat_hits(t.hosts, domains.squat_generate(mined_keywords(t))).select("page_id", "domain")


# ---------------------------------------------------------------- de-duplication and sets
C48 = lambda x: f"CAST('0x' || substr(md5({x}), 1, 12) AS BIGINT)"
BAG = lambda x: f"count({x})::VARCHAR || ':' || coalesce(sum({C48(x)}), 0)::VARCHAR"
FP = f""",
fp AS (SELECT tr.trace_id, md5(concat_ws('::', final_url, types, hs)) AS fingerprint FROM tr
  JOIN (SELECT trace_id, {BAG('event_type')} AS types FROM ev GROUP BY 1) a USING (trace_id)
  JOIN (SELECT trace_id, {BAG('h')} AS hs FROM (SELECT DISTINCT trace_id, {NETLOC('url')} AS h FROM rq) GROUP BY 1) b USING (trace_id))"""


@query("trace_fingerprint", sql(ALL + FP, "SELECT trace_id, fingerprint FROM fp"))
def _(t):
    return dedup.trace_fingerprint(t.tr, t.ev, t.rq)


@query("dedup_traces", sql(ALL + FP, """SELECT trace_id, (trace_id = min(trace_id) OVER (PARTITION BY fingerprint))::BIGINT AS is_unique, fingerprint FROM fp"""))
def _(t):
    return dedup.dedup_traces(dedup.trace_fingerprint(t.tr, t.ev, t.rq))


@query("dedup_url", sql(SERP, """SELECT query, url_key, url, engine, position FROM (SELECT *, row_number() OVER (PARTITION BY query, url_key ORDER BY engine, position, page_id) AS rn
  FROM (SELECT *, regexp_replace(lower(url), '/+$', '') AS url_key FROM serp)) WHERE rn = 1"""))
def _(t):
    return dedup.dedup_url(t.serp)


@query("dedup_phish_pool", sql(HOSTS, """SELECT url, source, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, page_id) AS rn FROM hosts) WHERE rn = 1"""))
def _(t):
    return ordered.first_per_key(t.hosts, ["url"], [F.col("source_rank"), F.col("page_id")], ["source", "page_id"])


@query("first_seen_dedup", sql(HOSTS, """SELECT domain, source, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source_rank, page_id) AS rn FROM hosts) WHERE rn = 1"""))
def _(t):
    return ordered.first_per_key(t.hosts, ["domain"], [F.col("source_rank"), F.col("page_id")], ["source", "page_id"])


@query("best_score_dedup", sql(HOSTS + DS, f"""SELECT domain, {R('score')} AS score, source, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain
  ORDER BY score DESC, source_rank, page_id) AS rn FROM ds) WHERE rn = 1"""))
def _(t):
    return dedup.best_score_dedup(domains.domain_score(t.hosts).drop("reasons")).select("domain", "score", "source", "page_id")


@query("rank_candidates", sql(HOSTS + DS, f"SELECT DISTINCT domain, {R('score')} AS score FROM ds ORDER BY 2 DESC, 1"))
def _(t):
    return domains.domain_score(t.hosts).select("domain", "score").distinct().orderBy(F.desc("score"), "domain")


@query("union_sources", sql(HOSTS + "," + SERP, """SELECT source, count(*) AS n, count(DISTINCT domain) AS n_domains FROM hosts GROUP BY 1
  UNION ALL SELECT engine, count(*), count(DISTINCT domain) FROM serp GROUP BY 1"""))
def _(t):
    u = dedup.union_sources(t.hosts.select("domain", "url", "source"), t.serp.select("domain", "url", F.col("engine").alias("source"), "title"))
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("n_domains"))


@query("combine_discoveries", sql(HOSTS, """SELECT url, domain, source FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source_rank, page_id) AS rn FROM hosts WHERE domain <> '')
  WHERE rn = 1 AND url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'http://'))"""))
def _(t):
    return dedup.combine_discoveries(t.hosts, t.pages.filter("url LIKE 'http://%'")).select("url", "domain", "source")


@query("seen_anti", sql(HOSTS, f"SELECT page_id, source, domain FROM hosts WHERE domain NOT IN (SELECT {DOM('url')} FROM pages)"))
def _(t):
    return dedup.seen_anti(t.hosts, t.pages.select(urls.domain_of("url").alias("domain")), "domain").select("page_id", "source", "domain")


@query("new_domains", sql(HOSTS, f"SELECT domain FROM hosts EXCEPT ALL SELECT {DOM('url')} FROM pages"))
def _(t):
    return t.hosts.select("domain").exceptAll(t.pages.select(urls.domain_of("url").alias("domain")))


@query("intersection_dataset", sql(G_ALL + DEG, "SELECT trace_id, y::BIGINT AS y FROM tr WHERE success AND trace_id IN (SELECT trace_id FROM nn WHERE n >= 2)"))
def _(t):
    return t.tr.filter("success").join(t.itg.filter("num_nodes >= 2").select("trace_id"), "trace_id", "left_semi").select("trace_id", "y")


# ---------------------------------------------------------------- suffix lists
SUFFIX_LIST = ["// rules of every kind", "com", "net  a comment", "xyz", "dev", "uk", "co.uk", "*.ck", "!www.ck", "icu", "pages.dev", "us", "k12.ma.us", "dev.pages.example"]
SUFFIX_RULES = [("plain", r) for r in ("com", "net", "xyz", "dev", "uk", "co.uk", "icu", "pages.dev", "us", "k12.ma.us", "dev.pages.example")] + [("wildcard", "ck"), ("exception", "www.ck")]
SUFFIX_SQL = HOSTS + f""",
sn AS MATERIALIZED (SELECT page_id, source, lower(d) AS name FROM (SELECT page_id, source, domain AS d FROM hosts
   UNION ALL SELECT page_id, 'ck', 'a.' || b || '.ck' FROM h1 UNION ALL SELECT page_id, 'www', 'shop.WWW.ck' FROM h1 WHERE page_id % 2 = 0
   UNION ALL SELECT page_id, 'school', b || '.k12.ma.us' FROM h1 UNION ALL SELECT page_id, 'none', b || '.unknown-ending' FROM h1 UNION ALL SELECT page_id, 'bare', 'ck' FROM h1)),
sl AS (SELECT *, string_split(name, '.') AS l FROM sn WHERE contains(name, '.') AND NOT regexp_matches(name, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$')),
sr AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{r}')" for k, r in SUFFIX_RULES)}) v(kind, rule)),
sh AS (SELECT page_id, source, kind, len(l) AS n, len(string_split(rule, '.')) + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END AS size
   FROM sl JOIN sr ON name = rule OR ends_with(name, '.' || rule)),
sb AS (SELECT page_id, source, coalesce(max(size) FILTER (kind = 'exception'), max(size)) AS size FROM sh WHERE size <= n GROUP BY 1, 2),
sf AS (SELECT sl.page_id, sl.source, name, l, coalesce(size, 1) AS size FROM sl LEFT JOIN sb USING (page_id, source))"""


@query("suffix_list", sql(SUFFIX_SQL, """SELECT page_id, source, name, coalesce(array_to_string(l[-size:], '.'), '') AS suffix,
  CASE WHEN len(l) > size THEN array_to_string(l[-(size + 1):], '.') ELSE '' END AS registered,
  CASE WHEN len(l) > size + 1 THEN array_to_string(l[:len(l) - size - 1], '.') ELSE '' END AS subdomain
  FROM sn LEFT JOIN (SELECT page_id, source, l, size FROM sf) f USING (page_id, source)"""))
def _(t):
    path = scratch_path(t.spark, "suffixes")
    t.spark.createDataFrame([(x,) for x in SUFFIX_LIST], "value string").write.text(path)
    brand = F.element_at(F.array(*[F.lit(b) for b in fixed.QUERY_BRANDS[:10]]), (F.col("page_id") % 10 + 1).cast("int"))
    p = t.pages.select("page_id", brand.alias("b"))
    made = {"ck": F.concat(F.lit("a."), "b", F.lit(".ck")), "school": F.concat("b", F.lit(".k12.ma.us")), "none": F.concat("b", F.lit(".unknown-ending")), "bare": F.lit("ck"),
            "www": F.when(F.col("page_id") % 2 == 0, "shop.WWW.ck")}
    rows = p.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("domain")) for k, v in made.items()])).alias("x")).select("page_id", "x.*")
    rows = t.hosts.select("page_id", "source", "domain").unionByName(rows.filter("domain IS NOT NULL"))
    d = suffixes.with_suffix(rows, suffixes.suffix_rules(t.spark, path))
    return d.select("page_id", "source", F.lower("domain").alias("name"), "suffix", "registered", "subdomain")
