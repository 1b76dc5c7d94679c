"""The adapter of tracegraph.sources.adapter in SQL, as common table expressions."""

from tracegraph.functions import fixed

LIT = lambda s: "'" + s.replace("'", "''") + "'"
LIST = lambda xs: "[" + ", ".join(LIT(x) for x in xs) + "]"
IN = lambda xs: "(" + ", ".join(LIT(x) if isinstance(x, str) else str(x) for x in xs) + ")"

NETLOC = lambda c: f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
PATH = lambda c: f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = lambda c: f"regexp_extract({c}, '^[^?#]*\\?([^#]*)', 1)"
SCHEME = lambda c: f"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
DOM = lambda c: f"lower(split_part({NETLOC(c)}, ':', 1))"
ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, {LIT(w)})" for w in words) + ")"
HITS = lambda c, words: "(" + " + ".join(f"contains({c}, {LIT(w)})::INT" for w in words) + ")"
ENDS = lambda c, words: "(" + " OR ".join(f"ends_with({c}, {LIT(w)})" for w in words) + ")"
CNT = lambda c, ch: f"(length({c}) - length(replace({c}, {LIT(ch)}, '')))"
ENT = lambda c: (f"(CASE WHEN length({c}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform("
                 f"list_distinct(string_split({c}, '')), lambda ch: -((length({c}) - length(replace({c}, ch, ''))) / "
                 f"length({c})) * log2((length({c}) - length(replace({c}, ch, ''))) / length({c})))), 0.0) END)")
R = lambda e: f"round(CAST({e} AS DOUBLE) + 3e-9, 6)"  # nudged off exact ties, as in registry.present
I = lambda e: f"CAST({e} AS BIGINT)"
DIV = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"

SUFFIX = lambda d: (f"(CASE WHEN regexp_matches({d}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR NOT contains({d}, '.') "
                    f"THEN '' WHEN array_to_string(string_split({d}, '.')[-2:], '.') IN {IN(fixed.TWO_LABEL_SUFFIXES)} "
                    f"AND {CNT(d, '.')} >= 2 THEN array_to_string(string_split({d}, '.')[-2:], '.') "
                    f"ELSE string_split({d}, '.')[-1] END)")

V = """
v AS (SELECT event_id, user_id, epoch_us(ts) AS tus, event_type AS kind,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        user_id * 100 + CAST(floor((epoch_us(ts) - 1704067200000000) / 604800000000) AS BIGINT) AS trace_id
      FROM events),
visits AS (SELECT v.*, p.page_id, p.url AS page_url FROM v
      JOIN pages p ON p.page_id = v.k % (SELECT count(*) FROM pages))"""
EV = V + """,
ev0 AS (SELECT *, row_number() OVER w - 1 AS raw_idx, coalesce(lag(page_url) OVER w, page_url) AS url_before,
        first_value(page_url) OVER w AS root_url FROM visits WINDOW w AS (PARTITION BY trace_id ORDER BY tus, event_id)),
ev AS (SELECT trace_id, event_id, user_id, tus, raw_idx, page_id, page_url, k, root_url, url_before,
        CASE WHEN k % 3 = 0 THEN page_url ELSE url_before END AS url_after,
        CASE kind WHEN 'click' THEN 'button_click' WHEN 'view' THEN 'link_detected' WHEN 'signup' THEN 'form_input'
          WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'screenshot' END AS event_type,
        CASE kind WHEN 'click' THEN 'button' WHEN 'view' THEN 'a' WHEN 'signup' THEN 'input'
          WHEN 'purchase' THEN 'form' WHEN 'error' THEN 'page' END AS element_tag,
        ['password', 'email', 'card_number', 'nav', ''][k % 5 + 1] AS element_id, '' AS element_class,
        '' AS element_text,
        CASE WHEN k % 5 <> 4 AND kind IN ('signup', 'purchase')
          THEN ['password', 'email', 'card_number', 'nav', ''][k % 5 + 1] ELSE '' END AS form_field
      FROM ev0)"""
RQ = """,
rq AS (SELECT trace_id, event_id, tus, page_url AS url,
        ['document', 'script', 'stylesheet', 'image', 'xhr', 'fetch', 'font'][k % 7 + 1] AS resource_type,
        CASE event_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS status,
        CASE k % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/javascript'
          WHEN 2 THEN 'text/css' END AS content_type FROM visits)"""
RD = """,
rd0 AS (SELECT trace_id, event_id, tus, page_url AS url, lag(page_url) OVER w AS p FROM visits WHERE k % 7 = 0
      WINDOW w AS (PARTITION BY trace_id ORDER BY tus, event_id)),
rd AS (SELECT trace_id, event_id, tus, url, row_number() OVER w - 1 AS pos, lag(url) OVER w AS prev_url
      FROM rd0 WHERE p IS NULL OR p <> url WINDOW w AS (PARTITION BY trace_id ORDER BY tus, event_id))"""
TR = """,
tr0 AS (SELECT trace_id, user_id, arg_min(page_id, (tus, event_id)) AS page_id,
        arg_min(page_url, (tus, event_id)) AS url, arg_max(page_url, (tus, event_id)) AS final_url,
        count(*) FILTER (kind = 'purchase') AS forms_submitted,
        count(*) FILTER (kind <> 'error') AS elements_interacted, count(*) AS n_events,
        min(tus) AS start_us, max(tus) AS end_us FROM visits GROUP BY trace_id, user_id),
tr AS (SELECT t.trace_id, t.user_id, t.url, t.final_url, regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS page_title,
        t.user_id % 50 <> 49 AS success, forms_submitted, greatest(0, forms_submitted - 1) AS dual_submissions,
        elements_interacted, n_events, start_us, end_us, coalesce(l.toxic, (t.user_id % 5 = 0)::INT) AS y
      FROM tr0 t JOIN pages p USING (page_id) LEFT JOIN labels l ON l.doc_id = t.user_id)"""
ALL = EV + RQ + RD + TR

HOSTS = f"""
h0 AS (SELECT page_id, url, {DOM('url')} AS host,
        {LIST(fixed.QUERY_BRANDS[:10])}[page_id % 10 + 1] AS b,
        {LIST(fixed.SQUAT_INDICATORS)}[(page_id // 3) % 8 + 1] AS kw,
        ['xyz', 'com', 'top', 'co.uk', 'net'][(page_id // 2) % 5 + 1] AS tld FROM pages),
h1 AS (SELECT *, CASE page_id % 7 WHEN 0 THEN b || '-' || kw || '.' || tld WHEN 1 THEN kw || '.' || b || '-id.a.b.' || tld
        WHEN 2 THEN b || '.com' WHEN 3 THEN substr(b, 1, 6) || '1.' || tld
        WHEN 4 THEN 'my-' || b || '-' || kw || '-now.pages.dev' WHEN 5 THEN '192-168-10-1.secure-wallet-claim.' || kw || '.icu'
        ELSE 'www.' || host END AS lk FROM h0),
hosts AS (SELECT page_id, url, host AS domain, 'observed' AS source, 1 AS source_rank FROM h1
      UNION ALL SELECT page_id, 'https://' || lk, lk, 'lookalike', 0 FROM h1)"""
SERP = f"""
s0 AS (SELECT page_id, url AS u0, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t,
        regexp_extract(html, '<p>([^<]*)', 1) AS para,
        {LIST(fixed.QUERY_BRANDS)}[page_id % {len(fixed.QUERY_BRANDS)} + 1] AS brand,
        {LIST(fixed.QUERY_ACTIONS)}[(page_id // 5) % {len(fixed.QUERY_ACTIONS)} + 1] AS act,
        {LIST(fixed.SNIPPET_PHRASES)}[(page_id // 2) % {len(fixed.SNIPPET_PHRASES)} + 1] AS phrase,
        {LIST([c[0] for c in fixed.QUERY_CATEGORIES])}[(page_id // 7) % 6 + 1] AS category FROM pages),
s1 AS (SELECT *, replace(replace(['{{h}}', '{{b}}-login.xyz', '10.0.0.7', '{{b}}.com'][page_id % 4 + 1], '{{h}}', {DOM('u0')}),
        '{{b}}', regexp_replace(brand, '[^a-z0-9]', '', 'g')) AS domain FROM s0),
serp AS (SELECT page_id, brand || ' ' || act AS query,
        'http://' || domain || ['/login', '/account/verify', '/', ''][(page_id // 4) % 4 + 1] AS url,
        CASE WHEN page_id % 3 = 0 THEN array_to_string(list_transform(string_split(brand, ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') ELSE '' END || ' ' || t AS title,
        CASE WHEN page_id % 2 = 0 THEN phrase ELSE '' END || ' ' || para AS snippet,
        ['google', 'bing', 'duckduckgo'][page_id % 3 + 1] AS engine, (page_id // 3) % 20 + 1 AS position, domain, category
      FROM s1)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip().lstrip(',')}\n{body}"

GRAPH = """,
en0 AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY raw_idx) - 1 AS idx,
        url_after <> '' AND url_before <> '' AND url_after <> url_before AS nav
      FROM ev WHERE event_type IS DISTINCT FROM 'screenshot' AND element_tag IS DISTINCT FROM 'page'),
en AS (SELECT *, event_type || '_' || idx AS node,
        coalesce(lag(CASE WHEN nav THEN url_after ELSE event_type || '_' || idx END)
          OVER (PARTITION BY trace_id ORDER BY idx), root_url) AS prev_node FROM en0),
edges AS (SELECT trace_id, src, dst, max(weight) AS weight FROM (
        SELECT trace_id, prev_node AS src, node AS dst, 1.0::DOUBLE AS weight FROM en
        UNION ALL SELECT trace_id, node, url_after, 2.0 FROM en WHERE nav
        UNION ALL SELECT trace_id, prev_url, url, 3.0 FROM rd WHERE prev_url IS NOT NULL) GROUP BY ALL),
nodes0 AS (SELECT trace_id, url AS node, -1::BIGINT AS node_seq, 'url' AS node_type, '' AS element_tag, '' AS element_id,
          '' AS element_class, NULL::BIGINT AS tus, '' AS form_field, url AS root_url FROM tr
        UNION ALL SELECT trace_id, node, idx * 2, event_type, element_tag, element_id, element_class, tus, form_field,
          root_url FROM en
        UNION ALL SELECT trace_id, url_after, idx * 2 + 1, 'url', '', '', '', NULL, '', root_url FROM en WHERE nav
        UNION ALL SELECT trace_id, prev_url, 1000000000000 + pos * 2, 'url', '', '', '', NULL, '', '' FROM rd
          WHERE prev_url IS NOT NULL
        UNION ALL SELECT trace_id, url, 1000000000001 + pos * 2, 'url', '', '', '', NULL, '', '' FROM rd
          WHERE prev_url IS NOT NULL),
nodes AS (SELECT * EXCLUDE (rn), lower(element_tag || ' ' || element_id || ' ' || element_class) AS attr FROM (
        SELECT *, row_number() OVER (PARTITION BY trace_id, node ORDER BY node_seq) AS rn FROM nodes0) WHERE rn = 1)"""
G_ALL = ALL + GRAPH
