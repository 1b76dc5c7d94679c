"""Label refinement, spectrum, walks, embeddings, critical paths."""

from pyspark.sql import functions as F

from tracegraph.operators import critical, embed, structure
from tracegraph.plans.base_sql import ALL, ANY, DOM, G_ALL, I, NETLOC, PATH, QUERY, R, SCHEME, sql
from tracegraph.plans.cat_rules import BAG, C48
from tracegraph.plans.cat_views import DIST
from tracegraph.plans.registry import query

SENSITIVE = ANY("form_field", ["password", "pass", "pwd", "email", "ssn", "card", "credit"])
BAG_CTE = """,
bag AS (SELECT trace_id, prev_node AS src, node AS dst FROM en UNION ALL SELECT trace_id, node, url_after FROM en WHERE nav
   UNION ALL SELECT trace_id, prev_url, url FROM rd WHERE prev_url IS NOT NULL)"""
WL = BAG_CTE + f""",
wl0 AS MATERIALIZED (SELECT trace_id, node, node_type || '|' || element_tag || '|' || ({SENSITIVE})::INT AS label FROM nodes)""" + "".join(f""",
wl{r} AS MATERIALIZED (SELECT p.trace_id, p.node, substr(md5(p.label || '||' || coalesce(m.dg, '0:0')), 1, 12) AS label FROM wl{r - 1} p LEFT JOIN
   (SELECT b.trace_id, b.src AS node, {BAG('l.label')} AS dg FROM bag b JOIN wl{r - 1} l ON l.trace_id = b.trace_id AND l.node = b.dst
    GROUP BY 1, 2) m ON m.trace_id = p.trace_id AND m.node = p.node)""" for r in range(1, 6)) + """,
wl AS (""" + " UNION ALL ".join(f"SELECT trace_id, {r} AS round, label, count(*) AS n FROM wl{r} GROUP BY 1, 3" for r in range(6)) + """),
voc AS (SELECT label, sum(n)::BIGINT AS freq FROM wl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 256)"""


@query("wl_labels", sql(G_ALL + WL, "SELECT trace_id, round::BIGINT AS round, label, n FROM wl"))
def _(t):
    return structure.wl_labels(t.nodes, t.bag)


@query("vocab_top_k", sql(G_ALL + WL, "SELECT label, freq FROM voc"))
def _(t):
    return structure.vocab_top_k(t.wl)


@query("wl_vectors", sql(G_ALL + WL, f"""SELECT trace_id, label, {R('n / sqrt(sum(n * n) OVER (PARTITION BY trace_id))')} AS weight FROM
  (SELECT trace_id, label, sum(n)::DOUBLE AS n FROM wl WHERE label IN (SELECT label FROM voc) GROUP BY 1, 2)"""))
def _(t):
    return structure.wl_vectors(t.wl, structure.vocab_top_k(t.wl))


@query("spectral_moments", sql(G_ALL + BAG_CTE + """,
sy AS (SELECT trace_id, src AS a, dst AS b FROM bag UNION SELECT trace_id, dst, src FROM bag),
dgr AS (SELECT trace_id, a, count(*)::DOUBLE AS d FROM sy GROUP BY 1, 2),
en2 AS (SELECT s.trace_id, s.a = s.b AS lp, 1 / sqrt(x.d * y.d) AS w FROM sy s JOIN dgr x ON x.trace_id = s.trace_id AND x.a = s.a
   JOIN dgr y ON y.trace_id = s.trace_id AND y.a = s.b),
mo AS (SELECT trace_id, sum(CASE WHEN lp THEN w ELSE 0 END) AS loops, sum(CASE WHEN lp THEN (1 - w) * (1 - w) - 1 ELSE w * w END) AS sq FROM en2 GROUP BY 1),
mm AS (SELECT trace_id, count(*) AS n, coalesce(max(loops), 0) AS loops, coalesce(max(sq), 0) AS sq FROM nodes LEFT JOIN mo USING (trace_id) GROUP BY 1)""",
    f"""SELECT trace_id, {R('(n - loops) / n')} AS spectrum_mean, {R('(n + sq) / n - ((n - loops) / n) * ((n - loops) / n)')} AS spectrum_variance,
  {R('n + sq')} AS spectrum_energy FROM mm"""))
def _(t):
    return structure.spectral_moments(t.nodes, t.bag)


WALK = BAG_CTE + f""",
nidx AS MATERIALIZED (SELECT trace_id, node, node_type, row_number() OVER (PARTITION BY trace_id ORDER BY node_seq) - 1 AS idx,
   count(*) OVER (PARTITION BY trace_id) AS n FROM nodes),
adj AS MATERIALIZED (SELECT trace_id, src, dst, row_number() OVER (PARTITION BY trace_id, src ORDER BY {C48('dst')}, dst) - 1 AS rk,
   count(*) OVER (PARTITION BY trace_id, src) AS od FROM bag),
wk(trace_id, walk, step, node) AS (
   SELECT s.trace_id, s.walk, 0, x.node FROM (SELECT DISTINCT trace_id, n, unnest(range(50)) AS walk FROM nidx) s
     JOIN nidx x ON x.trace_id = s.trace_id AND x.idx = {C48("s.trace_id || '|' || s.walk")} % s.n
   UNION ALL SELECT w.trace_id, w.walk, w.step + 1, a.dst FROM wk w JOIN adj a ON a.trace_id = w.trace_id AND a.src = w.node
     AND a.rk = {C48("w.trace_id || '|' || w.walk || '|' || (w.step + 1) || '|' || w.node")} % a.od WHERE w.step < 9)"""
WSTAT = WALK + """,
tv AS (SELECT node_type, row_number() OVER (ORDER BY c DESC, node_type) - 1 AS bin FROM (SELECT node_type, count(*) AS c FROM nodes GROUP BY 1)
   ORDER BY c DESC, node_type LIMIT 7),
vis AS (SELECT w.trace_id, w.node, coalesce(bin, 7) AS bin FROM wk w JOIN nidx x ON x.trace_id = w.trace_id AND x.node = w.node LEFT JOIN tv USING (node_type)),
ty AS (SELECT trace_id, count(*) AS total, count(DISTINCT node) AS seen, """ + ", ".join(f"count(*) FILTER (bin = {b}) AS t{b}" for b in range(8)) + """ FROM vis GROUP BY 1),
fr AS (SELECT w.trace_id, w.walk, min(w.step) AS f FROM wk w JOIN wk o ON o.trace_id = w.trace_id AND o.walk = w.walk AND o.step = 0 AND o.node = w.node
   WHERE w.step > 0 GROUP BY 1, 2),
rt AS (SELECT trace_id, count(*) AS nr, """ + ", ".join(f"count(*) FILTER (least(f - 1, 4) = {b}) AS r{b}" for b in range(5)) + """ FROM fr GROUP BY 1),
bm AS (SELECT trace_id, count(*) AS m FROM bag GROUP BY 1),
nz AS (SELECT DISTINCT trace_id, n FROM nidx)"""


@query("random_walk_stats", sql(G_ALL + WSTAT, "SELECT trace_id, " + ", ".join(
    [f"{R(f't{b} / total')} AS type_{b}" for b in range(8)] + [f"{R(f'CASE WHEN coalesce(nr, 0) = 0 THEN 0 ELSE r{b} / nr END')} AS return_{b}" for b in range(5)])
    + f""", {R('total / 500')} AS completion, {R('seen / n')} AS coverage,
  {R(' + '.join(f"(CASE WHEN t{b} > 0 THEN -(t{b} / total) * log2(t{b} / total) ELSE 0 END)" for b in range(8)))} AS type_entropy,
  {R('ln(1 + n)')} AS log_nodes, {R('ln(1 + coalesce(m, 0))')} AS log_edges FROM nz JOIN ty USING (trace_id) LEFT JOIN rt USING (trace_id) LEFT JOIN bm USING (trace_id)"""))
def _(t):
    return structure.random_walk_stats(t.nodes, t.bag)


@query("gcn_graph", sql(G_ALL, f"""SELECT trace_id, {I('1 + 3 * count(*)')} AS n_edges, count(*) + 1 AS n_nodes FROM en GROUP BY 1"""))
def _(t):
    g = embed.gcn_graph(t.ev)
    return g.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_edges"), (F.max("i") + 1).alias("n_nodes"))


HN = f"regexp_replace(lower(regexp_replace({NETLOC('url')}, '^.*@', '')), ':\\d*$', '')"


@query("node_features_16", sql(G_ALL, f"""SELECT trace_id, 0::BIGINT AS i, {R(f"length(url) + length({HN}) + length({PATH('url')}) + length({QUERY('url')})")} AS mass,
  {R("length(url)")} AS f0, {R(f"({SCHEME('url')} = 'https')::INT")} AS f7 FROM tr UNION ALL
  SELECT trace_id, idx + 1, {R("""(event_type IN ('submit', 'button_click', 'form_input'))::INT + 1 + contains(element_id, 'password')::INT
    + contains(element_id, 'email')::INT + (event_type = 'submit')::INT""")}, {R("0")}, {R("0")} FROM en"""))
def _(t):
    h = embed.node_features_16(t.tr, t.ev)
    root = F.col("i") == 0
    mass = F.when(root, F.col("h")[0] + F.col("h")[1] + F.col("h")[2] + F.col("h")[6]).otherwise(
        F.aggregate("h", F.lit(0.0), lambda a, x: a + x))
    return h.select("trace_id", "i", mass.alias("mass"), F.col("h")[0].alias("f0"), F.col("h")[7].alias("f7"))


@query("gcn_embed")
def _(t):
    return embed.gcn_embed(embed.node_features_16(t.tr, t.ev), embed.gcn_graph(t.ev))


@query("gat_embed")
def _(t):
    return embed.gat_embed(embed.node_features_16(t.tr, t.ev, t.seq), embed.gcn_graph(t.ev, t.seq))


@query("sage_embed")
def _(t):
    return embed.sage_embed(embed.node_features_16(t.tr, t.ev), embed.gcn_graph(t.ev))


SCORE = f"""((CASE WHEN {ANY('attr', ['password', 'pwd', 'pass'])} THEN 3.0 ELSE 0 END) + (CASE WHEN {ANY('attr', ['email', 'mail', 'login'])} THEN 2.0 ELSE 0 END)
  + (CASE WHEN {ANY('attr', ['ssn', 'social', 'card', 'credit', 'cvv'])} THEN 3.0 ELSE 0 END) + (CASE WHEN node_type IN ('submit', 'form_submit') THEN 2.5 ELSE 0 END)
  + (CASE WHEN node_type = 'form_input' THEN 1.5 ELSE 0 END) + (CASE WHEN node_type = 'url' AND node_seq <> -1 THEN 1.0 ELSE 0 END))::DOUBLE"""
SC = f""",
nsc AS MATERIALIZED (SELECT trace_id, node, node_seq, {SCORE} AS score FROM nodes)"""


@query("node_suspicion", sql(G_ALL + SC, f"SELECT trace_id, node, {R('score')} AS score FROM nsc"))
def _(t):
    return critical.node_scores(t.nodes).select("trace_id", "node", "score")


NODE_LABEL = "CASE WHEN n.node_seq = -1 THEN 'root' WHEN node_type = 'url' THEN 'redirect' ELSE concat_ws(':', node_type, element_tag) END"
CRIT = DIST + f""",
cl AS MATERIALIZED (SELECT n.trace_id, n.node_seq, score, {NODE_LABEL} AS label FROM nodes n JOIN nsc c ON c.trace_id = n.trace_id AND c.node = n.node),
far AS MATERIALIZED (SELECT trace_id, t, d FROM reach WHERE s = -1),
par AS MATERIALIZED (SELECT e.trace_id, e.t, min(e.s) AS p FROM ie e JOIN far a ON a.trace_id = e.trace_id AND a.t = e.s
   JOIN far b ON b.trace_id = e.trace_id AND b.t = e.t WHERE b.d = a.d + 1 GROUP BY 1, 2),
tgt AS MATERIALIZED (SELECT trace_id, arg_max(node_seq, (score, -node_seq)) AS t, arg_max(label, (score, -node_seq)) AS target, count(*) AS k FROM cl GROUP BY 1),
way(trace_id, t, d) AS (SELECT g.trace_id, g.t, f.d FROM tgt g JOIN far f ON f.trace_id = g.trace_id AND f.t = g.t
   UNION ALL SELECT w.trace_id, p.p, w.d - 1 FROM way w JOIN par p ON p.trace_id = w.trace_id AND p.t = w.t),
wl8 AS (SELECT w.trace_id, list(label ORDER BY d) AS l FROM way w JOIN cl ON cl.trace_id = w.trace_id AND cl.node_seq = w.t GROUP BY 1),
tp8 AS (SELECT trace_id, list(label ORDER BY score DESC, node_seq)[1:5] AS l FROM cl GROUP BY 1),
cpl AS (SELECT g.trace_id, target, k, coalesce(wl8.l, tp8.l) AS l FROM tgt g JOIN tp8 USING (trace_id) LEFT JOIN wl8 USING (trace_id)),
critical AS (SELECT trace_id, target, CASE WHEN k <= 1 THEN '' ELSE array_to_string(l, ' > ') END AS path,
   CASE WHEN k <= 1 THEN 'Insufficient interaction data for path analysis.' ELSE array_to_string(list_transform(l, lambda x, i:
     CASE WHEN i = 1 THEN 'Entry: ' || x WHEN i = len(l) THEN 'Target: ' || x ELSE 'Step ' || (i - 1) || ': ' || x END), ' -> ') END AS description FROM cpl)"""


@query("critical_path", sql(G_ALL + SC + CRIT, "SELECT * FROM critical"))
def _(t):
    return critical.critical_path(t.nodes, t.edges)


def reach_sql(name: str, cond: str) -> str:
    return f""",
{name}(trace_id, node) AS (SELECT trace_id, node FROM nsc WHERE node_seq = -1
   UNION SELECT r.trace_id, e.dst FROM {name} r JOIN edges e ON e.trace_id = r.trace_id AND e.src = r.node
     JOIN nsc s ON s.trace_id = e.trace_id AND s.node = e.dst WHERE {cond})"""


@query("prune_reachability", sql(G_ALL + SC + reach_sql("ra", "true") + reach_sql("rb", "s.node_seq = -1 OR least(1.0, s.score / 6.0) >= 0.3"),
       """SELECT n.trace_id, count(a.node) AS credentials_before, count(b.node) AS credentials_after FROM nodes n
  LEFT JOIN nsc c ON c.trace_id = n.trace_id AND c.node = n.node AND least(1.0, c.score / 6.0) >= 0.5
  LEFT JOIN ra a ON a.trace_id = c.trace_id AND a.node = c.node LEFT JOIN rb b ON b.trace_id = c.trace_id AND b.node = c.node GROUP BY 1"""))
def _(t):
    return critical.prune_reachability(t.nodes, t.edges)


@query("branching_reduction", sql(G_ALL + SC + """,
br0 AS (SELECT n.trace_id, count(*) AS n, count(*) FILTER (least(1.0, score / 6.0) < 0.3 AND n.node_seq <> -1) / count(*) AS r_score,
  count(*) FILTER (node_type = 'link_detected') / count(*) AS r_link FROM nodes n JOIN nsc s ON s.trace_id = n.trace_id AND s.node = n.node GROUP BY 1),
bm AS (SELECT trace_id, count(*) AS m FROM edges GROUP BY 1)""", f"""SELECT trace_id, {R('coalesce(m, 0) / n')} AS branching, {R('r_score')} AS r_score, {R('r_link')} AS r_link,
  {R('coalesce(m, 0) / n * (1 - r_score) * (1 - r_link)')} AS effective_branching FROM br0 LEFT JOIN bm USING (trace_id)"""))
def _(t):
    return critical.branching_reduction(t.nodes, t.edges)


@query("order_preserved", sql(G_ALL, """SELECT en.trace_id, count(*) AS n_steps, count(*) FILTER (e.src IS NULL) AS n_missing FROM en
  LEFT JOIN edges e ON e.trace_id = en.trace_id AND e.src = en.prev_node AND e.dst = en.node GROUP BY 1"""))
def _(t):
    from tracegraph.operators import events
    e = events.event_sequence(t.ev).select("trace_id", F.col("prev_node").alias("src"), F.col("node").alias("dst"))
    j = e.join(t.edges.select("trace_id", "src", "dst", F.lit(1).alias("ok")), ["trace_id", "src", "dst"], "left")
    return j.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("ok").isNull()).alias("n_missing"))
