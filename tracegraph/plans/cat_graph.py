"""Queries over nodes and edges."""

from tracegraph.operators import events, graph
from tracegraph.plans.base_sql import ALL, ANY, DIV, G_ALL, I, NETLOC, R, sql
from tracegraph.plans.registry import query


@query("interaction_filter", sql(ALL, """SELECT trace_id, event_id, event_type, element_tag FROM ev
  WHERE event_type IS DISTINCT FROM 'screenshot' AND element_tag IS DISTINCT FROM 'page'"""))
def _(t):
    return events.interaction_filter(t.ev).select("trace_id", "event_id", "event_type", "element_tag")


@query("content_event_filter", sql(ALL, """SELECT event_type, count(*) AS n FROM ev
  WHERE event_type NOT IN ('screenshot', 'page') GROUP BY 1"""))
def _(t):
    return events.content_event_filter(t.ev).groupBy("event_type").count().withColumnRenamed("count", "n")


@query("event_sequence", sql(G_ALL, "SELECT trace_id, event_id, raw_idx, idx, node FROM en"))
def _(t):
    return events.event_sequence(t.ev).select("trace_id", "event_id", "raw_idx", "idx", "node")


@query("previous_node", sql(G_ALL, "SELECT trace_id, node, prev_node, nav::BIGINT AS nav FROM en"))
def _(t):
    return events.event_sequence(t.ev).select("trace_id", "node", "prev_node", "nav")


@query("itg_nodes", sql(G_ALL, f"""SELECT trace_id, node, node_seq, node_type, element_tag, element_id,
  (node_seq = -1)::BIGINT AS is_root,
  {ANY('form_field', ['password', 'pass', 'pwd', 'email', 'ssn', 'card', 'credit'])}::BIGINT AS has_sensitive FROM nodes"""))
def _(t):
    return graph.itg_nodes(t.tr, t.ev, t.rd).select("trace_id", "node", "node_seq", "node_type", "element_tag", "element_id", "is_root",
                              "has_sensitive")


@query("itg_edges", sql(G_ALL, """SELECT trace_id, src, dst, weight,
  CASE weight WHEN 1 THEN 'sequence' WHEN 2 THEN 'navigation' ELSE 'redirect' END AS edge_type FROM edges"""))
def _(t):
    return graph.itg_edges(t.ev, t.rd)


@query("itg_bag", sql(G_ALL, """SELECT trace_id, count(*) AS n_edges, sum(multi)::BIGINT AS n_bag, max(multi)::BIGINT AS max_multi
  FROM (SELECT trace_id, src, dst, count(*) AS multi FROM (
    SELECT trace_id, prev_node AS src, node AS dst FROM en UNION ALL SELECT trace_id, node, url_after FROM en WHERE nav
    UNION ALL SELECT trace_id, prev_url, url FROM rd WHERE prev_url IS NOT NULL) GROUP BY ALL) GROUP BY 1"""))
def _(t):
    from pyspark.sql import functions as F
    bag = graph.edge_bag(t.ev, t.rd).groupBy("trace_id", "src", "dst").agg(F.count(F.lit(1)).alias("multi"))
    return bag.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("multi").alias("n_bag"),
                                       F.max("multi").alias("max_multi"))


DEG = """,
nn AS (SELECT trace_id, count(*) AS n FROM nodes GROUP BY 1),
nd AS (SELECT trace_id, node, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (
   SELECT trace_id, src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT trace_id, dst, 1, 0 FROM edges) GROUP BY 1, 2),
dg AS (SELECT trace_id, sum(o)::BIGINT AS m, max(i + o) AS maxd, max(i) AS maxi, max(o) AS maxo FROM nd GROUP BY 1)"""


@query("degree_stats", sql(G_ALL + DEG, f"""SELECT trace_id, n AS num_nodes, {I('coalesce(m, 0)')} AS num_edges,
  {I('coalesce(maxd, 0)')} AS max_degree, {I('coalesce(maxi, 0)')} AS in_degree_max, {I('coalesce(maxo, 0)')} AS out_degree_max,
  {R(DIV('2 * coalesce(m, 0)', 'n'))} AS avg_degree, {R(DIV('coalesce(m, 0)', 'n * (n - 1)'))} AS graph_density,
  {R(DIV('coalesce(m, 0)', 'n'))} AS edge_node_ratio FROM nn LEFT JOIN dg USING (trace_id)"""))
def _(t):
    return graph.degree_stats(t.nodes, t.edges)


SENS = f"""SELECT trace_id, {I('max(pwd)')} AS has_password_input, {I('max(mail)')} AS has_email_input,
  {I('sum(pwd + mail + ssn)')} AS credential_fields_count, {I('sum(fin)')} AS financial_fields_count,
  {I("count(*) FILTER (node_type IN ('input', 'form_input'))")} AS num_input_fields,
  {I("count(*) FILTER (node_type = 'button_detected')")} AS num_buttons,
  {I("count(*) FILTER (node_type = 'link_detected')")} AS num_links,
  {I("count(*) FILTER (contains(node_type, 'submit'))")} AS num_forms,
  {I('(sum(pwd + mail + ssn) > 0 OR sum(fin) > 0)::INT')} AS requests_sensitive_data
  FROM (SELECT *, {ANY('attr', ['password', 'pwd'])}::INT AS pwd, {ANY('attr', ['email', 'mail'])}::INT AS mail,
    {ANY('attr', ['ssn', 'social'])}::INT AS ssn, {ANY('attr', ['card', 'credit', 'cvv'])}::INT AS fin FROM nodes)
  GROUP BY trace_id"""


@query("sensitive_field_stats", sql(G_ALL, SENS))
def _(t):
    return graph.sensitive_field_stats(t.nodes)


URLN = f"""SELECT trace_id, count(*) - 1 AS num_redirects,
  greatest(0, count(DISTINCT CASE WHEN {NETLOC('node')} <> '' THEN {NETLOC('node')} END) - 1)::BIGINT AS external_redirects
  FROM nodes WHERE node_type = 'url' GROUP BY 1"""


@query("url_node_stats", sql(G_ALL, URLN))
def _(t):
    return graph.url_node_stats(t.nodes)


CLUST = """,
un AS (SELECT DISTINCT trace_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
sy AS (SELECT trace_id, a, b FROM un UNION ALL SELECT trace_id, b, a FROM un),
ud AS (SELECT trace_id, a AS v, count(*) AS d FROM sy GROUP BY 1, 2),
tri AS (SELECT p.trace_id, p.a AS v, count(*) AS t FROM sy p JOIN sy q ON p.trace_id = q.trace_id AND p.a = q.a AND p.b < q.b
   JOIN sy r ON r.trace_id = p.trace_id AND r.a = p.b AND r.b = q.b GROUP BY 1, 2),
lc AS (SELECT trace_id, sum(2.0 * t / (d * (d - 1))) AS s FROM tri JOIN ud USING (trace_id, v) GROUP BY 1),
cl AS (SELECT trace_id, CASE WHEN count(*) > 2 THEN coalesce(max(s), 0.0) / count(*) ELSE 0.0 END AS clustering_coefficient
   FROM nodes LEFT JOIN lc USING (trace_id) GROUP BY 1)"""


@query("clustering", sql(G_ALL + CLUST, f"SELECT trace_id, {R('clustering_coefficient')} AS clustering_coefficient FROM cl"))
def _(t):
    return graph.clustering(t.nodes, t.edges)


@query("edge_triangle_join", sql(G_ALL + CLUST, f"SELECT trace_id, {I('sum(t) / 3')} AS n_triangles FROM tri GROUP BY 1"))
def _(t):
    return graph.edge_triangle_counts(t.edges)


@query("neighbor_join", sql(G_ALL, f"""SELECT e.trace_id, src, count(*) AS n_out,
  {I("count(*) FILTER (node_type = 'url')")} AS n_url_out FROM edges e
  JOIN nodes n ON n.trace_id = e.trace_id AND n.node = e.dst GROUP BY 1, 2"""))
def _(t):
    return graph.neighbor_join(t.nodes, t.edges)
