"""Interaction graphs of all traces as two tables: nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegraph.functions import urls
from tracegraph.functions.text import any_word, div
from tracegraph.operators import events
from tracegraph.session import land

REDIRECT_SEQ = 1000000000000


def _edge(src, dst, kind: str, weight: float):
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))


def edge_bag(ev: DataFrame, rd: DataFrame, seq: DataFrame | None = None) -> DataFrame:
    """All edges with repetitions: sequence (1), navigation (2), redirect (3). ``seq`` is the event sequence of ``ev`` where it is at hand."""
    e = events.event_sequence(ev) if seq is None else seq
    pair = F.array(_edge(F.col("prev_node"), F.col("node"), "sequence", 1.0),
                   F.when(F.col("nav"), _edge(F.col("node"), F.col("url_after"), "navigation", 2.0)))
    a = e.select("trace_id", F.explode(pair).alias("e")).filter("e IS NOT NULL").select("trace_id", "e.*")
    b = rd.filter("prev_url IS NOT NULL").select(
        "trace_id", F.col("prev_url").alias("src"), F.col("url").alias("dst"), F.lit("redirect").alias("edge_type"),
        F.lit(3.0).alias("weight"))
    return a.unionByName(b)


def itg_edges(ev: DataFrame, rd: DataFrame, seq: DataFrame | None = None) -> DataFrame:
    return edge_bag(ev, rd, seq).groupBy("trace_id", "src", "dst").agg(
        F.max("edge_type").alias("edge_type"), F.max("weight").alias("weight"))


def _node(name, seq, kind, tag, eid, cls, tus, field):
    return F.struct(name.alias("node"), seq.cast("long").alias("node_seq"), kind.alias("node_type"),
                    tag.alias("element_tag"), eid.alias("element_id"), cls.alias("element_class"),
                    tus.cast("long").alias("tus"), field.alias("form_field"))


def itg_nodes(tr: DataFrame, ev: DataFrame, rd: DataFrame, seq: DataFrame | None = None) -> DataFrame:
    """Root URL, one node per interaction event, navigation targets, redirect hops; the first appearance wins."""
    no, url = F.lit(""), F.lit("url")

    def url_node(name, seq):
        return _node(name, seq, url, no, no, no, F.lit(None), no)

    e = events.event_sequence(ev) if seq is None else seq
    c = F.col
    per_event = F.array(
        _node(c("node"), c("idx") * 2, c("event_type"), c("element_tag"), c("element_id"), c("element_class"),
              c("ts_us"), c("form_field")),
        F.when(c("nav"), url_node(c("url_after"), c("idx") * 2 + 1)))
    hops = F.array(url_node(c("prev_url"), REDIRECT_SEQ + c("pos") * 2),
                   url_node(c("url"), REDIRECT_SEQ + c("pos") * 2 + 1))
    rows = (tr.select("trace_id", F.array(url_node(c("url"), F.lit(-1))).alias("a"))
            .unionByName(e.select("trace_id", per_event.alias("a")))
            .unionByName(rd.filter("prev_url IS NOT NULL").select("trace_id", hops.alias("a"))))
    rows = rows.select("trace_id", F.explode("a").alias("n")).filter("n IS NOT NULL").select("trace_id", "n.*")
    attrs = ["node_seq", "node_type", "element_tag", "element_id", "element_class", "tus", "form_field"]
    best = rows.groupBy("trace_id", "node").agg(F.min_by(F.struct(*attrs), "node_seq").alias("r"))
    return best.select("trace_id", "node", "r.*").select(
        "*", (c("node_seq") == -1).alias("is_root"), events.sensitive_fields().alias("has_sensitive"),
        F.lower(F.concat_ws(" ", "element_tag", "element_id", "element_class")).alias("attr"))


def node_degrees(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                   F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return edges.select("trace_id", F.explode(ends).alias("x")).select("trace_id", "x.*").groupBy(
        "trace_id", "node").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    d = node_degrees(edges).groupBy("trace_id").agg(
        F.sum("outdeg").alias("num_edges"), F.max(F.col("indeg") + F.col("outdeg")).alias("max_degree"),
        F.max("indeg").alias("in_degree_max"), F.max("outdeg").alias("out_degree_max"))
    return with_ratios(n.join(d, "trace_id", "left").na.fill(0))


def with_ratios(degrees: DataFrame) -> DataFrame:
    """Degree figures that follow from the numbers of nodes and edges."""
    nn, m = F.col("num_nodes"), F.col("num_edges")
    return degrees.select("*", div(2 * m, nn).alias("avg_degree"), div(m, nn * (nn - 1)).alias("graph_density"),
                          div(m, nn).alias("edge_node_ratio"))


def sensitive_aggs() -> list:
    a = F.col("attr")
    pwd, mail = any_word(a, ["password", "pwd"]), any_word(a, ["email", "mail"])
    ssn, fin = any_word(a, ["ssn", "social"]), any_word(a, ["card", "credit", "cvv"])
    t = F.col("node_type")
    return [
        F.max(pwd.cast("int")).alias("has_password_input"), F.max(mail.cast("int")).alias("has_email_input"),
        F.sum(pwd.cast("int") + mail.cast("int") + ssn.cast("int")).alias("credential_fields_count"),
        F.count_if(fin).alias("financial_fields_count"),
        F.count_if(t.isin("input", "form_input")).alias("num_input_fields"),
        F.count_if(t == "button_detected").alias("num_buttons"), F.count_if(t == "link_detected").alias("num_links"),
        F.count_if(F.contains(t, F.lit("submit"))).alias("num_forms"),
    ]


def sensitive_field_stats(nodes: DataFrame) -> DataFrame:
    s = nodes.groupBy("trace_id").agg(*sensitive_aggs())
    return s.withColumn("requests_sensitive_data", ((F.col("credential_fields_count") > 0)
                                                    | (F.col("financial_fields_count") > 0)).cast("int"))


def url_node_stats(nodes: DataFrame) -> DataFrame:
    host = F.when(F.col("node_type") == "url", urls.netloc("node"))
    return nodes.filter("node_type = 'url'").groupBy("trace_id").agg(
        (F.count(F.lit(1)) - 1).alias("num_redirects"),
        F.greatest(F.lit(0), F.countDistinct(F.when(host != "", host)) - 1).alias("external_redirects"))


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges a < b without self-loops."""
    return land(edges.filter("src <> dst").select("trace_id", F.least("src", "dst").alias("a"),
                                                  F.greatest("src", "dst").alias("b")).distinct(), "undirected")


def triangles(und: DataFrame) -> DataFrame:
    """Triangles as (trace_id, x, y, z).

    Every edge points from the end with fewer neighbours to the other, so a hub
    of any size starts no wedge of its own: the number of wedges stays within
    m * sqrt(m) instead of the square of the largest degree.
    """
    both = und.select("trace_id", F.explode(F.array("a", "b")).alias("v"))
    deg = both.groupBy("trace_id", "v").agg(F.count(F.lit(1)).alias("d"))
    da, db = deg.toDF("trace_id", "a", "da"), deg.toDF("trace_id", "b", "db")
    e = und.join(da, ["trace_id", "a"]).join(db, ["trace_id", "b"])
    up = F.struct("da", "a") < F.struct("db", "b")
    o = e.select("trace_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"),
                 F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"))
    w = o.toDF("trace_id", "x", "y").join(o.toDF("trace_id", "x", "z"), ["trace_id", "x"]).filter("y < z")
    closed = w.join(und.toDF("trace_id", "y", "z"), ["trace_id", "y", "z"], "left_semi")
    return closed.select("trace_id", "x", "y", "z")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean local clustering of the undirected simple graph; 0 for two nodes or fewer."""
    und = undirected(edges)
    tri = triangles(und).select("trace_id", F.explode(F.array("x", "y", "z")).alias("v")).groupBy(
        "trace_id", "v").agg(F.count(F.lit(1)).alias("t"))
    deg = und.select("trace_id", F.explode(F.array("a", "b")).alias("v")).groupBy("trace_id", "v").agg(
        F.count(F.lit(1)).alias("d"))
    local = tri.join(deg, ["trace_id", "v"]).groupBy("trace_id").agg(
        F.sum(2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1))).alias("s"))
    n = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(local, "trace_id", "left").select(
        "trace_id", F.when(F.col("n") > 2, F.coalesce("s", F.lit(0.0)) / F.col("n")).otherwise(0.0)
        .alias("clustering_coefficient"))


def edge_triangle_counts(edges: DataFrame) -> DataFrame:
    return triangles(undirected(edges)).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_triangles"))


def neighbor_join(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-neighbour types of every node, counted."""
    return edges.join(nodes.select("trace_id", F.col("node").alias("dst"), F.col("node_type").alias("dst_type")),
                      ["trace_id", "dst"]).groupBy("trace_id", "src").agg(
        F.count(F.lit(1)).alias("n_out"), F.count_if(F.col("dst_type") == "url").alias("n_url_out"))


def node_time_stats(nodes: DataFrame) -> DataFrame:
    t = F.when(F.col("tus") > 0, F.col("tus"))
    a = nodes.groupBy("trace_id").agg(F.count(t).alias("k"), events.span_seconds("tus").alias("total_interaction_time"))
    tt = F.col("total_interaction_time")
    return a.select("trace_id", "total_interaction_time",
                    F.when(F.col("k") > 1, tt / (F.col("k") - 1)).otherwise(0.0).alias("avg_time_between_events"),
                    F.when(tt > 0, F.col("k") / tt).otherwise(0.0).alias("event_frequency"))
