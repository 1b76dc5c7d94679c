"""Traces, requests, redirects, hosts and search results derived from the given tables.

The given tables hold no recorded visits, so every query starts from this fixed
mapping: one trace per user and week of ``events``, visited pages from
``pages``, labels from ``labels``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegraph.functions import fixed, ordered, urls
from tracegraph.session import land, prepare

BASE_MICROS = 1704067200000000
WEEK = 604800000000
SLICE_MICROS = 60000000  # one minute: a week-long trace has at most 10,080 slices
WHOLE = 50000  # rows of a trace that one window takes
EVENT_TYPES = {"click": "button_click", "view": "link_detected", "signup": "form_input", "purchase": "submit",
               "error": "screenshot"}
EVENT_TAGS = {"click": "button", "view": "a", "signup": "input", "purchase": "form", "error": "page"}
ELEMENT_IDS = ["password", "email", "card_number", "nav", ""]
RESOURCE_TYPES = ["document", "script", "stylesheet", "image", "xhr", "fetch", "font"]


def pick(values, index):
    """values[index] for a small fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def time_slice(col: str = "tus"):
    return F.floor(F.col(col) / SLICE_MICROS)


class Tables:
    """Lazily built inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_pages(self) -> int:
        return self.raw("pages").count()  # answered from the file footers

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages").select("page_id", "url")

    @cached_property
    def visits(self) -> DataFrame:
        """One row per raw event with the visited page, not yet ordered."""
        k = F.get_json_object("props", "$.k").cast("long")
        tus = F.unix_micros(F.col("ts").cast("timestamp"))
        e = self.raw("events").select(
            "event_id", "user_id", tus.alias("tus"), F.col("event_type").alias("kind"), k.alias("k"))
        e = e.withColumn("trace_id", F.col("user_id") * 100 + F.floor((F.col("tus") - BASE_MICROS) / WEEK))
        e = e.withColumn("page_id", F.col("k") % self.n_pages)
        # events are parsed and joined once; ev, rq, rd and tr read the result
        return land(e.join(self.pages.withColumnRenamed("url", "page_url"), "page_id"), "visits")

    @cached_property
    def large(self) -> DataFrame | None:
        """The traces of more than ``WHOLE`` visits, whose rows are ordered slice by slice; None if there are none."""
        size = self.visits.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
        large = land(size.filter(F.col("n") > WHOLE).select("trace_id"), "large")
        return None if large.isEmpty() else large

    def sequence(self, df: DataFrame, keys: list[str], order: list[str], slice_expr: Column, index: str = "idx",
                 previous: dict[str, str] | None = None, first: dict[str, str] | None = None) -> DataFrame:
        """``ordered.sequence`` of rows that come from visits."""
        return ordered.sequence_by_size(df, keys, order, slice_expr, self.large, index, previous, first)

    @cached_property
    def ev(self) -> DataFrame:
        """Recorded events in order: raw_idx, url_before, url_after, element fields."""
        v = self.sequence(self.visits, ["trace_id"], ["tus", "event_id"], time_slice(), "raw_idx",
                          {"prev_url": "page_url"}, {"root_url": "page_url"})
        before = F.coalesce("prev_url", "page_url")
        types, tags = F.create_map(*_pairs(EVENT_TYPES)), F.create_map(*_pairs(EVENT_TAGS))
        v = v.select(
            "trace_id", "event_id", "user_id", "tus", F.col("tus").alias("ts_us"), "raw_idx", "page_id", "page_url", "k", "root_url",
            types[F.col("kind")].alias("event_type"), tags[F.col("kind")].alias("element_tag"),
            pick(ELEMENT_IDS, F.col("k") % 5).alias("element_id"), F.lit("").alias("element_class"),
            F.lit("").alias("element_text"), before.alias("url_before"),
            F.when(F.col("k") % 3 == 0, F.col("page_url")).otherwise(before).alias("url_after"))
        field = F.when((F.col("element_id") != "") & F.col("event_type").isin("form_input", "submit"),
                       F.col("element_id")).otherwise(F.lit(""))
        return land(v.withColumn("form_field", field), "ev")

    @cached_property
    def rq(self) -> DataFrame:
        """Network requests; (tus, event_id) is the recorded order."""
        s = F.col("event_id") % 10
        status = (F.when(s == 0, 404).when(s == 1, 301).when(s == 2, 500).when(s == 3, F.lit(None)).otherwise(200))
        rtype = pick(RESOURCE_TYPES, F.col("k") % 7)
        ctype = F.when(F.col("k") % 7 == 0, F.lit("text/html; charset=utf-8")).when(
            F.col("k") % 7 == 1, F.lit("application/javascript")).when(F.col("k") % 7 == 2, F.lit("text/css"))
        return land(self.visits.select(
            "trace_id", "event_id", "tus", F.col("page_url").alias("url"), rtype.alias("resource_type"),
            status.cast("int").alias("status"), ctype.alias("content_type")), "rq")

    @cached_property
    def rd(self) -> DataFrame:
        """Redirect chain: visits with k divisible by 7, consecutive repeats removed, with pos and prev_url."""
        hops = self.visits.filter("k % 7 = 0").select("trace_id", "event_id", "tus", F.col("page_url").alias("url"))
        seq = self.sequence(hops, ["trace_id"], ["tus", "event_id"], time_slice(), "_i", {"_p": "url"})
        seq = seq.filter("_p IS NULL OR _p <> url").drop("_i", "_p")
        return land(self.sequence(seq, ["trace_id"], ["tus", "event_id"], time_slice(), "pos", {"prev_url": "url"}), "rd")

    @cached_property
    def seq(self) -> DataFrame:
        """The interaction events in order; nodes, edges and bag read the result."""
        return land(events.event_sequence(self.ev, self.sequence).select(
            "trace_id", "event_type", "element_tag", "element_id", "element_class", "ts_us", "form_field", "url_after", "nav", "idx", "node", "prev_node"), "seq")

    @cached_property
    def nodes(self) -> DataFrame:
        return land(graph.itg_nodes(self.tr, self.ev, self.rd, self.seq), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return land(graph.itg_edges(self.ev, self.rd, self.seq), "edges")

    @cached_property
    def bag(self) -> DataFrame:
        return land(graph.edge_bag(self.ev, self.rd, self.seq), "bag")

    @cached_property
    def wl(self) -> DataFrame:
        return land(structure.wl_labels(self.nodes, self.bag), "wl-labels")

    @cached_property
    def shapes(self) -> DataFrame:
        """Path metrics, degrees and clustering of every trace."""
        return land(paths.path_metrics(self.nodes, self.edges, shapes=True), "shapes")

    @property
    def paths(self) -> DataFrame:
        return self.shapes.select("trace_id", *paths.METRICS)

    @cached_property
    def itg(self) -> DataFrame:
        return land(views.itg_view(self.nodes, self.edges, self.shapes), "itg")

    @cached_property
    def views(self) -> DataFrame:
        """The 125 view columns with the label y."""
        full = views.all_views(self.tr, self.ev, self.rq, self.rd, self.itg)
        return land(full.join(self.tr.filter("success").select("trace_id", "y"), "trace_id"), "views")

    @cached_property
    def tr(self) -> DataFrame:
        """One row per trace."""
        order = F.struct("tus", "event_id")
        a = self.visits.groupBy("trace_id", "user_id").agg(
            F.min_by(F.struct("page_id", "page_url"), order).alias("first"),
            F.max_by("page_url", order).alias("final_url"),
            F.count_if(F.col("kind") == "purchase").alias("forms_submitted"),
            F.count_if(F.col("kind") != "error").alias("elements_interacted"),
            F.count(F.lit(1)).alias("n_events"), F.min("tus").alias("start_us"), F.max("tus").alias("end_us"))
        titles = self.raw("pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
                                          .alias("page_title"))
        a = a.select("*", F.col("first.page_id").alias("page_id"), F.col("first.page_url").alias("url"))
        a = a.join(titles, "page_id").join(
            self.raw("labels").select(F.col("doc_id").alias("user_id"), "toxic"), "user_id", "left")
        return land(a.select(
            "trace_id", "user_id", "url", "final_url", "page_title", (F.col("user_id") % 50 != 49).alias("success"),
            F.col("forms_submitted"), F.greatest(F.lit(0), F.col("forms_submitted") - 1).alias("dual_submissions"),
            "elements_interacted", "n_events", "start_us", "end_us",
            F.coalesce(F.col("toxic"), (F.col("user_id") % 5 == 0).cast("int")).alias("y")), "tr")

    @cached_property
    def hosts(self) -> DataFrame:
        """Observed hosts and, per page, a derived look-alike so that every domain rule meets data."""
        p = self.pages.select("page_id", "url", urls.domain_of("url").alias("host"))
        b = pick(fixed.QUERY_BRANDS[:10], F.col("page_id") % 10)
        kw = pick(fixed.SQUAT_INDICATORS, F.floor(F.col("page_id") / 3) % 8)
        tld = pick(["xyz", "com", "top", "co.uk", "net"], F.floor(F.col("page_id") / 2) % 5)
        shape = F.col("page_id") % 7
        dot = F.lit(".")
        like = (F.when(shape == 0, F.concat(b, F.lit("-"), kw, dot, tld))
                .when(shape == 1, F.concat(kw, dot, b, F.lit("-id.a.b."), tld))
                .when(shape == 2, F.concat(b, dot, F.lit("com")))
                .when(shape == 3, F.concat(F.substring(b, 1, 6), F.lit("1."), tld))
                .when(shape == 4, F.concat(F.lit("my-"), b, F.lit("-"), kw, F.lit("-now.pages.dev")))
                .when(shape == 5, F.concat(F.lit("192-168-10-1.secure-wallet-claim."), kw, F.lit(".icu")))
                .otherwise(F.concat(F.lit("www."), F.col("host"))))
        both = p.select("page_id", "url", F.col("host").alias("domain"), F.lit("observed").alias("source")).unionByName(
            p.select("page_id", F.concat(F.lit("https://"), like).alias("url"), like.alias("domain"),
                     F.lit("lookalike").alias("source")))
        return both.withColumn("source_rank", F.when(F.col("source") == "observed", 1).otherwise(0))

    @cached_property
    def serp(self) -> DataFrame:
        """Search results: page titles and headings under a query made of a brand and an action."""
        p = self.raw("pages").select(
            "page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("t"),
            F.regexp_extract("html", r"<p>([^<]*)", 1).alias("para"))
        brand = pick(fixed.QUERY_BRANDS, F.col("page_id") % len(fixed.QUERY_BRANDS))
        action = pick(fixed.QUERY_ACTIONS, F.floor(F.col("page_id") / 5) % len(fixed.QUERY_ACTIONS))
        phrase = pick(fixed.SNIPPET_PHRASES, F.floor(F.col("page_id") / 2) % len(fixed.SNIPPET_PHRASES))
        host = pick(["{h}", "{b}-login.xyz", "10.0.0.7", "{b}.com"], F.col("page_id") % 4)
        compact = F.regexp_replace(brand, "[^a-z0-9]", "")
        host = F.replace(F.replace(host, F.lit("{h}"), urls.domain_of("url")), F.lit("{b}"), compact)
        tail = pick(["/login", "/account/verify", "/", ""], F.floor(F.col("page_id") / 4) % 4)
        n = F.col("page_id")
        return p.select(
            "page_id", F.concat(brand, F.lit(" "), action).alias("query"),
            F.concat(F.lit("http://"), host, tail).alias("url"),
            F.concat(F.when(n % 3 == 0, F.initcap(brand)).otherwise(F.lit("")), F.lit(" "), F.col("t")).alias("title"),
            F.concat(F.when(n % 2 == 0, phrase).otherwise(F.lit("")), F.lit(" "), F.col("para")).alias("snippet"),
            pick(["google", "bing", "duckduckgo"], n % 3).alias("engine"),
            ((F.floor(n / 3)) % 20 + 1).alias("position"), host.alias("domain"),
            pick([c[0] for c in fixed.QUERY_CATEGORIES], F.floor(n / 7) % 6).alias("category"))


from tracegraph.operators import events, graph, paths, structure, views  # noqa: E402  (operators import the slice rule above)


def _pairs(d: dict) -> list:
    return [F.lit(x) for kv in d.items() for x in kv]
