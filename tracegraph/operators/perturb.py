"""Robustness transforms of recorded traces; all choices come from md5, so runs repeat exactly.

Added events carry recorded time 0 and so stay out of time statistics; ``tus``
and ``event_id`` place them in the order of their trace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import fixed, ordered
from tracegraph.operators import events
from tracegraph.operators.dedup import code48
from tracegraph.sources.adapter import pick, time_slice

TAIL = 10 ** 15  # event ids of appended events
SPREAD = 1000  # room between two recorded event ids


def chance(*cols: Column | str, salt: str = "") -> Column:
    """A number in [0, 1) from md5."""
    return code48(F.concat_ws("|", F.lit(salt), *cols)).cast("double") / float(2 ** 48)


def choose(n: Column, *cols, salt: str = "") -> Column:
    return F.pmod(code48(F.concat_ws("|", F.lit(salt), *cols)).cast("long"), n)


def spread_ids(ev: DataFrame) -> DataFrame:
    return ev.withColumn("event_id", F.col("event_id") * SPREAD)


Order = Callable[..., DataFrame]  # numbers rows as ``ordered.sequence`` does


def renumber(ev: DataFrame, order: Order = ordered.sequence) -> DataFrame:
    return order(ev.drop("raw_idx"), ["trace_id"], ["tus", "event_id"], time_slice(), "raw_idx")


def _added(rows: DataFrame, ev: DataFrame, **cols: Column) -> DataFrame:
    """Complete partial event rows to the columns of ``ev``."""
    base = {"ts_us": F.lit(0), "raw_idx": F.lit(None), "element_class": F.lit(""), "element_text": F.lit(""),
            "element_id": F.lit(""), "form_field": F.lit(""), "element_tag": F.lit(""), **cols}
    out = rows.select(*[c for c in rows.columns if c not in base], *[v.alias(k) for k, v in base.items()])
    kinds = dict(ev.dtypes)
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ev.columns])


def inject_nodes(tr: DataFrame, ev: DataFrame, n: int = 5, order: Order = ordered.sequence) -> DataFrame:
    """Five navigation-link events in front of md5-chosen events."""
    spots = tr.select("trace_id", "url", "n_events", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    spots = spots.withColumn("raw_idx", choose(F.greatest(F.lit(1), F.col("n_events")), "url", F.col("i").cast("string"), salt="inject"))
    wide = spread_ids(ev)
    at = spots.join(wide.select("trace_id", "raw_idx", "tus", "event_id", "user_id", "root_url"), ["trace_id", "raw_idx"])
    new = _added(at.select("trace_id", "user_id", "root_url", "tus", (F.col("event_id") - 500 + F.col("i")).alias("event_id"), "i",
                           F.col("url").alias("url_before"), F.col("url").alias("url_after")), ev,
                 event_type=F.lit("link_detected"), element_tag=F.lit("a"), element_class=F.lit("nav-link"),
                 element_id=F.concat(F.lit("nav_"), F.col("i").cast("string")))
    return renumber(wide.unionByName(new), order)


def rewire_edges(ev: DataFrame, p: float = 0.2) -> DataFrame:
    """Swap the targets of md5-chosen neighbouring events (2m, 2m + 1)."""
    e = ev.withColumn("m", F.floor(F.col("raw_idx") / 2)).withColumn("odd", F.col("raw_idx") % 2)
    swap = chance("root_url", F.col("m").cast("string"), salt="rewire") < p
    other = e.select("trace_id", "m", (1 - F.col("odd")).alias("odd"), F.col("url_after").alias("_other"))
    j = e.join(other, ["trace_id", "m", "odd"], "left")
    return j.withColumn("url_after", F.when(swap & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("url_after"))).select(*ev.columns)


def _append(tr: DataFrame, ev: DataFrame, rows: list[dict]) -> DataFrame:
    arr = F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows])
    at = tr.select("trace_id", "user_id", F.col("url").alias("root_url"), F.col("end_us").alias("tus"), F.col("url").alias("url_before"),
                   F.col("url").alias("url_after"), F.posexplode(arr).alias("i", "r"))
    at = at.select("*", (F.lit(TAIL) + F.col("i")).alias("event_id"))
    keys = list(rows[0])
    return _added(at, ev, **{k: F.col(f"r.{k}") for k in keys})


def inflate_graph(tr: DataFrame, ev: DataFrame, factor: int = 3, order: Order = ordered.sequence) -> DataFrame:
    """Dummy navigation cycles of three events each at the end."""
    rows = [{"event_type": F.lit("navigation"), "element_tag": F.lit("div"), "element_class": F.lit("content"),
             "element_id": F.lit(f"dummy_cycle_{c}_{j}")} for c in range(factor) for j in range(3)]
    return renumber(ev.unionByName(_append(tr, ev, rows)), order)


def combined_structural(tr: DataFrame, ev: DataFrame, order: Order = ordered.sequence) -> DataFrame:
    return inflate_graph(tr, rewire_edges(inject_nodes(tr, ev, order=order)), order=order)


def decoy_links(tr: DataFrame, ev: DataFrame, n: int = 10, order: Order = ordered.sequence) -> DataFrame:
    rows = []
    for i in range(n):
        tag, cls, kind = fixed.DECOY_KINDS[i % len(fixed.DECOY_KINDS)]
        rows.append({"event_type": F.lit(kind), "element_tag": F.lit(tag), "element_class": F.lit(cls), "element_id": F.lit(f"decoy_{cls}_{i}")})
    return renumber(ev.unionByName(_append(tr, ev, rows)), order)


def split_forms(ev: DataFrame, fields: str = "form_fields") -> DataFrame:
    """One form_input per field for events with more than one field."""
    many = F.size(fields) > 1
    one = ev.select("*", F.explode_outer(F.when(many, F.col(fields))).alias("_f"))
    return one.withColumn("event_type", F.when(F.col("_f").isNotNull(), "form_input").otherwise(F.col("event_type"))).withColumn(
        fields, F.when(F.col("_f").isNotNull(), F.array("_f")).otherwise(F.col(fields))).drop("_f")


def decoy_navigation(tr: DataFrame, ev: DataFrame, rq: DataFrame, n: int = 5, order: Order = ordered.sequence) -> tuple[DataFrame, DataFrame]:
    """Per decoy a link and a navigation event and four requests, in steps of 500 seconds."""
    step = 500_000_000
    links, reqs = [], []
    for i in range(n):
        host = fixed.DECOY_HOSTS[i % len(fixed.DECOY_HOSTS)]
        links.append({"event_type": F.lit("link_detected"), "element_class": F.lit("nav-link"), "element_id": F.lit(f"decoy-{i}"),
                      "ts_us": F.col("end_us") + (i + 1) * step})
        links.append({"event_type": F.lit("navigation"), "element_class": F.lit(""), "element_id": F.lit(""),
                      "ts_us": F.col("end_us") + (i + 1) * step + 100_000_000})
        for kind in ("document", "script", "stylesheet", "image"):
            reqs.append(F.struct(F.lit(f"https://{host}/assets/{kind}{i}.{kind[:2]}").alias("url"), F.lit(kind).alias("resource_type"),
                                 (F.col("end_us") + (i + 1) * step + 200_000_000).alias("tus"),
                                 F.lit("text/html" if kind == "document" else "application/javascript").alias("content_type")))
    more = tr.select("trace_id", F.posexplode(F.array(*reqs)).alias("i", "r"))
    more = more.select("trace_id", (F.lit(TAIL) + F.col("i")).alias("event_id"), "r.tus", "r.url", "r.resource_type",
                       F.lit(200).alias("status"), "r.content_type")
    added = _append(tr, ev, links).withColumn("url_before", F.lit("")).withColumn("url_after", F.lit(""))
    return renumber(ev.unionByName(added), order), rq.unionByName(more.select(*rq.columns))


def url_camouflage(tr: DataFrame) -> DataFrame:
    host = pick(fixed.CLEAN_HOSTS, choose(F.lit(len(fixed.CLEAN_HOSTS)), "url", salt="camouflage"))
    clean = F.concat(F.lit("https://"), host, F.lit("/auth/verify"))
    return tr.withColumn("final_url", clean).withColumn("url", clean)


def form_step_split(ev: DataFrame, order: Order = ordered.sequence) -> DataFrame:
    """A navigation event in front of the first password event of each trace."""
    wide = spread_ids(ev)
    hit = wide.filter(F.contains(events.field_text(), F.lit("password")))
    first = hit.groupBy("trace_id").agg(F.min_by(F.struct("tus", "event_id", "ts_us", "user_id", "root_url"), F.struct("tus", "event_id")).alias("f"))
    rows = first.select("trace_id", "f.user_id", "f.root_url", "f.tus", (F.col("f.event_id") - 1).alias("event_id"),
                        F.lit("").alias("url_before"), F.lit("").alias("url_after"), (F.col("f.ts_us") - 50_000_000).alias("t"))
    new = _added(rows, ev, event_type=F.lit("navigation"), ts_us=F.col("t"))
    return renumber(wide.unionByName(new), order)


# ------------------------------------------------------------------ feature space
def benign_replacement(df: DataFrame, columns: list[str], strength: float = 1.0, label: str = "y") -> DataFrame:
    """Blend the columns of positives with an md5-chosen benign row."""
    benign = df.filter(F.col(label) == 0)
    pool = ordered.sequence(benign.withColumn("one", F.lit(1)).withColumn("h", ordered.hash_order(7, "trace_id")), ["one"],
                            ["h", "trace_id"], F.substring("h", 1, 3), "slot")
    n = benign.count()
    pool = pool.select("slot", F.struct(*columns).alias("_b"))
    keyed = df.withColumn("slot", F.when(F.col(label) == 1, choose(F.lit(max(1, n)), F.col("trace_id").cast("string"), salt="benign")))
    j = keyed.join(pool, "slot", "left").drop("slot")
    keep = [c for c in df.columns if c not in columns]
    return j.select(*keep, *[F.when(F.col("_b").isNotNull(), strength * F.col(f"_b.{c}") + (1 - strength) * F.col(c)).otherwise(F.col(c)).alias(c)
                             for c in columns])


def mean_substitution(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    from tracegraph.session import land
    m = land(df.filter(F.col(label) == 0).agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")), "benign-mean")
    keep = [c for c in df.columns if c not in columns]
    return df.withColumn("_m", m.scalar()).select(*keep, *[F.when(F.col(label) == 1, F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
