"""Hand-worked documents through scan, flatten, graph, rules."""

import json

import pytest

from tracegraph.operators import dedup, domains, graph, rules, views
from tracegraph.sources import traces


def event(t, kind, before="", after="", tag="input", eid="", cls="", form=None, text=""):
    return {"timestamp": t, "event_type": kind, "element_tag": tag, "element_id": eid, "element_class": cls, "element_text": text,
            "url_before": before, "url_after": after, "form_data": form or {}}


def doc(name, events=(), requests=(), redirects=(), url="https://a.test/", title="Home", final="https://a.test/", success=True):
    return {"url": url, "hash": name, "success": success, "final_url": final,
            "trace": {"url": url, "final_url": final, "page_title": title, "events": list(events), "network_requests": list(requests),
                      "redirects": list(redirects)}}


OK = {"url": "https://a.test/", "method": "GET", "resource_type": "document", "status": 200, "timestamp": 1.0}
DOCS = [
    doc("g1", url="https://only.test/"),
    doc("g2", [event(0, "navigation", "https://a.test/", "https://a.test/"), event(1, "click", "https://a.test/", "https://a.test/", "button"),
               event(2, "input", "https://a.test/", "https://a.test/", "input", "user"), event(3, "navigation", "https://a.test/", "https://a.test/home")]),
    doc("g3", [event(1, "input", eid="password", form={"password": "x"}), event(2, "submit", tag="form")]),
    doc("g4", [event(1, "click", tag="button")], [OK]),
    doc("g5", [event(1, "click", tag="button")], [{**OK, "status": 404}], title="404 - Page Not Found"),
    doc("g6", final="about:blank", title="x"),
    doc("g7a", [event(1, "click"), event(2, "submit")], [OK]),
    doc("g7b", [event(5, "submit"), event(9, "click")], [OK, {**OK, "timestamp": 2.0}]),
    doc("bad", [event(1, "click")], success=False),
]


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for i, d in enumerate(DOCS):
        folder = root / ("phishing" if i % 2 else "benign")
        folder.mkdir(exist_ok=True)
        (folder / f"{d['hash']}.json").write_text(json.dumps(d, indent=1))
    (root / "benign" / "broken.json").write_text("{not json")
    docs = traces.trace_scan(spark, str(root), only_success=False, multi_line=True)
    assert traces.trace_scan(spark, str(root), multi_line=True).count() == len(DOCS) - 1
    return traces.trace_flatten(docs.persist())


def by_id(df):
    return {r["trace_id"]: r.asDict() for r in df.collect()}


def test_graph_of_golden_traces(flat):
    nodes = graph.itg_nodes(flat["tr"], flat["ev"], flat["rd"]).persist()
    edges = graph.itg_edges(flat["ev"], flat["rd"]).persist()
    # path metrics key traces by number in the packed helper, so hash the names
    import pyspark.sql.functions as F
    num = {r["trace_id"]: r["k"] for r in nodes.select("trace_id", F.xxhash64("trace_id").alias("k")).distinct().collect()}
    n2, e2 = nodes.withColumn("trace_id", F.xxhash64("trace_id")), edges.withColumn("trace_id", F.xxhash64("trace_id"))
    itg = by_id(views.itg_view(n2, e2))
    g1, g2, g3 = itg[num["g1"]], itg[num["g2"]], itg[num["g3"]]
    assert (g1["num_nodes"], g1["num_edges"]) == (1, 0)
    assert (g2["num_nodes"], g2["num_edges"], g2["diameter"], g2["num_redirects"]) == (6, 5, 5, 1)
    assert g2["avg_path_length"] == pytest.approx(7 / 3) and g2["graph_density"] == pytest.approx(1 / 6)
    assert g2["max_redirect_depth"] == 5 and g2["external_redirects"] == 0 and g2["num_input_fields"] == 1
    assert (g2["total_interaction_time"], g2["avg_time_between_events"], g2["event_frequency"]) == (2.0, 1.0, 1.5)
    assert (g3["num_nodes"], g3["num_edges"], g3["has_password_input"], g3["credential_fields_count"]) == (3, 2, 1, 1)
    risk = by_id(rules.risk_patterns(views.itg_view(n2, e2)))
    assert risk[num["g2"]]["risk_score"] == pytest.approx(0.05)


def test_quality_of_golden_traces(flat):
    q = by_id(rules.trace_quality(rules.quality_inputs(flat["tr"], flat["ev"], flat["rq"], flat["rd"])))
    assert q["g4"]["quality"] == 1.0 and q["g4"]["is_valid"]
    assert q["g5"]["quality"] == 0.0 and [i.split(":")[0] for i in q["g5"]["issues"]] == ["http_error", "error_page_content"]
    assert q["g6"]["quality"] == pytest.approx(0.25) and not q["g6"]["is_valid"]
    assert [i.split(":")[0] for i in q["bad"]["issues"]] == ["crawl_failed"]


def test_fingerprints(flat):
    f = by_id(dedup.trace_fingerprint(flat["tr"], flat["ev"], flat["rq"]))
    assert f["g7a"]["fingerprint"] == f["g7b"]["fingerprint"] != f["g4"]["fingerprint"]
    d = by_id(dedup.dedup_traces(dedup.trace_fingerprint(flat["tr"], flat["ev"], flat["rq"])))
    assert d["g7a"]["is_unique"] == 1 and d["g7b"]["is_unique"] == 0


def test_domain_scores(spark):
    d = spark.createDataFrame([("paypal-login-verify.xyz",), ("secure-banking.com",), ("example.com",)], "domain string")
    s = {r["domain"]: r["score"] for r in domains.domain_score(d).collect()}
    assert s == {"paypal-login-verify.xyz": 0.70, "secure-banking.com": 0.48, "example.com": 0.0}


def test_login_links(spark):
    p = spark.createDataFrame([(1, '<a href="/x">Sign in</a><a href="/about">About</a>'), (2, '<a href="/login">Go</a>')], "page_id long, html string")
    assert {(r["page_id"], r["href"]) for r in rules.login_link_match(p).collect()} == {(1, "/x"), (2, "/login")}
