"""Suffix lists and documents of mixed shape."""

from tracegraph.functions import suffixes
from tracegraph.sources import traces


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n\ncom\nUK // old\nco.uk\n*.ck\n!www.ck\n*.kawasaki.jp\n!city.kawasaki.jp\njp\nk12.ma.us\n")
    rules = suffixes.suffix_rules(spark, str(tmp_path / "list.dat"))
    assert sorted(map(tuple, rules.collect()))[:4] == [("city.kawasaki.jp", "exception"), ("ck", "wildcard"), ("co.uk", "plain"), ("com", "plain")]
    want = {"a.b.com": ("com", "b.com", "a"), "com": ("", "", ""), "x.co.uk": ("co.uk", "x.co.uk", ""), "co.uk": ("co.uk", "", ""), "a.uk": ("uk", "a.uk", ""), "b.a.ck": ("a.ck", "b.a.ck", ""),
            "a.ck": ("a.ck", "", ""), "www.ck": ("ck", "www.ck", ""), "m.www.ck": ("ck", "www.ck", "m"), "p.q.kawasaki.jp": ("q.kawasaki.jp", "p.q.kawasaki.jp", ""),
            "t.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", "t"), "Lin.K12.ma.us": ("k12.ma.us", "lin.k12.ma.us", ""), "x.y.nowhere": ("nowhere", "y.nowhere", "x"),
            "10.0.0.1": ("", "", ""), "": ("", "", "")}
    df = spark.createDataFrame([(d, "s") for d in want] + [(None, "s")], "domain string, kind string")
    got = {r.domain: (r.suffix, r.registered, r.subdomain) for r in suffixes.with_suffix(df, rules).collect()}
    assert got == {**want, None: ("", "", "")}


def test_documents_of_mixed_shape(spark, tmp_path):
    lines = ['{"hash": "a", "events": [{"event_type": "x", "form_data": {"b": 1, "a": [2]}}, {"form_data": "plain"}]}', '{"hash": "b", "trace": {"events": [{"event_type": 7, "form_data": ["p", 3]}, {}]}}',
             '{"hash": 5, "events": "none"}', "[1]", "{broken", '"text"', ""]
    (tmp_path / "docs.json").write_text("\n".join(lines))
    docs = traces.variant_scan(spark, str(tmp_path))
    assert docs.count() == 3 and "form_data" in traces.variant_shape(docs).first().shape
    got = sorted(map(tuple, traces.variant_events(docs).collect()))
    assert got == [("a", 0, "x", "a b"), ("a", 1, "unknown", "plain"), ("b", 0, "7", "p 3"), ("b", 1, "unknown", "")]
