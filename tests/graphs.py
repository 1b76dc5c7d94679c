"""Builders of small node and edge tables."""

NODE = ("trace_id long, node string, node_seq long, node_type string, element_tag string, element_id string, element_class string, "
        "tus long, form_field string, is_root boolean, has_sensitive boolean, attr string")
EDGE = "trace_id long, src string, dst string, edge_type string, weight double"


def tables(spark, graphs):
    """graphs: {trace_id: (nodes in order, [(src, dst, weight)])}; names starting with u are URLs, the first is the root."""
    nodes, edges = [], []
    for tid, (names, links) in graphs.items():
        for i, n in enumerate(names):
            kind = "url" if n.startswith("u") else "submit" if n.startswith("s") else "form_input"
            attr = "input password" if n.startswith("p") else ""
            nodes.append((tid, n, -1 if i == 0 else i, kind, "", "", "", None, "", i == 0, False, attr))
        edges += [(tid, a, b, "sequence", float(w)) for a, b, w in links]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


PATH6 = (["u0", "a", "b", "c", "d", "u5"], [("u0", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "u5", 2)])
STAR = (["u0", "a", "b", "c", "d", "e"], [("u0", x, 1) for x in "abcde"])
CYCLE = (["u0", "a", "b", "c"], [("u0", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "u0", 2)])
TRIANGLE = (["u0", "a", "b", "c"], [("u0", "a", 1), ("a", "b", 1), ("b", "u0", 1), ("b", "c", 1)])
SPLIT = (["u0", "a", "u1", "u2"], [("u0", "a", 1), ("u1", "u2", 3)])
LOOP = (["u0", "a", "p1"], [("u0", "a", 1), ("a", "u0", 2), ("u0", "u0", 3), ("u0", "p1", 1)])
LONE = (["u0"], [])
DIAMOND = (["u0", "a", "b", "s1", "p2"], [("u0", "a", 1), ("u0", "b", 1), ("a", "s1", 1), ("b", "s1", 1), ("s1", "p2", 2)])
ALL = {1: PATH6, 2: STAR, 3: CYCLE, 4: TRIANGLE, 5: SPLIT, 6: LOOP, 7: LONE, 8: DIAMOND}
