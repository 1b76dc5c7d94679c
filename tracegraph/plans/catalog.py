"""All registered queries."""

from tracegraph.plans import (cat_graph, cat_learn, cat_rules, cat_scalar, cat_scan, cat_stats, cat_structure,  # noqa: F401
                              cat_stream, cat_views)
