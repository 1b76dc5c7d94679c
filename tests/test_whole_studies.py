"""Studies ask for whole learners, columns and folds."""

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from tracegraph.operators import fits, learn, views
from tracegraph.plans.registry import QUERIES, tables


class Asked(Exception):
    pass


@pytest.fixture
def asked(spark, monkeypatch):
    """What a query hands to the function ``name`` of ``learn``: its arguments and keywords."""
    def ask(query, name):
        def stop(*args, **kwargs):
            raise Asked(args, kwargs)

        monkeypatch.setattr(learn, name, stop)
        with pytest.raises(Asked) as got:
            QUERIES[query](tables(spark, "/root/testdata/sf0.001"))
        return got.value.args

    return ask


def test_clf_rf(asked):
    (_, cases), kwargs = asked("clf_rf", "evaluate")
    (columns, learner), = cases.values()
    assert len(columns) == 42 and learner == fits.forest(500, depth=None) and kwargs == {}  # ten folds


def test_clf_mlp(asked):
    (_, cases), kwargs = asked("clf_mlp", "evaluate")
    (columns, learner), = cases.values()
    assert len(columns) == 42 and learner.params["hidden"] == (128, 64) and learner.params["rounds"] >= 500 and kwargs == {}


def test_stacked_smve(asked):
    (_, bases, finals, raw, _), kwargs = asked("stacked_smve", "stacked_whole")
    assert list(bases) == list(views.VIEW_PREFIX) and sum(len(c) for c, _ in bases.values()) == 125 and len(raw) == 21 and kwargs == {}  # ten folds, three inside
    assert [learner.params["trees"] for _, learner in bases.values()] == [200, 300, 200, 200, 300, 150]
    assert [f.kind for f in finals] == ["logistic", "boosted"] and finals[1].params["trees"] == 100


def test_stack_concat(asked):
    (_, bases, finals, raw, _, folds, inner), _ = asked("stack_concat", "stacked_whole")
    assert all(len(c) == 125 for c, _ in bases.values()) and (folds, inner, raw) == (10, 3, [])
    assert bases["rf"][1].params["trees"] == bases["gbm"][1].params["trees"] == 300 and bases["mlp"][1].params["hidden"] == (128, 64)
    assert [f.kind for f in finals] == ["logistic"]


def test_baseline_suite(asked):
    (_, cases), kwargs = asked("baseline_suite", "out_of_fold_whole")
    trees = {m: learner.params.get("trees") for m, (_, learner) in cases.items()}
    assert kwargs == {} and trees["redirect_gbm"] == 200 and trees["behaviour_gbm"] == 150 and trees["all_rf"] == trees["url_rf"] == trees["vote:rf"] == trees["vote:gbm"] == 100
    assert cases["all_rf"][1].params["depth"] is None and cases["visual_mlp"][1].params["hidden"] == (128, 64, 32)
