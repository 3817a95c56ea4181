"""Model queries that take every feature."""

from tallyframe.queries import QUERIES
from tallyframe.queries_forecast import _model_frames

SMALL = "/root/testdata/sf0.001"


def test_every_feature_is_ranked(spark):
    *_, names, categories = _model_frames(spark, SMALL)
    ranked = {r.feature: r.importance for r in QUERIES["permutation_importance"](spark, SMALL).collect()}
    assert set(ranked) == set(names)
    first = QUERIES["backward_elimination"](spark, SMALL).collect()[0]
    assert first.n_features == len([n for n in names if n not in categories])
