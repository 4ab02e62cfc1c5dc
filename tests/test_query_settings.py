"""Queries of studies and ensembles run the operators' own seeds, folds and rounds."""

import pytest

from modaweave.operators import learners
from modaweave.plans import CATALOG, catalog_models


class Called(Exception):
    pass


@pytest.mark.parametrize("name, study", [("study_low_data", "low_data_curves"), ("study_descriptor_benchmark", "descriptor_benchmark"), ("predict_with_best", "cross_validate")])
def test_studies_use_default_settings(spark, data, monkeypatch, name, study):
    def run(*_, **settings):
        raise Called(settings)

    monkeypatch.setattr(catalog_models.studies, study, run)
    with pytest.raises(Called) as e:
        CATALOG[name].run(spark, data)
    assert not {"seeds", "folds"} & e.value.args[0].keys()


def test_balanced_ensemble_uses_default_rounds():
    made = learners.make("Balanced Ensemble", "classification", **catalog_models._SMALL.get("Balanced Ensemble", {}))
    assert (made.size, made.rounds) == (learners.BalancedEnsemble().size, learners.BalancedEnsemble().rounds)
