"""Registered training queries fit the full sizes of the constants."""

from types import SimpleNamespace

import pytest

from holdfast import constants as K
from holdfast.plans import catalog


class Reached(Exception):
    pass


@pytest.mark.parametrize("name, module, function, sizes", [
    ("train_gbt", "models", "fit_boosted", K.BOOSTING_DEFAULT), ("calibrate", "models", "fit_calibrated", K.BOOSTING_DEFAULT),
    ("select_model", "models", "candidate_results", K.BOOSTING_CANDIDATES), ("train_run", "training", "train", K.BOOSTING_CANDIDATES),
])
def test_registered_fits_are_of_full_size(monkeypatch, name, module, function, sizes):
    def stop(*given, **_):
        raise Reached(given[-1])

    part = SimpleNamespace(persist=lambda: part, unpersist=lambda: None, where=lambda _: part)
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none"))
    monkeypatch.setattr(catalog, "cleaned", lambda *_: part)
    monkeypatch.setattr(catalog.models, "with_label", lambda *_: part)
    monkeypatch.setattr(catalog.training, "split_frame", lambda *_: part)
    monkeypatch.setattr(getattr(catalog, module), function, stop)
    with pytest.raises(Reached) as reached:
        catalog.QUERIES[name](session, name)
    assert reached.value.args[0] == sizes
