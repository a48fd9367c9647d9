import inspect

import pytest

from nichespark.operators.fit import fit_design
from nichespark.plans import closed


class Seen(Exception):
    pass


@pytest.mark.parametrize("query", [closed.mixed_fit, closed.mixed_variance, closed.mixed_df])
def test_random_effects_run_the_default_rounds(monkeypatch, query):
    def fit(spark, sf, **how):
        raise Seen(how)

    monkeypatch.setattr(closed, "_fitted", fit)
    with pytest.raises(Seen) as e:
        query(None, "")
    how, default = e.value.args[0], inspect.signature(fit_design).parameters
    assert how["random"] == "intercept"
    assert how.get("re_maxit", default["re_maxit"].default) >= 10 and how.get("re_tol", default["re_tol"].default) <= 1e-3
