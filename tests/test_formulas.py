"""Formulas with nested, crossed and powered terms, arithmetic, and the names of coefficients."""

import numpy as np
import pandas as pd
import pytest

from hapdiff.functions import design

D = pd.DataFrame({"a": list("uvuvuvuvuv"), "b": list("ppqqppqqpq"), "x": [1.0, 2, 3, 4, 6, 5, 8, 9, 7, 2], "old": [True, False, True, True, False, False, True, False, False, True]})


@pytest.mark.parametrize(
    "formula, same",
    [
        ("~ a * b", "~ a + b + a:b"),
        ("~ a / b", "~ a + a:b"),
        ("~ (a + b) / c", "~ a + b + a:b:c"),
        ("~ a / (b + c)", "~ a + a:b + a:c"),
        ("~ a / b / c", "~ a + a:b + a:b:c"),
        ("~ (a + b + c)^2", "~ a + b + c + a:b + a:c + b:c"),
        ("~ (a + b + c)^3", "~ a * b * c"),
        ("~ (a + b)^2 - a:b", "~ a + b"),
        ("~ a * (b + c)", "~ a + b + c + a:b + a:c"),
        ("~ a * b * c - a:b:c", "~ a + b + c + a:b + a:c + b:c"),
        ("~ ((a) + (b))", "~ a + b"),
        ("~ (a + b):c", "~ a:c + b:c"),
        ("~ a:b*c", "~ a:b + c + a:b:c"),
        ("~ a + b:a + a:b", "~ a + b:a"),
        ("~ -1 + a", "~ 0 + a"),
        ("~ a - 1 + 1", "~ a"),
        ("~ a^1", "~ a"),
    ],
)
def test_terms(formula, same):
    (got, intercept), (want, other) = design.formula_terms(formula), design.formula_terms(same)
    assert [set(t) for t in got] == [set(t) for t in want] or sorted(map(sorted, got)) == sorted(map(sorted, want))
    assert intercept == other


@pytest.mark.parametrize("bad", ["~ a +", "~ (a", "~ a)", "~ log(a)", "~ a ^ b", "~ a^0", "~ I(log(x))", "~ I(x", "~ I()", "~ 2a", "~ a ? b", "~ I(__import__)()", "~ I(x.y)", "~ a b"])
def test_refused(bad):
    with pytest.raises(ValueError):
        design.design_matrix(D, bad)


def test_arithmetic():
    for text, name, want in (("I(x^2)", "I(x^2)", D.x**2), ("I((x+1)/2)", "I((x + 1)/2)", (D.x + 1) / 2), ("I(-x*3)", "I(-x * 3)", -3 * D.x), ("I(x-(2-x))", "I(x - (2 - x))", 2 * D.x - 2), ("I((x^2)^2*2)", "I((x^2)^2 * 2)", 2 * D.x**4), ("I(2 ^ x - x)", "I(2^x - x)", 2**D.x - D.x)):
        x, names = design.design_matrix(D, f"~ a + {text}")
        assert np.allclose(x[:, 2], want) and names == ["(Intercept)", "av", name]
    x, names = design.design_matrix(D, "~ a * I(x^2)")
    assert names == ["(Intercept)", "av", "I(x^2)", "av:I(x^2)"] and np.allclose(x[:, 3], x[:, 1] * D.x**2)
    with pytest.raises(ValueError, match="column of numbers"):
        design.design_matrix(D, "~ I(a + 1)")
    with pytest.raises(ValueError, match="finite"):
        design.design_matrix(D, "~ a + I(1/(x - 1))")


def test_names_of_levels():
    assert design.design_matrix(D, "~ old + x")[1] == ["(Intercept)", "oldTRUE", "x"]
    assert design.design_matrix(D, "~ 0 + old")[1] == ["oldFALSE", "oldTRUE"]
    assert design.design_matrix(D, "~ a / x")[1] == ["(Intercept)", "av", "au:x", "av:x"]


def test_group_column_of_a_formula_with_arithmetic():
    assert design.group_column(D.assign(group=D["a"]), "~ group + I(x^2)", 2) == "group"
