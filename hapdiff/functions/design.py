"""Designs, contrasts and groups: small tables that the driver checks before any job runs."""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd


def align_design(design: pd.DataFrame, samples: Sequence[str]) -> pd.DataFrame:
    """One row for each sample in their order: by a `sample` column that names them all, else by the index if that does, else as given."""
    if len(design) != len(samples):
        raise ValueError("the design must have one row per sample")
    for own in ([design["sample"]] if "sample" in design else []) + [design.index]:
        names = [str(x) for x in own]
        if sorted(names) == sorted(samples):
            return design.iloc[[names.index(s) for s in samples]].reset_index(drop=True)
    return design.reset_index(drop=True)


def _is_number(own: pd.Series) -> bool:
    return pd.api.types.is_numeric_dtype(own) and not pd.api.types.is_bool_dtype(own)


def _levels(own: pd.Series) -> list:
    """The levels of a category that occur, in its order; of other values in ascending order."""
    if isinstance(own.dtype, pd.CategoricalDtype):
        return [x for x in own.cat.categories if (own == x).any()]
    return sorted(own.unique())


def as_groups(own: pd.Series) -> pd.Series:
    """A grouping column as a category of text, levels in its order if it is one, else as they first appear. Two levels."""
    text = lambda x: f"{x:.15g}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else _level_name(x)
    levels = _levels(own) if isinstance(own.dtype, pd.CategoricalDtype) else list(dict.fromkeys(own))
    if own.isna().any() or len(levels) != 2:
        raise ValueError("the grouping column needs exactly two levels and no missing values")
    return pd.Series(pd.Categorical([text(x) for x in own], categories=[text(x) for x in levels]), index=own.index)


Term = tuple[str, ...]
_TOKEN = re.compile(r"I\(|[\w.]+|[-+*/:^()]")


def _crossed(left: list[Term], right: list[Term]) -> list[Term]:
    return _different([tuple(dict.fromkeys(a + b)) for a in left for b in right])


def _different(terms: list[Term]) -> list[Term]:
    """Terms of the same factors once, as they first appear."""
    found: dict[frozenset, Term] = {}
    for t in terms:
        found.setdefault(frozenset(t), t)
    return list(found.values())


class _Formula:
    """The right side of a formula, read from left to right: `^` binds closest, then `:`, `*` and `/`, then `+` and `-`."""

    def __init__(self, text: str):
        self.text, self.at, self.intercept = text.replace(" ", ""), 0, True

    def peek(self) -> str:
        found = _TOKEN.match(self.text, self.at)
        if not found and self.at < len(self.text):
            raise ValueError(f"the formula isn't understood from {self.text[self.at:]} on")
        return found[0] if found else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if token and (token in wanted or not wanted):
            self.at += len(token)
            return token
        return ""

    def sum(self) -> list[Term]:
        terms: list[Term] = []
        sign = self.take("+", "-") or "+"
        while sign:
            if self.peek() in ("0", "1"):
                self.intercept = (self.take() == "1") == (sign == "+")
            else:
                own = self.product()
                gone = {frozenset(t) for t in own}
                terms = _different(terms + own) if sign == "+" else [t for t in terms if frozenset(t) not in gone]
            sign = self.take("+", "-")
        return terms

    def product(self) -> list[Term]:
        left = self.interaction()
        while sign := self.take("*", "/"):
            right = self.interaction()
            within = left if sign == "*" else [tuple(dict.fromkeys(itertools.chain.from_iterable(left)))]
            left = _different(left + (right if sign == "*" else []) + _crossed(within, right))
        return left

    def interaction(self) -> list[Term]:
        left = self.power()
        while self.take(":"):
            left = _crossed(left, self.power())
        return left

    def power(self) -> list[Term]:
        own = self.factor()
        if self.take("^"):
            degree = self.take()
            if not degree.isdigit() or int(degree) < 1:
                raise ValueError("a formula's power is a whole number from 1 on")
            base = own
            for _ in range(int(degree) - 1):
                own = _different(own + _crossed(own, base))
        return own

    def factor(self) -> list[Term]:
        if self.take("("):
            own = self.sum()
            if not self.take(")"):
                raise ValueError("the formula lacks a closing parenthesis")
            return own
        if self.take("I("):
            depth, begin = 1, self.at
            while depth:
                if self.at == len(self.text):
                    raise ValueError("the formula lacks a closing parenthesis")
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
            return [(f"I({_spelled(_arithmetic(self.text[begin : self.at - 1]))})",)]
        name = self.take()
        if not re.fullmatch(r"[\w.]+", name) or name[0].isdigit() or self.peek() == "(":
            raise ValueError(f"the formula's term {name or self.text[self.at:]} isn't understood")
        return [(name,)]


_SIGNS = {ast.Add: " + ", ast.Sub: " - ", ast.Mult: " * ", ast.Div: "/", ast.Pow: "^"}
_BINDS = {ast.Add: 1, ast.Sub: 1, ast.Mult: 2, ast.Div: 2, ast.Pow: 3}


def _arithmetic(text: str) -> ast.expr:
    """What I() holds: numbers and columns with + - * / ^ and parentheses."""
    try:
        root = ast.parse(text.replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"I({text}) isn't understood") from e
    for node in ast.walk(root):
        known = isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Name, ast.Load, ast.USub, ast.UAdd, *_SIGNS)) or isinstance(node, ast.Constant) and isinstance(node.value, (int, float))
        if not known:
            raise ValueError(f"I({text}) isn't understood")
    return root


def _spelled(node: ast.expr) -> str:
    """An expression as coefficients name it."""
    if isinstance(node, ast.BinOp):
        binds = _BINDS[type(node.op)]
        left, right = (2 * _BINDS[type(x.op)] if isinstance(x, ast.BinOp) else 9 for x in (node.left, node.right))
        first = f"({_spelled(node.left)})" if left < 2 * binds + (binds == 3) else _spelled(node.left)
        second = f"({_spelled(node.right)})" if right < 2 * binds + (binds < 3) else _spelled(node.right)
        return first + _SIGNS[type(node.op)] + second
    if isinstance(node, ast.UnaryOp):
        return ("-" if isinstance(node.op, ast.USub) else "+") + _spelled(node.operand)
    return node.id if isinstance(node, ast.Name) else f"{node.value:.15g}"


def _value(node: ast.expr, design: pd.DataFrame) -> np.ndarray | float:
    if isinstance(node, ast.BinOp):
        left, right = _value(node.left, design), _value(node.right, design)
        with np.errstate(all="ignore"):
            return {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.divide, ast.Pow: np.power}[type(node.op)](left, right)
    if isinstance(node, ast.UnaryOp):
        return -_value(node.operand, design) if isinstance(node.op, ast.USub) else _value(node.operand, design)
    if isinstance(node, ast.Constant):
        return float(node.value)
    if node.id not in design or not _is_number(design[node.id]):
        raise ValueError(f"the design has no column of numbers {node.id}")
    return design[node.id].to_numpy(float)


def formula_terms(formula: str) -> tuple[list[Term], bool]:
    """The terms of a one-sided formula, each the columns that it multiplies, main effects first, and whether it has an intercept.

    Read are `+`, `-`, `:`, `*` (both and their product), `/` (the left and within it the right), `^` (all products up to a degree),
    parentheses, `0`, `1`, and `I()` with arithmetic on columns of numbers; other calls are refused.
    """
    left, tilde, right = formula.partition("~")
    if left.strip() or not tilde or not right.strip():
        raise ValueError("the formula must be one-sided")
    reader = _Formula(right)
    found = reader.sum()
    if reader.peek():
        raise ValueError(f"the formula isn't understood from {reader.text[reader.at:]} on")
    return sorted(found, key=len), reader.intercept


def _level_name(x: object) -> str:
    return str(x).upper() if isinstance(x, (bool, np.bool_)) else str(x)


def design_matrix(design: pd.DataFrame, formula: str) -> tuple[np.ndarray, list[str]]:
    """The columns of formula_terms() and their names: categories as indicators of their levels, numbers and I() as they are.

    A category of a term leaves out its first level if the formula also has the term without it. Full rank and more rows than
    columns are required.
    """
    terms, intercept = formula_terms(formula)
    held = [set(t) for t in terms] + ([set()] if intercept else [])
    columns, names = ([np.ones(len(design))], ["(Intercept)"]) if intercept else ([], [])
    for term in terms:
        made = [(np.ones(len(design)), "")]
        for name in term:
            if name.startswith("I("):
                coded = [(np.broadcast_to(_value(_arithmetic(name[2:-1]), design), len(design)).astype(float), name)]
            elif name not in design:
                raise ValueError(f"the design has no column {name}")
            elif design[name].isna().any():
                raise ValueError(f"column {name} has missing values")
            elif _is_number(own := design[name]):
                coded = [(own.to_numpy(float), name)]
            else:
                levels = _levels(own)[1 if set(term) - {name} in held else 0 :]
                coded = [((own == x).to_numpy(float), f"{name}{_level_name(x)}") for x in levels]
                if term == (name,) and set() not in held:
                    held.append(set())  # its indicators sum to the intercept
            made = [(x * y, f"{a}:{b}" if a else b) for y, b in coded for x, a in made]
        columns += [x for x, _ in made]
        names += [a for _, a in made]
    x = np.column_stack(columns) if columns else np.zeros((len(design), 0))
    if not np.isfinite(x).all():
        raise ValueError("the design has values that aren't finite")
    if not x.shape[1] or x.shape[0] <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design matrix needs full rank and more rows than columns")
    return x, names


def contrast(coef: str | int | Sequence[float], names: Sequence[str]) -> np.ndarray:
    """A vector from a column's name, its place counted from 1, or itself."""
    if isinstance(coef, str):
        if coef not in names:
            raise ValueError(f"no coefficient {coef} among {list(names)}")
        return np.eye(len(names))[list(names).index(coef)]
    if isinstance(coef, (int, float)) and coef == int(coef):
        coef = int(coef)
        if not 1 <= coef <= len(names):
            raise ValueError("the coefficient's place is outside the design")
        return np.eye(len(names))[coef - 1]
    out = np.asarray(coef, float)
    if out.shape != (len(names),) or not np.isfinite(out).all() or not out.any():
        raise ValueError("a contrast has one finite number per column, not all of them 0")
    return out


def group_column(design: pd.DataFrame, formula: str, coef: str | int | Sequence[float]) -> str:
    """The formula's two-level column that is permuted: `group` or `groups`, else the one whose name the coefficient has, else the only one."""
    used = dict.fromkeys(name for term in formula_terms(formula)[0] for name in term if name in design)
    two = [name for name in used if design[name].nunique() == 2]
    named = [name for name in two if isinstance(coef, str) and name in coef]
    for found in ([name for name in two if name in ("group", "groups")], named, two):
        if len(found) == 1:
            return found[0]
    raise ValueError("no single two-level grouping column in the formula; name it group or groups")


def group_codes(groups: Mapping[str, str] | Sequence[str], samples: Sequence[str], levels: Sequence[str] | None = None) -> tuple[list[int], list[str]]:
    """1 or 2 for each sample, and the two levels in order: as given, else as they first appear."""
    own = [groups[s] for s in samples] if isinstance(groups, Mapping) else list(groups)
    if len(own) != len(samples):
        raise ValueError("one group per sample is needed")
    order = list(levels) if levels is not None else list(dict.fromkeys(own))
    if len(order) != 2 or set(order) != set(own):
        raise ValueError("exactly two groups are needed")
    return [order.index(g) + 1 for g in own], order


def check_parameters(threshold: float, max_gap_smooth: float, max_gap_region: float, min_cpgs: int, bp_span: float, min_in_span: float) -> None:
    for name, value in (("threshold", threshold), ("max_gap_smooth", max_gap_smooth), ("max_gap_region", max_gap_region)):
        if not np.isfinite(value) or value < 0:
            raise ValueError(f"{name} must be finite and not negative")
    if min_cpgs != int(min_cpgs) or min_cpgs < 3:
        raise ValueError("min_cpgs must be a whole number of at least 3")
    for name, value in (("bp_span", bp_span), ("min_in_span", min_in_span)):
        if not np.isfinite(value) or value <= 0:
            raise ValueError(f"{name} must be finite and positive")
