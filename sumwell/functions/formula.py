"""Regression formulas: ``y1 + y2 ~ a + b``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Formula:
    outcomes: tuple[str, ...]
    covariates: tuple[str, ...]


def parse(text: str, many_outcomes: bool = True) -> Formula:
    """Outcomes and covariates of a formula.

    Terms are column names, joined by ``+``; an intercept is always part of
    the model.  Fixed effects (``| f``) are refused: include their group means
    (:class:`~sumwell.operators.panel.Mundlak`) instead.
    """
    if "|" in text:
        raise NotImplementedError("fixed effects after '|' are not supported; add group means as covariates instead")
    if text.count("~") != 1:
        raise ValueError(f"a formula has one '~': {text!r}")
    left, right = ([t.strip() for t in side.split("+") if t.strip()] for side in text.split("~"))
    if not left:
        raise ValueError(f"a formula has an outcome before '~': {text!r}")
    if len(left) > 1 and not many_outcomes:
        raise ValueError(f"this model has one outcome: {text!r}")
    if len(set(left)) < len(left) or len(set(right)) < len(right):
        raise ValueError(f"a term occurs twice: {text!r}")
    return Formula(tuple(left), tuple(right))
