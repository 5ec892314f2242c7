"""Enumeration of feature sets: every attribute, every pair, every triplet."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations


@dataclass(frozen=True)
class FeatureSet:
    """``attrs`` are the attributes a flag is reported for, ``features`` the ones a model reads."""

    set_id: int
    attrs: tuple[int, ...]
    features: tuple[int, ...]

    @property
    def arity(self) -> int:
        return len(self.attrs)

    @property
    def label(self) -> str:
        return "-".join(map(str, self.attrs))

    @property
    def mask(self) -> int:
        return attr_mask(self.attrs)


def attr_mask(attrs) -> int:
    mask = 0
    for attr in attrs:
        mask |= 1 << attr
    return mask


def feature_sets(d: int, max_arity: int = 3, min_arity: int = 1) -> list[FeatureSet]:
    """Sets over ``d`` attributes in order of size, then of position.

    Pairs exist from two attributes on and triplets from three on. The list lives on the driver; its length
    depends on the schema only.
    """
    if not 1 <= max_arity <= 3 or not 1 <= min_arity <= max_arity:
        raise ValueError("feature sets hold one, two or three attributes")
    chosen = [c for arity in range(min_arity, max_arity + 1) for c in combinations(range(d), arity)]
    return [FeatureSet(i, c, c) for i, c in enumerate(chosen)]
