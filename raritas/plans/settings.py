"""Size-dependent default settings and checks of user arguments."""

from __future__ import annotations

from dataclasses import dataclass

DETECTORS = ("loda", "AE", "IF", "ngram")
BIG_ROWS = 10_000


@dataclass(frozen=True)
class Settings:
    epochs: int
    batch_size: int
    activation: str
    layers: tuple[int, ...]
    estimators: int


# The tuned settings for small and big tables, and the two network shapes.
LAYERS = {"long": (64, 32, 16, 1, 16, 32, 64), "short": (32, 16, 1, 16, 32)}
PROFILES = {
    "small": Settings(epochs=20, batch_size=128, activation="tanh", layers=LAYERS["long"], estimators=400),
    "big": Settings(epochs=100, batch_size=32, activation="relu", layers=LAYERS["short"], estimators=50),
}


def size_profile(rows: int) -> Settings:
    """Settings for a table of ``rows`` rows; more than 10000 rows count as big."""
    return PROFILES["big" if rows > BIG_ROWS else "small"]


def choose_settings(profile: str, rows: int) -> Settings:
    """'small' or 'big', or 'by_rows' for the original rule that takes one of them by the number of rows."""
    if profile == "by_rows":
        return size_profile(rows)
    if profile not in PROFILES:
        raise ValueError(f"the profile is 'by_rows', {' or '.join(map(repr, PROFILES))}")
    return PROFILES[profile]


def check_method(method: str) -> None:
    if method not in DETECTORS:
        raise ValueError(f"unknown method {method!r}; choose one of {', '.join(DETECTORS)}")


def check_split(train_split: float) -> None:
    if not 0 <= train_split <= 1:
        raise ValueError("train_split is a share of the table, between 0 and 1")
