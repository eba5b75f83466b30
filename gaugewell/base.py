"""What all analyzers share."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame


class AnalyzerType(Enum):
    DATASET = "dataset"
    MODEL = "model"


@dataclass
class Result:
    """A report, and the small DataFrame behind its chart if it has one."""

    df: DataFrame
    plot_data: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @property
    def raw(self) -> DataFrame:
        return self.df

    @property
    def plot(self) -> DataFrame:
        if self.plot_data is None:
            raise ValueError("this result has no chart")
        return self.plot_data


class Analyzer:
    """Metadata of an analyzer. ``provides`` names its capability, ``requires`` what it builds on."""

    id = ""
    capability = ""
    requires: tuple[str, ...] = ("profile.base",)
    provides: tuple[str, ...] = ()
    analyzer_type = AnalyzerType.DATASET

    @property
    def capability_name(self) -> str:
        return self.capability


def require_column(df: DataFrame, column: str | None, role: str) -> None:
    if column is not None and column not in df.columns:
        raise ValueError(f"{role} {column!r} is not a column of the table")


def require_share(value: float, role: str) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{role} must lie in [0, 1], not {value}")
