"""Weights, penalties, thresholds and limits, passed to the operators as values.

Points are handled as whole hundredths (and tenths for weights) inside the plans,
so sums do not depend on the order in which a shuffle delivers rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from datetime import datetime

from evisift.operators.signals import SignalTable
from evisift.vocabulary import CLOUD_FULLSTACK_TENTHS, PYTHON_BACKEND_TENTHS


@dataclass(frozen=True)
class Weights:
    """Category caps in points; they must add up to 100."""

    ai_project_depth: int = 40
    python_backend: int = 30
    cloud_fullstack: int = 15
    github: int = 10
    engineering_depth: int = 5

    def total(self) -> int:
        return sum(getattr(self, cap.name) for cap in fields(self))

    def __post_init__(self) -> None:
        if self.total() != 100:
            raise ValueError(f"category weights add up to {self.total()}, not 100")


@dataclass(frozen=True)
class Penalties:
    """Deductions in points."""

    thin_min: int = 5
    thin_max: int = 15
    tutorial: int = 3
    cap: int = 15
    detail_words: int = 15


# How much a mention counts by the place it stands in, in tenths.
SOURCE_TENTHS = {
    "project": 10,
    "experience": 9,
    "unknown": 6,
    "summary": 5,
    "skills": 4,
}


@dataclass(frozen=True)
class Thresholds:
    source_tenths: dict[str, int] = field(default_factory=lambda: dict(SOURCE_TENTHS))
    thin_quality: int = 3              # of 10
    name_only_percent: int = 25        # of the depth category
    name_only_points_per_term: int = 2
    python_target_tenths: int = 70
    cloud_target_tenths: int = 40
    breadth_projects: int = 3
    depth_percent: int = 70
    breadth_percent: int = 15
    signal_percent: int = 15
    event_days: int = 90
    repo_days: int = 180
    unknown_activity_points: int = 5   # of 10, when a profile could not be read
    same_day_events: bool = True       # count an event that is zero days old


@dataclass(frozen=True)
class Limits:
    """Text lengths that are part of the output format; None: the whole text, in the outputs and where signals are counted."""

    context: int = 140
    title: int | None = 120
    description: int | None = 1200
    judged_description: int | None = 1500
    scoring_context: int = 6000
    full_context: int = 14000
    summary: int | None = 240


@dataclass(frozen=True)
class ScreenParams:
    weights: Weights = field(default_factory=Weights)
    penalties: Penalties = field(default_factory=Penalties)
    thresholds: Thresholds = field(default_factory=Thresholds)
    limits: Limits = field(default_factory=Limits)
    as_of: datetime = datetime(2024, 2, 1)
    # Term weights in tenths for the two weighted categories, by term name.
    python_backend_tenths: Mapping[str, int] = field(default_factory=lambda: PYTHON_BACKEND_TENTHS)
    cloud_fullstack_tenths: Mapping[str, int] = field(default_factory=lambda: CLOUD_FULLSTACK_TENTHS)
    # Section headings by section, in order of precedence; None: the fixed ones.
    aliases: Mapping[str, Sequence[str]] | None = None
    # A join key held by at least this many rows is joined through a broadcast of
    # its few partner rows, so it never meets in a single task. The number of such
    # keys is at most rows / hot_rows.
    hot_rows: int = 1_000_000
    # Forms that show a project's signals, and markers of tutorials; None for the fixed ones.
    signals: SignalTable | None = None
    tutorial_markers: tuple[str, ...] | None = None
