"""Roles of panel columns; every operator that needs several roles takes a PanelSpec."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    contest: str = "contest_id"
    entry: str = "entry_id"
    number: str = "entry_no"
    day: str = "event_date"
    year: str = "year"
    runner: str = "runner"
    status: str = "status"
    rank: str = "rank"
    field_size: str = "field_size"
    win_pay: str = "win_pay"
    place_pay: str = "place_pay"
    win_odds: str = "win_odds"
    # Year -> split of the standard panel.
    splits: dict = field(default_factory=lambda: {
        **{y: "train" for y in range(2016, 2024)}, 2024: "validation", 2025: "test", 2026: "latest_holdout"})
