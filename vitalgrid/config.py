"""Tunables, as frozen dataclasses; unknown keys and contradictory values are refused."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


def within(default: Any, least: float | None = None, most: float | None = None, above: float | None = None, one_of: tuple = ()):
    """A setting with a range: from ``least``, over ``above``, up to ``most``, or one of some values. None passes where it is the default."""
    return field(default=default, metadata={"least": least, "most": most, "above": above, "one_of": one_of})


class Ranged:
    """Checks every setting that has a range."""

    def __post_init__(self):
        for f in fields(self):
            value, m = getattr(self, f.name), f.metadata
            if not m or value is None and f.default is None:
                continue
            if m["one_of"]:
                ok = value in m["one_of"]
            else:
                ok = isinstance(value, (int, float)) and not isinstance(value, bool) and (m["least"] is None or value >= m["least"]) and (m["most"] is None or value <= m["most"]) and (m["above"] is None or value > m["above"])
            if not ok:
                raise ValueError(f"{type(self).__name__}.{f.name}: {value!r} is out of range")


@dataclass(frozen=True)
class Profile(Ranged):
    age: int | None = None
    sex: str | None = within(None, one_of=("male", "female", "unspecified"))
    hr_max: float | None = within(None, 120, 230)
    hr_rest: float | None = within(None, 25, 120)

    def __post_init__(self):
        super().__post_init__()
        if self.age is not None and not 10 <= self.age <= 120:
            raise ValueError("age is implausible")
        if self.hr_max is not None and self.hr_rest is not None and self.hr_max <= self.hr_rest:
            raise ValueError("hr_max must exceed hr_rest")


@dataclass(frozen=True)
class Correlation(Ranged):
    max_lag: int = within(3, 0, 14)
    min_overlap: int = within(42, 2)
    keep_alpha: float = within(0.10, most=1, above=0)
    fdr_alpha: float = within(0.05, most=1, above=0)  # the level asked of the adjustment; adjusted p values, which keep_alpha is held against, do not depend on it
    min_active: int = within(10, 0)
    min_abs: float = within(0.25, 0, 1)
    raw_min_abs: float = within(0.15, 0, 1)


@dataclass(frozen=True)
class Anomaly(Ranged):
    window: int = within(28, 2)
    threshold: float = within(3.5, above=0)
    recent_days: int = within(14, 1)
    min_global_z: float = within(2.5, 0)


@dataclass(frozen=True)
class Shape(Ranged):
    trend_strength: float = within(0.30, 0, 1)
    min_monotonicity: float = within(0.70, 0, 1)
    season_strength: float = within(0.20, 0, 1)
    reproducibility: float = within(0.30, 0, 1)


@dataclass(frozen=True)
class Recovery(Ranged):
    recent_days: int = within(14, 1)
    z: float = within(1.5, above=0)
    sleep_z: float = -1.0


@dataclass(frozen=True)
class Consistency(Ranged):
    window: int = within(28, 2)
    duration_std: float = within(1.0, 0)
    bedtime_std: float = within(1.0, 0)


@dataclass(frozen=True)
class Load(Ranged):
    metric: str = within("both", one_of=("trimp", "energy", "both"))
    edwards: bool = True  # zone load beside the others, where heart rates of sessions are stored
    acwr_high: float = within(1.5, above=0)
    acwr_low: float = within(0.8, above=0)
    min_active_days: int = within(8, 1, 28)
    fresh: float = within(0.05, 0, 1)
    detraining: float = within(0.15, 0, 1)
    overreach: float = within(-0.30, -1, 0)


@dataclass(frozen=True)
class Stress(Ranged):
    enabled: bool = True
    window_days: int = within(90, 1, 3650)
    reserve_full: float = within(0.5, most=1, above=0)
    hrv_weight: float = within(0.3, 0, 1)
    steps_per_min: float = within(60.0, 0)
    low: float = within(25.0, 0, 100)
    medium: float = within(50.0, 0, 100)
    high: float = within(75.0, 0, 100)
    min_measured: float = within(60.0, 0)
    alert: float = within(60.0, 0, 100)
    recent_days: int = within(14, 1)

    def __post_init__(self):
        super().__post_init__()
        if not self.low < self.medium < self.high:
            raise ValueError("stress zones must ascend")


@dataclass(frozen=True)
class Energy(Ranged):
    enabled: bool = True
    window_days: int = within(90, 1, 3650)
    neutral: float | None = within(None, 0, 100)
    charge: float = within(0.03, 0)
    drain: float = within(0.2, 0)
    sleep: float = within(0.15, 0)
    active: float = within(0.3, 0)
    seed: float = within(50.0, 0, 100)
    min_measured: int = within(60, 0)
    alert: float = within(20.0, 0, 100)
    recent_days: int = within(14, 1)


@dataclass(frozen=True)
class Report(Ranged):
    lookback_days: int = within(7, 1, 90)
    max_correlations: int = within(15, 0, 200)
    language: str = within("en", one_of=("en", "de"))


@dataclass(frozen=True)
class Config:
    zone: str = "Europe/Vienna"
    profile: Profile = field(default_factory=Profile)
    correlation: Correlation = field(default_factory=Correlation)
    anomaly: Anomaly = field(default_factory=Anomaly)
    shape: Shape = field(default_factory=Shape)
    recovery: Recovery = field(default_factory=Recovery)
    consistency: Consistency = field(default_factory=Consistency)
    load: Load = field(default_factory=Load)
    stress: Stress = field(default_factory=Stress)
    energy: Energy = field(default_factory=Energy)
    report: Report = field(default_factory=Report)
    type_map: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.energy.enabled and not self.stress.enabled:
            raise ValueError("the energy reserve needs the stress timeline")


def from_dict(values: dict[str, Any], kind: type = Config):
    """A config of nested plain values; unknown keys raise."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    out = {}
    for name, value in values.items():
        default = known[name].default_factory if callable(known[name].default_factory) else None
        out[name] = from_dict(value, default) if isinstance(default, type) and is_dataclass(default) else value
    return kind(**out)


# Fixed values of the model.
WEEK, YEAR = 7, 365
ACUTE_DAYS, CHRONIC_DAYS, CTL_TAU, ATL_TAU, CTL_LOOKBACK, CTL_REL = 7, 28, 42, 7, 28, 0.05
REST_WINDOW, REST_MIN, REST_DEFAULT, HR_MAX_DEFAULT, HR_MAX_LOW, HR_MAX_HIGH = 28, 7, 60.0, 190.0, 160.0, 210.0
BUCKET_MIN, GAP_CAP_MIN = 1.0, 10.0
NEUTRAL_DEFAULT, NEUTRAL_PCT, NEUTRAL_DAYS, NEUTRAL_ROWS, NEUTRAL_LOW, NEUTRAL_HIGH, WARM_UP_DAYS = 25.0, 0.4, 60, 1440, 5.0, 50.0, 7
