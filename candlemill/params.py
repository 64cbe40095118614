"""Typed parameters of the screen and of the trade evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

THINNING_RULES = ("1.1", "1.2")


@dataclass(frozen=True)
class ScreenParams:
    """Conditions of the breakout screen. Rates and amplitudes are in percent, caps in 1e8 currency units."""

    earliest: datetime = datetime(2025, 6, 1)
    history_bars: int = 40
    main_amplitude: float = 25.0
    growth_amplitude: float = 35.0
    gain: float = 0.05
    require_gain: bool = False
    min_cap: float = 30.0
    max_cap: float = 500.0
    profit_growth: float = -20.0
    revenue_growth: float = -20.0
    require_growth: bool = False
    thinning: str = "1.1"
    range_days: int = 5

    def __post_init__(self) -> None:
        if self.history_bars < 1:
            raise ValueError("history_bars must be at least 1")
        if self.min_cap > self.max_cap:
            raise ValueError("min_cap exceeds max_cap")
        if self.thinning not in THINNING_RULES:
            raise ValueError(f"thinning must be one of {THINNING_RULES}")
        if self.range_days < 0:
            raise ValueError("range_days must not be negative")

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> ScreenParams:
        """Build from the text settings, rejecting switches other than yes and no.

        Fixed values: the names of the settings, their defaults and the form of `cond1_and_cond3`.
        """
        defaults = cls()
        bars, main, growth = settings.get("cond1_and_cond3", "40_25_35").split("_")
        return cls(
            earliest=_moment(settings.get("earliest_time_limit"), defaults.earliest),
            history_bars=int(bars),
            main_amplitude=float(main),
            growth_amplitude=float(growth),
            gain=float(settings.get("cond2", defaults.gain)),
            require_gain=_switch(settings, "apply_cond2_or_not"),
            min_cap=float(settings.get("min_market_capitalization", defaults.min_cap)),
            max_cap=float(settings.get("max_market_capitalization", defaults.max_cap)),
            profit_growth=float(settings.get("net_profit_growth_rate", defaults.profit_growth)),
            revenue_growth=float(settings.get("total_revenue_growth_rate", defaults.revenue_growth)),
            require_growth=_switch(settings, "apply_cond5_or_not"),
            thinning=settings.get("use_cond_1_1_or_cond_1_2", defaults.thinning),
            range_days=int(settings.get("range_days_of_cond_1_2", defaults.range_days)),
        )

    @property
    def first_trade_date(self) -> date:
        return self.earliest.date()

    @property
    def first_report_date(self) -> date:
        """First report date whose midnight is not before the bound."""
        day = self.earliest.date()
        return day if self.earliest.time() == time() else day + timedelta(days=1)


@dataclass(frozen=True)
class TradeParams:
    """Sizing, holding and dip settings."""

    initial_cash: float = 100_000.0
    max_holding_days: int = 40
    support_tolerance: float = 0.995
    window_holding_days: int | None = 40

    def __post_init__(self) -> None:
        if self.initial_cash <= 0 or self.max_holding_days < 1:
            raise ValueError("initial_cash and max_holding_days must be positive")

    @property
    def days_limit(self) -> int:
        """Length of a support window in calendar days."""
        return 41 if self.window_holding_days is None else self.window_holding_days + 1


def _switch(settings: dict[str, str], key: str) -> bool:
    value = settings.get(key, "no")
    if value not in ("yes", "no"):
        raise ValueError(f"{key} must be yes or no, got {value!r}")
    return value == "yes"


def _moment(text: str | None, default: datetime) -> datetime:
    return default if text is None else datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
