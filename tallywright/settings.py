"""Run settings, passed explicitly to every plan (no global state)."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

DETAIL = "detail"
FS_LINE = "fs_line"

CURRENT = "CY"
PRIOR = "PY"
YEARS = (CURRENT, PRIOR)
MONTHS = tuple(range(1, 13))


@dataclass(frozen=True)
class Settings:
    """Materiality and analysis parameters of one review.

    ``pm`` is performance materiality and ``ctt`` the amount at or below which a
    change is clearly trivial. ``ratio_limit`` defaults to 0, so that every change
    above ``ctt`` is in scope; 0.2 gives the "20 % change" rule.
    """

    pm: Decimal | int
    ctt: Decimal | int
    ratio_limit: float = 0.0
    client_label: str = ""
    level: str = DETAIL
    z: float = 2.0
    balance_share: Decimal = Decimal("0.2")
    pm_share: Decimal = Decimal("0.5")
    contribution_limit: Decimal = Decimal("0.1")
    top_lines: int = 3

    def __post_init__(self) -> None:
        if self.level not in (DETAIL, FS_LINE):
            raise ValueError(f"level must be {DETAIL!r} or {FS_LINE!r}, not {self.level!r}")
        if self.top_lines < 1:
            raise ValueError("top_lines must be at least 1")
