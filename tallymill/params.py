"""Plain parameters of the reports: date ranges, code lists, calendar bounds."""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class DateRange:
    """Inclusive range of days."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("end date must be on or after start date")

    @classmethod
    def of(cls, start: str, end: str) -> DateRange:
        return cls(date.fromisoformat(start), date.fromisoformat(end))

    @classmethod
    def month_to_date(cls, today: date | None = None) -> DateRange:
        """First of this month up to today; the day is read at each call."""
        today = today or date.today()
        return cls(today.replace(day=1), today)

    @classmethod
    def previous_month_to_date(cls, today: date | None = None) -> DateRange:
        """The same days one month earlier, the last day clamped to that month's end."""
        today = today or date.today()
        end_of_previous = today.replace(day=1) - timedelta(days=1)
        return cls(
            end_of_previous.replace(day=1),
            end_of_previous.replace(day=min(today.day, end_of_previous.day)),
        )

    @classmethod
    def months(cls, year: int, first: int = 1, last: int = 12) -> DateRange:
        """All days from month `first` to month `last` of one year."""
        return cls(date(year, first, 1), month_end(date(year, last, 1)))


def month_end(day: date) -> date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])


def rest_of_month(day: date) -> DateRange | None:
    """The days after `day` in its month; None on the last day of a month."""
    last = month_end(day)
    return None if day == last else DateRange(day + timedelta(days=1), last)


def code_list(value: str | Iterable[str] | None) -> list[str] | None:
    """Codes from a comma-joined text, a list, or a list of comma-joined texts.

    Blanks around and between codes are dropped. No code at all means no filter: None.
    """
    if value is None:
        return None
    texts = [value] if isinstance(value, str) else list(value)
    codes = [code.strip() for text in texts for code in text.split(",") if code.strip()]
    return codes or None


def number_list(value: int | str | Sequence[int]) -> list[int]:
    """Integers from one number, a comma-joined text or a list."""
    if isinstance(value, int):
        return [value]
    if isinstance(value, str):
        return [int(part) for part in value.split(",")]
    return [int(part) for part in value]
