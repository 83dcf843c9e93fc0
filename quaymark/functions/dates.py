"""Date words of a question's arguments: a day, a month or a year, as the begin or the end of what it names."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

# Fixed formats. Month names are cut to three letters before they are read.
DAYS = ("%Y-%m-%d", "%d %b %Y", "%b %d %Y", "%Y/%m/%d", "%d/%m/%Y")
MONTHS = ("%Y-%m", "%b %Y")


def _read(text: str, formats: tuple[str, ...]) -> date | None:
    for form in formats:
        try:
            return datetime.strptime(text, form).date()
        except ValueError:
            continue
    return None


def bound(raw: str | date, upper: bool = False) -> date:
    """The first day (or, upper, the last) of the day, month or year that raw names; ValueError if it names none."""
    if isinstance(raw, date):
        return raw.date() if isinstance(raw, datetime) else raw
    text = re.sub(r"[A-Za-z]{3,9}", lambda m: m[0][:3], re.sub(r"[.,]", " ", str(raw)))
    text = " ".join(text.split())
    if re.fullmatch(r"\d{8}", text):
        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
    if day := _read(text, DAYS):
        return day
    if month := _read(text, MONTHS):
        return (month + timedelta(days=31)).replace(day=1) - timedelta(days=1) if upper else month
    if re.fullmatch(r"\d{4}", text) and text != "0000":
        return date(int(text), 12, 31) if upper else date(int(text), 1, 1)
    raise ValueError(f"{raw!r} is no date; write 2019-06-05, 5 Jun 2019, 2019-06, Jun 2019 or 2019")


def window(start: str | date | None, end: str | date | None) -> tuple[date | None, date | None]:
    """Both ends of a closed window, each widened to the period that it names; a bound that is missing doesn't bind."""
    low, high = (None if start is None else bound(start)), (None if end is None else bound(end, upper=True))
    if low and high and low > high:
        raise ValueError(f"the window begins at {start}, after its end {end}")
    return low, high
