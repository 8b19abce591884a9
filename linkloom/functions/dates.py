"""Dates as epoch milliseconds: parsing, the range grammar and formatting."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENT_MS = 1_209_600_000  # two weeks
DAY_MS = 86_400_000
RANGE_HELP = "A time range is one of: recent, after-DATE, before-DATE, between-DATE-and-DATE"
_DAY = r"^\d{1,2} [A-Z][a-z]{2} \d{4}"
_MONTH = r"^[A-Z][a-z]{%s} \d{1,2}, \d{4}"
#: shapes of date texts beyond ISO, with their patterns
_FORMS = (
    (_DAY + r" \d{2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy HH:mm:ss xx"),
    (_DAY + r" \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
    (_DAY + "$", "d MMM yyyy"),
    (_MONTH % "2" + "$", "MMM d, yyyy"),
    (_MONTH % "2,8" + "$", "MMMM d, yyyy"),
    (_MONTH % "2,8" + r" \d{2}:\d{2}:\d{2}$", "MMMM d, yyyy HH:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ms(col: Column | str) -> Column:
    """Epoch milliseconds of a timestamp column (UTC session)."""
    return F.unix_millis(_c(col).cast("timestamp"))


def parse_date_ms(col: Column | str) -> Column:
    """Digits pass through; ISO, mail and written dates are read, as UTC without a zone; anything else is NULL."""
    text = F.trim(_c(col))
    # "Wed, 01 May 2024 10:00:00 GMT": the day's name adds nothing, names of UTC become an offset
    plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", ""), r"\s+(GMT|UTC?|Z)$", " +0000")
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(F.when(plain.rlike(shape), plain), F.lit(form)) for shape, form in _FORMS]
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).otherwise(F.unix_millis(F.coalesce(*tries)))


def format_date(col: Column | str, style: str = "iso8601") -> Column:
    """rfc822, iso8601 or unix text of an epoch-millisecond column."""
    when = F.timestamp_millis(_c(col))
    if style == "rfc822":
        return F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    if style == "unix":
        return _c(col).cast("string")
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- driver side, for the few values of a query ----------------------------------


@dataclass(frozen=True)
class DateRange:
    """Inclusive bounds in epoch milliseconds."""

    after: int | None = None
    before: int | None = None

    def __bool__(self) -> bool:
        return self.after is not None or self.before is not None

    def holds(self, col: Column) -> Column:
        test = F.lit(True)
        if self.after is not None:
            test = test & (col >= F.lit(self.after))
        if self.before is not None:
            test = test & (col <= F.lit(self.before))
        return test

    def as_dict(self) -> dict[str, int]:
        pairs = {"after": self.after, "before": self.before}
        return {k: v for k, v in pairs.items() if v is not None}


def date_to_ms(text: str) -> int:
    if re.fullmatch(r"\d+", text):
        return int(text)
    day = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})", text)
    try:
        if day:
            found = datetime(*(int(g) for g in day.groups()))
        else:
            found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"Invalid date: {text}") from None
    if found.tzinfo is None:
        found = found.replace(tzinfo=timezone.utc)
    return int(found.timestamp() * 1000)


def parse_range(text: str | None, now_ms: int | None = None) -> DateRange:
    """recent | after-D | before-D | between-D-and-D."""
    if not text:
        return DateRange()
    if text == "recent":
        if now_ms is None:
            now_ms = int(datetime.now(timezone.utc).timestamp() * 1000)
        return DateRange(after=now_ms - RECENT_MS)
    command, dash, rest = text.partition("-")
    if not dash:
        raise ValueError(RANGE_HELP)
    try:
        if command == "after":
            return DateRange(after=date_to_ms(rest))
        if command == "before":
            return DateRange(before=date_to_ms(rest))
        if command == "between":
            start, _, end = rest.partition("-and-")
            if start and end:
                return DateRange(date_to_ms(start), date_to_ms(end))
    except ValueError:
        pass
    raise ValueError(RANGE_HELP)


def exact_range_text(bounds: DateRange | None) -> str:
    """The inverse of parse_range: days where the bounds are days, else milliseconds."""
    if not bounds:
        return ""
    given = [b for b in (bounds.after, bounds.before) if b is not None]
    if all(b % DAY_MS == 0 for b in given):
        return range_text(bounds)
    if len(given) == 2:
        return f"between-{bounds.after}-and-{bounds.before}"
    return f"after-{bounds.after}" if bounds.after is not None else f"before-{bounds.before}"


def range_text(bounds: DateRange | None) -> str:
    """The inverse of parse_range, at day precision."""
    if not bounds:
        return ""

    def day(value: int) -> str:
        return datetime.fromtimestamp(value / 1000, timezone.utc).date().isoformat()

    if bounds.after is not None and bounds.before is not None:
        return f"between-{day(bounds.after)}-and-{day(bounds.before)}"
    if bounds.after is not None:
        return f"after-{day(bounds.after)}"
    return f"before-{day(bounds.before)}"
