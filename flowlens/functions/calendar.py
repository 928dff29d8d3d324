"""Cron calendars in local time: occurrences, daylight saving, and what to do with those that are late."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

GAP_SCAN_SECONDS = 86_400
KEY = "%Y-%m-%dT%H:%M:%S"
_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
_NAMES = {n: k + 1 for k, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())} | {n: k for k, n in enumerate("SUN MON TUE WED THU FRI SAT".split())}


@dataclass(frozen=True)
class Occurrence:
    local: str
    due_at: int
    disposition: str  # exact, gap or ambiguous_earlier


class Cron:
    """Six fields, seconds first: second, minute, hour, day of month, month, day of week (0 or 7: Sunday)."""

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) != 6:
            raise ValueError("a cron expression has six fields, seconds first")
        self.sets = [self._field(f, *r, week=k == 5) for k, (f, r) in enumerate(zip(fields, _RANGES, strict=True))]
        self.any_day, self.any_week = fields[3] in ("*", "?"), fields[5] in ("*", "?")

    @staticmethod
    def _field(text: str, lo: int, hi: int, week: bool) -> frozenset[int]:
        out: set[int] = set()
        number = lambda x: _NAMES[x.upper()] if x.upper() in _NAMES else int(x)
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span in ("*", "?"):
                a, b = lo, hi
            elif "-" in span:
                a, b = map(number, span.split("-"))
            else:
                a = number(span)
                b = hi if step else a
            if not (lo <= a <= b <= hi + week) or (step and int(step) < 1):
                raise ValueError(f"invalid cron field {text!r}")
            out.update(range(a, b + 1, int(step or 1)))
        return frozenset(x % 7 if week else x for x in out)

    def _day(self, d: datetime) -> bool:
        month_day, week_day = d.day in self.sets[3], (d.weekday() + 1) % 7 in self.sets[5]
        if self.any_day or self.any_week:
            return d.month in self.sets[4] and month_day and week_day
        return d.month in self.sets[4] and (month_day or week_day)

    def after(self, local: datetime) -> datetime | None:
        """The first matching local time behind ``local``, within some years."""
        t = local.replace(microsecond=0) + timedelta(seconds=1)
        for _ in range(366 * 9):
            if self._day(t):
                for h in sorted(x for x in self.sets[2] if x >= t.hour):
                    for m in sorted(x for x in self.sets[1] if h > t.hour or x >= t.minute):
                        for s in sorted(x for x in self.sets[0] if (h, m) > (t.hour, t.minute) or x >= t.second):
                            return t.replace(hour=h, minute=m, second=s)
            t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
        return None


def resolve(local: datetime, zone: str) -> Occurrence:
    """When a local time comes: the earlier of two instants, or the first valid second behind a gap."""
    tz, key = ZoneInfo(zone), local.strftime(KEY)
    ms = lambda t: int(t.timestamp()) * 1000
    exists = lambda t: t.replace(tzinfo=tz).astimezone(UTC).astimezone(tz).replace(tzinfo=None) == t
    if exists(local):
        early, late = (local.replace(tzinfo=tz, fold=f) for f in (0, 1))
        return Occurrence(key, ms(early), "ambiguous_earlier" if early.utcoffset() != late.utcoffset() else "exact")
    t = local
    for _ in range(GAP_SCAN_SECONDS):
        t += timedelta(seconds=1)
        if exists(t):
            return Occurrence(key, ms(t.replace(tzinfo=tz)), "gap")
    raise ValueError("no valid local time within a day")


def occurrences(cron: Cron, zone: str, after_local: datetime, until: int, most: int = 10_000) -> Iterator[Occurrence]:
    """Occurrences behind a local time that are due by ``until``, at most ``most``; the local time only rises."""
    t = after_local
    for _ in range(most):
        t = cron.after(t)
        if t is None or (o := resolve(t, zone)).due_at > until:
            return
        yield o


def next_after(cron: Cron, zone: str, now: int) -> Occurrence | None:
    """The first occurrence due behind ``now``; the second pass of a repeated hour doesn't count again."""
    t = datetime.fromtimestamp(now / 1000, ZoneInfo(zone)).replace(tzinfo=None, microsecond=0) - timedelta(seconds=1)
    while (t := cron.after(t)) is not None:
        if (o := resolve(t, zone)).due_at > now:
            return o
    return None
