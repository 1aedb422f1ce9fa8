"""Free-form dates as a fold over tokens: numbers, names of months and weekdays, separators.

The text is repaired as dates are (letters that OCR takes for digits become digits), then cut into runs of digits, runs of
letters and single characters. A state, the numbers met so far and which of them is known to be the year or the month, is
carried over the tokens; what is not known is settled at the end, month first and, where that is no date, day first.
Missing parts come from ``as_of``, as does the century of two-digit years: at most 49 years ahead of it, 50 behind.

Cases. Null, blank, and texts with a word or sign that has no place in a date are null, as are more than three numbers,
days that a month doesn't have, and times but bare hours behind a whole date. Clock times, ``of`` before a year and numbers
with a comma inside are not read. A weekday without a day is the next such day.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.normalize import repair_date_text

# Names of months and weekdays, and words that may stand in a date.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
JUMPS = (" ", ".", ",", ";", "-", "/", "'", "at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")

MONTHS = {x: i for i, name in enumerate(MONTH_NAMES, 1) for x in (name, name[:3])} | {"sept": 9}
WEEKDAYS = {x: i for i, name in enumerate(WEEKDAY_NAMES) for x in (name, name[:3])}
STATE = "struct<parts:array<int>,year_at:int,month_at:int,century:boolean,weekday:int,timed:boolean,bad:boolean,skip:int>"


def _table(d: dict[str, int]) -> Column:
    return F.from_json(F.lit(json.dumps(d)), "map<string,int>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(c: Column) -> Column:
    """struct(low, digits, number, month, weekday, jump, at) for each token."""
    text = repair_date_text(c)
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[a-z]+|.)"), F.lit(1))

    def read(t: Column, i: Column) -> Column:
        one = F.when(t.rlike(r"^\s$"), " ").otherwise(t)
        digits = F.when(t.rlike("^[0-9]{1,8}$"), F.length(t)).otherwise(0)
        return F.struct(one.alias("low"), digits.alias("digits"), F.when(digits > 0, t.try_cast("int")).alias("number"), _table(MONTHS)[t].alias("month"), _table(WEEKDAYS)[t].alias("weekday"), one.isin(*JUMPS).alias("jump"), i.alias("at"))

    return F.transform(raw, read)


def _append(state: Column, number: Column, *, year: Column, month: bool = False) -> Column:
    """The state with one more number; ``year``: it can't be anything else. Twice a year or a month is bad."""
    at = F.size(state["parts"])
    twice = (year & state["year_at"].isNotNull()) if not month else state["month_at"].isNotNull()
    return _changed(
        state,
        parts=F.array_append(state["parts"], number),
        year_at=state["year_at"] if month else F.coalesce(state["year_at"], F.when(year, at)),
        month_at=F.coalesce(state["month_at"], at) if month else state["month_at"],
        century=state["century"] if month else state["century"] | year,
        bad=state["bad"] | F.coalesce(twice, F.lit(False)) | number.isNull(),
    )


def _changed(state: Column, **values: Column) -> Column:
    names = ("parts", "year_at", "month_at", "century", "weekday", "timed", "bad", "skip")
    return F.struct(*[values.get(n, state[n]).alias(n) for n in names]).cast(STATE)


def _member(state: Column, t: Column) -> Column:
    """A token behind a separator: a number, of more than two digits a year, or a month's name."""
    return F.when(t["month"].isNotNull(), _append(state, t["month"], year=F.lit(False), month=True)).otherwise(_append(state, t["number"], year=t["digits"] > 2))


def _step(state: Column, t: Column, all_: Column) -> Column:
    behind = lambda n: F.get(all_, t["at"] + n)
    low = lambda n: F.coalesce(behind(n)["low"], F.lit(""))
    n, size = t["number"], F.size(state["parts"])
    text = F.lpad(n.cast("string"), t["digits"], F.lit("0"))
    part = lambda a, k: F.substring(text, a, k).try_cast("int")
    go = lambda s, to: _changed(s, skip=t["at"] + to)
    hour = lambda h, m: _changed(state, timed=F.lit(True), bad=state["bad"] | (h > 23) | (m > 59))
    separated = low(1).isin("-", "/")
    third = lambda first: (low(first + 1) == low(1)) & (low(first + 1) != "")

    def members(start: Column) -> Column:
        """What follows a first number and its separator."""
        one = _let(start, lambda s: _member(s, behind(2)))
        two = _let(one, lambda s: _member(s, behind(4)))
        return F.when(behind(2).isNull() | behind(2)["jump"], go(start, 2)).when(third(2), go(two, 5)).otherwise(go(one, 3))

    def named(start: Column) -> Column:
        """What follows a month's name and its separator: numbers only."""
        one = _let(start, lambda s: _append(s, behind(2)["number"], year=behind(2)["digits"] > 2))
        two = _let(one, lambda s: _append(s, behind(4)["number"], year=behind(4)["digits"] > 2))
        return F.when(third(2), go(two, 5)).otherwise(go(one, 3))

    plain = _append(state, n, year=n > 100)
    six = _let(_let(_append(state, part(1, 2), year=F.lit(False)), lambda s: _append(s, part(3, 2), year=F.lit(False))), lambda s: _append(s, part(5, 2), year=F.lit(False)))
    eight = _let(_let(_append(state, part(1, 4), year=F.lit(True)), lambda s: _append(s, part(5, 2), year=F.lit(False))), lambda s: _append(s, part(7, 2), year=F.lit(False)))
    month = F.get(state["parts"], state["month_at"])
    most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    bad = _changed(state, bad=F.lit(True))
    number = (
        F.when((size == 3) & t["digits"].isin(2, 4) & ~state["timed"] & low(1).isin("", " "), F.when(t["digits"] == 2, hour(n, F.lit(0))).otherwise(hour(part(1, 2), part(3, 2))))
        .when(t["digits"] == 6, F.when(size == 0, six).otherwise(_changed(hour(part(1, 2), part(3, 2)), bad=state["bad"] | state["timed"] | (part(1, 2) > 23) | (part(3, 2) > 59) | (part(5, 2) > 59))))
        .when(t["digits"] == 8, eight)
        .when(separated, members(_append(state, n, year=t["digits"] > 2)))
        .when((low(1) == "") | F.coalesce(behind(1)["jump"], F.lit(False)), go(plain, 2))
        .when((n >= 1) & (n <= most), plain)
        .otherwise(bad)
    )
    return (
        F.when(state["bad"] | (t["at"] < state["skip"]), state)
        .when(n.isNotNull(), number)
        .when(t["weekday"].isNotNull(), _changed(state, weekday=t["weekday"]))
        .when(t["month"].isNotNull(), _let(_append(state, t["month"], year=F.lit(False), month=True), lambda s: F.when(separated, named(s)).otherwise(s)))
        .when(t["jump"], state)
        .otherwise(bad)
    )


def _settle(state: Column, day_first: bool) -> Column:
    """struct(y, m, d) of the numbers; those not given are null."""
    p, y_at, m_at = state["parts"], state["year_at"], state["month_at"]
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    none = F.lit(None).cast("int")
    of = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    first = F.lit(day_first)
    size = F.size(p)
    other = F.when(m_at == 0, F.coalesce(b, a)).otherwise(a)
    rest = F.get(p, 3 - y_at - m_at)
    one = F.when(m_at.isNotNull() & (size == 1), of(none, a, none)).when(other > 31, of(other, F.get(p, m_at), none)).otherwise(of(none, F.get(p, m_at), other))
    two = F.when(a > 31, of(a, b, none)).when(b > 31, of(b, a, none)).when(first & (b <= 12), of(none, b, a)).otherwise(of(none, a, b))
    three = (
        F.when(y_at.isNotNull() & m_at.isNotNull(), of(F.get(p, y_at), F.get(p, m_at), rest))
        .when(m_at == 0, F.when(b > 31, of(b, a, c)).otherwise(of(c, a, b)))
        .when(m_at == 1, F.when((a > 31) | (c <= 31), of(a, b, c)).otherwise(of(c, b, a)))
        .when(m_at == 2, F.when(b > 31, of(b, c, a)).otherwise(of(a, c, b)))
        .when((a > 31) | F.coalesce(y_at == 0, F.lit(False)) | ((b <= 12) & (c <= 31)), F.when(first & (c <= 12), of(a, c, b)).otherwise(of(a, b, c)))
        .when((a > 12) | (first & (b <= 12)), of(c, b, a))
        .otherwise(of(c, a, b))
    )
    both = (size == 2) & y_at.isNotNull() & m_at.isNotNull()
    only_year = (size == 1) & y_at.isNotNull()
    return F.when(both, of(F.get(p, y_at), F.get(p, m_at), none)).when(only_year, of(a, none, none)).when((size == 1) | ((size == 2) & m_at.isNotNull()), one).when(size == 2, two).when(size == 3, three)


def _date(state: Column, ymd: Column, as_of: datetime.date) -> Column:
    """The date of what was settled, or null."""
    base = as_of.year - as_of.year % 100
    wide = ymd["y"] + base
    year = F.coalesce(F.when(state["century"] | (ymd["y"] >= 100), ymd["y"]).when(wide >= as_of.year + 50, wide - 100).when(wide < as_of.year - 50, wide + 100).otherwise(wide), F.lit(as_of.year))
    month = F.coalesce(ymd["m"], F.lit(as_of.month))
    at = lambda d: F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    last = F.day(F.last_day(at(F.lit(1))))
    found = F.when((year >= 1) & (year <= 9999) & month.between(1, 12) & (ymd["d"].isNull() | ymd["d"].between(1, 31)), at(F.coalesce(ymd["d"], F.least(F.lit(as_of.day), last))))
    weekday = F.pmod(state["weekday"] - F.weekday(found), F.lit(7))
    return F.when(ymd["d"].isNull() & state["weekday"].isNotNull(), F.date_add(found, weekday)).otherwise(found)


def free_date(c: Column, as_of: datetime.date) -> Column:
    """ISO date of a text in any order of day, month and year, or null."""

    def whole(all_: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("parts"), F.lit(None).cast("int").alias("year_at"), F.lit(None).cast("int").alias("month_at"), F.lit(False).alias("century"), F.lit(None).cast("int").alias("weekday"), F.lit(False).alias("timed"), F.lit(False).alias("bad"), F.lit(0).alias("skip")).cast(STATE)
        return F.aggregate(all_, start, lambda s, t: _step(s, t, all_))

    def settled(s: Column) -> Column:
        # A weekday alone is a date.
        nothing = F.struct(*[F.lit(None).cast("int").alias(k) for k in ("y", "m", "d")])
        ways = [_let(F.when(F.size(s["parts"]) == 0, nothing).otherwise(_settle(s, f)), lambda ymd: _date(s, ymd, as_of)) for f in (False, True)]
        empty = (F.size(s["parts"]) == 0) & s["weekday"].isNull()
        return F.when(~s["bad"] & ~empty & (F.size(s["parts"]) <= 3), F.coalesce(*ways))

    usable = F.when(c.isNotNull() & (F.trim(c) != "") & ~repair_date_text(c).rlike(r"[0-9],[0-9]|(?i)\bof\s+[0-9]"), c)
    return F.date_format(_let(_let(_tokens(usable), whole), settled), "yyyy-MM-dd")
