"""Column functions: numbers, times, text repair, redaction, JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """"$1,234.5", "1.2K", "-3M", "5%", "N/A" as double; percent signs are dropped."""
    text = F.upper(F.trim(c))
    bare = F.regexp_replace(text, r"[R$,+%\s]", "")
    factor = F.when(bare.endswith("K"), 1e3).when(bare.endswith("M"), 1e6).when(bare.endswith("B"), 1e9).otherwise(1.0)
    return F.regexp_replace(bare, "[KMB]$", "").try_cast("double") * factor


def to_epoch_ms(c: Column) -> Column:
    """Seconds, milliseconds or ISO text as epoch milliseconds."""
    number = c.try_cast("double")
    ms = F.when(number >= 1e11, number).otherwise(number * 1000).cast("bigint")
    return F.coalesce(ms, F.unix_millis(F.try_to_timestamp(c)))


def iso_in(ms: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd'T'HH:mm:ss")


def compact_number(c: Column, digits: int = 1) -> Column:
    """1234 as 1.2K, 3400000 as 3.4M."""
    size = F.abs(c)
    show = lambda factor, sign: F.concat(F.format_string(f"%.{digits}f", F.round(c / factor + 1.7e-10, digits)), F.lit(sign))
    return F.when(size >= 1e9, show(1e9, "B")).when(size >= 1e6, show(1e6, "M")).when(size >= 1e3, show(1e3, "K")).otherwise(show(1.0, ""))


#: Text all of whose characters are UTF-8 read as Latin-1, with at least one sequence of several bytes.
_MISREAD = "^(?=[^\u0080-ÿ]*[Â-ô])(?:[\u0000-\u007f]|[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3})*+$"


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, decoded again. Text that is not wholly so, with characters that
    Latin-1 cannot hold or sequences that UTF-8 does not know, stays as it is."""
    return F.when(c.rlike(_MISREAD), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def redact(c: Column) -> Column:
    """Keys, tokens, e-mail addresses and long digit runs replaced by marks."""
    out = F.regexp_replace(c, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)(\"[^\"]*\"|\S+)", "$1$2***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.regexp_replace(out, r"[0-9]{13,19}", "<number>")


def json_double(c: str, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles have it: by 0 infinite, or NaN where a is 0 or NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ratio01(c: Column) -> Column:
    """A share given as 0-1 or 0-100 as 0-1."""
    return F.when(F.abs(c) > 1, c / 100).otherwise(c)


def percent100(c: Column) -> Column:
    """A share given as 0-1 or 0-100 as 0-100."""
    return F.when(F.abs(c) <= 1, c * 100).otherwise(c)


def half_up(c: Column, digits: int) -> Column:
    """Rounded away from zero at the half, exactly, in decimals."""
    return F.round(c.cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})")


def triplet_ok(ms: Column, utc: Column, other: Column, seconds: float = 2.0) -> Column:
    """Whether two times with their offsets name the same moment as an epoch, up to ``seconds``."""
    same = lambda c: F.coalesce(F.abs(F.unix_millis(F.try_to_timestamp(c)) - ms) <= seconds * 1000, F.lit(False))
    return same(utc) & same(other)


def shown_percent(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(c + 1.7e-10, digits)), F.lit("%"))


#: A brace, or a string in JSON with its closing quote, if it has one.
_JSON_PART = re.compile(r'[{}]|"(?:[^"\\]|\\.)*+("?)', re.S)


def _objects(text: str, at: int) -> tuple[tuple[int, int] | None, int | None, int | None]:
    """The first object from ``at`` on (begin, end); where a string without end stopped the search, else None; and the first brace
    inside a string that was passed."""
    opened, best, inner = [], None, None
    while found := _JSON_PART.search(text, at):
        at, sign = found.end(), found[0][0]
        if sign == "{":
            opened.append(found.start())
        elif sign == "}" and opened:
            start = opened.pop()
            if best is None or start < best[0]:
                best = (start, at)
            if not opened:
                return best, None, inner
        elif sign == '"' and not opened:
            at = found.start() + 1  # a quote in prose
        elif sign == '"' and not found[1]:
            return best, found.start() + 1, inner
        elif sign == '"' and inner is None and "{" in found[0]:
            inner = found.start() + found[0].index("{")
    return best, None, inner


def first_object(text: str) -> str | None:
    """The first JSON object in a text, at whatever depth it ends: braces in its strings do not count, quotes outside of
    objects neither. Of an object that never ends, the first one inside it that does.

    A string without end is taken for a stray quote: the search is done again with the quotes paired the other
    way, then behind the last quote, so a text is gone through three times at most."""
    best, stop, inner = _objects(text, 0)
    for start in (inner, stop) if stop is not None else ():
        if start is not None:
            found = _objects(text, start)[0]
            best = found if best is None or (found is not None and found[0] < best[0]) else best
    return None if best is None else text[best[0] : best[1]]


def json_object(c: Column) -> Column:
    """The first JSON object in a text that may hold thoughts, fences and other words; null without one."""
    bare = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first_object, na_action="ignore")

    return scan(bare)


def json_truncated(c: Column) -> Column:
    """Whether a text begins an object that it does not end."""
    return c.contains("{") & json_object(c).isNull()


def canonical_hash(names: list[str]) -> Column:
    """SHA-256 of the fields as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)
