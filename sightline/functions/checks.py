"""Checks and clamps of parameters that come with a request, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(x: Column, low: float, high: float) -> Column:
    """x, or the nearer bound if it lies outside."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def range_error(t0: Column, t1: Column, budget: Column, at: Column, duration: Column) -> Column:
    """The first thing wrong with a request for frames between t0 and t1 or at one time, null if nothing is."""
    return F.when(t1 <= t0, "bad_range").when(budget <= 0, "no_budget").when(at > duration, "beyond_end")


def clamped_range(t0: Column, t1: Column, duration: Column) -> Column:
    """(t0, t1) of a request, with t1 no later than the recording's end."""
    return F.struct(t0.alias("t0"), F.least(t1, duration).alias("t1"))


def valid_report(summary: Column, actions: Column) -> Column:
    """Whether a report has a summary that is not blank and at least one action."""
    return (F.trim(F.coalesce(summary, F.lit(""))) != "") & (F.size(F.coalesce(actions, F.array().cast("array<string>"))) > 0)


def sampling_error(samples: Column, budget: Column, alpha: Column) -> Column:
    """The first thing wrong with a sampling configuration, null if nothing is: a recording without samples, no budget, or a
    uniform share that is no number from 0 to 1."""
    fits = F.coalesce(alpha.between(0.0, 1.0), F.lit(False))
    return F.when(F.coalesce(samples, F.lit(0)) <= 0, "empty_profile").when(F.coalesce(budget, F.lit(0)) <= 0, "no_budget").when(~fits, "bad_alpha")


def crop(x: Column, y: Column, w: Column, h: Column, least: float = 0.01) -> Column:
    """A crop within the unit square: corner in 0..1, sides from `least` to what is left; at the far edge `least` is kept."""

    def side(length: Column, corner: Column) -> Column:
        left = 1 - F.greatest(corner, F.lit(0.0))
        return F.when(left < least, F.lit(least)).otherwise(F.least(F.greatest(length, F.lit(least)), left))

    return F.struct(within(x, 0.0, 1.0).alias("x"), within(y, 0.0, 1.0).alias("y"), side(w, x).alias("w"), side(h, y).alias("h"))


def holds_all(text: Column, words: list[str]) -> Column:
    """Whether the text holds each of the words."""
    return F.forall(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def mentions(query: str, *columns: Column) -> Column:
    """Whether any of the columns holds the query, in whatever case; a blank query is held by all rows."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c.cast("string")).contains(wanted), F.lit(False))
    return out


def rational(text: Column) -> Column:
    """"a/b" as a number, null if it is none or b is 0."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.nullif(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)))


# The hosts that requests may come from.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]")


def origin_host(origin: Column, hosts: tuple[str, ...] = LOCAL_HOSTS) -> Column:
    """The host of an origin (scheme://host:port) if it is exactly one of the hosts, else null. A host in brackets goes up to
    the closing one, any other up to the first colon; nothing else is cut off, so a name that only ends or begins like one
    of the hosts is null."""
    at = F.instr(origin, "://")
    rest = F.substring(origin, at + 3, F.length(origin))
    closing = F.instr(rest, "]")
    host = F.when(closing > 0, F.substring(rest, F.lit(1), closing)).otherwise(F.substring_index(rest, ":", 1))
    return F.when((at > 0) & host.isin(*hosts), host)


def needs_transcode(codec: Column, target: str = "h264") -> Column:
    """Whether a recording has another codec than the target, an unknown one included."""
    return F.coalesce(F.lower(codec), F.lit("")) != target
