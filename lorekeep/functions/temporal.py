"""Dates named in a text, as a range, and the kernel of a date's distance to it.

A text is read once into tokens of a few kinds (ISO day, day number, month, year, season, linking word); the kinds, a letter each, are
one string, in which a small table of sequences is looked for, the most specific first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The month that a season of three begins in; winter runs into the next year.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}
LINKS = ("in", "during", "since", "year")
FIRST_YEAR, LAST_YEAR = 1900, 2100
_TOKEN = r"\d{4}-\d{2}-\d{2}(?!\d)|\d+(?:st|nd|rd|th)?(?![a-z])|[a-z]+|[^\s,.a-z]"
#: Letters of the kinds: i ISO day, d day number, m month, y year, s season, o the word "of", p another linking word, x anything else.
_SEQUENCES = ("i", "do?my", "mdy", "mo?y", "so?y", "[po]y")


def _kind(token: Column) -> Column:
    month = F.exists(F.array(*map(F.lit, MONTHS)), lambda m: m.startswith(token))
    return (
        F.when(token.rlike(r"^\d{4}-"), "i").when(token.rlike(r"^\d{4}$"), "y").when(token.rlike(r"^\d{1,2}(st|nd|rd|th)?$"), "d")
        .when((F.length(token) >= 3) & month, "m").when(token.isin(*SEASONS), "s").when(token == "of", "o").when(token.isin(*LINKS), "p").otherwise("x")
    )


def _until(start: Column, end: Column) -> Column:
    """From midnight of a day up to the last millisecond before another."""
    return F.struct(start.cast("timestamp").alias("from"), (end.cast("timestamp") - F.expr("interval 0.001 second")).alias("to"))


def date_range(text: Column) -> Column:
    """struct(from, to) of the most specific date that a text names, else null: a day (ISO, or with a month's name), a month, a
    season or a year after a linking word (1900 to 2100). A day that doesn't exist is null."""

    def read(tokens: Column) -> Column:
        kinds = F.array_join(F.transform(tokens, _kind), "")
        out = F.lit(None)
        for sequence in reversed(_SEQUENCES):
            at, found = F.regexp_instr(kinds, F.lit(sequence)), F.regexp_extract(kinds, sequence, 0)
            part = lambda kind, at=at, found=found: F.try_element_at(tokens, F.when(F.locate(kind, found) > 0, at + F.locate(kind, found) - 1))
            year = part("y").cast("int")
            if sequence == "i":
                day = F.try_to_date(part("i"), "yyyy-MM-dd")
                value = _until(day, F.date_add(day, 1))
            else:
                month = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: m.startswith(part("m"))), True).cast("int")
                season = F.element_at(F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv]), part("s"))
                number = F.regexp_extract(part("d"), r"^\d+", 0)
                day = F.try_to_date(F.concat_ws("-", part("y"), month.cast("string"), number), "y-M-d")
                first = F.make_date(year, F.lit(1), F.lit(1))
                later = lambda n: F.add_months(first, n)
                value = {
                    "do?my": _until(day, F.date_add(day, 1)), "mdy": _until(day, F.date_add(day, 1)), "mo?y": _until(later(month - 1), later(month)),
                    "so?y": _until(later(season - 1), later(season + 2)), "[po]y": F.when(year.between(FIRST_YEAR, LAST_YEAR), _until(first, later(F.lit(12)))),
                }[sequence]
            out = F.when(at > 0, value).otherwise(out)
        return out

    tokens = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)
    return F.element_at(F.transform(F.array(tokens), read), 1)  # the tokens are bound once


def event_date(value: Column) -> Column:
    """YYYY, YYYY-MM or an ISO date or time as a timestamp; null for anything else."""
    padded = F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01"))).when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01"))).otherwise(value)
    return F.try_to_timestamp(padded)


def kernel(date: Column, start: Column, end: Column, tau_days: float) -> Column:
    """1 inside the range, exp(-days / tau) outside."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.exp(-F.greatest(F.lit(0), ms(start) - ms(date), ms(date) - ms(end)) / 86_400_000.0 / tau_days)
