"""News texts as numbers. Texts are searched in lower case; a null or blank text is no news."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import fixed


def _any(text: Column, patterns: list[str]) -> Column:
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))


def _blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^\s*$")


def availability(text: Column) -> Column:
    return F.when(_blank(text), 1.0).when(_any(text, fixed.UNAVAILABLE), 0.0).when(_any(text, fixed.DOUBTFUL), 0.5).when(_any(text, fixed.POSITIVE), 0.9).otherwise(1.0)


def minutes_risk(text: Column) -> Column:
    return F.when(_blank(text), 0.0).when(_any(text, fixed.ROTATION), 0.7).when(_any(text, fixed.DOUBTFUL), 0.3).otherwise(0.0)


def confidence(text: Column) -> Column:
    return F.when(_blank(text), 1.0).when(_any(text, fixed.SURE), 0.9).when(_any(text, fixed.LIKELY), 0.7).when(_any(text, fixed.UNSURE), 0.4).otherwise(0.6)


def adjustment(text: Column) -> Column:
    return availability(text) * (1 - minutes_risk(text))


def category(avail: Column, risk: Column, limits: dict[str, float] | None = None) -> Column:
    at = fixed.NEWS_LIMITS | (limits or {})
    return F.when(avail <= at["unavailable"], "unavailable").when(avail <= at["doubtful"], "doubtful").when(risk >= at["rotation_risk"], "rotation").when((avail >= at["positive_least"]) & (avail < at["positive_below"]) & (risk <= at["positive_risk"]), "positive").otherwise("neutral")


def snapshot_text(text: Column, status: Column, chance: Column) -> Column:
    """A snapshot as one text: the news, the status unless the text names it, the chance of playing below one."""
    said = F.nullif(F.trim(text), F.lit(""))
    words = F.create_map(*[F.lit(x) for pair in fixed.STATUS_WORDS.items() for x in pair])
    word = F.try_element_at(words, status)
    named = F.coalesce(F.lower(said).contains(word), F.lit(False))
    return F.concat_ws(". ", said, F.when(word.isNotNull() & ~named, F.concat(F.lit("Status: "), word)), F.when(chance < 1, F.concat((chance * 100).cast("int").cast("string"), F.lit("% chance of playing"))))


def strict_availability(text: Column, status: Column) -> Column:
    """As ``availability``, with a status of injured, suspended, unavailable or not in squad counting as out and doubtful as half."""
    return F.when(status.isin("i", "s", "u", "n"), 0.0).when(status == "d", F.least(F.lit(0.5), availability(text))).otherwise(availability(text))


def state_boost(kind: Column, sure: Column) -> Column:
    """Factors on the way into each state for a category of news, or null for none."""
    out = F.lit(None).cast("array<double>")
    for name, factors in fixed.STATE_BOOST.items():
        out = F.when(kind == name, F.array(*[1 + sure * (f - 1) for f in factors])).otherwise(out)
    return out


def process_shock(kind: Column) -> Column:
    """Factor on the process noise for a category of news, or null for none."""
    out = F.lit(None).cast("double")
    for name, factor in fixed.PROCESS_SHOCK.items():
        out = F.when(kind == name, F.lit(factor)).otherwise(out)
    return out
