"""The archive's metadata: tags, dates, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TAGS = ("_ftindex:yes", "_category:other")
LIMITS = {"title": 30, "description": 80, "long_description": 4000}


def tags(column: Column) -> Column:
    """The default tags and those of a ;-list, trimmed, distinct, sorted."""
    own = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";", -1), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, DEFAULT_TAGS)), own)))


def scraper(*parts: Column) -> Column:
    """The non-empty parts, joined by a comma and a blank."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def validate(title: str | None = None, description: str | None = None, long_description: str | None = None, tags: list[str] | None = None, languages: str | None = None) -> None:
    """Raises ValueError where a value is longer than its limit or isn't well-formed."""
    for name, value in (("title", title), ("description", description), ("long_description", long_description)):
        if value and len(value) > LIMITS[name]:
            raise ValueError(f"{name.replace('_', ' ').capitalize()} value is too long ({len(value)} > {LIMITS[name]})")
    if tags and any(";" in t for t in tags):
        raise ValueError("a tag holds a semicolon")
    if languages is not None:
        from archloom.functions.lang import code_of

        if not all(code_of(x) == x.strip() for x in languages.split(",")):
            raise ValueError(f"Language {languages!r} is no list of ISO 639-3 codes")
