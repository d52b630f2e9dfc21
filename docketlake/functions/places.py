"""Places in location text: coordinates, states, counties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def joined_list(values: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(values, lambda x: x != ""), " ; "), F.lit(""))


def _coordinate(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, fixed.LAT_LON, group), F.lit("")).cast("double")


def latitude(text: Column) -> Column:
    return _coordinate(text, 1)


def longitude(text: Column) -> Column:
    return _coordinate(text, 2)


def states(text: Column) -> Column:
    """Sorted names of states, by abbreviation after a comma or blank and by full name."""
    short = F.create_map(*[F.lit(x) for name, code in fixed.STATES.items() for x in (code, name)])
    codes = F.regexp_extract_all(text, F.lit(fixed.STATE_CODE), F.lit(1))
    by_code = F.filter(F.transform(codes, lambda c: short[c]), lambda x: x.isNotNull())
    lowered = F.lower(text)
    # one test for all names lets most texts pass at once; each name's pattern is a constant
    any_name = lowered.rlike(r"\b(?:" + "|".join(fixed.STATES) + r")\b")
    each = F.array_compact(F.array(*[F.when(lowered.rlike(rf"\b{n}\b"), F.lit(n)) for n in fixed.STATES]))
    by_name = F.when(any_name, each).otherwise(F.array().cast("array<string>"))
    both = F.array_sort(F.array_distinct(F.transform(F.concat(by_code, by_name), lambda n: F.initcap(n))))
    return F.coalesce(both, F.array().cast("array<string>"))


def counties(text: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.COUNTY), F.lit(1))))
    return F.coalesce(found, F.array().cast("array<string>"))


def location_columns(text: Column) -> dict[str, Column]:
    where, lat, lon = states(text), latitude(text), longitude(text)
    return {
        "project_state": where,
        "project_county": counties(text),
        "project_lat": lat,
        "project_lon": lon,
        "project_location_needs_geocoding": lat.isNotNull() & lon.isNotNull() & (F.size(where) == 0),
    }
