"""Tag-set classification: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .matches import strip


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Substring test of lowered text against literal terms; null is false."""
    return any_of([F.coalesce(F.contains(F.lower(text), F.lit(t)), F.lit(False)) for t in terms])


def tag_set(tags: Column) -> Column:
    """Distinct trimmed lower-case tags; null gives the empty set."""
    clean = F.transform(F.filter(tags, lambda x: x.isNotNull()), lambda x: F.lower(strip(x)))
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))


def energy_type(s: Column) -> Column:
    return F.when(F.arrays_overlap(s, words(fixed.FOSSIL)), "Fossil").when(F.arrays_overlap(s, words(fixed.CLEAN)), "Clean").otherwise("Other")


def utilities_broadband_only(s: Column) -> Column:
    return F.array_contains(s, fixed.UTILITIES) & F.array_contains(s, fixed.BROADBAND) & (F.size(s) == 2)


def energy_questions(s: Column) -> Column:
    both = F.arrays_overlap(s, words(fixed.FOSSIL)) & F.arrays_overlap(s, words(fixed.CLEAN))
    return both | utilities_broadband_only(s)


def nuclear_tech_only(s: Column) -> Column:
    return F.array_contains(s, fixed.NUCLEAR_TECH) & ~F.array_contains(s, fixed.NUCLEAR_POWER)


def utilities_to_exclude(s: Column) -> Column:
    other = words(fixed.NON_ENERGY)
    rest = F.array_except(s, words([fixed.UTILITIES, *fixed.NON_ENERGY]))
    return F.array_contains(s, fixed.UTILITIES) & F.arrays_overlap(s, other) & (F.size(rest) == 0)


def energy_type_strict(s: Column) -> Column:
    return F.when(utilities_broadband_only(s) | nuclear_tech_only(s), "Other").otherwise(energy_type(s))


def tag_counts(s: Column) -> tuple[Column, Column, Column]:
    return (
        F.size(s),
        F.size(F.array_intersect(s, words(fixed.CLEAN))),
        F.size(F.array_intersect(s, words(fixed.FOSSIL))),
    )


def energy_columns(tags: Column) -> dict[str, Column]:
    """The nine energy columns of a tag array."""
    s = tag_set(tags)
    total, clean, fossil = tag_counts(s)
    return {
        "project_energy_type": energy_type(s),
        "project_energy_type_strict": energy_type_strict(s),
        "project_energy_type_questions": energy_questions(s),
        "project_is_utilities_broadband_only": utilities_broadband_only(s),
        "project_is_nuclear_tech_only": nuclear_tech_only(s),
        "project_utilities_to_exclude": utilities_to_exclude(s),
        "project_type_count": total.cast("long"),
        "project_type_count_clean": clean.cast("long"),
        "project_type_count_fossil": fossil.cast("long"),
    }


def nuclear_waste(tags: Column, sponsor: Column, agency: Column, title: Column, terms: list[str] | None = None) -> Column:
    joined = F.array_join(tag_set(tags), " ")
    about = F.contains(joined, F.lit("waste management")) & F.contains(joined, F.lit("nuclear"))
    named = any_of([contains_any(c, terms or fixed.WASTE_TERMS) for c in (sponsor, agency, title)])
    return about & (named | contains_any(agency, fixed.WASTE_AGENCIES))


def excluded(df: DataFrame, military: DataFrame | None = None) -> DataFrame:
    """Clean projects that only serve other ends become 'Other' in both energy columns.

    They are listed by ``military`` (project_id), flagged as utilities to exclude or as nuclear waste
    (``project_nuclear_waste_to_exclude``). Adds ``project_military_to_exclude``.
    """
    ids = df.sparkSession.createDataFrame([], "project_id string") if military is None else military
    marked = df.join(ids.select("project_id").distinct().withColumn("_military", F.lit(True)), "project_id", "left")
    marked = marked.withColumn("project_military_to_exclude", F.coalesce("_military", F.lit(False))).drop("_military")
    flags = [F.coalesce(c, F.lit(False)) for c in ("project_military_to_exclude", "project_utilities_to_exclude", "project_nuclear_waste_to_exclude")]
    drop = (F.col("project_energy_type") == "Clean") & any_of(flags)
    kinds = {c: F.when(drop, "Other").otherwise(F.col(c)) for c in ("project_energy_type", "project_energy_type_strict")}
    return marked.withColumns(kinds)


def notebook_clean(tags: Column) -> Column:
    """Any tag of a short list, as written."""
    return F.coalesce(F.arrays_overlap(tags, words(fixed.NOTEBOOK_CLEAN)), F.lit(False))


def tag_label(value: Column, sep: str = ", ") -> Column:
    """JSON array text as one label."""
    return F.array_join(json_list(value), sep)


def split_tags(value: Column) -> Column:
    """Parts of a plain or JSON text of several values, also divided at bars; null for none."""
    bars = F.split(F.array_join(json_list(value), "|"), r"\|")
    return F.when(F.size(json_list(value)) > 0, bars)


def first_value(value: Column) -> Column:
    """First element of JSON array text, or the whole text."""
    quoted = F.nullif(F.regexp_extract(value, r'(?<=\[")[^"]+', 0), F.lit(""))
    return F.coalesce(quoted, value)


def department(agency: Column) -> Column:
    out = F.lit(fixed.DEPARTMENT_OTHER)
    for name in reversed(fixed.DEPARTMENT_NAMES):
        out = F.when(agency == name, name).otherwise(out)
    for prefix in reversed(fixed.DEPARTMENT_PREFIXES):
        out = F.when(agency.startswith(prefix), prefix).otherwise(out)
    return F.when(agency.isNull() | (agency == ""), F.lit(fixed.DEPARTMENT_OTHER)).otherwise(out)


def json_list(value: Column) -> Column:
    """JSON array text, or a plain scalar, as an array; blank and null as the empty one."""
    parsed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    plain = F.when(strip(value) != "", F.array(value))
    return F.coalesce(parsed, plain, F.array().cast("array<string>"))


def multiple(values: Column) -> Column:
    return F.coalesce(F.size(values) > 1, F.lit(False))


def document_category(kind: Column, file_name: Column | None = None) -> Column:
    """Category by type; by file name only where the type is in no list."""
    upper = F.upper(strip(kind))
    names = F.lit("other")
    if file_name is not None:
        for category in ("appendix", "draft", "final", "decision"):
            hit = any_of([F.coalesce(file_name.rlike(f"(?i){p}"), F.lit(False)) for p in fixed.FILE_NAME_PATTERNS[category]])
            names = F.when(hit, category).otherwise(names)
    out = names
    for category in reversed(list(fixed.DOCUMENT_TYPES)):
        types = [t for t in fixed.DOCUMENT_TYPES[category] if t or file_name is None]
        out = F.when(upper.isin(types), category).otherwise(out)
    return out


def non_power(kind: Column) -> Column:
    return F.coalesce(F.contains(F.lower(kind), F.lit("pipeline")), F.lit(False)) & ~contains_any(kind, fixed.POWER_WORDS)


def capacity_terms(kind: Column) -> Column:
    """Search terms of a project type."""
    extra = [F.when(F.contains(F.lower(kind), F.lit(k)), words(v)).otherwise(F.array().cast("array<string>")) for k, v in fixed.TYPE_TERMS.items()]
    return F.array_sort(F.array_distinct(F.concat(words(fixed.CAPACITY_TERMS), *extra)))


def process_type(name: Column, source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.PROCESS_NAMES.items() for x in kv])
    return F.coalesce(table[name], source)
