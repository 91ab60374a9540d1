"""Partial dates: a year, a year and month, or a full date, as text. A missing part counts as the end of its period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a partial date begins; what follows it does not count.
PARTIAL = r"^((?:19|20)\d{2})(?:-(\d{1,2})(?:-(\d{1,2}))?)?"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def date_number(text: Column) -> Column:
    """yyyymmdd with month 12 and day 31 where they are missing; null for null, ``unknown`` and other text."""
    part = lambda i, default: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, PARTIAL, i), F.lit("")), F.lit("9999")).cast("int"), F.lit(default) if default else F.lit(None).cast("int"))
    return part(1, 0) * 10000 + part(2, 12) * 100 + part(3, 31)


def precision(text: Column) -> Column:
    """day, month, year, or raw for any other text that is not empty."""
    has = lambda i: F.regexp_extract(text, PARTIAL, i) != ""
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(None)).when(has(3), "day").when(has(2), "month").when(has(1), "year").otherwise("raw")


def date_candidate(text: Column) -> Column:
    """struct<value, precision, raw>: the first day, else month, else year (19.. or 20..) named anywhere in a text.

    Days are written ``7 September 2004`` and months ``September 2004``. A text without any of them is its own value,
    of precision raw; null, empty and ``unknown`` give null.
    """
    raw = F.trim(F.regexp_replace(text, r"\s+", " "))
    number = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    name = f"({'|'.join(MONTHS)})"
    day, month, year = rf"(?i)\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b", rf"(?i)\b{name}\s+(\d{{4}})\b", r"\b((?:19|20)\d{2})\b"
    part = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    of = lambda pattern, i: F.try_element_at(number, F.lower(part(pattern, i)))
    made = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("precision"), raw.alias("raw"))
    found = F.when(raw.rlike(day), made(F.concat_ws("-", part(day, 3), of(day, 2), F.lpad(part(day, 1), 2, "0")), "day"))
    found = found.when(raw.rlike(month), made(F.concat_ws("-", part(month, 2), of(month, 1)), "month")).when(raw.rlike(year), made(part(year, 1), "year"))
    return F.when(raw.isNotNull() & (raw != "") & (F.lower(raw) != "unknown"), found.otherwise(made(raw, "raw")))


#: The fields and categories that tell when content came and went.
ADDED = ("release", "released", "date added", "added", "start date")
REMOVED = ("removal", "removed", "date removed", "end date", "discontinued")
CAME, WENT, EITHER = (rf"(?i)Content {w} in ((?:19|20)\d{{2}})" for w in ("released", "removed", "(?:released|removed)"))


def lifecycle(fields: Column, categories: Column) -> Column:
    """struct<added, removed, content_years> from fields (map of arrays) and categories.

    added and removed are the smallest date candidates by value (the first of equal ones), each with its source; a
    category counts only where no field gives a candidate. content_years: distinct years of such categories, rising.
    """
    cats = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c.isNotNull())

    def earliest(names: tuple[str, ...], pattern: str) -> Column:
        asked = F.filter(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,array<string>>"))), lambda e: e["key"].isin(*names))
        every = F.flatten(F.transform(asked, lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: F.struct(date_candidate(v).alias("c"), F.concat(F.lit("infobox:"), e["key"]).alias("source")))))
        dated = F.filter(every, lambda x: x["c"].isNotNull())
        sortable = F.transform(dated, lambda x, i: F.struct(x["c"]["value"].alias("value"), i.alias("i"), x["c"]["precision"].alias("precision"), x["source"].alias("source")))
        by_field = F.try_element_at(F.array_sort(sortable), F.lit(1))
        year = F.regexp_extract(F.try_element_at(F.filter(cats, lambda c: c.rlike(pattern)), F.lit(1)), pattern, 1)
        named = lambda value, precision, source: F.struct(value.alias("value"), precision.alias("precision"), source.alias("source"))
        return F.when(by_field.isNotNull(), named(by_field["value"], by_field["precision"], by_field["source"])).when(year.isNotNull(), named(year, F.lit("year"), F.lit("category")))

    years = F.array_sort(F.array_distinct(F.transform(F.filter(cats, lambda c: c.rlike(EITHER)), lambda c: F.regexp_extract(c, EITHER, 1).cast("int"))))
    return F.struct(earliest(ADDED, CAME).alias("added"), earliest(REMOVED, WENT).alias("removed"), years.alias("content_years"))
