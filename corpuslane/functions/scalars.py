"""Numbers, dates, arrays and small rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publication eras.
ERAS = (("foundational", None, 2017), ("established", 2018, 2020), ("recent", 2021, 2022), ("current", 2023, None))


def year_of(date: Column) -> Column:
    """The year that a date text starts with; null if it starts with none."""
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")


def era(year: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(ERAS):
        inside = (year >= low if low else F.lit(True)) & (year <= high if high else F.lit(True))
        out = F.when(inside, name).otherwise(out)
    return F.when(year.isNotNull(), out)


def recency(year: Column, now: int = 2024) -> Column:
    """1 for this year or later, a tenth less for every year before, at least 0; 0.5 without a year."""
    return F.when(year.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.1 * F.greatest(F.lit(0), now - year)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct values of ``b`` that ``a`` has; 0 when ``b`` is empty or null."""
    n = F.size(F.array_distinct(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or null."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n / d)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def coverage_band(share: Column) -> Column:
    return F.when(share >= 0.6, "eligible").when(share >= 0.25, "nearby").otherwise("rejected")


def squash(score: Column, top: Column) -> Column:
    """A score between 0.55 and 0.99, by its share of the best one."""
    return F.bround(F.least(F.lit(0.99), 0.55 + ratio(score, top) * 0.44), 2)


def published_date(text: Column) -> Column:
    """A date from an ISO text, or from day, month and year inside an RFC-822 text; null for anything else."""
    rfc = F.try_to_date(F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy")
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), rfc)


def repaired_date(text: Column, arxiv: Column) -> Column:
    """An ISO date; a cut one is completed to the first of its month, or taken from the year and month of an arXiv id."""
    cut = F.try_to_date(F.concat(F.regexp_extract(text, r"^(\d{4}-\d{2})", 1), F.lit("-01")), "yyyy-MM-dd")
    yymm = F.regexp_extract(arxiv, r"^(\d{4})\.\d{4,5}", 1)
    century = F.when(F.substring(yymm, 1, 2) >= "91", "19").otherwise("20")
    from_id = F.try_to_date(F.concat(century, F.substring(yymm, 1, 2), F.lit("-"), F.substring(yymm, 3, 2), F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(published_date(text), cut, F.when(yymm != "", from_id))


def stable_id(stem: Column) -> Column:
    """A slug and ten hexadecimal digits of the text's SHA-256."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(stem, 256), 1, 10))
