"""Document metadata: issue numbers, dates from text, tiered joins, completeness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import java_literal
from textloom.operators.corpus import year_from_name

# German names of months with their usual short forms, weekdays from Monday, how the weekdays are looked for in texts
# (in this order; Sonnabend is another name of Samstag), and the forms in which names carry the number of an issue.
MONTHS = {"januar": 1, "februar": 2, "märz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12, "jan": 1, "feb": 2, "mär": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12}
WEEKDAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
WRITTEN_WEEKDAYS = (("Montag", "Montag"), ("Dienstag", "Dienstag"), ("Mittwoch", "Mittwoch"), ("Donnerstag", "Donnerstag"), ("Freitag", "Freitag"), ("Samstag", "Samstag"), ("Sonnabend", "Samstag"), ("Sonntag", "Sonntag"))
MONTH_NAMES = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
ISSUE_FORMS = (r"(?U)^OCR\s+(\d+)", r"(?iU)^(\d+)[a-z]?[.\s]")


def issue_number(name: Column) -> Column:
    """The issue a name begins with: "OCR 10 1929", "12. Ausgabe", "34a 1930"; else null."""
    return F.coalesce(*[F.regexp_extract(name, p, 1).try_cast("int") for p in ISSUE_FORMS])


def issue_range(name: Column) -> Column:
    """A double issue such as 25_26 as 25-26, or null."""
    first, second = F.regexp_extract(name, r"(?<!\d)(\d{1,2})_(\d{1,2})(?!\d)", 1), F.regexp_extract(name, r"(?<!\d)(\d{1,2})_(\d{1,2})(?!\d)", 2)
    return F.when(first != "", F.concat(first, F.lit("-"), second))


def _made_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _dated_forms(place: str) -> tuple[tuple[str, bool], ...]:
    """(pattern with day, month and year as groups, whether the month is a word), from special to general."""
    day_month = r"(\d{1,2})\.\s+(\w+)\s+(\d{4})"
    weekdays = "|".join(w for w, _ in WRITTEN_WEEKDAYS)
    # What stands before a date, and the years of a date in figures.
    before = (rf"(?:{weekdays}),\s+den\s+", rf"{java_literal(place)},\s+den\s+", r"vom\s+", r"[–\-]\s+")
    return tuple((rf"(?iU){b}{day_month}", True) for b in before) + ((r"(\d{1,2})\.\s*(\d{1,2})\.\s*(19[23]\d)", False),)


def date_in_text(text: Column, year_hint: Column, head: int = 3000, tolerance: int = 2, place: str = "Osnabrück") -> Column:
    """The date in the first ``head`` characters, as mastheads give it: forms are tried in order, each at its first occurrence; an
    unknown month, an impossible date or a year away from the hint by more than ``tolerance`` passes to the next form."""
    start = F.left(text, F.lit(head))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    found = []
    for pattern, word in _dated_forms(place):
        part = lambda g, p=pattern: F.regexp_extract(start, p, g)
        month = F.try_element_at(months, F.lower(part(2))) if word else part(2).try_cast("int")
        year = part(3).try_cast("int")
        near = year_hint.isNull() | (F.abs(year - year_hint) <= tolerance)
        found.append(F.when(near, _made_date(year, month, part(1).try_cast("int"))))
    return F.coalesce(*found)


def weekday_name(day: Column, text: Column | None = None) -> Column:
    """The date's weekday; without a date the first name of WRITTEN_WEEKDAYS that the text has as a word."""
    named = F.when(day.isNotNull(), F.element_at(F.lit(list(WEEKDAYS)), F.weekday(day) + 1))
    if text is None:
        return named
    return F.coalesce(named, *[F.when(text.rlike(rf"(?iU)\b{written}\b"), F.lit(name)) for written, name in WRITTEN_WEEKDAYS])


def long_date(day: Column) -> Column:
    """As in 3. Mai 1930."""
    return F.when(day.isNotNull(), F.concat(F.dayofmonth(day), F.lit(". "), F.element_at(F.lit(list(MONTH_NAMES)), F.month(day)), F.lit(" "), F.year(day)))


def tiered_join(docs: DataFrame, files: DataFrame, prefix: int = 15) -> DataFrame:
    """doc_id, year, path, tier: each document's file by the first strategy that finds one.

    docs: (doc_id, year), files: (path, year, stem). Tiers: same stem in the year; same stem without year; stem after a trailing -N
    is taken off; same first ``prefix`` characters. Within a tier the least path wins. All tiers are equality joins.
    """
    bare = F.regexp_replace("doc_id", r"-\d+$", "")
    left = docs.select("doc_id", "year")
    least = F.min("path").alias("path")  # one file for a key before any join
    tiers = [
        left.join(files.where("year is not null").groupBy("year", F.col("stem").alias("doc_id")).agg(least), ["doc_id", "year"]).withColumn("tier", F.lit(1)),
        left.join(files.where("year is null").groupBy(F.col("stem").alias("doc_id")).agg(least), "doc_id").withColumn("tier", F.lit(2)),
        left.withColumn("stem", bare).where("stem <> doc_id").join(files.groupBy("stem").agg(least), "stem").withColumn("tier", F.lit(3)),
        left.withColumn("p", F.rtrim(F.left("doc_id", F.lit(prefix)))).join(files.groupBy(F.rtrim(F.left("stem", F.lit(prefix))).alias("p")).agg(least), "p").withColumn("tier", F.lit(4)),
    ]
    found = reduce(DataFrame.unionByName, [t.select("doc_id", "path", "tier") for t in tiers])
    best = found.groupBy("doc_id").agg(F.min(F.struct("tier", "path")).alias("x")).select("doc_id", "x.path", "x.tier")
    return left.join(best, "doc_id", "left").select("doc_id", "year", "path", "tier")


def composite_join(docs: DataFrame, quality: DataFrame, on: Sequence[str] = ("year", "issue")) -> DataFrame:
    """Left join on several keys; a document with a null or 0 in any key finds nothing."""
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != 0) for c in on])
    keys = [F.when(usable, F.col(c)).alias(f"_{c}") for c in on]
    right = quality.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in quality.columns if c not in on])
    return docs.select("*", *keys).join(right, [f"_{c}" for c in on], "left").drop(*[f"_{c}" for c in on])


def completeness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, complete (all columns neither null nor empty), and for each column the rows that have it."""
    has = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns}
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(reduce(lambda a, b: a & b, has.values())).alias("complete"), *[F.count_if(h).alias(f"has_{c}") for c, h in has.items()])


def issue_table(docs: DataFrame, corpus_df: DataFrame, pages: DataFrame, quality: DataFrame) -> DataFrame:
    """issue, year, date, date_iso, weekday, n_pages, n_raw_tokens, n_tokens, doc_id, cer, wer in order of year and issue (absent last).

    docs: (doc_id, name, text); corpus_df as of corpus(); pages: (doc_id, page); quality: (year, issue, cer, wer).
    """
    named = docs.withColumn("year", year_from_name("name")).withColumn("issue", issue_number(F.col("name")))
    dated = named.withColumn("date_iso", date_in_text(F.col("text"), F.col("year"))).withColumn("weekday", weekday_name(F.col("date_iso"), F.left("text", F.lit(3000))))
    counted = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    joined = composite_join(dated, quality).join(corpus_df.select("doc_id", "n_raw_tokens", "n_tokens"), "doc_id", "left").join(counted, "doc_id", "left")
    ordered = joined.orderBy(F.coalesce("year", F.lit(9999)), F.coalesce("issue", F.lit(9999)), "doc_id")
    return ordered.select("issue", "year", long_date(F.col("date_iso")).alias("date"), F.date_format("date_iso", "yyyy-MM-dd").alias("date_iso"), "weekday", "n_pages", "n_raw_tokens", "n_tokens", "doc_id", "cer", "wer")


def first_match(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
