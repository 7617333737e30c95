"""Sections between header lines, bullet entries, names and their scores, headings from positioned characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import unnested, unnested_at


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, line (trimmed)."""
    return unnested_at(docs, F.split(text, r"\R"), "pos", "line", "doc_id").withColumn("line", F.trim("line"))


def section_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines after a line that matches ``start`` up to one that matches ``end``; neither header is kept, and a start inside a section
    is swallowed. The state runs within a document."""
    event = F.when(F.col("line").rlike(start), F.lit(1)).when(F.col("line").rlike(end), F.lit(0))
    state = F.coalesce(F.last("_e", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return lines.withColumn("_e", event).withColumn("_s", state).where("_s = 1 and _e is null").select("doc_id", "pos", "line")


def bullet_names(entry: Column) -> Column:
    """Names in a bullet entry. With a colon before any comma it is "category: name, ...; name, ...", else "name, address: text"."""
    colon, comma = F.instr(entry, ":"), F.instr(entry, ",")
    first = lambda part: F.trim(F.split_part(part, F.lit(","), F.lit(1)))
    after = F.substring(entry, colon + 1, F.lit(2**31 - 1))
    grouped = F.transform(F.split(after, ";"), first)
    before = F.when(colon > 0, F.substring(entry, F.lit(1), colon - 1)).otherwise(entry)
    names = F.when((colon > 0) & ((comma == 0) | (colon < comma)), grouped).otherwise(F.array(first(before)))
    return F.filter(names, lambda n: n != "")


# Marks at the edges of names, function words that are no names, and endings of street names.
NAME_EDGES = " .,-;:●•"
FUNCTION_WORDS = ("der", "die", "das", "ein", "eine", "und", "oder", "für", "bei", "mit", "vom", "von", "zu", "an", "in", "auf", "als", "nach", "seit", "unter", "über", "vor", "durch")
STREET_ENDINGS = ("straße", "str\\.", "gasse", "weg", "platz", "allee")
#: What no name looks like: figures and marks only, exclamations and questions, a small first letter, streets, short abbreviations.
REJECTED = (r"^[\d\s.\-,/:()\[\]!?&|]+$", "[!?]", r"^\P{Lu}", rf"(?iU)({'|'.join(STREET_ENDINGS)})\s*\d*$", r"^[A-Za-z]{1,3}\.$")


def clean_name(name: Column, least: int = 3, most: int = 55, blacklist: Sequence[str] = (), rejected: Sequence[str] = REJECTED) -> Column:
    """The name without a bracketed address at its end, with single spaces and without marks at its edges, or null where its length,
    a pattern, a function word or the caller's blacklist rejects it."""
    bare = F.regexp_replace(name, r"(?U)\s*\([^)]*\)\s*$", "")
    tidy = F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(NAME_EDGES))
    bad = ~F.char_length(tidy).between(least, most) | F.lower(tidy).isin([*FUNCTION_WORDS, *(b.lower() for b in blacklist)])
    for pattern in rejected:
        bad = bad | tidy.rlike(pattern)
    return F.when(~bad, tidy)


def section_names(lines: DataFrame, bullet: str = r"^[●•*-]\s*", **rules) -> DataFrame:
    """doc_id, pos, name: cleaned names of the bullet entries among lines."""
    entries = lines.where(F.col("line").rlike(bullet)).select("doc_id", "pos", F.regexp_replace("line", bullet, "").alias("entry"))
    return entries.select("doc_id", "pos", F.explode(bullet_names(F.col("entry"))).alias("name")).withColumn("name", clean_name(F.col("name"), **rules)).where("name is not null")


def name_scores(bullets: DataFrame, recognised: DataFrame, k: int = 50, weight: int = 2) -> DataFrame:
    """rank, name, kind, score, n_bullets, n_recognised: weight * bullets + recognised, the k best. recognised: (doc_id, pos, name,
    kind); kind is the name's last in order of document and place."""
    rows = bullets.select("name", F.lit(1).alias("b"), F.lit(0).alias("r"), F.lit(None).cast("string").alias("kind"), "doc_id", "pos").unionByName(recognised.select("name", F.lit(0).alias("b"), F.lit(1).alias("r"), "kind", "doc_id", "pos"))
    grouped = rows.groupBy("name").agg(F.sum("b").alias("n_bullets"), F.sum("r").alias("n_recognised"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("doc_id", "pos"))).alias("kind"))
    best = grouped.withColumn("score", weight * F.col("n_bullets") + F.col("n_recognised")).orderBy(F.desc("score"), "name").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "name"))).select("rank", "name", F.coalesce("kind", F.lit("")).alias("kind"), "score", "n_bullets", "n_recognised")


def char_lines(chars: DataFrame, gap: float = 2.0) -> DataFrame:
    """file, page, line_no, text, size, bold from positioned characters (file, page, text, size, fontname, top, x0); see page_lines."""
    return page_lines(chars.groupBy("file", "page").agg(F.collect_list(char_item()).alias("c")), gap)


def char_item() -> Column:
    """A character of a page, from the columns of its row."""
    return F.struct("top", "x0", "text", "size", F.lower("fontname").contains("bold").alias("bold"))


def page_lines(pages: DataFrame, gap: float = 2.0) -> DataFrame:
    """file, page, line_no, text, size, bold from pages (file, page, c: array of characters, see char_item).

    A character more than ``gap`` below the first of its line begins a new line, so the anchor is a fold over the page's characters
    from top to bottom. Characters of a line are read from left to right; size is their largest. A page's lines are made where the
    page lies.
    """
    none = F.array().cast("array<array<struct<x0:double,text:string,size:double,bold:boolean>>>")
    line = F.array().cast("array<struct<x0:double,text:string,size:double,bold:boolean>>")
    zero = F.struct(none.alias("done"), line.alias("line"), F.lit(None).cast("double").alias("anchor"))

    def step(acc, x):
        new = F.abs(x["top"] - acc["anchor"]) > gap
        new = acc["anchor"].isNull() | new
        cell = F.array(F.struct(x["x0"].alias("x0"), x["text"].alias("text"), x["size"].alias("size"), x["bold"].alias("bold")))
        over = new & (F.size(acc["line"]) > 0)
        done = F.when(over, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(new, cell).otherwise(F.concat(acc["line"], cell)).alias("line"), F.when(new, x["top"]).otherwise(acc["anchor"]).alias("anchor"))

    folded = F.aggregate(F.array_sort("c"), zero, step, lambda acc: F.when(F.size(acc["line"]) > 0, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]))
    text = lambda x: F.trim(F.array_join(F.transform(F.array_sort(F.transform(x, lambda y: F.struct(y["x0"], y["text"]))), lambda y: y["text"]), ""))
    made = F.transform(folded, lambda x: F.struct(text(x).alias("text"), F.array_max(F.transform(x, lambda y: y["size"])).alias("size"), F.array_max(F.transform(x, lambda y: y["bold"])).alias("bold")))
    return unnested_at(pages, made, "line_no", "x", "file", "page").select("file", "page", "line_no", "x.*")


NOT_HEADINGS = (r"^\d+$", r"(?i)^(seite|nr|nummer)\b", r"^\P{L}+$", r"(?i)(telefon|fernruf|postscheck)")


def headings(lines: DataFrame, title: float = 18.0, article: float = 12.5, least: int = 5, most: int = 120, rejected: Sequence[str] = NOT_HEADINGS) -> DataFrame:
    """file, page, line_no, text, kind: haupttitel by size, artikel by size and bold, fallback for other bold lines of at most 80
    characters that begin with a capital; each text once per file, its first place."""
    bad = ~F.char_length("text").between(least, most)
    for pattern in rejected:
        bad = bad | F.col("text").rlike(pattern)
    strict = F.char_length("text").between(least, 80) & F.col("text").rlike(r"^\p{Lu}") & ~F.col("text").rlike(r"[.,;]$")
    kind = F.when(F.col("size") >= title, F.lit("haupttitel")).when((F.col("size") >= article) & F.col("bold"), F.lit("artikel")).when(F.col("bold") & strict, F.lit("fallback"))
    kept = lines.where(~bad).withColumn("kind", kind).where("kind is not null")
    first = kept.groupBy("file", "text").agg(F.min(F.struct("page", "line_no", "kind")).alias("x"))
    return first.select("file", "x.page", "x.line_no", "text", "x.kind")


def outline(found: DataFrame) -> DataFrame:
    """file and its headings in order, as an array of structs."""
    return found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "kind", "text"))).alias("headings"))
