"""Readers: text trees, tables, lexicons, topic model files. Every schema is explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import YEAR, without_comments


class MissingInput(FileNotFoundError):
    """An input path that doesn't exist."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def require(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not exists(spark, path):
            raise MissingInput(path)


def text_files(spark: SparkSession, path: str, recursive: bool = False, exclude: Sequence[str] = (), errors: str = "replace", comments: str | None = None, glob: str = "*.txt") -> DataFrame:
    """path, folder, name, text of the files of a folder, a row for each.

    errors: replace (bad bytes become U+FFFD), skip (files that are not UTF-8 are left out; see rejected_files), latin1 (such files
    are read as ISO-8859-1). exclude: names of folders anywhere on the path. comments: lines beginning with it are taken out.
    """
    require(spark, path)
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = _without(read.load(path), exclude)
    valid = F.is_valid_utf8("content")
    if errors == "skip":
        files = files.where(valid)
    content = F.col("content")
    utf8 = F.make_valid_utf8(content.cast("string"))
    text = F.when(valid, utf8).otherwise(F.decode(content, "ISO-8859-1")) if errors == "latin1" else utf8
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), text.alias("text"))
    return named.withColumn("text", without_comments("text", comments)) if comments else named


def rejected_files(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.txt") -> DataFrame:
    """path, bytes of the files that are not UTF-8."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return read.load(path).where(~F.is_valid_utf8("content")).select("path", F.col("length").alias("bytes"))


def _without(files: DataFrame, exclude: Sequence[str]) -> DataFrame:
    for folder in exclude:
        files = files.where(~F.contains("path", F.lit(f"/{folder}/")))
    return files


def year_of_path(path: Column) -> Column:
    """The year in the parent folder's name, else in the file's name, else null."""
    folder, name = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    year = lambda c: F.regexp_extract(c, YEAR, 1).try_cast("int")
    return F.coalesce(year(folder), year(name))


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, malformed: str = "PERMISSIVE", separator: str = ",", header: bool = True) -> DataFrame:
    """malformed DROPMALFORMED leaves out rows that don't fit the schema."""
    return spark.read.schema(schema).option("header", str(header).lower()).option("sep", separator).option("mode", malformed).csv(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """token: the distinct lines of a file, lower-cased, without comments and blank lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("token")).where("token <> '' and token not like '#%'").distinct()


def default_stopwords(language: str = "german") -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def weighted_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, weight from lines of lemma|tag, weight and comma-separated forms, parted by tabs; a word's least weight counts."""
    rows = spark.read.schema("lemma string, weight double, forms string").option("sep", "\t").option("header", "false").csv(path)
    words = F.concat(F.array(F.split("lemma", r"\|")[0]), F.split(F.coalesce("forms", F.lit("")), ","))
    each = rows.select(F.explode(words).alias("word"), "weight").select(F.lower(F.trim("word")).alias("word"), "weight").where("word <> ''")
    return each.groupBy("word").agg(F.min("weight").alias("weight"))


def topic_keys(spark: SparkSession, path: str) -> DataFrame:
    """topic, weight, terms from lines of number, weight (point or comma) and terms parted by spaces."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(p) >= 3)
    made = rows.select(p[0].try_cast("int").alias("topic"), F.replace(p[1], F.lit(","), F.lit(".")).try_cast("double").alias("weight"), F.filter(F.split(F.trim(p[2]), r"\s+"), lambda t: t != "").alias("terms"))
    return made.where("topic is not null and weight is not null")


def document_topics(spark: SparkSession, path: str, k: int = 7) -> DataFrame:
    """doc_id, source, topic_0, ...: lines of number, URI and shares; comments skipped, bad or missing shares 0."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%'").where(F.size(p) >= 2)
    share = lambda t: F.coalesce(F.try_element_at(p, F.lit(t + 3)).try_cast("double"), F.lit(0.0)).alias(f"topic_{t}")
    return rows.select(F.regexp_replace(F.regexp_extract(p[1], r"([^/]+)$", 1), r"\.[^.]+$", "").alias("doc_id"), p[1].alias("source"), *[share(t) for t in range(k)])


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, text from rows (doc_id, page, text) that a PDF reader made; pages are parted by a blank line."""
    grouped = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return grouped.select("doc_id", "n_pages", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, text of PDF files, where the workers have pdfplumber."""
    import pandas as pd

    def run(frames):
        import io

        import pdfplumber

        for pdf in frames:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as book:
                    out += [(name, n + 1, page.extract_text() or "") for n, page in enumerate(book.pages)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, text string")


def paired(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Rows of both sides that exist in both."""
    return left.join(right, key)
