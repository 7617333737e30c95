"""Slots for models that Spark has no equivalent of: loaded once per task, fed Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotated(docs: DataFrame, load: Callable[[], Any], annotate: Callable[[Any, str], Any], schema: str, column: str = "annotation", text: str = "text", keep: tuple[str, ...] = ("doc_id", "slice"), on_error: str = "fail") -> DataFrame:
    """keep and ``column`` of Spark type ``schema``: annotate(load(), text) for every document; null text gives null.

    on_error "skip" leaves out documents for which annotate raises, as a scorer that may refuse a text needs.
    """

    def run(frames: Iterator[pd.DataFrame]):
        model = load()
        for pdf in frames:
            made, good = [], []
            for value in pdf[text]:
                try:
                    made.append(None if value is None else annotate(model, value))
                    good.append(True)
                except Exception:
                    if on_error != "skip":
                        raise
                    made.append(None)
                    good.append(False)
            yield pdf[list(keep)].assign(**{column: made})[good]

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInPandas(run, f"{kinds}, `{column}` {schema}")


TAGGED = "array<struct<text:string,lemma:string,pos:string,is_stop:boolean>>"


def tagged(docs: DataFrame, load, tag) -> DataFrame:
    """doc_id, slice, tokens of (text, lemma, pos, is_stop), for tagged_collocations and lemma corpora."""
    return annotated(docs, load, tag, TAGGED, "tokens")


def lemma_corpus(tagged_docs: DataFrame, min_length: int = 4) -> DataFrame:
    """The corpus table from tagged tokens: lower-cased lemmas that are letters only, no stop words and long enough."""
    kept = F.filter("tokens", lambda t: ~F.coalesce(t["is_stop"], F.lit(False)) & t["lemma"].rlike(r"^\p{L}+$") & (F.char_length(t["lemma"]) >= min_length))
    rows = tagged_docs.select("doc_id", "slice", F.transform(kept, lambda t: F.lower(t["lemma"])).alias("tokens"), F.size("tokens").alias("n_raw_tokens"))
    return rows.select("doc_id", "slice", "tokens", F.size("tokens").alias("n_tokens"), "n_raw_tokens")
