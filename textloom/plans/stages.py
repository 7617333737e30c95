"""The stages of a corpus run by name, each a function of the tables before it, and the report on all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import stem_pattern
from textloom.operators import collocations, correction, density, frequency, keyness, kwic, ngrams, report, tfidf, topics
from textloom.operators.corpus import corpus, overview
from textloom.plans.explore import topic_labels


@dataclass
class Settings:
    """What a run is asked for. seeds: term to category; stems: (stem, category); lexicon: words with weights; rules: (label, regex,
    replacement); vocabulary: known words for text quality."""

    stopwords: Sequence[str] = ()
    min_length: int = 4
    slices: Sequence = ()
    targets: Sequence[str] = ()
    kwic_targets: Sequence[tuple[str, str]] = ()
    window: int = 5
    seeds: dict[str, str] = field(default_factory=dict)
    stems: Sequence[tuple[str, str]] = ()
    lexicon: Sequence[tuple[str, float]] = ()
    rules: Sequence[tuple[str, str, str]] = ()
    vocabulary: Sequence[str] = ()
    n_topics: int = 7
    topic_rounds: int = 500
    max_features: int = 5000


@dataclass
class Run:
    """Tables made so far; a stage's table is made when first asked for, those it needs before it. Tables stay on disk (and in memory
    where there is room) until the run is closed, so no stage computes another's anew; with keep=False they are plans only."""

    docs: DataFrame
    settings: Settings = field(default_factory=Settings)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keep: bool = True
    fitted: topics.Topics | None = None

    def table(self, stage: str) -> DataFrame:
        if stage not in self.tables:
            if stage not in STAGES:
                raise KeyError(f"no stage {stage!r}; there are {', '.join(STAGES)}")
            made = STAGES[stage].make(self)
            self.tables[stage] = made.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else made
        return self.tables[stage]

    def again(self, stage: str) -> DataFrame:
        if stage in self.tables:
            self.tables.pop(stage).unpersist()
        return self.table(stage)

    def close(self) -> None:
        """Give the kept tables up."""
        for df in self.tables.values():
            df.unpersist()
        self.tables.clear()
        self.fitted = None

    def model(self) -> topics.Topics:
        if self.fitted is None:
            s = self.settings
            weights = tfidf.weights(self.table("corpus"), "doc_id", "tokens", max_features=s.max_features)
            self.fitted = topics.nmf(weights, k=s.n_topics, rounds=s.topic_rounds)
        return self.fitted

    def report(self, stages: Sequence[str] = ()) -> str:
        """The named stages' tables, or without names the consolidated report, as Markdown."""
        return report.report({STAGES[s].label: self.table(s) for s in stages} if stages else report_tables(self))


@dataclass(frozen=True)
class Stage:
    label: str
    make: Callable[[Run], DataFrame]


def _transitions(run: Run) -> list[tuple]:
    s = list(run.settings.slices)
    return list(zip(s, s[1:], strict=False))


def _spark(run: Run):
    return run.docs.sparkSession


def _patterns(run: Run) -> list[tuple[str, str, str]]:
    return [(s, c, stem_pattern(s)) for s, c in run.settings.stems]


def _methods(run: Run) -> DataFrame:
    """Pattern counts beside counts of the seeds that begin with the stem."""
    pairs = [(s, t) for s, _ in run.settings.stems for t in run.settings.seeds if t.startswith(s)]
    counts = run.table("seeds").withColumnRenamed("term", "token")
    return frequency.compare_methods(run.table("patterns"), counts, _spark(run).createDataFrame(pairs, "stem string, token string"))


def _shares(run: Run) -> DataFrame:
    return run.model().shares.join(run.table("corpus").select("doc_id", "slice"), "doc_id")


STAGES: dict[str, Stage] = {
    "corpus": Stage("Preprocessing", lambda r: corpus(r.docs, r.settings.stopwords, r.settings.min_length, letters_only=True)),
    "overview": Stage("Overview", lambda r: overview(r.table("corpus"))),
    "frequency": Stage("Frequencies", lambda r: frequency.scoped_frequencies(r.table("corpus"))),
    "seeds": Stage("Seed terms", lambda r: frequency.seed_grid(r.table("corpus"), _spark(r).createDataFrame(list(r.settings.seeds.items()), "term string, category string"), r.settings.slices)),
    "patterns": Stage("Pattern frequencies", lambda r: frequency.pattern_frequencies(r.docs, _patterns(r))),
    "methods": Stage("Patterns and seed terms compared", _methods),
    "coverage": Stage("Pattern coverage", lambda r: frequency.coverage(r.docs, [(s, p) for s, _, p in _patterns(r)], r.settings.slices)),
    "keyness": Stage("Keywords", lambda r: keyness.ranked(keyness.keyness(r.table("corpus"), _transitions(r)))),
    "ngrams": Stage("n-grams", lambda r: ngrams.top_ngrams(ngrams.ngram_counts(r.table("corpus")))),
    "seeded": Stage("n-grams with seed terms", lambda r: ngrams.with_seeds(ngrams.ngram_counts(r.table("corpus"), scopes="slices", seeds=list(r.settings.seeds)), r.settings.seeds).drop("has_seed")),
    "collocations": Stage("Collocations", lambda r: collocations.top_collocations(collocations.collocations(r.table("corpus"), r.settings.targets, r.settings.window))),
    "topics": Stage("Topics", lambda r: topics.topic_terms(r.model(), _spark(r), 15, list(r.settings.seeds))),
    "shares": Stage("Topics by document", lambda r: topics.with_dominant(_shares(r), r.settings.n_topics)),
    "slice_shares": Stage("Topics by slice", lambda r: topics.slice_shares(r.table("shares").drop("dominant_topic"), r.settings.n_topics)),
    "kwic": Stage("Concordances", lambda r: kwic.kwic(r.docs, r.settings.kwic_targets)),
    "corrections": Stage("Corrections", lambda r: correction.rule_log(correction.corrected(r.docs, r.settings.rules), r.settings.rules)),
    "quality": Stage("Text quality", lambda r: density.known_share(r.docs, _spark(r).createDataFrame([(w,) for w in r.settings.vocabulary], "word string"))),
    "density": Stage("Lexicon density", lambda r: density.lexicon_density(r.docs, _spark(r).createDataFrame(list(r.settings.lexicon), "word string, weight double"))),
}


def report_tables(run: Run, k: int = 10) -> dict[str, DataFrame]:
    """The parts of the consolidated report: corpus, seed terms, keywords of each transition, n-grams with seed terms and their
    categories, collocates, topics and their shares, concordances with quotations, text quality, lexicon density, and a summary with
    a row for each slice. A part that the settings give nothing to is left out."""
    s, out = run.settings, {}
    slices = list(s.slices)
    out["Corpus"] = run.table("overview").orderBy("slice")
    if s.seeds:
        out["Seed terms"] = report.strongest_seeds(run.table("seeds"), k).orderBy("slice", "rank")
    if len(slices) > 1:
        best = keyness.strongest(run.table("keyness"), k)
        out["Keywords"] = best.select("transition", "direction", "rank", "token", F.round("pm_a", 1).alias("pm_a"), F.round("pm_b", 1).alias("pm_b"), F.round("pm_diff", 1).alias("pm_diff"), F.round(F.abs("g2"), 1).alias("g2")).orderBy("transition", "direction", "rank")
    if s.seeds:
        seeded = run.table("seeded")
        out["n-grams with seed terms"] = frequency.top_k(seeded, 15, ["scope"], [F.desc("per_million"), "ngram"]).select("scope", "rank", "ngram", "n", "abs", F.round("per_million", 1).alias("per_million"), "category").orderBy("scope", "rank")
        out["n-grams by category"] = frequency.pivoted(seeded, ["category"], "scope", [str(x) for x in slices], "abs").orderBy("category")
    if s.targets:
        out["Collocates"] = run.table("collocations").where(F.col("rank") <= k).select("target", "scope", "rank", "collocate", "cofreq", F.round("ll", 1).alias("ll"), F.round("pmi", 2).alias("pmi")).orderBy("target", "scope", "rank")
    if s.n_topics:
        out["Topics"] = topic_labels(run.table("topics"), k).orderBy("topic")
        out["Topics by slice"] = frequency.pivoted(run.table("slice_shares"), ["topic"], "slice", slices, "mean_share", 0.0).orderBy("topic")
    if s.kwic_targets:
        hits = run.table("kwic")
        out["Concordances"] = hits.where("slice is not null").groupBy("slice").agg(F.count(F.lit(1)).alias("hits")).orderBy("slice")
        out["Quotations"] = report.numbered(hits, "slice", ["doc_id", "pos_in_doc", "target"], F.concat_ws(": ", F.col("doc_id").cast("string"), "concordance")).orderBy("slice", "rank")
    if s.vocabulary:
        scored = run.table("quality").join(run.docs.select("doc_id", "slice"), "doc_id")
        out["Text quality"] = scored.groupBy("slice").agg(F.round(F.avg("score"), 3).alias("mean"), F.round(F.min("score"), 3).alias("min"), F.round(F.max("score"), 3).alias("max"), F.count(F.lit(1)).alias("n")).orderBy("slice")
    if s.lexicon:
        out["Lexicon density"] = density.density_statistics(run.table("density")).orderBy("slice")
    out["Summary"] = _summary(run)
    return out


def _summary(run: Run) -> DataFrame:
    """slice, n_docs, n_tokens and, where there are such, the rate of all seed terms, concordances and mean density."""
    s, rows = run.settings, run.table("overview").where("slice is not null").select("slice", "n_docs", "n_tokens")
    if s.seeds:
        rows = rows.join(run.table("seeds").groupBy("slice").agg(F.round(F.sum("per_million"), 1).alias("seeds_per_million")), "slice", "left")
    if s.kwic_targets:
        rows = rows.join(run.table("kwic").groupBy("slice").agg(F.count(F.lit(1)).alias("concordances")), "slice", "left")
    if s.lexicon:
        rows = rows.join(run.table("density").groupBy("slice").agg(F.round(F.avg("density"), 2).alias("density")), "slice", "left")
    return rows.orderBy("slice")
