"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's expression a Boolean query over mandatory trigrams is derived. The index has, for each trigram that any query names,
posting lists of the documents whose folded text has it, one list for each block of documents, so that no list grows with the data.
Rules are looked up by intersecting and uniting posting lists; the documents found are candidates, whose texts are fetched and
verified. Rules without mandatory trigrams (runs of hexadecimal digits) scan every text where it is. Spans come from the pieces
between matches, so they are code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialize, spot
from .trigrams import trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """Matches of pattern of which group ``group`` has at least ``least`` characters; leftmost, not overlapping."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then public formats of well-known tokens.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{4,64}@"),
)
BASE = 3


#: Documents of a block of the index (about), and buckets of the bit table that says which documents may be candidates.
BLOCK, BITS = 4096, 1 << 20


def postings(docs: DataFrame, wanted: set[str], blocks: int) -> DataFrame:
    """The inverted index over the wanted trigrams: (block, trigram, docs), docs being the keys of a posting list."""
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("_f"), F.lit(t)), F.lit(t)) for t in sorted(wanted)]))
    rows = docs.select("key", F.lower("text").alias("_f")).select("key", F.explode(present).alias("trigram"))
    return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("docs"))


def looked_up(query, lists: Column) -> Column:
    """The documents of a block that satisfy a query, from its posting lists (a map by trigram)."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [looked_up(q, lists) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, try): the documents whose postings satisfy a rule's trigram query, with the numbers of those rules."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    found = F.array(*[F.struct(F.lit(k).alias("rule"), looked_up(q, F.col("lists")).alias("docs")) for k, q in queries.items()])
    each = lists.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.docs").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("try"))


SPANS = "array<struct<s:int,k:int,e:int>>"


def sliced(items: Column, size: int = 256) -> Column:
    """An array of slices of ``size`` items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<s, k, e>> of the rule's spans in text, with its number k.

    Pieces between matches and the matches add up to positions, first within slices of the hits, then over slices, so that the work
    stays near linear in the hits.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    sized = F.zip_with(F.transform(matches, F.char_length), F.transform(groups, F.char_length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    before = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    steps = F.zip_with(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), sized, lambda b, x: F.struct(b.alias("b"), x["m"].alias("m"), x["g"].alias("g")))
    none = F.array().cast(SPANS)

    def step(acc, x):
        s = acc["at"] + x["b"]
        span = F.struct(s.alias("s"), F.lit(number).alias("k"), (s + x["m"]).alias("e"))
        return F.struct((s + x["m"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    within = F.transform(sliced(steps), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def move(acc, x):
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), y["k"].alias("k"), (y["e"] + acc["at"]).alias("e")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(within, start, move, lambda acc: F.flatten(acc["out"]))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = True) -> DataFrame:
    """``docs`` with ``_tl_spans``: array<struct<s, k, e>> of all rules' spans by start, rule, end.

    A document's key is a hash of id and text; documents that share it share their rules to try, which only ever tries more. Texts of
    documents that can't be candidates stay where they are: a bit table of BITS buckets, broadcast, says which those are; the others
    are joined to their rules by key, keys of more than 1 / HOT_KEYS of the candidates by broadcast. ``carry``: whether text stays.
    """
    keyed = docs.withColumn("_tl_key", F.xxhash64(spot(), F.coalesce("text", F.lit(""))))
    texts = keyed.select(F.col("_tl_key").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = set().union(*(trigrams(trigram_query(r.pattern)) for r in rules))
    blocks = max(1, texts.count() // BLOCK)
    tried = materialize(candidates(postings(texts, wanted, blocks), rules).withColumnsRenamed({"key": "_tl_key", "try": "_tl_try"}))
    bucket = F.pmod("_tl_key", F.lit(BITS))
    marked = keyed.join(F.broadcast(tried.select(bucket.alias("_tl_bit")).distinct()), bucket == F.col("_tl_bit"), "left")
    text, free = F.coalesce("text", F.lit("")), [k for k, r in enumerate(rules) if trigram_query(r.pattern) is True]

    def found(numbers, allowed) -> Column:
        spans = [F.when(allowed(k) & text.rlike(rules[k].pattern), rule_spans(text, rules[k], k)).otherwise(F.array().cast(SPANS)) for k in numbers]
        return F.concat(*spans) if spans else F.array().cast(SPANS)

    columns = [c for c in docs.columns if carry or c != "text"]
    plain = marked.where("_tl_bit is null").withColumn("_tl_spans", F.array_sort(found(free, lambda k: F.lit(True)))).select(*[F.col(f"`{c}`") for c in columns], "_tl_spans")
    maybe = marked.where("_tl_bit is not null").drop("_tl_bit")
    joined = _tried(maybe, keyed, tried)
    tries = lambda k: F.lit(True) if k in free else F.array_contains(F.coalesce("_tl_try", F.array().cast("array<int>")), k)
    verified = joined.withColumn("_tl_spans", F.array_sort(found(range(len(rules)), tries)))
    return plain.unionByName(verified.select(*[F.col(f"`{c}`") for c in columns], "_tl_spans"))


def _tried(maybe: DataFrame, keyed: DataFrame, tried: DataFrame) -> DataFrame:
    """maybe left-joined to its rules; keys of very many rows (fewer than HOT_KEYS of them) by broadcast."""
    counts = keyed.join(tried.select("_tl_key"), "_tl_key", "left_semi").groupBy("_tl_key").agg(F.count(F.lit(1)).alias("_tl_n")).where("_tl_n > 1")
    counts = materialize(counts)
    total = counts.agg(F.sum("_tl_n")).first()[0] or 0
    hot = tried.join(counts.where((F.col("_tl_n") > 1000) & (F.col("_tl_n") * HOT_KEYS > F.lit(total))).select("_tl_key"), "_tl_key")
    if hot.isEmpty():
        return maybe.join(tried, "_tl_key", "left")
    hot = materialize(hot)
    cold = maybe.join(F.broadcast(hot.select("_tl_key")), "_tl_key", "left_anti").join(tried, "_tl_key", "left")
    return cold.unionByName(maybe.join(F.broadcast(hot), "_tl_key"))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def is_number(k: int):
    return lambda x: F.when(x == k, x)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    The first three rules are the base. A null or empty text has no spans (the sha256 is that of the empty string). Null ids and
    repeated rows each come back.
    """
    found = with_spans(docs.select("doc_id", "text"), rules, carry=False)
    base = F.filter("_tl_spans", lambda x: x["k"] < BASE)
    kinds = F.transform("_tl_spans", lambda x: x["k"])
    count = {r.kind: F.size(F.array_compact(F.transform(kinds, is_number(k)))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules[:BASE])}
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "_tl_spans").select(
        "doc_id", *count.values(), F.sha2(written(base, rules).cast("binary"), 256).alias("base_sha256"), written(F.col("_tl_spans"), rules).alias("spans"), F.size("_tl_spans").cast("long").alias("n_spans")
    )


#: Code points of the pieces that a text is cut into before gaps are taken from it.
PIECE = 1024


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points from 0, end exclusive) out of its pieces, without going through all of it."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans in text replaced by ``mark``; other columns, and null texts, stay. Spans are merged
    to the gaps between them, which are cut out of pieces of the text, so that long texts with many spans stay near linear."""
    gap = "struct<s:int,e:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{gap}>").alias("gaps"))

    def step(acc, x):
        own = F.struct(acc["at"].alias("s"), x["s"].alias("e"))
        gaps = F.when(x["s"] >= acc["at"], F.concat(acc["gaps"], F.array(own))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), gaps.alias("gaps"))

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    size = F.char_length("text")
    merged = F.aggregate("_tl_spans", start, step, lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("s"), size.alias("e")))))
    made = with_spans(docs, rules).withColumn("_tl_gaps", F.when(F.size("_tl_spans") > 0, merged)).withColumn("_tl_pieces", F.when(F.size("_tl_spans") > 0, pieces))
    clean = F.array_join(F.transform("_tl_gaps", lambda g: between(F.col("_tl_pieces"), g["s"], g["e"])), mark)
    return made.withColumn("text", F.when(F.size("_tl_spans") > 0, clean).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
