"""Media columns: interleaved sequences of text and media references, payloads in a store by digest.

Parsing HTML gives each document an ordered array of structs: text blocks and media references, a reference with the caption of
its figure (or its alternative text). References name a digest; a join with the store resolves it, and sequences come back in
order with captions beside their media. Payloads are stored as binary PGM images: 8-bit samples, 24 to a row, so any bytes come
back as they were. The store is a table of (digest, image) in the shared folder, read back for the images' features.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_key, id_key, join_hot, materialize

ITEM = "pos int, kind string, text string, digest string, src string, caption string"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "figure", "header", "footer", "main", "nav", "aside", "blockquote", "pre", "body", "html", "head", "title"}
#: Tags that end a caption that was not closed.
_AFTER_CAPTION = {"figure", "article", "section", "body", "html", "header", "footer", "main", "nav", "aside"}
_HIDDEN = {"script", "style", "template", "noscript"}
_DIGEST = re.compile(r"^media:sha256/([0-9a-f]{64})$")


class _Sequence(HTMLParser):
    """Items in document order; a figure's caption goes to the media of that figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = []
        elif tag in _MEDIA:
            attrs = dict(attrs)
            if src := (attrs.get("src") or "").strip():
                self.flush()
                digest = _DIGEST.match(src)
                self.items.append({"kind": "media", "src": src, "digest": digest[1] if digest else None, "caption": attrs.get("alt") or None})
        elif tag in _BLOCK:
            if self.caption is not None and tag in _AFTER_CAPTION:
                self.end_caption()
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.items))

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BLOCK:
            if tag in _AFTER_CAPTION:
                self.end_caption()
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def end_caption(self):
        """Give the caption read so far to its figure's media; one of no figure, or of one without media, is text."""
        if self.caption is None:
            return
        caption, self.caption = " ".join("".join(self.caption).split()), None
        media = [x for x in self.items[self.figures[-1] :] if x["kind"] == "media"] if self.figures else []
        for item in media:
            item["caption"] = caption or item["caption"]
        if caption and not media:
            self.items.append({"kind": "text", "text": caption})

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of an HTML text, of any shape; none for null or empty."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader.end_caption()
    reader.flush()
    none = {"text": None, "digest": None, "src": None, "caption": None}
    return [none | item | {"pos": k} for k, item in enumerate(reader.items)]


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, items): one row per row of ``pages``; items is empty for a null or empty page. Other columns are dropped."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "items": [parse(x) for x in pdf["html"]]})

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {pages.schema[key].dataType.simpleString()}, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def references(parsed: DataFrame) -> DataFrame:
    """The media references of parsed sequences: key, pos, caption, src, digest, and n_items, the length of their sequence."""
    refs = parsed.select("key", F.size("items").alias("n_items"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return refs.select("key", "item.pos", "item.caption", "item.src", "item.digest", "n_items")


def resolve(refs: DataFrame, features: DataFrame) -> DataFrame:
    """References (see references), each with the features of its payload; null features where it names no digest or the store has no
    such one. ``features`` has one narrow row per digest; digests that many pages name are broadcast (see join_hot)."""
    refs = materialize(refs)
    named = refs.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    known = materialize(named.join(features, "digest", "left"))
    found = join_hot(refs.where("digest is not null"), known, "digest", "_n").drop("_n")
    return found.unionByName(refs.where("digest is null"), allowMissingColumns=True)


WIDTH, UNIT = 24, 576


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def store(payload: bytes, n_bytes: int) -> bytes:
    """A binary PGM image, 24 samples to a row; the comment holds the bytes before padding."""
    return b"P5\n# %d\n%d %d\n255\n" % (n_bytes, WIDTH, len(payload) // WIDTH) + payload


def stored(text: str) -> bytes:
    return store(payload_of(text), len(text.encode("utf-8", "surrogatepass")))


def load(media: bytes) -> tuple[int, int, int, bytes]:
    """(n_bytes, width, height, samples) of a stored image."""
    magic, note, size, top, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an image of this store")
    return int(note[2:]), width, height, samples


def features_of(media: bytes) -> tuple:
    n_bytes, width, height, samples = load(media)
    values = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(values, minlength=256) / len(values)
    some = share[share > 0]
    steps = np.abs(np.diff(values.astype(np.int16))).mean()
    feature = f"{width}x{height};mean={values.mean():.6f};std={values.std():.6f};entropy={max(0.0, -(some * np.log2(some)).sum()):.6f};step={steps:.6f};max={values.max()}"
    return n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_store(docs: DataFrame) -> DataFrame:
    """(digest, media): the stored image of every text, copies within a batch once."""

    def run(frames):
        for pdf in frames:
            seen, out = set(), []
            for text in pdf["text"]:
                media = stored(text)
                digest = hashlib.sha256(media).digest()
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest.hex(), media))
            yield pd.DataFrame(out, columns=["digest", "media"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "digest string, media binary")


def store_features(images: DataFrame) -> DataFrame:
    """One row per digest of a store (digest, media): the images are read back where they lie and only their features are shuffled."""
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(d, *features_of(m)) for d, m in zip(pdf["digest"], pdf["media"], strict=True)], columns=["digest", *names])

    made = images.mapInPandas(run, f"digest string, {FEATURES}")
    return made.groupBy("digest").agg(*[F.first(c).alias(c) for c in names])


def page_of(text: str) -> str:
    """A page with the text's paragraphs and, after the first, its stored image, captioned with its length."""
    digest = hashlib.sha256(stored(text)).hexdigest()
    figure = f'<figure><img src="media:sha256/{digest}" alt="text"><figcaption>text, {len(text)} characters</figcaption></figure>'
    first, *rest = [f"<p>{markup.escape(x, quote=False)}</p>" for x in text.split("\n") if x.strip()] or [""]
    return f"<article>{first}{figure}{''.join(rest)}</article>"


def document_media(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the features of its text's stored image as read back, its position in the
    document's sequence of paragraphs and image, the sequence's length, and its caption. A null text is empty, and the empty text one
    padded unit; null ids and repeated rows come back as they are."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "html": [page_of(t) for t in pdf["text"]]})

    pages = docs.select(id_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "key string, html string")
    found = resolve(references(sequences(pages, "key", "html")), store_features(materialize(media_store(docs), "zstd", 500)))
    return found.select(from_key(F.col("key")).alias("doc_id"), *(c.split()[0] for c in FEATURES.split(", ")), "pos", "caption", "n_items")


def page_summary(pages: DataFrame) -> DataFrame:
    """page_id, n_items, n_text, n_media, n_captions, first_text, media (sources in order) of every page of ``pages`` (page_id, html)."""
    of = lambda kind: F.filter("items", lambda x: x["kind"] == kind)
    return sequences(pages, "page_id", "html").select(
        F.col("key").alias("page_id"), F.size("items").cast("long").alias("n_items"), F.size(of("text")).cast("long").alias("n_text"), F.size(of("media")).cast("long").alias("n_media"),
        F.size(F.filter("items", lambda x: x["caption"].isNotNull())).cast("long").alias("n_captions"), F.get(of("text"), F.lit(0))["text"].alias("first_text"), F.array_join(F.transform(of("media"), lambda x: x["src"]), " ").alias("media"),
    )
