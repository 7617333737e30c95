"""Byte-level BPE, media columns and secret scans: round trips and other libraries' results."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest

from textloom.llm import bpe, media, secrets
from textloom.llm.trigrams import trigram_query, trigrams

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("chunk", [32 << 20, 500])
def test_bpe_on_awkward_rows(awkward, awkward_rows, chunk):
    library = bpe.encoder(bpe.rank_table(RANKS), PATTERN)
    found = bpe.encode_documents(awkward, RANKS, PATTERN, chunk_chars=chunk).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in awkward_rows]
    assert sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in found) == sorted((repr(i), a, b) for i, a, b in want)


def test_bpe_digests(spark, nothing):
    texts = ["hello  world\n\n", "", "don't 12  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = bpe.encoder(bpe.rank_table(RANKS), PATTERN)
    for r in bpe.digests(df, RANKS, PATTERN).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
    assert bpe.digests(nothing, RANKS, PATTERN).count() == 0


def test_own_splitting_equals_the_librarys():
    import regex

    library, split = bpe.encoder(bpe.rank_table(RANKS), PATTERN), regex.compile(PATTERN).findall
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "﻿", "\x1c", "\x85"]
    for s in spaces:
        text = f"a{s}b{s}{s} c{s}"
        assert [i for w in split(text) for i in library._encode_single_piece(w)] == library.encode_ordinary(text), hex(ord(s))


def test_packed_numbers():
    import numpy as np

    arrays = [np.array([], dtype=np.uint32), np.array([0, 255]), np.array([256, 1]), np.array([70_000]), np.array([2**31])]
    assert [a.tolist() for a in bpe._unpack(bpe._pack(*arrays))] == [a.tolist() for a in arrays]


def test_media_on_awkward_rows(awkward, awkward_rows, nothing):
    found = media.document_media(awkward).collect()
    want = []
    for i, t in awkward_rows:
        payload = media.payload_of(t or "")
        assert len(payload) % 576 == 0 and payload and payload.startswith((t or "").encode())
        want.append((repr(i), len((t or "").encode()), len(payload), sha(payload), zlib.crc32(payload[-32:])))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == sorted(want)
    assert media.document_media(nothing).count() == 0


def test_stored_images_read_back():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577):
        text = "".join(chr(rng.randrange(32, 0x250)) for _ in range(n))
        payload = media.payload_of(text)
        assert media.load(media.store(payload, len(text.encode()))) == (len(text.encode()), 24, len(payload) // 24, payload)
    with pytest.raises(ValueError):
        media.load(media.store(b"x" * 576, 1)[:-1])


def test_sequences_interleave(spark):
    d = "ab" * 32
    html = f'<h1>T&amp;</h1>lead<script>no</script><figure><img src="media:sha256/{d}"><img src="u.png"><figcaption>both <b>here</b></figcaption></figure><p>end<img src="v.png" alt="own">x<p><figure><figcaption>alone</figcaption>'
    items = media.parse(html)
    assert [(i["kind"], i["text"] or i["src"], i["caption"]) for i in items] == [
        ("text", "T&", None), ("text", "lead", None), ("media", f"media:sha256/{d}", "both here"), ("media", "u.png", "both here"), ("text", "end", None), ("media", "v.png", "own"), ("text", "x", None), ("text", "alone", None),
    ]
    assert [i["pos"] for i in items] == list(range(8)) and items[2]["digest"] == d and items[3]["digest"] is None
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p")], "page_id long, html string")
    parsed = media.sequences(pages, "page_id", "html")
    assert {r["key"]: len(r["items"]) for r in parsed.collect()} == {1: 8, 2: 0, 3: 0, 4: 1}
    features = spark.createDataFrame([(d, 5)], "digest string, size int")
    assert sorted((r["pos"], r["size"]) for r in media.resolve(media.references(parsed), features).collect() if r["size"]) == [(2, 5)]


def test_a_caption_without_end_swallows_nothing():
    page = "<figure><img src=a.png><figcaption>seen</figure><p>after</p><figure><img src=b.png><figcaption>last"
    assert [(i["kind"], i["text"] or i["src"], i["caption"]) for i in media.parse(page)] == [("media", "a.png", "seen"), ("text", "after", None), ("media", "b.png", "last")]


def test_document_pages_hold_the_text():
    text = "first <b> & line\n\nsecond line"
    items = media.parse(media.page_of(text))
    assert [i["kind"] for i in items] == ["text", "media", "text"]
    assert [i["text"] for i in items if i["kind"] == "text"] == ["first <b> & line", "second line"] and items[1]["caption"] == f"text, {len(text)} characters"


def test_real_pages(spark, data):
    from textloom.llm.queries import media_pages

    rows = media_pages(spark, data).collect()
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == set(pages) and any(r["n_text"] for r in rows)
    for r in rows:
        assert r["n_items"] == r["n_text"] + r["n_media"] == len(media.parse(pages[r["page_id"]]))


BASE = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16)]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least)


def test_secrets_equal_brute_force(spark, awkward, awkward_rows, nothing):
    rng = random.Random(6)
    parts = ["token", "Api_Key", "PASSWORD", " = ", ":", '"', "'", "=", " ", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "dead", "é", "🙂", "\n", "x.y/z", "secret", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["token=api_key: longlonglonglong", 'password"x token="abc" secret = "aaaaaaaaaaaa"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [*zip(texts, [secrets.scan(df).where(f"doc_id < {len(texts)}").collect()], strict=False)]
    found = {r["doc_id"]: r for r in rows[0][1]}
    for i, text in enumerate(texts):
        spans = brute_spans(text)
        listed = ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in spans)
        r = found[i]
        assert r["base_sha256"] == sha(listed.encode()) and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)], text
    assert secrets.scan(awkward).count() == len(awkward_rows) and secrets.scan(nothing).count() == 0


def test_more_rules_and_redaction(spark, awkward, awkward_rows):
    text = "é ghp_" + "a1" * 18 + " https://user:passw@host token=abcdefabcdefabcdef end"
    df = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "clean", 1)], "doc_id long, text string, try int")
    kinds = [x.split(":")[0] for x in secrets.scan(df).where("doc_id = 1").first()["spans"].split(",")]
    assert kinds == ["forge", "login", "assign", "hex"] or "forge" in kinds and "login" in kinds
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean == {1: "é [SECRET] [SECRET]host [SECRET] end", 2: None, 3: "clean"}
    made = secrets.redact(awkward)
    assert made.columns == awkward.columns and made.count() == len(awkward_rows)


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigrams_are_mandatory(rule):
    samples = {
        "assign": ["Passwd='x'", "API_KEY: y", "apikey=z", "token =q"], "access": ["AKIAX"], "forge": ["ghs_" + "x" * 36], "chat": ["xoxb-1234567890"], "cloud": ["AIza" + "x" * 35],
        "payment": ["rk_live_" + "x" * 16], "private": ["-----BEGIN RSA PRIVATE KEY-----"], "bearer": ["eyJ" + "x" * 10 + ".eyJ" + "y" * 10 + "." + "z" * 8], "login": ["ftp://a:bcde@"],
    }.get(rule.kind, [])

    def holds(query, text):
        if query is True or isinstance(query, str):
            return query is True or query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    query = trigram_query(rule.pattern)
    for text in samples:
        assert re.search(rule.pattern, text) and holds(query, text.lower())
    assert (query is True) == (rule.kind == "hex") and all(len(t) == 3 for t in trigrams(query))
