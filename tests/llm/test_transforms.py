"""Fill-in-middle, the WARC archive and phrase mining against plain Python, and on odd tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replimerge.llm import infill, phrases, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    for c in ("n", "form", "output", "__t", "__d", "__h1", "head", "digest", "payload", "phrase", "rank", "words", "key", "known", "a", "score"):
        df = df.withColumn(c, F.lit("own"))
    return df


# --- 11 fill in middle ---


def plain_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_pieces_against_plain_python(spark):
    rng = random.Random(3)
    alphabet = ["a", "Zz", " ", "\n", "\r\n", "é", "漢", "😀", "\x00", "<", ">", "P", "<P", "M>", ".", "0", " ", "�"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)] + ["<S>", "x<M>y", "", None, "word", "é" * 5, "ab " * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = infill.fill_in_middle(clashing(df)).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = sorted(map(tuple, done.collect()), key=str)
    want = sorted(((i, *plain_fim(i, t or ""), t or "") for i, t in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_portions_hold_all_rows():
    text = pa.array(["a" * 5, None, "b" * 50, "c", "d" * 9, ""])
    assert list(infill.portions(text, 10)) == [(0, 2), (2, 1), (3, 3)]
    assert list(infill.portions(text.slice(0, 0), 10)) == []


def test_fill_in_middle_of_an_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


# --- 12 WARC ---


def parse_warc(data):
    """Records of a WARC file by their Content-Length alone."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if x)
        stop = end + int(fields[b"Content-Length"])
        out.append((fields, data[end:stop]))
        assert data[stop : stop + 4] == b"\r\n\r\n"
        at = stop + 4
    return out


PAGES = [
    (1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (4, "http://c/\r\nX: y", "other\r\n\r\nWARC/1.1\r\n"), (6, "http://d/é", None), (2, "", ""), (9, "u", "tie"), (9, "v", "tie"), (8, "w", "tie"),
    (None, "n", "no id"), (None, "m", "same"), (-3, "neg", "x" * 300_000),
]


def test_pages_come_back_from_the_archive(spark, tmp_path):
    pages = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4))
    warc.archive_pages(pages, f"{tmp_path}/a")
    got = sorted((tuple(r) for r in warc.read_pages(spark, f"{tmp_path}/a").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        chosen = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        kind = "response" if page == chosen else "revisit"
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, chosen if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").collect()
    assert sorted(bytes(r.payload) for r in stored) == sorted({(h or "").encode() for _, _, h in PAGES})

    warc.write_warc(warc.read_records(spark, f"{tmp_path}/a").repartition(2), f"{tmp_path}/files")
    records = [r for f in sorted((tmp_path / "files").glob("part-*")) for r in parse_warc(f.read_bytes())]
    assert len(records) == len(PAGES) and len(list((tmp_path / "files").glob("part-*"))) > 1
    kinds = Counter((f[b"WARC-Type"], f[b"WARC-Record-ID"]) for f, _ in records)
    assert kinds == Counter((k.encode(), f"<urn:x-page:{'' if p is None else p}>".encode()) for p, _, _, k, _ in want)
    for fields, block in records:
        head, body = block.split(b"\r\n\r\n", 1)
        assert head.startswith(b"HTTP/1.1 200 OK")
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(body).digest())
        else:
            assert body == b"" and fields[b"WARC-Refers-To"].startswith(b"<urn:x-page:")


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.archive_pages(pages, f"{tmp_path}/a", least=3)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_pages(spark, f"{tmp_path}/a").collect()}
    assert got == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_lost_and_changed_payloads_are_errors(spark, tmp_path):
    headers = spark.createDataFrame([(b"h", "0" * 64)], "head binary, digest string")
    warc.write_archive(headers, spark.createDataFrame([(b"p",)], "payload binary"), f"{tmp_path}/lost")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_records(spark, f"{tmp_path}/lost").collect()
    headers.write.parquet(f"{tmp_path}/bad/headers")
    spark.createDataFrame([("0" * 64, b"p")], "digest string, payload binary").write.parquet(f"{tmp_path}/bad/payloads")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_records(spark, f"{tmp_path}/bad").collect()


def test_archive_of_an_empty_table(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.read_pages(spark, f"{tmp_path}/a").collect() == []


# --- 13 phrases ---


def plain_phrases(rows, least, most=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or any(q_lang == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (q_lang, q), b in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang in out for i, (s, a, p, l, r) in enumerate(sorted(out[lang])[:top])]


def phrase_rows(seed=5, n=160):
    rng = random.Random(seed)
    vocabulary = {"en": ["the", "Of", "a", "new", "York", "CITY", "x", "ÄB"], "fr": ["le", "la", "ÉTÉ", "de"], None: ["q", "r"], "": ["q", "r"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocabulary))
        words = rng.choices(vocabulary[lang], k=rng.randrange(60))
        if i % 5 == 0:
            words += ["once", "upon", "a", "time", "there", "was"]
        rows.append(("".join(w + rng.choice([" ", " ", "\t ", ", ", ".\n", "!", "\r", " "]) for w in words), lang))
    return [*rows, (None, "en"), ("", "en"), (" \t\n.", None), ("same same same same", "en"), ("same same same same", "en")]


@pytest.mark.parametrize("sample", [1, 3, 1000])
@pytest.mark.parametrize("portion", [200, 8_000_000])
def test_phrases_against_plain_python(spark, sample, portion):
    rows = phrase_rows()
    df = clashing(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3))
    got = sorted(map(tuple, phrases.collocations(df, least=12, top=30, sample=sample, portion=portion).collect()))
    assert got == sorted(plain_phrases(rows, 12, top=30))
    assert max(len(r[2].split(" ")) for r in got) > 2 and {r[0] for r in got} >= {"fr", "und", ""}


@pytest.mark.parametrize("bits", [64, 256, 1024])
def test_chance_finds_of_the_filters_change_nothing(spark, monkeypatch, bits):
    """Filters so small that they have much that was never put in."""
    monkeypatch.setattr(phrases, "FEWEST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rows = phrase_rows(21, 250)
    rows += [(" ".join([f"{a}{b}"] * 12), "en") for a in "abcdefgh" for b in "stuvwxyz"]  # repeated words, each in one text alone
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(df, least=9, sample=5).collect())) == sorted(plain_phrases(rows, 9))


def test_a_poor_proposal_changes_nothing(spark):
    rows = phrase_rows(9, 60)
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    for lowered in (0.0, 50.0):  # everything is proposed, almost nothing is
        assert sorted(map(tuple, phrases.collocations(df, least=8, sample=2, lowered=lowered).collect())) == sorted(plain_phrases(rows, 8))


def test_products_beyond_64_bits(spark):
    big = 10**9 * 7
    assert 1000 * big * big > 2**63
    counts = [("en", "", 0, big * 3), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, words int, n long")
    keep = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *a, **k: frame
    try:
        row = phrases.collocations(spark.createDataFrame([], DOCS)).collect()
    finally:
        phrases.frequent_phrases = keep
    assert [tuple(r) for r in row] == [("en", 1, "a b", big - 2, big, big - 1, big * 3, 1000 * (big - 2) * big * 3 // (big * (big - 1)))]


def test_cuts_end_at_texts_and_pieces():
    data = np.frombuffer(b"aa bb. cc dd ee ff gg.hhhh", np.uint8)
    starts = np.array([0, 3, 3, 22, 26])
    assert list(phrases._cuts(data, starts, 8)) == [(0, 3), (3, 6), (6, 21), (21, 26)]


def test_filter_has_what_was_put_in(spark):
    keys = spark.range(1000).select(F.expr("xxhash64(id) & 1099511627775").alias("key"))
    have = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    f = phrases.filter_of(keys)
    assert f.has(have).all() and f.has(have ^ np.uint64(1)).mean() < 0.02
    both = phrases.Filter((np.zeros(1, np.uint64),)) | f
    assert both.has(have).all() and not phrases.Filter(()).has(have).any() and not phrases.filter_of(keys.limit(0)).has(have).any()


def test_phrases_odd(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    long_ = "one two three four five " * 40_000
    rows = [(1, long_, "en"), (None, long_, None), (2, None, None)]
    got = phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1).collect()
    assert {(r.lang, r.n) for r in got} == {("en", 200_000), ("und", 200_000)} and len(got) == 10 and all(len(r.phrase.split()) == 5 for r in got)
