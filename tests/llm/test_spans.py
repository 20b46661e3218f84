"""Secrets and personal data against plain regular expressions and counts."""

import hashlib
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import empty, odd, odd_rows, prose
from tidemark.llm import personal, secrets
from tidemark.llm.common import CHUNK, prefix_sums


def secret_base(t):
    out = []
    assign = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def personal_base(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


HARD = [
    'api_key="abcdefgh" APIKEY : abcdefg token=secret=abcdefgh1 token: secret: abcdefghij ſecret=abcdefgh toKen=abcdefgh',
    "AKIAAKIA AKIA0123456789AB AKIA0123456789A xAKIA" + "Z" * 40, "password= " + " " * 500 + "x", "é" * 40 + "deadbeef" * 4 + "0" * 31,
    "a@b.c_x@d.e x@y..z .@a.b a@b@c.d %@-.-.-", "0.0.0.0 256.1.1.1 1.2.3.4.5.6.7.8 00255.1.01.001 9.99.999.9999 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 1234567890123456789012 4111  1111", "+1 (988) 555-2485 ++49 30 1234567 +1- +12 +999999999999999999",
    "漢\U0001f600 a@b.cd 漢 4111111111111111 \U0001f600+1 988 555 24 85", "a@" + "b." * 3000 + "c", "1" * 20_000 + ".1.1.1", "12 " * 7000, "+1" + " " * 9000 + "2",
    'password="' + "a" * 300 + "' token = x", "@@@@", "....",
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("source", F.lit("s"))


def test_base_spans(spark, hard):
    for got, base in ((secrets.secret_spans(hard), secret_base), (personal.personal_spans(hard), personal_base)):
        for r in got.collect():
            spans = base(HARD[r.doc_id])
            assert r.base_sha256 == digest(spans), HARD[r.doc_id][:80]
            kinds = ("assign", "access", "hex") if base is secret_base else ("email", "ip", "card", "phone")
            assert [r[f"n_{k}"] for k in kinds] == [sum(s[3] == k for s in spans) for k in kinds]
            assert set(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(spark):
    want = [(i, t or "") for i, t, *_ in odd_rows()]
    for got, base in ((secrets.secret_spans(odd(spark)), secret_base), (personal.personal_spans(odd(spark)), personal_base)):
        rows = sorted((str(r.doc_id), r.base_sha256) for r in got.collect())
        assert rows == sorted((str(i), digest(base(t))) for i, t in want)


def test_prefix_sums_of_long_arrays(spark):
    got = spark.range(3).select(prefix_sums(F.sequence(F.lit(1), (F.col("id") * 700 + 1).cast("int"))).alias("s")).collect()
    for i, r in enumerate(got):
        n = i * 700 + 1
        assert r.s == [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert spark.range(1).select(prefix_sums(F.array().cast("array<int>")).alias("s")).first().s == []


def test_prefix_sums_beyond_every_chunk(spark):
    for n in (CHUNK, CHUNK + 1, CHUNK**2, CHUNK**2 + 1):
        got = spark.range(1).select(prefix_sums(F.sequence(F.lit(1), F.lit(n))).alias("s")).first().s
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_many_matches_in_one_text(spark):
    """100,000 addresses in one text: positions are found in linear work, and the digests are those of the base spans."""
    text = " ".join(f"u{i}@h{i}.example.com 10.0.{i // 250}.{i % 250} token=abcd{i:06d}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "u7@h7.example.com alone", "s")], "doc_id long, text string, source string")
    start = time.time()
    for got, base in ((secrets.secret_spans(docs), secret_base), (personal.personal_spans(docs), personal_base)):
        assert {r.doc_id: r.base_sha256 for r in got.collect()}[1] == digest(base(text))
    assert time.time() - start < 120


def test_ownership_separates_examples_from_live_secrets(spark):
    rows = [(i, f"owner{i % 4}", 'token = "abcd1234efgh5678"') for i in range(12)]
    rows += [(20, "owner0", "token=zq91yk82xv73 ghp_" + "a1B2" * 10), (21, "owner0", "token=zq91yk82xv73"), (22, "owner9", "password=changeme")]
    rows += [(30 + i, f"owner{i}", "see ghp_" + "Z9y8" * 10) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    assert all((got[i].n_assign, got[i].n_example, got[i].n_live) == (1, 1, 0) for i in range(12))
    assert (got[20].n_live, got[21].n_live) == (2, 1) and "format:19:" in got[20].spans
    assert (got[22].n_live, got[22].n_example, got[22].n_assign) == (0, 0, 1)  # a word, not a live-looking key
    assert all(got[30 + i].spans == "" for i in range(5))  # a format token that five owners share


def plain_terms(texts, base, contexts=2, discloses=0.8):
    """(doc, start, end, action) of disclosing terms; contexts are up to 64 characters from the gap next to a span."""
    n = len(texts)
    df = {}
    for t in texts:
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            df[w] = df.get(w, 0) + 1
    near, entity_docs = [], {}
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",)
    for d, t in enumerate(texts):
        matches = list(re.finditer(patterns[0], t))
        for k, m in enumerate(matches):
            low = matches[k - 1].end() if k else 0
            high = matches[k + 1].start() if k + 1 < len(matches) else len(t)
            before, after = t[max(low, m.start() - 64) : m.start()], t[m.end() : min(high, m.end() + 64)]
            e, c = m[0].lower(), (before.lower(), after.lower())
            entity_docs.setdefault(e, set()).add(d)
            for w in re.finditer(r"[^\W_]+", before):
                if w.start() > 0 or len(before) < 64:
                    near.append((d, e, c, w[0].lower(), m.start() - len(before) + w.start(), m.start() - len(before) + w.end()))
            for w in re.finditer(r"[^\W_]+", after):
                if w.end() < len(after) or len(after) < 64:
                    near.append((d, e, c, w[0].lower(), m.end() + w.start(), m.end() + w.end()))
    near = [x for x in near if len(x[3]) >= 3]
    out = set()
    for d, e, _, w, a, b in near:
        if len({x[2] for x in near if x[1] == e and x[3] == w}) < contexts:
            continue
        both = len({x[0] for x in near if x[1] == e and x[3] == w})
        of = len(entity_docs[e])
        information = math.log2(n / of)
        ratio = math.log2(n * both / (of * df[w])) / information if information > 0 else 0.0
        if ratio >= discloses:
            out.add((d, a, b, "remove" if ratio >= 0.95 else "generalise"))
    return out


def test_disclosing_terms(spark):
    texts = [prose(i, 30) for i in range(60)]
    for i in (3, 4, 5):  # the nickname stands by this address only
        texts[i] = prose(100 + i, 10) + " the Quux wrote to quentin@mail.example.com from and " + prose(200 + i, 10)
    texts[6] = "zebra zebra the quux is here"
    texts[7] = texts[3]
    texts[8], texts[9] = "two copies by solo@mail.example.com only", "two copies by solo@mail.example.com only"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal.personal_spans(docs).collect()
    got = {(r.doc_id, s.start, s.end, s.action) for r in rows for s in r.all_spans if s.rank == 4}
    assert got == plain_terms(texts, None)
    found = {texts[d][a:b].lower() for d, a, b, _ in got}
    assert "quux" in found and "the" not in found and "copies" not in found
    cleaned = personal.personal_spans(docs).join(docs, "doc_id").withColumn("clean", personal.sanitised(F.col("text"), F.col("all_spans")))
    clean = {r.doc_id: r.clean for r in cleaned.collect()}
    assert "quux" not in clean[3].lower() and "[email]" in clean[3] and "quux" in clean[6]
    for d, t in enumerate(texts):
        spans = sorted((s.start, s.rank, s.end, s.action) for r in rows if r.doc_id == d for s in r.all_spans)
        out, at = "", 0
        for a, rank, b, action in spans:
            if a >= at:
                out += t[at:a] + ("" if action == "remove" else f"[{personal.KINDS[rank]}]")
                at = b
        assert clean[d] == out + t[at:]


def test_disclosing_terms_anywhere_in_the_document(spark):
    """A name far from the address: counted over whole documents, marked at every place; against plain counts."""
    texts = [prose(i, 60) for i in range(60)]
    for i in (3, 4, 5, 6):  # near once, far twice, and in the heading only
        close = "Quux " if i == 3 else ""
        texts[i] = f"Zorblat {prose(300 + i, 40)} Quux {prose(400 + i, 40)} {close}quentin@mail.example.com {prose(500 + i, 40)} the QUUX"
    texts[7] = texts[3]
    texts[8], texts[9] = ("xylo " + prose(8, 40) + " solo@mail.example.com",) * 2  # copies count once
    texts[10] = "zorblat " + prose(10, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = personal.personal_spans(docs).collect()
    got = {(r.doc_id, s.start, s.end, s.action) for r in rows for s in r.all_spans if s.rank == 4}
    n, address = len(texts), re.compile(r"[a-z]+@mail\.example\.com")
    held = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    want = set()
    for e in ("quentin@mail.example.com", "solo@mail.example.com"):
        of = [d for d, t in enumerate(texts) if e in t]
        for w in {w for d in of for w in held[d] if len(w) >= 3}:
            both = [d for d in of if w in held[d]]
            df = sum(w in h for h in held)
            ratio = math.log2(n * len(both) / (len(of) * df)) / math.log2(n / len(of))
            if len({texts[d] for d in both}) >= 2 and ratio >= 0.8:
                for d in both:
                    spans = [m.span() for m in address.finditer(texts[d])]
                    for m in re.finditer(r"[^\W_]+", texts[d]):
                        if m[0].lower() == w and not any(a <= m.start() < b for a, b in spans):
                            want.add((d, *m.span(), "remove" if ratio >= 0.95 else "generalise"))
    assert got == want
    found = [(d, texts[d][a:b]) for d, a, b, _ in got]
    assert all(found.count((d, w)) == k for d in (3, 4, 5, 6, 7) for w, k in (("Zorblat", 1), ("QUUX", 1), ("Quux", 2 if d in (3, 7) else 1)))
    assert not any(d in (8, 9, 10) for d, _ in found)


def test_empty_tables(spark):
    assert secrets.secret_spans(empty(spark)).count() == 0
    assert personal.personal_spans(empty(spark)).count() == 0
