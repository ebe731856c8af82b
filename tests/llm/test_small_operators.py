"""URL filter, secret scan, quality rules, sharding and personal data against brute force, and on edge cases."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from notelake.llm import pii, quality, secrets, sharding, urls

LONG = "word " * 40_000


@pytest.fixture
def docs(spark):
    """Documents with clashing extra columns."""
    return lambda *texts: spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


# URLs


def test_rules_longest_wins(spark):
    rows = [("https://www.A.example.net/en/x?q", "example.net/en/", "allow"), ("http://example.net/de", "net/", "block"), ("http://x.example.com/de/1#y", "example.com/de/", "block"), ("https://a.net", None, None), ("https://badexample.org/fr/", "org/fr/", "allow"), (None, None, None), ("nothing", None, None), ("", None, None)]
    got = urls.judge_urls(spark.createDataFrame([(i, r[0], "z") for i, r in enumerate(rows)], "page_id long, url string, verdict string")).orderBy("page_id").collect()
    assert [r.rule for r in got] == [r[1] for r in rows]
    assert [r.verdict for r in got if r.rule] == [r[2] for r in rows if r[1]]
    assert (got[0].host, got[0].path) == ("www.a.example.net", "/en/x") and (got[3].host, got[3].path) == ("a.net", "")
    assert [(r.host, r.path) for r in got[5:]] == [("", "")] * 3 and {r.verdict for r in got} <= {"allow", "block"}


def test_model_on_hosts_it_has_not_seen(spark):
    bad = ["mega-casino.example.com", "best-poker-slots.test", "cheap-viagra-pills.example.com", "track-ads.example.com", "fast-payday-cash.test", "hot-adult-video.test"]
    good = ["city-museum.example.com", "school-library.test", "garden-notes.example.com", "science-journal.test", "open-maps.example.com", "town-theatre.test"]
    got = urls.judge_urls(spark.createDataFrame([(f"https://{h}/en/12",) for h in bad + good], "url string")).collect()
    right = sum((r.verdict == "block") == (r.host in bad) for r in got)
    assert right >= 10
    assert urls.judge_urls(spark.createDataFrame([], "url string")).count() == 0


# Secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


SECRETS = (
    "token:token:abcdef PassWord = 'hunter2x' é😀 api_key=\"" + "0a" * 20 + '"', "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 12, "secret: short token=abcde", "f" * 24 + "g" + "0" * 23,
    None, "", LONG + " passwd:abcdef", "token=abcdefg\ntoken = xyz12345", "token=abcdefg\ntoken = xyz12345",
)


def test_secret_spans_and_ledger(spark, docs):
    versions = docs(*SECRETS)
    ledger, found = secrets.scan(versions, secrets.empty_ledger(spark), "doc_id")
    base = [r.kind for r in secrets.BASE_RULES]
    got = {r.path: r.s for r in found.select("path", secrets.span_text(F.col("spans"), base).alias("s")).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(SECRETS)}
    assert ledger.count() == len({t or "" for t in SECRETS})
    more = versions.unionByName(docs("token=abcdefgh"))
    assert secrets.scan_unseen(more, ledger).count() == 1
    newer = (*secrets.RULES, secrets.Rule("pin", 1, "[0-9]{4}", 4))
    fresh = secrets.scan_unseen(versions, ledger, newer).collect()
    assert len(fresh) == ledger.count() and all(set(r.findings) == {"pin@1"} for r in fresh)
    assert secrets.scan(docs().limit(0), ledger, "doc_id")[1].count() == 0


def test_more_secret_kinds_do_not_touch_base_spans(spark, docs):
    text = "x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJlLWhlcmU ghp_" + "a1B2" * 6
    _, found = secrets.scan(docs(text), secrets.empty_ledger(spark), "doc_id")
    assert {s.kind for s in found.first().spans} == {"jwt", "forge"}


# Quality


def test_quality_counts_and_verdicts(docs):
    import random

    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "ter", "sol", "an", "de") for b in ("", "n", "ri", "st", "la", "mo")]
    prose = " ".join(rng.choice(words) for _ in range(600))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ ") for _ in range(9000))
    texts = (prose, "one two three four five six seven", "a b c d e\n" * 30, noise, None, "", "x#\n\n x \nx#\n" + " ".join(map(str, range(20))))
    got = [r.quality for r in quality.with_quality(docs(*texts)).orderBy("doc_id").collect()]
    assert [r.kept for r in got[:6]] == [True, False, False, False, False, False]
    assert not got[3].base_failed and got[2].base_failed and got[2].n_repeat_words == 150 and got[2].n_dup_lines == 29
    assert (got[6].n_words, got[6].n_symbols, got[6].n_dup_lines, got[6].word_chars) == (23, 2, 1, 35)
    assert [r.doc_id for r in quality.keep_good(docs(*texts)).collect()] == [0, 6]
    assert quality.keep_good(docs(*texts)).columns == ["doc_id", "text", "spans"]


def test_repeated_windows():
    assert quality.base_counts("a b c d e x a b c d e")[4] == 10
    assert quality.base_counts("a a a a a a")[4] == 6 and quality.base_counts("a b c d e")[4] == 0


# Sharding


def brute_shard(key, n):
    import math

    score = lambda i: -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return min(range(n), key=score)


def test_sharding(spark):
    rows = [(i, f"t{i % 7}") for i in range(500)] + [(None, None), (3, "t3"), (3, "t3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.with_slots(sharding.assign_shards(df, "doc_id", [1.0] * 16).withColumn("grown", sharding.rendezvous(F.col("doc_id"), [1.0] * 17)), "shard", ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    assert all(r.shard == brute_shard("null" if r.doc_id is None else r.doc_id, 16) for r in got)
    assert all(r.grown in (r.shard, 16) for r in got) and any(r.grown == 16 for r in got)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    heavy = sharding.assign_shards(df, "doc_id", [3.0, 1.0]).groupBy("shard").count().collect()
    assert dict(map(tuple, heavy))[0] > 300


def test_sharding_query_fields(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op6_sharding(spark, str(tmp_path)).collect()}
    assert (got[1].size, got[1].text_crc32) == (3, zlib.crc32("é".encode())) and (got[2].size, got[2].text_crc32) == (1, 0)


# Personal data


def brute_personal(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and pii.luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    import random

    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "@@z.z", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-4567", "+1-", "12", ".", "..", "-", " ", "é", "\n", "a", "%", "0" * 20, "+1 202 555 0143", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute_personal(text), text


def test_random_field_follows_repetitions(docs):
    far = "some plain words here " * 60
    texts = ("Call +1 (202) 555-0143 now. " + far + "Again: 12025550143 please.", "The count is 1234567 and page 17 of 2024.", None, "", LONG)
    got = pii.find_personal_data(docs(*texts)).orderBy("doc_id").collect()
    added = got[0].personal_data.added
    assert [(s.kind, texts[0][s.start : s.end]) for s in added] == [("phone", "12025550143")]
    assert all(not r.personal_data.base and not r.personal_data.added for r in got[1:])
    assert pii.redact(docs("to a@b.cc x", None)).orderBy("doc_id").first().text == "to [email] x"


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    unary, edges = np.array([[0.2, 1.0], [0.5, 0.1], [0.0, 0.3]]), [(0, 1, pii.CHAIN), (1, 2, pii.SKIP)]
    pair = np.array([[[0.7, -0.2], [-0.2, 0.1]], [[1.5, 0.0], [0.0, 0.4]]])
    weight = {y: np.exp(sum(unary[i, y[i]] for i in range(3)) + sum(pair[k, y[a], y[b]] for a, b, k in edges)) for y in itertools.product((0, 1), repeat=3)}
    exact = np.array([[sum(w for y, w in weight.items() if y[i] == k) for k in (0, 1)] for i in range(3)]) / sum(weight.values())
    assert np.allclose(pii.marginals(unary, edges, pair), exact, atol=1e-3)


def test_fitted_bands_reject_labelled_bad_and_keep_good(spark):
    """Fitted on the even ids, judged on the odd ones."""
    sf = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    limits = quality.fitted(docs, labels.filter("doc_id % 2 = 0"))
    odd = labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("label"))
    rows = quality.with_quality(docs.join(odd, "doc_id"), **limits).select("label", "quality.*").filter("not base_failed").collect()
    n = lambda label, kept: sum(r.label == label and r.kept == kept for r in rows)
    assert n(0, False) > n(0, True) and n(1, False) <= 0.005 * n(1, True), (n(0, False), n(0, True), n(1, False), n(1, True))
    chunked = [r for r in rows if r.n_chunks]
    outside = lambda label: sum(r.n_bad_chunks > quality.CHUNK_SHARE * r.n_chunks for r in chunked if r.label == label)
    assert outside(0) >= 0.9 * sum(r.label == 0 for r in chunked) and outside(1) == 0
    assert quality.fitted(docs, labels.limit(0))["bands"] == tuple((e, *next(b[1:] for b in quality.DOCUMENT_BANDS if e <= b[0])) for e in quality.FITTED_EDGES)


def test_bands_lie_between_good_and_bad():
    good = [(900, 0.5 + i / 1000, True, 1) for i in range(100)]
    assert quality.fitted_bands(good, edges=(1024, 4096)) == ((1024, 0.25, 0.82), (4096, 0.22, 0.76))
    assert quality.fitted_bands([*good, (900, 0.4, False, 3), (900, 0.55, False, 9)], edges=(1024,)) == ((1024, 0.45, 0.82),)
    assert quality.fitted_bands([*good, (900, 0.499, False, 3), (900, 0.7, False, 1)], edges=(1024,)) == ((1024, 0.496, 0.6495),)
    assert quality.fitted_bands([(900, 0.5, True, 19), (900, 0.4, False, 3)], edges=(1024,)) == ((1024, 0.25, 0.82),)


def test_chunks_cover_every_byte():
    for n in (0, 1, 4, 5, 8, 9, 13):
        raw = bytes(range(n))
        chunks = quality.chunks_of(raw, 4)
        assert all(len(c) == 4 for c in chunks) and (n <= 4) == (not chunks) and (n <= 4 or set(b"".join(chunks)) == set(raw))


def test_one_bad_stretch_and_repeated_rows(spark):
    import random

    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(9000))
    docs = spark.createDataFrame([(1, prose(6000), 7), (1, prose(6000), 7), (2, prose(2000) + noise + prose(2000), 8), (None, None, None)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality long, good int")
    got = quality.with_quality(docs, out="verdict", **quality.fitted(docs, labels, most=5)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.quality, r.verdict.kept) for r in got] == [(None, None, False), (1, 7, True), (1, 7, True), (2, 8, False)]


def test_marginals_of_long_chains_are_exact():
    import numpy as np

    n, k = 60, len(pii.LABELS)
    unary = np.zeros((n, k))
    unary[0, 4] = 10
    pair = np.stack([np.zeros((k, k)), 6.0 * np.eye(k)])
    agree = np.exp(pair[pii.SKIP])
    left, right = [np.ones(k)], [np.ones(k)]
    for i in range(n - 1):
        a, b = agree @ (left[-1] * np.exp(unary[i])), agree @ (right[-1] * np.exp(unary[n - 1 - i]))
        left.append(a / a.sum())
        right.append(b / b.sum())
    exact = np.array(left) * np.array(right[::-1]) * np.exp(unary)
    got = pii.marginals(unary, [(i, i + 1, pii.SKIP) for i in range(n - 1)], pair)
    assert np.allclose(got, exact / exact.sum(1, keepdims=True), atol=1e-4)
    assert (got[:, 4] >= pii.ACCEPT).sum() > 50


def test_learnt_potentials_agree_with_their_sense():
    _, pair = pii.weights()
    phone, card = pii.LABELS.index("phone"), pii.LABELS.index("card")
    skip = pair[pii.SKIP]
    assert all(skip[k, k] > max(skip[k, j] for j in range(len(pii.LABELS)) if j != k) for k in range(len(pii.LABELS)))
    assert pair[pii.CHAIN][phone, phone] > pair[pii.CHAIN][phone, 0] and pair[pii.CHAIN][card, card] < pair[pii.CHAIN][phone, phone]


def held_out(rng):
    """Documents with personal data that no pattern finds, and what is to be found; numbers, names and order are drawn anew."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    far = " ".join(rng.choice(["garden", "river", "stone", "evening", "letter"]) for _ in range(rng.randint(30, 200)))
    phone = f"+1 ({d(3)}) 555-{d(4)}"
    yield f"{far} {phone} 203.0.113.{rng.randint(1, 255)} {far}", [phone]
    a, b, c = "2" + d(2), d(3), d(4)
    yield f"reach +1 ({a}) {b}-{c} now {far} again {a}.{b}.{c} or {a}{b}{c} {far}", [f"{a}.{b}.{c}", f"{a}{b}{c}"]
    card = next(x for x in iter(lambda: "4" + d(15), None) if pii.luhn(x))
    spaced = "/".join(card[i : i + 4] for i in range(0, 16, 4))
    yield f"paid with {card} {far} later {spaced} {far} and order {d(12)}", [spaced]
    name = f"{rng.choice(['mia', 'tom', 'eva'])}.{d(2)}x"
    yield f"write {name}@mail.example.org {far} or {name}@mailhost {far} in {d(4)}", [f"{name}@mailhost"]
    ip = [str(rng.randint(100, 255)) for _ in range(4)]
    yield f"from {'.'.join(ip)} {far} and {'-'.join(ip)} too {far} version 3.{d(1)}.{d(1)}", ["-".join(ip)]
    bad = next(x for x in iter(lambda: "9" + d(15), None) if not pii.luhn(x))
    yield f"order {bad} {far} again {bad} and serial {d(12)} {far} on 2024-05-{d(2)} page {d(2)} sum {d(2)}.{d(2)}", []


def test_national_numbers_behind_a_word_for_phones():
    """Numbers without a country's code: labelled documents hold such forms, but none of these numbers; and numbers that are none."""
    for text, want in (("my phone 0301234567 and again 0301234567", ["0301234567"] * 2), ("call 415-555-2671 now", ["415-555-2671"]), ("order 0301234567 and 415-555-2671 are parts", []), ("x" * 300 + "1234567 is a name", [])):
        assert [text[a:b] for a, _, b in pii.crf_spans(text, pii.base_spans(text))] == want


def test_tokens_are_judged_whole():
    assert pii.alike("1." + "x" * 300 + "2.3.4") == pii.alike("1-2-3-4") == "1.2.3.4"
    assert pii.features("", "(" + "1" * 300 + ")")[pii.FEATURES.index("all_digits")] == 1
    assert pii.features("", "1" * 100 + "a" * 100 + "1" * 100)[pii.FEATURES.index("all_digits")] == 0


def test_added_spans_of_held_out_documents():
    import random

    rng = random.Random(13)
    caught = wanted = wrong = 0
    for text, want in (x for _ in range(40) for x in held_out(rng)):
        got = [text[a:b] for a, _, b in pii.crf_spans(text, pii.base_spans(text))]
        caught += sum(w in got for w in want)
        wanted += len(want)
        wrong += sum(g not in want for g in got)
    assert caught >= 0.9 * wanted and wrong <= 0.05 * wanted, (caught, wanted, wrong)


def test_personal_data_in_long_runs_takes_linear_time():
    import time

    for text in ("a" * 1_000_000, "7" * 1_000_000, "x" * 500_000 + "7", "@" * 100_000, "+1 (226) 555-4081 " * 3000):
        began = time.process_time()
        pii.crf_spans(text, pii.base_spans(text))
        assert time.process_time() - began < 3
