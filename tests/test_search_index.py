"""Substring, similarity, phrase and ranked search against brute force on small tables with awkward rows."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from notelake.operators import enrich as E
from notelake.operators import fulltext as X
from notelake.operators import grams as Gr
from notelake.operators import search as S

QUERY = "qid int, text string, language string, type string"


def random_texts(rng, n, letters="abcdeé ", most=40):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("rows_per_salt", [200_000, 3])
def test_substrings_equal_brute_force(spark, monkeypatch, rows_per_salt):
    monkeypatch.setattr(Gr, "ROWS_PER_SALT", rows_per_salt)
    rng = random.Random(1)
    texts = random_texts(rng, 150) + [None, "", "a", "ab", "日本語", "😀x", "abc" * 4000]
    asked = sorted({t[i : i + rng.randint(1, 8)] for t in filter(None, texts) for i in [rng.randrange(len(t))]} | {"zzz", "z", "", "日本", "😀"})
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, part string")
    index = Gr.build_grams(rows, "k", F.col("t"))
    got = {(r.qid, r.id) for r in Gr.holders(rows, "k", F.col("t"), index, q, "part").collect()}
    assert got == {(i, k) for i, part in enumerate(asked) for k, t in enumerate(texts) if part and t is not None and part in t}
    moved = sum(len(r.gram) for r in index.rows.collect())
    assert moved <= 3 * sum(len(t) for t in texts if t)


def item_rows(spark, texts):
    return spark.createDataFrame([(f"vocabulary|de|{t}", t, i % 5, "vocabulary", "de") for i, t in enumerate(texts)], "item_key string, normalized string, seen_count int, type string, language string")


def test_similar_texts_equal_brute_force_and_few_are_scored(spark):
    rng = random.Random(2)
    roots = ["".join(rng.choice("abcdefghijklmnoprstuvwäöü") for _ in range(rng.randint(3, 12))) for _ in range(400)]
    texts = sorted({"".join(c if rng.random() > 0.12 else rng.choice("aeinrst") for c in rng.choice(roots)) for _ in range(3000)})[:2000] + ["x" * 30_000]
    asked = rng.sample(texts[:2000], 60) + ["", "q", "ae"]
    items = S._with_ids(item_rows(spark, texts))
    q = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(asked)], QUERY)
    best = {(i, t) for i, a in enumerate(asked) if a for t in texts if 100 * SequenceMatcher(None, a, t).ratio() >= 70}
    got = {(r.qid, r.item_key.split("|")[2]) for r in S.fuzzy_lookup(items, q, 70, 10_000).collect()}
    assert got == best
    assert S.fuzzy_pairs(items, q, 70).count() <= 10 * len(best)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    near = {(i, t) for i, a in enumerate(asked) for t in texts if abs(len(a) - len(t)) <= 2 and edits(a, t) <= 2}
    assert {(r.qid, r.item_key.split("|")[2]) for r in S.levenshtein_lookup(items, q, 2, 10_000).collect()} == near


def test_lookup_joins_exact_and_similar(spark):
    items = item_rows(spark, ["haus", "hause", "maus", "xyz"]).withColumns({"text": F.col("normalized"), "updated_at": F.lit("")})
    q = spark.createDataFrame([(0, "Haus", None, None), (1, "haus", "en", None), (2, "", None, None)], QUERY)
    got = {(r.qid, r.match, r.item_key[14:]) for r in S.lookup(items, q, 70).collect()}
    assert got == {(0, "exact", "haus"), (0, "fuzzy", "hause"), (0, "fuzzy", "maus")}


def test_terms_in_sentences_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "ab. é+"
    sentences = [" ".join("".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    terms = sorted({s[i : i + rng.randint(3, 12)].strip() for s in sentences for i in (rng.randrange(len(s) + 1),)} | {"ab a b", "a  b"})
    plain = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_ÄÖÜäöüß")

    def held(t, s):
        if len(t) < 3 or t not in s:
            return False
        starts = [i for i in range(len(s)) if s.startswith(t, i)]
        return " " in t or any((i == 0 or s[i - 1] not in plain) and (i + len(t) == len(s) or s[i + len(t)] not in plain) for i in starts)

    words = spark.createDataFrame([(f"t{i}", "de" if i % 3 else "en", t) for i, t in enumerate(terms)], "path string, language string, term_norm string")
    texts = spark.createDataFrame([(f"s{i}", "de" if i % 2 else "en", t) for i, t in enumerate(sentences)], "path string, language string, sentence_norm string")
    got = {(r.sentence_path, r.term_path) for r in E.match_terms(words, texts).collect()}
    assert got == {(f"s{i}", f"t{k}") for i, s in enumerate(sentences) for k, t in enumerate(terms) if (i % 2 > 0) == (k % 3 > 0) and held(t, s)}
    assert any(len(t.split(" ")) > 2 for t in terms)


def test_each_different_term_is_looked_for_once(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIRS_PER_SALT", 7)
    texts = spark.createDataFrame([(f"s{i}", "de", "der hund, der alte hund bellt") for i in range(5)], "path string, language string, sentence_norm string")
    words = spark.createDataFrame([(f"t{i}", "de", t) for i, t in enumerate(["hund", "hund,", "r hu", "r alte hu"] * 20)], "path string, language string, term_norm string")
    found = E.term_hits(words, texts)
    assert (found.hits.count(), found.terms.count(), found.unique) == (20, 80, True)
    got = [(r.sentence_path, r.term_path) for r in E.match_terms(words, texts).collect()]
    assert sorted(got) == sorted((f"s{i}", f"t{k}") for i in range(5) for k in range(80))
    twice = words.limit(4).unionByName(words.limit(4).withColumn("term_norm", F.lit("bellt")))
    assert len(E.match_terms(twice, texts).collect()) == 20


DOCS = "path string, language string, doc_type string, title string, body string"


def doc_rows(rng, n, first=0):
    words = "haus maus der die das ein kalt warm sehr alt neu".split()
    return [(f"p{first + i}", rng.choice(["de", "en"]), "sentence", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def brute_search(docs, queries, n):
    import math

    toks = {p: ((t.split(), b.split())) for p, _, _, t, b in docs}
    length = {p: len(t) + len(b) for p, (t, b) in toks.items() if t or b}
    avg = sum(length.values()) / len(length)
    df = Counter(w for t, b in toks.values() for w in set(t) | set(b))
    out = set()
    for qid, text, language, _ in queries:
        terms, rows = text.split(), []
        for p, lang, *_ in docs:
            t, b = toks[p]
            if not terms or not set(terms) <= set(t) | set(b) or (language and lang != language):
                continue
            phrase = any(c[i : i + len(terms)] == terms for c in (t, b) for i in range(len(c)))
            tf = Counter(t) + Counter(b)
            score = sum(max(math.log((len(length) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * length[p] / avg)) for w in set(terms))
            rows.append((1 if phrase else 2, -round(score, 6), p))
        out |= {(qid, k + 1, p, pas, -s) for k, (pas, s, p) in enumerate(sorted(rows)[:n])}
    return out


def rounded(rows):
    return {(r.qid, r.rank, r.path, r["pass"], round(r.score, 6)) for r in rows}


def test_index_grows_and_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BITS", 2)
    rng = random.Random(6)
    first, second = doc_rows(rng, 60), doc_rows(rng, 25, 50)
    folder = f"{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    X.add_documents(folder, frame(first))
    gone = ["p1", "p2", "p59", "none"]
    X.add_documents(folder, frame(second), gone=spark.createDataFrame([(p,) for p in gone], "path string"))
    latest = {r[0]: r for r in first if r[0] not in gone} | {r[0]: r for r in second}
    queries = [(0, "haus", None, None), (1, "der alt", None, None), (2, "alt der haus", "de", None), (3, "das das", None, None), (4, "unbekannt haus", None, None), (5, "", None, None), (6, "sehr neu kalt warm", None, None)]
    q = spark.createDataFrame(queries, QUERY)
    want = brute_search(list(latest.values()), queries, 5)
    index = X.read_index(spark, folder)
    rows = lambda i: Counter(tuple(r) for p in i.postings for r in p.select("term", "path", "col", "tf", "positions").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")).collect())
    X.add_documents(f"{tmp_path}/whole", frame(list(latest.values())))
    whole = X.read_index(spark, f"{tmp_path}/whole")
    assert rows(index) == rows(whole) and set(map(tuple, index.counts.collect())) == set(map(tuple, whole.counts.collect()))
    assert rounded(X.text_search(index, q, 5).collect()) == want
    X.merge_segments(folder, frame(list(latest.values())))
    merged = X.read_index(spark, folder)
    assert len(merged.postings) == 1 and rows(merged) == rows(whole) and rounded(X.text_search(merged, q, 5).collect()) == want


def test_ranked_search_reads_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BITS", 3)
    rng = random.Random(8)
    docs = [(f"p{i:04}", "de", "sentence", "", " ".join(["haus"] * (40 if 300 <= i < 310 else i % 3 == 0) + [rng.choice("abcdef") for _ in range(60)])) for i in range(800)]
    X.add_documents(f"{tmp_path}/index", spark.createDataFrame(docs, DOCS))
    index = X.read_index(spark, f"{tmp_path}/index")
    q = spark.createDataFrame([(0, "haus", None, None)], QUERY)
    best, work = X.top_documents(index, q, 5)
    assert {r.path for r in best.collect()} <= {f"p{i:04}" for i in range(300, 310)} and best.count() == 5
    r = work.first()
    assert r.n_blocks >= 80 and r.n_read <= 12
    plan = index.postings[0].join(spark.createDataFrame([("haus", 0)], "term string, qid int").hint("merge"), "term")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the query's side alone


def test_words_that_the_index_splits_are_phrases(spark, tmp_path):
    import re

    rng = random.Random(12)
    bodies = [" ".join(rng.choice("aa bb cc dd".split()) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    docs = [(f"p{i:03}", "de" if i % 3 else "en", "sentence", "", b) for i, b in enumerate(bodies)]
    X.add_documents(f"{tmp_path}/index", spark.createDataFrame(docs, DOCS))
    index = X.read_index(spark, f"{tmp_path}/index")
    asked = ["cc aa_bb", "AA_bb_cc dd", "aa × bb", "aa_bb dd_cc", "aa bb", "aa_", "dd _ aa", "_", "bb_zz aa", "", "aa_bb aa_bb", None]
    q = spark.createDataFrame([(i, t, "en" if i == 3 else None, None) for i, t in enumerate(asked)], QUERY)
    holds = lambda words, part: any(words[i : i + len(part)] == part for i in range(len(words))) if part else False

    def every_word(text, body):
        words = [re.findall("[a-z]+", w) for w in re.findall(r"[\w×]+", (text or "").lower())]
        return bool(words) and all(holds(body.split(), w) for w in words)

    hits = {(i, p) for i, t in enumerate(asked) for p, _, _, _, b in docs if every_word(t, b)}
    assert {(r.qid, r.path) for r in X.all_terms_match(index, q).collect()} == hits
    fits = lambda i, p: i != 3 or p in {d[0] for d in docs if d[1] == "en"}
    found = X.text_search(index, q, 1000).collect()
    assert {(r.qid, r.path) for r in found if r["pass"] == 2} <= {h for h in hits if fits(*h)}
    phrases = {(i, p) for i, t in enumerate(asked) for p, _, _, _, b in docs if holds(b.split(), re.findall("[a-z]+", (t or "").lower()))}
    assert {(r.qid, r.path) for r in found} == {h for h in hits | phrases if fits(*h)}
    assert any(r["pass"] == 2 and r.qid == 0 for r in found)


def test_snippets_equal_brute_force(spark):
    rng = random.Random(10)
    bodies = [" ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(n)) for n in (0, 1, 19, 20, 21, 60, 300)]
    docs = spark.createDataFrame([(f"p{i}", b) for i, b in enumerate(bodies)], "path string, body string")
    asked = ["aa", "bb cc", "zz", "aa aa dd"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    found = q.select("qid").join(docs.select("path"))

    def brute(terms, body):
        t, terms = body.split(), set(terms.split())
        at = max(range(max(len(t) - 20 + 1, 1)), key=lambda i: (sum(x in terms for x in t[i : i + 20]), -i))
        shown = " ".join(f"[{x}]" if x in terms else x for x in t[at : at + 20])
        return (" ... " if at else "") + shown + (" ... " if at + 20 < len(t) else "")

    got = {(r.qid, r.path): r.snippet for r in S.snippet(docs, q, found).collect()}
    assert got == {(i, f"p{k}"): brute(a, b) for i, a in enumerate(asked) for k, b in enumerate(bodies)}


def test_links_of_sentences(notes):
    from notelake.operators import notes as N

    word = "---\ntype: vocabulary\nlanguage: german\nterm: {}\n---\n\n## Related Grammar\n\n{}\n"
    said = "---\ntype: sentence\nlanguage: {}\nsentence: {}\n---\n\n{}"
    had = "## Contains Vocabulary\n\n- [[vocabulary/german/haus|old]]\n- [[Vocabulary/German/Alt|Alt]]\n\n## Grammar / Pattern\n\n- [[Grammar/G0|G0]]\n- [[grammar/g1|again]]\n"
    df = notes(
        ("Vocabulary/German/Haus.md", word.format("Haus", "- [[Grammar/G1|G1]]\n- [[Grammar/G2|G2]]")), ("Vocabulary/German/im Haus.md", word.format("im Haus", "")), ("Vocabulary/German/c.md", word.format("C++", "")),
        ("Sentences/German/s1.md", said.format("german", "Ich bin im Haus.", had)), ("Sentences/German/s2.md", said.format("german", "Hausbau mit C++.", "")), ("Sentences/English/s3.md", said.format("english", "Haus", "")),
    )
    got = {r.path: (r.vocab_links, r.grammar_links, r.status) for r in E.enrich_links(N.parse_frontmatter(df)).collect()}
    assert got == {
        "Sentences/German/s1.md": ("[[Vocabulary/German/Haus|Haus]] [[Vocabulary/German/im Haus|im Haus]] [[Vocabulary/German/Alt|Alt]]", "[[Grammar/G1|G1]] [[Grammar/G2|G2]] [[Grammar/G0|G0]]", "would_update"),
        "Sentences/German/s2.md": ("[[Vocabulary/German/c|C++]]", "", "would_update"),
        "Sentences/English/s3.md": ("", "", "unchanged"),
    }


@pytest.mark.parametrize("name", ["e3_fuzzy_lookup", "e4_lookup"])
def test_lookup_queries_equal_brute_force(spark, name):
    from notelake.functions.text import norm_db
    from notelake.plans import index_queries, registry, search_queries

    sf = "/root/testdata/sf0.001"
    items = index_queries.items(spark, sf).select("item_key", "normalized", "seen_count", "updated_at", "language").collect()
    asked = search_queries.terms(spark, sf).select("qid", norm_db(F.col("text")).alias("norm"), "language").collect()
    want = set()
    for a in asked:
        fitting = [i for i in items if a.language in (None, i.language)]
        exact = sorted((i for i in fitting if i.normalized == a.norm), key=lambda i: i.item_key)
        for by in ("updated_at", "seen_count"):
            exact.sort(key=lambda i: i[by], reverse=True)
        score = lambda i: 100 * SequenceMatcher(None, a.norm, i.normalized).ratio()  # noqa: B023, E731
        bound = lambda i: 200 * min(len(a.norm), len(i.normalized)) / (len(a.norm) + len(i.normalized))  # noqa: B023, E731
        near = [(-score(i), -i.seen_count, i.item_key) for i in fitting if a.norm and i.normalized and bound(i) >= 69]
        near = [(k + 1, n) for k, n in enumerate(sorted(n for n in near if n[0] <= -70)[:10])]
        if name == "e3_fuzzy_lookup":
            want |= {(a.qid, k, n[2], round(-n[0], 6)) for k, n in near}
        else:
            keys = {i.item_key for i in exact}
            want |= {(a.qid, "exact", k + 1, i.item_key) for k, i in enumerate(exact)} | {(a.qid, "fuzzy", k, n[2]) for k, n in near if n[2] not in keys}
    rows = registry.queries()[name](spark, sf).collect()
    got = {(r.qid, r.rank, r.item_key, round(r.score, 6)) if name == "e3_fuzzy_lookup" else (r.qid, r.match, r["rank"], r.item_key) for r in rows}
    assert want and got == want and len(rows) == len(got)


@pytest.mark.parametrize("per_salt", [5_000, 7])
def test_relations_of_matches_keep_equal_texts_together(spark, tmp_path, monkeypatch, per_salt):
    monkeypatch.setattr(S, "RELATIONS_PER_SALT", per_salt)
    rng = random.Random(3)
    views = [("hot", rng.choice(("incoming", "outgoing")), "similar_to", "".join(rng.choices("abcdefgh ", k=2_000)) + str(i)) for i in range(60)] + [("one", "incoming", "related_to", "x"), ("other", "incoming", "related_to", "y")]
    matches = [(i, "hot") for i in range(300)] + [(300, "one"), (301, "none")]
    found = S.with_relations(spark.createDataFrame(matches, "qid bigint, item_key string"), spark.createDataFrame(views, "item_key string, direction string, relation_type string, other_key string"))
    assert found.columns == ["item_key", "qid", "n_relations", "direction", "relation_type", "other_key"]
    want = [(k, q, n, *v[1:]) for q, k in matches for n in [sum(v[0] == k for v in views)] for v in views if v[0] == k] + [("none", 301, 0, None, None, None)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    found.write.parquet(f"{tmp_path}/out")
    # 300 times 60 texts of 2,000 letters.
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5_000_000


def test_pairs_are_scored_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "DOCS_PER_BUCKET", 10)
    X.add_documents(f"{tmp_path}/index", spark.createDataFrame(doc_rows(random.Random(2), 200), DOCS))
    assert [p.name.rsplit("-", 1)[1] for p in (tmp_path / "index").glob("segment-*")] == ["32"]  # buckets grow with the documents
    index, q = X.read_index(spark, f"{tmp_path}/index"), spark.createDataFrame([(0, "haus alt", None, None)], QUERY)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights, pairs = X.written(X.query_weights(index, q), "weights"), X.written(X.all_terms_match(index, q), "pairs")
        scored = X.bm25(index, weights, pairs=pairs)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert scored.count() == pairs.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(term" not in plan and "SortMergeJoin" in plan


def test_a_segment_shuffles_texts_once_and_postings_once(spark, monkeypatch, tmp_path):
    rows = [(f"p{i}", "english", "vocabulary", f"word{i % 3}", " ".join(f"w{k % (i + 1)}" for k in range(i))) for i in range(300)] + [("none", None, None, None, None)]
    docs = spark.createDataFrame(rows, "path string, language string, doc_type string, title string, body string")
    dealt = []
    for name in ("repartition", "repartitionByRange"):
        own = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda self, *a, own=own: dealt.append(a) or own(self, *a))
    X.add_documents(str(tmp_path / "index"), docs)
    assert len(dealt) == 2
    index = X.read_index(spark, str(tmp_path / "index"))
    doc = {r.path: r for r in index.docs.collect()}
    want = {}
    for path, _, _, title, body in rows:
        words = f"{title or ''} {body or ''}".split()
        for term, tf in Counter(words).items():
            most, least, n = want.get((term, doc[path].doc >> X.BLOCK_BITS), (0, 1 << 30, 0))
            want[term, doc[path].doc >> X.BLOCK_BITS] = (max(most, tf), min(least, len(words)), n + 1)
    assert {(r.term, r.block): (r.max_tf, r.min_len, r.n) for r in index.blocks[0].collect()} == want


def test_lists_are_fewer_rows_than_postings_and_search_asks_equal_queries_once(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs = doc_rows(rng, 300)
    X.add_documents(f"{tmp_path}/index", spark.createDataFrame(docs, DOCS), expected=300)
    index = X.read_index(spark, f"{tmp_path}/index")
    # Texts of a bucket share their lists: some 4,000 postings are at most 12 terms in 16 buckets.
    assert index.postings[0].count() > 2_000 and index.lists[0].count() <= 12 * 16
    met, own = [], X._hits
    monkeypatch.setattr(X, "_hits", lambda i, rarest, *a, **k: met.append(rarest) or own(i, rarest, *a, **k))
    queries = [(i, ["alt_neu haus", "das ein"][i % 2], None, None) for i in range(40)]
    found = X.text_search(index, spark.createDataFrame(queries, QUERY), 5).collect()
    assert met and max(m.count() for m in met) <= 2
    by = lambda q: sorted((r["rank"], r.path, r["pass"], r.score) for r in found if r.qid == q)
    assert by(0) and by(1) and all(by(i) == by(i % 2) for i in range(40))


def test_lists_that_cuts_divide_are_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(X, "CHUNK_BITS", 3)
    monkeypatch.setattr(X, "MOST_LETTERS", 12)
    rng = random.Random(9)
    texts = [[" ".join(rng.choice("aa b cc".split()) for _ in range(rng.randint(0, 5))) for _ in range(2)] for _ in range(30)]
    rows = pa.RecordBatch.from_pydict({"doc": np.arange(5, 35), "len": np.array([len(" ".join(t).split()) for t in texts]), "title": [t[0] for t in texts], "body": [t[1] for t in texts]})
    got = set()
    for batch in X._inverted(1)([rows.slice(0, 11), rows.slice(11)]):
        for r in batch.to_pylist():
            n, data = r["n"], r["data"]
            at, ends, positions = data[:n], data[n : 2 * n], data[2 * n + 3 * r["n_blocks"] :]
            assert len(positions) == ends[-1] and len({a >> 1 for a in at}) == r["docs"]
            got |= {(r["term"], (r["chunk"] << 3) + (a >> 1), a & 1, p) for a, b, e in zip(at, [0, *ends], ends) for p in positions[b:e]}
    assert got == {(w, i + 5, c, p) for i, t in enumerate(texts) for c in (0, 1) for p, w in enumerate(t[c].split())}


def test_pairs_of_items_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 100)
    relations = spark.createDataFrame([("hot", f"text {i}") for i in range(40)] + [("cold", "x")], "item_key string, other_text string")
    holders = spark.createDataFrame([("hot", f"p{i}") for i in range(50)] + [("cold", "q"), ("none", "r")], "item_key string, path string")
    found = S.paired(relations, holders, S.item_counts(relations, holders))
    rows = [(r.item_key, r.path, r.n_relations, r.other_text) for r in found.collect()]
    assert sorted(rows) == sorted([("hot", f"p{i}", 40, f"text {k}") for i in range(50) for k in range(40)] + [("cold", "q", 1, "x")])
    # 2,001 pairs: 21 tasks, however few their bytes; no task has all of the hot item; a relation's rows follow each other.
    parts = found.withColumn("part", F.spark_partition_id()).collect()
    sizes = Counter(r.part for r in parts)
    assert len(sizes) > 5 and max(sizes.values()) <= 600
    changes = sum((a.part, a.other_text) != (b.part, b.other_text) for a, b in zip(parts, parts[1:], strict=False))
    assert changes == 40


def test_term_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIRS_PER_TASK", 100)
    texts = spark.createDataFrame([(f"s{i}", "de", f"hund{i % 7} bellt") for i in range(70)], "path string, language string, sentence_norm string")
    words = spark.createDataFrame([(f"t{i}", "de", f"hund{i % 7}") for i in range(140)], "path string, language string, term_norm string")
    found = E.match_terms(words, texts)
    assert {(r.sentence_path, r.term_path) for r in found.collect()} == {(f"s{i}", f"t{k}") for i in range(70) for k in range(140) if i % 7 == k % 7}
    assert found.rdd.getNumPartitions() == 15
