"""The manifest, the license scan and the alignment against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from notelake.llm import alignment, licenses, manifest, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def write(spark, at, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    return str(at)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def stated(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return t and re.sub("[A-Z]", lambda m: m[0].lower(), t)


def climb(nodes):
    """Root and, per node, its siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i // 16 * 16
            path.append((level[run:i], level[i + 1 : run + 16]))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, source, lang, n_chars, text = r
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = h(*map(stated, r))
        groups[source].append((doc_id is not None, doc_id or 0, leaf, h(*map(stated, (doc_id, source, lang, n_chars, lower(text) if changed else text)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    climbed = [climb([x[2] for x in sorted(groups[s])]) for s in names]
    root, above = climb([c[0] for c in climbed])
    out = Counter()
    for s, (subroot, paths), up in zip(names, climbed, above, strict=True):
        for (known, doc_id, leaf, altered), path in zip(sorted(groups[s]), paths, strict=True):
            folded = altered
            for before, after in path + up:
                folded = h(*before, folded, *after)
            proof = "".join(x for before, after in path + up for x in before + after)
            out[(doc_id if known else None, leaf, subroot, root, h(proof), folded, folded == root)] += 1
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "B", "ä", "", "hot", "hot"]), "en", i * 3, "Word " * rng.randint(0, 9) + str(i)) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "a", "en", 0, ""), (7, "lone", None, 1, "X" * 200_000)] + [(11, "hot", "en", 1, "Same ROW")] * 40 + [(None, "hot", "en", 1, "Same ROW")] * 3
    return rows


def test_manifest_equals_brute_force_and_sql(spark, awkward, tmp_path):
    sf = write(spark, tmp_path, awkward)
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf)
    want = brute_manifest(awkward)
    assert Counter(tuple(r) for r in got.select(*MANIFEST).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert Counter(con.sql(queries.ORACLE_SQL["op12_merkle_manifest"]).select(", ".join(MANIFEST)).fetchall()) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_over_three_rounds(spark, tmp_path):
    rows = [(i, "hot" if i % 97 else f"s{i}", "en", 1, f"T{i}") for i in range(66_500)]
    sf = write(spark, tmp_path, rows)
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf).select(*MANIFEST).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows)


def test_manifest_of_one_row_and_other_columns(spark):
    one = spark.createDataFrame([(1, "s", "x")], "id int, tree string, node string")
    r = manifest.manifest(one, "tree", "id", ["id", "node"]).collect()
    assert [(x.leaf, x.subroot, x.root, x.path, x.altered) for x in r] == [(h("1:1", "1:x"), h("1:1", "1:x"), h("1:1", "1:x"), [], None)]
    assert manifest.manifest(one.limit(0), "tree", "id", ["id", "node"]).count() == 0


MIT = licenses.TEMPLATES[2].text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    prose = " ".join(rng.choice("under the mit license version cc by nc lorem ipsum dolor apache".split()) for _ in range(4000))
    return [
        None, "", "...", "one", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "lead words " * 5000 + "under the mit license" + " tail" * 100, "CC-BY-NC " * 3, prose, "Größe under the MIT license\nunder the mit\nlicense", MIT, "x " + MIT.replace("documentation", "doc").replace("limitation", "limits and more words"),
        "licensed under the GNU Lesser General Public License, version 3", "licensed under the GNU Affero General Public License version 3", "licensed under the general store of public words version 3",
        "Released under the MIT license. Licensed under the BSD license.", "The quick brown fox is granted permission to sell copies of the newspaper to any person.", "cc by", "mit license",
    ]


def test_license_places_equal_brute_force(spark, texts, tmp_path):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(texts)] + [(4, "s", "en", 1, texts[4]), (None, "s", "en", 1, texts[10])]
    want = Counter()
    for i, *_, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, label) for label, phrase in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want[(i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x[1] for x in at})))] += 1
    got = queries.QUERIES["op13_license_scan"](spark, write(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None}
    assert [labels[i] for i in (4, 5, 6, 7, 12, 13, 14, 15, 16, 17, 18, 19)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "mit", "mit", "lgpl-3", "agpl-3", "", "bsd,mit", "", ""]


def test_license_spans_equal_brute_force(spark):
    """Every template with a tenth of its words changed, put in or left out is found where it stands, and nothing else is."""
    rng = random.Random(3)
    rows, want = [], {}
    for i, t in enumerate(licenses.TEMPLATES):
        w = re.findall(r"[a-z0-9]+", t.text.lower())
        names = set(t.names.split())
        loose = [k for k, x in enumerate(w) if x not in names and 0 < k < len(w) - 1]
        for k in rng.sample(loose, min(len(w) // 10, len(loose))):
            w[k] = rng.choice(["", f"{w[k]} more", "other"])
        lead = rng.randint(0, 30)
        rows.append((i, " ".join([f"w{k}" for k in range(lead)] + w + [f"z{k}" for k in range(20)])))
        want[i] = t.label
    got = licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: {s.label for s in r.license_spans} for r in got} == {i: {x} for i, x in want.items()}


def test_license_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License", "own", 5, "k")], "doc_id long, text string, labels string, digest int, `a.b` string")
    r = licenses.with_licenses(docs).collect()[0]
    assert (r.labels, r.digest, r["a.b"], r.n_base) == ("mit", 5, "k", 1)
    assert licenses.with_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("a, b", [("", ""), ("abcab", "cab"), ("xaxbxc", "abc"), ("abc", "zzz")])
def test_common_words(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    n, taken = licenses.common(list(a), list(b))
    assert n == best[-1][-1] and taken == min(i for i in range(len(a) + 1) if best[i][-1] == n)


def brute_alignment(rows):
    """Every token pair compared, every document's pairs counted."""
    t = alignment.tokenizers(*alignment.vocabulary_files())
    docs, counts = [], Counter()
    for i, text in rows:
        a = t.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(t.a_bytes[x] for x in a) != want or b"".join(t.b_bytes[x] for x in b) != want:
            a, b = [], []
        spans = lambda ids, sizes: [(sum(len(sizes[x]) for x in ids[:k]), sum(len(sizes[x]) for x in ids[: k + 1])) for k in range(len(ids))]
        sa, sb = spans(a, t.a_bytes), spans(b, t.b_bytes)
        links = [(x, y) for x, (s, e) in zip(a, sa, strict=True) for y, (u, v) in zip(b, sb, strict=True) if s < v and u < e]
        groups, x, y = [], [], []
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        for end in ends:
            x, y = [str(i) for i, (_, e) in zip(a, sa, strict=True) if e <= end], [str(i) for i, (_, e) in zip(b, sb, strict=True) if e <= end]
            done = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
            groups.append((x[done[0] :], y[done[1] :]))
        said = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        counts.update(set(links))
        docs.append((i, len(a), len(b), len(groups), links, h(said) if a else ""))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((i, a, b, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), d) for i, a, b, g, links, d in docs)


@pytest.fixture(scope="module")
def short():
    rng = random.Random(4)
    base = ["", None, "a", "  two  spaces ", "Hello world, hello World!", "<|endoftext|> plain <s></s><unk><0x41>", "日本語のテキスト", "naïve café – “quoted”", "tab\there\nline\r\n", "▁low", "\x00nul", "ﬁligature ½", "aaaa" * 30, "😀 emoji"]
    base += [" ".join("".join(rng.choice("etaoinsrhl") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(base)] + [(4, base[4]), (None, base[20]), (4, base[4])]


def test_alignment_equals_brute_force(spark, short, tmp_path):
    sf = write(spark, tmp_path, [(i, "s", "en", 1, t) for i, t in short])
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == brute_alignment(short)


def test_alignment_slices_and_shuffled_counts(spark, short, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    docs = spark.createDataFrame([(i, t, "own", 3) for i, t in short], "doc_id long, text string, groups string, pair int").repartition(3)
    files = alignment.vocabulary_files()
    got = alignment.aligned(docs, *files)
    assert got.filter("pair = 3").count() == len(short)
    want = brute_alignment(short)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want
    monkeypatch.setattr(alignment.looked_up, "__defaults__", (0,))
    far = alignment.aligned(docs, *files)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in far.collect()) == want
    assert alignment.aligned(docs.limit(0), *files).count() == 0


def test_words_are_encoded_once_and_as_in_whole_texts(monkeypatch):
    """Signs that Unicode versions see differently leave a text to A's own splitter."""
    t = alignment.tokenizers(*alignment.vocabulary_files())
    rng = random.Random(5)
    pool = "ab'sS dtlrvem019 \t\n\r\x0b!?.,-_é߀ … ÀŸ²ªº×"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> x", "\x1c a\x1d", "x\x85y", "日本 語", "a　b", "ʰx"]
    for remembered in (alignment.REMEMBERED, 0):
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        assert t.a_ids(texts) == [e.ids for e in t.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
    monkeypatch.setattr(alignment, "REMEMBERED", 1 << 30)
    t.known.clear()
    t.a_ids(["one two one", " two"])
    t.known[" one"] = [7]
    assert t.a_ids(["one one"]) == [[7, 7]]
