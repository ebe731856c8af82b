"""Line dedup, HTML, BPE, SimHash, decontamination and the pipeline against brute force, and on edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import bpe, decontaminate, html_text, lines, simhash


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with inner ones."""
    return lambda *rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, h long")


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


# Lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("étaoxyz")]
    return "".join(out)


@pytest.mark.parametrize("hot", [lines.HOT, 1])
def test_edit_distance_and_links(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(11)
    base = [words(rng, 6)[:n] for n in (20, 21, 33, 34, 35, 40)] + ["x" * 30, "short"]
    texts = [changed(rng, b, k) if len(b) > 5 else b for b in base for k in (0, 1, 1, 2, 2, 3, 4)]
    rows = [(i, "\n".join(rng.sample(texts, 4))) for i in range(30)] + [(None, texts[0]), (7, texts[1]), (7, texts[1]), (50, None), (51, ""), (52, "\n\n")]
    got = lines.judged_lines(docs(*rows)).collect()
    held = [(d, x) for d, t in rows for x in dict.fromkeys((t or "").split("\n")) if x]
    first = {}
    for d, x in held:
        first[x] = min(first.get(x, 10**9), 10**9 if d is None else d)
    near = {x: [y for y in first if y != x and min(len(x), len(y)) >= lines.MIN_CHARS and edits(x, y) <= lines.EDITS] for x in first}
    import hashlib

    want = sorted((str(d), hashlib.md5(x.encode()).hexdigest(), len(near[x]), (10**9 if d is None else d) == first[x] and not any((first[y], y) < (first[x], x) for y in near[x])) for d, x in held)
    assert sorted((str(r.doc), r.class_id, r.n_links, r.kept) for r in got) == want
    assert sum(len(v) for v in near.values()) > 20


def test_repeated_lines_go_but_copies_stay(docs):
    rng = random.Random(2)
    shared, own = words(rng, 12), [words(rng, 30) for _ in range(3)]
    rows = [(0, f"{own[0]}\n{shared}"), (1, f"{own[1]}\n\n{shared}\nok"), (2, f"{own[0]}\n{shared}"), (3, f"{shared}\n{own[2]}\n{shared[:-1]}"), (4, None), (5, "")]
    out = lines.without_repeated_lines(docs(*rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == ["doc_id", "text", "line", "h"]
    assert got == {0: rows[0][1], 1: f"{own[1]}\n\nok", 2: rows[2][1], 3: own[2], 4: None, 5: ""}
    assert lines.without_repeated_lines(docs(*rows).limit(0)).count() == 0


def test_mostly_repeated_documents_lose_their_repeated_lines(docs):
    rng = random.Random(8)
    shared, own = [words(rng, 150), words(rng, 60)], [words(rng, 40) for _ in range(4)]
    mixed = f"{shared[0]}\n{own[2]}\n{shared[1]}"
    rows = [(0, f"{own[0]}\n{shared[0]}"), (1, f"{own[1]}\n{shared[1]}"), (2, mixed), (3, mixed), (4, "\n".join([shared[1], "short", shared[0]])), (None, mixed), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in lines.without_repeated_lines(docs(*rows)).collect()), key=str)
    assert got == sorted([rows[0], rows[1], (2, own[2]), (3, own[2]), (4, "short"), (None, own[2]), (2, None)], key=str)


def test_places_of_repeated_lines_inside_documents(docs):
    rng = random.Random(5)
    a, b, c = (words(rng, 8) for _ in range(3))
    rows = [(1, f"{a}\n{b}\n{a}\n\n{a}\nx\nx\n"), (7, f"{c}\n{b}"), (7, f"{b}\n{c}\n{a}"), (9, "y" * 300_000 + f"\n{b}")]
    got = sorted((r.doc_id, r.text) for r in lines.without_repeated_lines(docs(*rows, rows[0])).collect())
    assert got == sorted([(1, f"{a}\n{b}\n\nx\nx\n")] * 2 + [(7, c), (7, c), (9, "y" * 300_000)])


def test_full_sketches_lose_no_near_line(spark):
    rng = random.Random(9)
    pairs = [(t, changed(rng, t, k)) for t in (words(rng, 9), words(rng, 40), "Zürich 10, 01. a b c d e") for k in (0, 1, 2, 2, 2) * 20]
    rows = spark.createDataFrame(pairs, "a string, b string").select(lines.may_be_near_by_all(lines.full_sketch(F.col("a")), lines.full_sketch(F.col("b"))).alias("near"))
    assert rows.filter("NOT near").count() == 0
    far = spark.createDataFrame([(words(rng, 9), words(rng, 9))] * 5, "a string, b string").select(lines.may_be_near_by_all(lines.full_sketch(F.col("a")), lines.full_sketch(F.col("b"))).alias("near"))
    assert far.filter("near").count() == 0


# HTML


def test_main_text_of_awkward_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this site and you agree.</div><article><h1>Tom &amp; Ann</h1><p>One&nbsp;two <b>three<br>four</b> <a href='x>y'>five</a> six seven.<p>Short.</p>"
        "<aside>Related things of interest here</aside><form><p>Your mail please</p></form><ul><li>first</li></ul><section id='comments'><p>I liked this article a lot, thanks for it.</p></section></article>"
        "<div class=sidebar><p>Some long sidebar text that nobody wants to read at all.</p></div><footer>&copy; site</footer></body></html>"
    )
    assert html_text.main_text(page) == "Tom & Ann\nOne two three four five six seven.\nShort.\nfirst"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p> \n") == ""
    assert html_text.main_text("<article><p>a &am") == "a &am" and html_text.main_text("<article><p>one<b") == "one"
    assert len(html_text.main_text("<article><p>" + "w " * 100_000)) == 199_999


def test_tree_on_held_out_pages():
    x, y, page = html_text.labelled_blocks()
    right, words = {True: 0, False: 0}, {True: 0, False: 0}
    for p in range(len(html_text.LABELLED_PAGES)):
        own = page == p
        got = html_text.classify(x[own], html_text.grow(x[~own], y[~own]))
        named = bool(x[own, 0].any())
        right[named] += (x[own, 2] * (got == y[own])).sum()
        words[named] += x[own, 2].sum()
    assert right[True] >= 0.95 * words[True] and right[False] >= 0.9 * words[False]


def test_tree_reads_words_and_links_of_neighbours():
    def read(node):
        return {html_text.FEATURES[node[0]]} | read(node[2]) | read(node[3]) if isinstance(node, tuple) else set()

    assert {"words_before", "words_after", "link_density_before", "link_density_after"} & read(html_text.tree()) and {"article", "words", "link_density"} <= read(html_text.tree())
    menu, long = "<ul><li><a href=x>Home</a></li><li><a href=x>Two words</a></li></ul>", "word " * 60
    page = f"{menu}<div>Buy our nice shoes today for less</div><h1>My title here</h1><p>{long}</p><p>Short one.</p><p>{long}</p><div>Copyright 2024 Foo Inc. All rights reserved</div>"
    assert html_text.main_text(page).replace("word ", "").replace("word", "") == "My title here\n\nShort one.\n"


@pytest.mark.parametrize("name", ["content with-sidebar", "post has-comments", "entry-content related", "story-body header-fixed"])
def test_article_names_outweigh_others(name):
    got = html_text.main_text(f'<nav><a href=x>Home</a></nav><div class="{name}"><h1>My title here</h1><p>{"word " * 60}</p></div><footer>Copyright</footer>')
    assert got.split("\n")[0] == "My title here" and got.count("word") == 60


@pytest.mark.parametrize("name", ["main-menu", "main-nav", "main-header", "article-comments", "post-meta", "content-sidebar", "story-related"])
def test_boxes_named_after_an_article_are_no_article(name):
    """Beside a text without a name they are left out and the text stays; inside an article they are left out."""
    art = f"<h1>My title here</h1><p>{'word ' * 60}</p><p>{'more ' * 40}</p>"
    beside = html_text.main_text(f'<div class="{name}"><a href=x>Home</a> <a href=y>About</a></div><div>{art}</div><footer>Copyright</footer>')
    inside = html_text.main_text(f'<article>{art}<div class="{name}"><p>Great stuff said one reader here</p></div></article>')
    for got in (beside, inside):
        assert got.startswith("My title here\n") and got.count("word") == 60 and got.count("more") == 40 and "Home" not in got and "Great" not in got


def test_quotations_begin_behind_an_equals_sign():
    assert html_text.main_text("<article><p title=don't>AAA one two</p><p>mid</p><p title=can't>BBB</p></article>") == "AAA one two\nmid\nBBB"
    assert html_text.main_text("<article><p title = 'a > b' class=\"x>y\" data-q=it's=\"z\">A</p><p it's>B</p></article>") == "A\nB"


def test_deep_nesting_is_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert len(html_text.main_text("<article>" + "<div>x " * n)) == 2 * n - 1
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.02)


def test_blocks_equal_brute_force():
    """Blocks of random pages of closed elements, against a recursive reader of the same tree."""
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return words(rng, rng.randint(0, 4))
        return [(rng.choice(["div", "section", "h2", "b", "i", "a", "ul", "li", "article", "aside"]), [tree(depth - 1) for _ in range(rng.randint(0, 3))])]

    def page(node):
        return node if isinstance(node, str) else "".join(f"<{t}>{''.join(map(page, kids))}</{t}>" for t, kids in node)

    def flat(node, inside_link, out):
        if isinstance(node, str):
            out.append((node, inside_link))
            return
        for t, kids in node:
            edge = t in html_text.BLOCK_TAGS
            if edge:
                out.append(None)
            for k in kids:
                flat(k, inside_link or t == "a", out)
            if edge:
                out.append(None)

    for _ in range(200):
        node, out = tree(5), []
        flat(node, False, out)
        want, held = [], []
        for piece in [*out, None]:
            if piece is not None:
                held.append(piece)
                continue
            text = "".join(t for t, _ in held).split()
            if text:
                want.append((" ".join(text), len(text), min(len(text), sum(len(t.split()) for t, link in held if link))))
            held = []
        assert [(t, b[0], b[1]) for t, b in html_text.text_blocks(page(node))] == want


def test_html_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<article><p>é x</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op5_html_text(spark, str(tmp_path)).collect()}
    assert got == {1: ("é x", 3), 2: ("", 0)}


# BPE


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    path, pattern = bpe.vocabulary_file()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(4)
    texts = ["", None, "Hello world", " it's we'LL  \n\t x", "é😀日本語", "=" * 3000, "ab" * 2000, "x" * 256, "x" * 257, "".join(rng.choice("abcé ß1!😀\n") for _ in range(3000)), "Hello world"]
    got = bpe.with_token_ids(docs(*enumerate(texts)), path, pattern).orderBy("doc_id").collect()
    assert [list(r.token_ids) for r in got] == [reference.encode_ordinary(t or "") for t in texts]
    assert all(r.round_trip for r in got)
    ids = spark.createDataFrame([([1, 2, 300],), ([],), (None,)], "ids array<int>").select(bpe.bpe_decode(F.col("ids"), path).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in ids] == [reference.decode_bytes([1, 2, 300]), b"" or ids[1].b, None]


def test_words_of_one_query_do_not_touch():
    """One sort puts the positions of all words in order; a word's last token never pairs with the next word's first, and rounds cost no window for each word."""
    path, _ = bpe.vocabulary_file()
    known, con = bpe.ranks(path), bpe.engine(path)
    asked = [b"t", b"h", b"e", b"the", b"", b"th", b"e", b" in", b"g", b"aaaa", b"a", *[w.encode() for w in words(random.Random(3), 200).split()]]
    assert bpe.encode_words(asked, known, con) == [np.array(bpe.contract_long(w, known), "<u4").tobytes() for w in asked]
    plan = con.sql("EXPLAIN " + bpe.ENCODE.replace("FROM positions", "FROM (SELECT 0 AS word, 0 AS pos, 0 AS token)")).fetchall()[0][1]
    assert "PARTITION BY" not in plan


# SimHash


def test_components_equal_brute_force(spark, docs):
    import xxhash

    def slow(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rng = random.Random(9)
    texts = [None, "", " ", "A b", "a B", "a b c d e"] + [words(rng, 300) for _ in range(20)]
    texts += [" ".join(w if i != k else "zzz" for i, w in enumerate(t.split())) for t in texts[6:16] for k in (3, 100, 250)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[8]), (ids[9], texts[9])]
    f = [slow(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (f[i] ^ f[j]).bit_count() <= 4:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in group}
    got = sorted((str(r.key), r.f & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs(*rows)).collect())
    assert got == sorted((str(d), x, least[g]) for (d, _), x, g in zip(rows, f, group, strict=True))
    kept = simhash.one_per_group(docs(*rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values())) and simhash.near_duplicates(docs(*rows).limit(0)).count() == 0


@pytest.mark.parametrize("leaf_points, points_a_leaf", [(50, 1_000), (7, 1)])
def test_links_of_dense_fingerprints(spark, monkeypatch, leaf_points, points_a_leaf):
    monkeypatch.setattr(simhash, "LEAF_POINTS", leaf_points)
    monkeypatch.setattr(simhash, "POINTS_A_LEAF", points_a_leaf)
    rng = random.Random(1)
    points = {0, -1} | {rng.getrandbits(64) for _ in range(200)}
    for p in list(points)[:40]:
        for _ in range(8):
            points.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = sorted({(p & (2**64 - 1)) - (1 << 64 if p & (1 << 63) else 0) for p in points})
    got = dict(map(tuple, simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "f long"))).collect()))
    root = {p: p for p in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {p: low if r == high else r for p, r in root.items()}
    assert {p: got.get(p, p) for p in signed} == root


@pytest.mark.parametrize("spread", [64, 24])
def test_trees_in_leaves_lose_no_pair_and_compare_less(spread):
    import numpy as np

    rng = np.random.default_rng(4)
    low = np.uint64((1 << spread) - 1)
    points = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64) & low)
    points = np.unique(np.concatenate([points, points[:500] ^ np.uint64(0b1011), points[:300] ^ np.uint64(1 << 9)]))
    own, every = np.arange(len(points) // 3), np.arange(len(points))
    met, pairs = 0, set()
    for stored, others in simhash.meetings(points, own, every):
        met += len(stored) * len(others)
        near = np.bitwise_count(points[stored][:, None] ^ points[others][None, :]) <= 4
        pairs |= {(int(stored[i]), int(others[j])) for i, j in np.argwhere(near)}
    want = {(int(i), int(j)) for i, j in np.argwhere(np.bitwise_count(points[own][:, None] ^ points[None, :]) <= 4)}
    assert pairs == want and met < 0.9 * len(own) * len(every)


def test_vantage_points_come_from_the_data():
    rng = random.Random(3)
    blocks = [rng.getrandbits(16) for _ in range(256)]
    chosen = simhash.vantage_points(blocks)
    assert len(set(chosen)) == simhash.MOST_LEVELS and set(chosen) <= {*blocks, *simhash.SPARE_POINTS} and len(set(chosen) & set(blocks)) > 8
    assert len(set(simhash.vantage_points([7, 7]))) == simhash.MOST_LEVELS and simhash.leaves_of_levels(chosen)[-1] > 20_000


# Decontamination


def test_masks_are_lossless():
    for gone in itertools.combinations(range(decontaminate.WINDOW), 3):
        assert any(not set(gone) & {o + i for i, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - len(m) + 1))


def test_contaminated_equals_brute_force(spark, docs):
    rng = random.Random(6)
    items = [words(rng, n) for n in (15, 20, 40, 12, 6, 4)] + ["", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def swap(text, n):
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = "zzz"
        return " ".join(w)

    texts = [f"{words(rng, 30)} {swap(items[k], n)}, {words(rng, 9)}" for k in range(6) for n in (0, 1, 2, 3, 4) if n < len(items[k].split())]
    rows = list(enumerate(texts)) + [(900, words(rng, 500)), (901, None), (902, ""), (None, items[0].upper()), (0, "again")]
    want = set()
    for d, t in rows:
        for k, item in enumerate(items):
            a, b = decontaminate.TOKEN.findall((t or "").lower()), decontaminate.TOKEN.findall((item or "").lower())
            n = min(len(b), decontaminate.WINDOW)
            if n and any(sum(x == y for x, y in zip(a[i : i + n], b[j : j + n], strict=False)) >= decontaminate.AGREE * n for i in range(len(a) - n + 1) for j in range(len(b) - n + 1)):
                want.add((d, k))
    got = {(r.doc, r.item) for r in decontaminate.contaminated(docs(*rows), bench).collect()}
    assert got == want
    clean = {r.doc_id for r in decontaminate.decontaminated(docs(*rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_whole_items_of_every_length_with_all_changes(spark, docs):
    rng = random.Random(12)
    items = [words(rng, n) for n in range(1, decontaminate.WINDOW)]
    rows, want = [], set()
    for k, item in enumerate(items):
        n = len(item.split())
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontaminate.AGREE)):
            want.add((len(rows), k))
            rows.append((len(rows), f"{words(rng, 20)} {' '.join('zzz' if i in gone else w for i, w in enumerate(item.split()))} {words(rng, 20)}"))
    found = decontaminate.contaminated(docs(*rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert want <= {(r.doc, r.item) for r in found.collect()}


def test_token_hashes_are_those_of_single_texts():
    rng = random.Random(2)
    texts = ["", "_a_B-c", "ÉTÉ été 10km", "ΟΔΟΣ Σ", "x" * 5000, "日本 語", "\U0001F600 a"] + [words(rng, 40) for _ in range(20)]
    together, counts = decontaminate.token_hashes(texts)
    tokens = [decontaminate.TOKEN.findall(t.lower()) for t in texts]
    assert counts.tolist() == [len(x) for x in tokens]
    by_token = {}
    for token, h in zip(itertools.chain(*tokens), together.tolist(), strict=True):
        assert by_token.setdefault(token, h) == h
    assert len(set(by_token.values())) == len(by_token)


def test_decontamination_of_empty_tables_and_long_texts(spark, docs):
    item = words(random.Random(4), 30)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(1, "a " * 600_000 + item), (2, "b" * 1_200_000), (3, None)]
    assert {(r.doc, r.item) for r in decontaminate.contaminated(docs(*rows), bench).collect()} == {(1, 0)}
    assert decontaminate.contaminated(docs(*rows).limit(0), bench).count() == 0
    assert decontaminate.decontaminated(docs(*rows), bench.limit(0)).count() == 3


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from notelake.llm import quality

    rng = random.Random(3)
    good = [words(rng, 120) for _ in range(8)]
    item = words(rng, 20)
    texts = good + [good[0], good[1], "too short", "a b c d e " * 50, f"{words(rng, 80)} {item} {words(rng, 30)}", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == list(range(8)) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    assert quality.keep_good(docs.limit(0)).count() == 0
