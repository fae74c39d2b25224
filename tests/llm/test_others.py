import math
import random

import numpy as np
from pyspark.sql import functions as F

from textdelta.llm import permutation_index, queries, style_tree, url_filter
from textdelta.llm.components import components

from .helpers import prose


def test_urls(spark):
    urls = [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://www.EXAMPLE.com/en/7x?q#f", "example.com/en/7", "allow"),
        ("https://example.com/en/6", "com/en/", "block"),
        ("x://b.net/de/8", "net/de/", "allow"),
        ("x://m.example.net/de/8", "example.net/de/8", "block"),
        ("x://notexample.net/de/8", "net/de/", "allow"),
        ("x://c.org/es/", "org/es/", "block"),
        ("x://c.org/es", None, None),
        ("nothing", None, None),
        (None, None, None),
        ("x://", None, None),
        ("x://h?p://q/r", None, None),
        ("x://" + "a" * 100000, None, None),
    ]
    rows = spark.createDataFrame([(i, u, "h", "r") for i, (u, _, _) in enumerate([*urls, urls[0]])], "page_id long, url string, host string, rule string")
    got = sorted(url_filter.judge(rows).collect(), key=lambda r: r.page_id)
    for r, (_, rule, verdict) in zip(got, [*urls, urls[0]], strict=True):
        assert r.rule == rule and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/7x") and (got[8].host, got[8].path) == ("", "") and (got[11].host, got[11].path) == ("h", "")
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_url_models_tell_labels_apart(spark):
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.com/en/{i}" if i % 2 else f"http://{word('vwxyz')}.net/de/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://{word('abcde')}.info/{i}" if i % 2 else f"http://{word('vwxyz')}.info/{i}") for i in range(100)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) >= 95


def test_url_model_against_plain_counts():
    texts = ["abcab", "bcbc"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": texts, "accepted": [True, False]})
    cells = next(url_filter._count(iter([batch])))
    flat = np.zeros(4 * (url_filter.ORDER + 1) * url_filter.CELLS, dtype=np.int64)
    flat[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    model = url_filter.Model(flat.reshape(2, url_filter.ORDER + 1, 2, url_filter.CELLS))

    def p(train, text, k):
        out = 1 / 256
        for order in range(url_filter.ORDER + 1):
            context = lambda t, j: tuple(t[j - m] if j - m >= 0 else "" for m in range(1, order + 1))  # noqa: B023, E731
            seen = [(context(train, j), train[j]) for j in range(len(train))]
            both = seen.count((context(text, k), text[k]))
            alone = sum(c == context(text, k) for c, _ in seen)
            out = (both + url_filter.WEIGHT * out) / (alone + url_filter.WEIGHT)
        return out

    want = sum(math.log(p(texts[0], "cabd", k)) - math.log(p(texts[1], "cabd", k)) for k in range(4)) / 4
    assert abs(model.scores(pa.array(["cabd", ""]))[0] - want) < 1e-9 and model.scores(pa.array([""]))[0] == 0


def test_url_models_keep_ngrams_apart(spark):
    """As many distinct n-grams as there are, each with its own count."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(60)) for _ in range(4000)]
    model, _ = url_filter.fit(spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text string, accepted boolean"))
    trained = {r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").where(F.pmod(F.xxhash64("text"), F.lit(url_filter.HELD_OUT)) != 0).collect()}
    grams = {t[max(j - 5, 0) : j + 1] if j >= 5 else (j, t[: j + 1]) for i, t in enumerate(texts) if i % 2 == 0 and t in trained for j in range(60)}
    places = model.counts.places // url_filter.KEYS
    assert (places == ((url_filter.ORDER + 1) + url_filter.ORDER) * 2 + 1).sum() == len(grams) > url_filter.CELLS


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[2000:2400] = x[100]  # a crowd of equal vectors
    rows = [(i, v.tolist(), "r", 1) for i, v in enumerate(x)]
    odd = [(5000, None, "r", 1), (5050, [0.0] * 32, "r", 1), (5100, [float("nan")] * 32, "r", 1), (5150, [1.0, None], "r", 1), (5200, [1.0], "r", 1), (None, x[3].tolist(), "r", 1), (7, x[7].tolist(), "r", 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank string, score int").repartition(4)
    got: dict[int, list] = {}
    for r in permutation_index.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = x.astype(np.float64)
    norm = np.linalg.norm(exact, axis=1)
    hits = 0
    for q in range(0, 3000, 50):
        s = exact @ exact[q] / (norm * norm[q])
        s[q] = -9
        top = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len(set(top.tolist()) & {i for i, _ in got[q]})
        assert [i for i, _ in got[q]] == [i for i, _ in sorted(got[q], key=lambda p: (-p[1], p[0]))]
    assert hits / 300 >= 0.9 and set(got) == set(range(0, 3000, 50))
    assert [i for i, _ in got[100]] == [2000, 2001, 2002, 2003, 2004]
    assert permutation_index.nearest(df.limit(0)).count() == 0
    few = permutation_index.nearest(df.where("vec_id IN (0, 1, 2)")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank) if r.query_id == 0] and len(few) == 2


def test_nearest_of_repeated_queries_and_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist()), (50, (x[50] + 1).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = permutation_index.nearest(df, share=1.0).collect()
    assert sorted(r.rank for r in whole if r.query_id == 50) == sorted([1, 2, 3, 4, 5] * 3)
    monkeypatch.setattr(permutation_index, "BLOCK", 100)
    monkeypatch.setattr(permutation_index, "QUERIES", 5)
    assert sorted(map(str, permutation_index.nearest(df.repartition(7), share=1.0).collect())) == sorted(map(str, whole))
    assert sorted(map(str, permutation_index.nearest(df.repartition(7)).collect())) == sorted(map(str, permutation_index.nearest(df.coalesce(1)).collect()))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav>
<div id="cookie-notice">cookies</div><main><article><header><h1>A &amp; <i>b</i>c</h1></header><p>One<br>two<p>Three &lt;x&gt;<script>var t="</p>";</script>
<ul><li>a<li>b</ul><aside>side</aside><form>go</form><section class="comments"><p>nice</p></section></article></main><div class="sidebar">zz</div><footer>&copy;</footer>"""


def test_main_text():
    assert style_tree.main_text(PAGE) == "A & bc One two Three <x> a b"
    assert style_tree.main_text(None) == "" and style_tree.main_text("") == "" and style_tree.main_text("plain  text") == "plain text"
    assert style_tree.main_text("<script>no end") == ""
    assert len(style_tree.main_text("<p>" + "word " * 50000)) == 249999


def test_style_tree_drops_what_is_alike(spark):
    page = lambda i: f"<body><div class=x>Everywhere the same</div><div class=y>text {i} {i * 7}</div></body>"
    rows = [(i, "http://host.a/x", page(i), "h") for i in range(8)] + [(100 + i, f"http://h{i}.b/x", page(i), "h") for i in range(3)]
    rows += [(200, None, None, "h"), (201, "u", "", "h"), (0, "http://host.a/x", page(0), "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in style_tree.extract(df).collect()}
    assert got[3].text == "text 3 21" and got[3].n_chars == 9
    assert got[100].text == "Everywhere the same text 0 0" and got[200].text == "" and got[201].n_chars == 0
    assert style_tree.extract(df).count() == len(rows) and style_tree.extract(df.limit(0)).count() == 0


def test_style_tree_drops_what_is_alike_inside_articles(spark):
    page = lambda i: f"<body><{'article' if i % 2 else 'main'}><div class=x>Share it with all</div><p>text {i}</p></body>"
    rows = [(i, "http://host.a/x", page(2 * i + 1)) for i in range(8)] + [(50 + i, "http://host.b/x", page(2 * i)) for i in range(8)] + [(100 + i, "http://few.b/x", page(1 + 2 * i)) for i in range(3)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 7" and got[53] == "text 6" and got[101] == "Share it with all text 3"


def test_style_tree_counts_equal_pages_once(spark, monkeypatch):
    page = lambda i: f"<body><div class=y>text {i}</div></body>"
    rows = [(i, "http://HOST.a/x" if i % 2 else "http://host.a/y", page(0)) for i in range(40)] + [(100 + i, "http://host.a/x", page(1 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a batch a page
    try:
        for bound in (style_tree.BROADCAST_NODES, 0):
            monkeypatch.setattr(style_tree, "BROADCAST_NODES", bound)
            assert {r.page_id: r.text for r in style_tree.extract(df).collect()} == {i: f"text {max(i - 99, 0)}" for i, _, _ in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_style_tree_joins_when_too_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(style_tree, "BROADCAST_NODES", 0)
    page = lambda i: f"<body><div class=x>same</div><div class=y>text {i}</div></body>"
    df = spark.createDataFrame([(i, "http://host.a/x", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in style_tree.extract(df).collect()} == {f"text {i}" for i in range(6)}


def test_importances_against_plain_counts(spark):
    rng = random.Random(20)
    part = lambda: rng.choice(["<p>same</p>", f"<p>{rng.randrange(4)}</p>", f"<div class=c{rng.randrange(2)}><p>{rng.randrange(9)}</p></div>", "<ul><li>x<li>y</ul>"])
    rows = [(i, f"http://h{rng.randrange(3)}.org/{i}", f"<body>{''.join(part() for _ in range(rng.randint(1, 5)))}</body>") for i in range(60)]
    seen: dict = {}
    for host, html in {(url.split("/")[2], html) for _, url, html in rows}:
        page = style_tree.parse(html)
        for node, _, _, text in {(b[0], 0, 0, b[3]) for b in page.blocks}:
            seen.setdefault((host, node, 1), []).append(text)
        for node, shown in set(page.presentations):
            seen.setdefault((host, node, 0), []).append(shown)
    want: dict = {}
    for (host, node, _), all_ in seen.items():
        n = len(all_)
        own = 1.0 if n < 4 else -sum(all_.count(x) / n * math.log(all_.count(x) / n) for x in set(all_)) / math.log(n)
        want[host, node] = max(own, want.get((host, node), 0.0))
    want = {k: v for k, v in want.items() if (*k, 1) in seen}
    got = {(r.host, r.node): r.importance for r in style_tree.importances(spark.createDataFrame(rows, "page_id long, url string, html string"), 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_weak_words_go_only_where_alike(spark):
    page = lambda i: f"<body><div class=more>{i % 2 and 'Read on'} </div><div class='more-info'>fact {i}</div><div class=comments>c {i}</div></body>"
    rows = [(i, "http://host.a/x", page(i).replace("False", "Read on").replace("0 ", "Read on ")) for i in range(8)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "fact 3"
    assert style_tree.main_text("<div class='more-info'>fact</div>") == "fact"


def test_broken_and_deep_pages():
    import time

    began = time.perf_counter()
    assert style_tree.main_text('<p>a <a title="x < y">b</a> c</p>') == "a b c"
    assert style_tree.main_text('<p>one</p><a href="x>two</a><p>three</p>').startswith("one")
    for html in ('<a "' * 60000, "<div>" * 100000 + "</section>" * 100000, "<" * 200000, "<p x='" * 50000, "<!--" * 50000):
        style_tree.main_text(html)
    assert time.perf_counter() - began < 20
    assert style_tree.main_text("<div>" * 100000 + "deep") == "deep"


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(1, 1), (None, 3)]
    up: dict[int, int] = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names():
    assert len({n.split("_")[0] for n in queries.QUERIES}) == 10 and set(queries.SQL) <= set(queries.QUERIES)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda: prose(rng, 60, 3000)
    docs = [(i, text()) for i in range(60)]
    docs += [(60, docs[1][1]), (61, docs[2][1] + " more")]
    docs += [(70 + i, "start blockhead " + text()) for i in range(30)]
    bench = text()
    docs.append((200, f"{text()} {' '.join(bench.split()[5:25])}"))
    lines = [(300 + i, f"{text()}\nplease visit the mirror now\n{text()}") for i in range(6)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs + lines], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(70 <= i < 100)) for i, _ in docs[:-1]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, t in docs if "blockhead" in t}
    assert set(left) == {i for i, _ in docs + lines} - toxic - {60, 61, 200}
    assert left[301].decoded_sha256 == spark.range(1).select(F.sha2(F.lit(lines[1][1].replace("\nplease visit the mirror now", "")), 256).alias("s")).first().s


def test_answers_by_broadcast_and_by_join_are_alike(spark, monkeypatch):
    from textdelta.llm import components as own

    rng = random.Random(18)
    rows = spark.createDataFrame([(rng.choice([0, 0, 0, rng.randrange(60)]), i % 3, i) for i in range(4000)], "k long, j int, x long").union(spark.createDataFrame([(None, 1, -1)], "k long, j int, x long"))
    answers = rows.where("k % 7 <> 3").groupBy("k", "j").agg(F.min("x").alias("least"), F.count("*").alias("n"))
    want = sorted(map(str, own.answered(rows, answers, ["k", "j"], F.col("x")).collect()))
    for rows_most, hot in ((0, 1000), (0, 10), (0, 1 << 40)):
        monkeypatch.setattr(own, "BROADCAST_ROWS", rows_most)
        monkeypatch.setattr(own, "HOT", hot)
        assert sorted(map(str, own.answered(rows, answers, ["k", "j"], F.col("x")).collect())) == want


def test_line_dedup_by_joins(spark, monkeypatch):
    """The same rows where nothing is few enough for a broadcast."""
    from textdelta.llm import components as own
    from textdelta.llm import line_dedup

    rng = random.Random(19)
    texts = [(i, "\n".join(rng.choice([f"item {rng.randrange(9)} is in the basket of user {prose(rng, 1, 3)}", "All rights reserved.", prose(rng, 6, 4)]) for _ in range(6))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(str, line_dedup.digest(docs).collect()))
    monkeypatch.setattr(own, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(own, "HOT", 20)
    assert sorted(map(str, line_dedup.digest(docs).collect())) == want


def test_near_copies_of_repeated_rows_and_rows_without_ids(spark):
    import corpus_pipeline

    rng = random.Random(22)
    a, b, c = (prose(rng, 60, 3000) for _ in range(3))
    rows = [(5, a), (5, a), (9, a), (None, a), (None, b), (None, b), (None, f"{b} more"), (7, c), (8, ""), (8, ""), (None, ""), (None, ""), (10, None), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text and b not in r.text) == sorted([("5", a), ("7", c)])
    assert sum(b in (r.text or "") for r in left) == 1 and sum(not r.text for r in left) == 6
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), "").count() == 0


def test_url_model_probabilities_add_up_to_one(spark):
    """Over all bytes that may follow a context, met in training or not."""
    import pyarrow as pa

    rng = random.Random(23)
    texts = ["".join(rng.choice("abc") for _ in range(12)) for _ in range(60)]
    model, _ = url_filter.fit(spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text string, accepted boolean"))
    for start in (texts[0][:7], "zzabc", ""):
        total = [0.0, 0.0]
        for c in range(256):
            data = np.frombuffer(start.encode() + bytes([c]), np.uint8)
            p = [1 / 256, 1 / 256]
            for order, (context, both) in enumerate(url_filter._contexts(data, np.array([0, len(data)]), url_filter.KEYS)):
                for label in (0, 1):
                    seen = lambda kind, cell: float(model.counts.of(label, order, kind, cell[-1:])[0])  # noqa: B023, E731
                    p[label] = (seen(1, both) + url_filter.WEIGHT * p[label]) / (seen(0, context) + url_filter.WEIGHT)
            total = [a + b for a, b in zip(total, p, strict=True)]
        assert all(abs(x - 1) < 1e-9 for x in total)
    assert model.scores(pa.array(["abc"])).shape == (1,)


def test_url_models_larger_than_a_broadcast_score_alike(spark, monkeypatch):
    """By the join as by the broadcast: hot and empty texts, nulls, repeated ids and rows, texts over a group's size."""
    rng = random.Random(29)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.com/en/{i}" if i % 2 else f"http://{word('vwxyzé')}.net/de/{i}") for i in range(400)]
    rows += [(1000 + i, f"x://{word('abcdv')}.info/{word('xyzé')}") for i in range(60)]
    rows += [(2000 + i, "x://same.info/") for i in range(300)] + [(None, None), (3000, None), (3001, "no host"), (3002, "x://")] * 30
    rows += [(4000, "x://" + "ab" * 3000), (4000, "x://" + "ab" * 3000), (4001, "x://q.info/" + "z" * 5000)]
    df = spark.createDataFrame([(*r, "h", "t", 1.0) for r in rows], "page_id long, url string, host string, text string, score double")
    read = lambda: sorted(map(tuple, url_filter.judge(df).collect()), key=repr)
    whole = read()
    monkeypatch.setattr(url_filter, "MODEL_ROWS", 100)
    monkeypatch.setattr(url_filter, "GROUP_BYTES", 2000)
    assert read() == whole and len(whole) == len(rows)
    monkeypatch.setattr("textdelta.llm.components.BROADCAST_ROWS", 10)  # scores by a shuffle, a hot text's by broadcast
    monkeypatch.setattr("textdelta.llm.components.HOT", 50)
    assert read() == whole
    assert url_filter.judge(df.limit(0)).count() == 0
