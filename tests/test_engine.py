import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdelta import queries
from textdelta.functions import mapping, metrics, normalize, render, tokens
from textdelta.operators import align, classify, group, naive_bayes, select, semantic, single, syntax
from textdelta.plans.config import CyclicDependency, DiffConfig, InvalidDependency, execution_order
from textdelta.plans.engine import compute_diff, compute_distinct, ops_table, summary


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "text", "out"),
    [
        ("lowercase", "Hello World", "hello world"),
        ("whitespace", "Hello    World", "Hello World"),
        ("whitespace", "a  b  ", "a b "),
        ("whitespace_trim", "  a  b  ", "a b"),
        ("whitespace_each", "a  b  ", "a  b"),
        ("remove_punctuation", "Hello, World!", "Hello World"),
        ("remove_numbers", "Test123", "Test"),
        ("remove_accents", "é, à!", "e a"),
        ("remove_latin_accents", "é, à!", "e a"),
        ("lowercase", None, None),
        ("lowercase", "", ""),
    ],
)
def test_normalizers(spark, name, text, out):
    assert one(spark, text, normalize.NORMALIZERS[name]) == out


@pytest.mark.parametrize(
    ("name", "text", "out"),
    [
        ("character", "abc", ["a", "b", "c"]),
        ("word", "Test123 don't café² a,b!", ["Test", "123", "don", "t", "café", "²", "a", "b"]),
        ("char_bigram", "abc", ["ab", "bc"]),
        ("char_bigram", "a", []),
        ("word_bigram", "a b c", ["a b", "b c"]),
        ("word_bigram", "a", []),
        ("sentence", "Hi there...  OK? tail bit", ["Hi there.", ".", ".", "OK?", "tail bit"]),
        ("word", "", []),
    ],
)
def test_tokenizers(spark, name, text, out):
    assert one(spark, text, tokens.TOKENIZERS[name]) == out


def pair(spark, a, b, **config):
    return compute_diff(spark.createDataFrame([(1, a, b)], "pair_id long, original string, modified string"), DiffConfig(**config))


def test_text_metrics(spark):
    r = metrics.text_metrics(spark.createDataFrame([("The cat sat on the mat.",)], "t string"), "t").first()
    assert (r.char_count, r.word_count, r.sentence_count, r.syllable_count) == (23, 6, 1, 6)
    assert r.flesch_reading_ease == pytest.approx(116.145) and r.flesch_kincaid_grade == pytest.approx(-1.45)


def test_default_diff(spark):
    r = pair(spark, "hello world", "hello rust").first()
    assert (r.insertions, r.deletions, r.modifications, r.edit_distance, r.levenshtein_distance) == (1, 1, 0, 2, 5)
    assert r.change_percentage == pytest.approx(2 / 11) and r.semantic_similarity == pytest.approx(1 / 3)
    assert r.stylistic_change == pytest.approx(0.045455, abs=1e-6) and r.readability_change == -0.5
    assert [o.category for o in r.ops] == ["Unknown", "Semantic", "Semantic"]


def test_edges_of_pairs(spark):
    rows = [(1, "", ""), (2, None, "a"), (3, "café noir", "cafe noir"), (4, "", "hello world"), (5, "a " * 20000, "b " * 20000)]
    df = spark.createDataFrame(rows, "pair_id long, original string, modified string")
    found = {r.pair_id: r for r in compute_diff(df, DiffConfig(max_chars=1000)).collect()}
    assert found[1].word_overlap == 1.0 and found[1].ops == [] and found[1].change_percentage == 0.0
    assert found[2].ops is None
    assert found[3].levenshtein_distance == 1
    assert found[4].insertions == 2
    assert found[5].edit_distance == 40000 and found[5].levenshtein_distance is None
    assert compute_diff(df.limit(0)).count() == 0


def test_minimal_and_pruned(spark):
    r = pair(spark, "hello world", "hello rust", algorithm="myers", compute_semantic_similarity=False, classify_edits=False, analyze_style=False, compat_pruned_metrics=True).first()
    assert r.semantic_similarity == 0.0 and r.word_overlap == 0.0 and r.length_ratio == 0.0 and r.edit_distance == 2
    assert DiffConfig.minimal().metrics() == []


def test_plan_order():
    order = execution_order({"char_similarity", "semantic_similarity"})
    assert order.index("levenshtein_distance") < order.index("char_similarity")
    with pytest.raises(InvalidDependency):
        execution_order({"nothing"})
    with pytest.raises(CyclicDependency):
        execution_order({"a"}, {"a": ("b",), "b": ("a",)})


def test_ignore_case_and_summary(spark):
    r = pair(spark, "Hello  World", "hello world", ignore_case=True, ignore_whitespace=True).select("*", summary().alias("line")).first()
    assert r.edit_distance == 0 and r.line.startswith("Changes: 0 insertions, 0 deletions")


@pytest.mark.parametrize(("part", "whole", "said"), [(69, 240, "28.8"), (1, 16, "6.3"), (2875, 10001, "28.7"), (0, 1, "0.0"), (3, 2, "150.0")])
def test_summary_rounds_half_up(spark, part, whole, said):
    df = spark.createDataFrame([(1, 2, 0, part / whole, part / whole)], "insertions long, deletions long, modifications long, change_percentage double, semantic_similarity double")
    assert df.select(summary().alias("line")).first().line == f"Changes: 1 insertions, 2 deletions, 0 modifications ({said}% changed, {said}% similar)"


def op(spark, kind, o, m, category="Unknown"):
    schema = "edit_type string, original_text string, modified_text string, category string, confidence double"
    return spark.createDataFrame([((kind, o, m, category, 0.8),)], f"op struct<{schema.replace(' string', ':string').replace(' double', ':double')}>")


@pytest.mark.parametrize(("o", "m", "category", "confidence"), [("Hello", "hello", "Formatting", 0.95), ("cat", "dog", "Semantic", 0.85), ("Hi!", "Hi", "Syntactic", 0.85), ("a b", "ab", "Formatting", 0.95)])
def test_rules(spark, o, m, category, confidence):
    r = op(spark, "Modify", o, m).select(classify.rule_based(F.col("op")).alias("r")).first().r
    assert (r.category, r.confidence) == (category, confidence)


def test_ensembles(spark):
    results = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("confidence")) for c, p in [("Semantic", 0.2), ("Semantic", 0.3), ("Stylistic", 0.9)]))
    r = spark.range(1).select(classify.ensemble(results).alias("v"), classify.ensemble(results, "average").alias("a"), classify.ensemble(results, "other").alias("o")).first()
    assert (r.v.category, r.a.category, r.o.category) == ("Semantic", "Stylistic", "Unknown")
    assert r.v.confidence == pytest.approx(2 / 3)


def test_selectors(spark):
    text = "# One\nfirst words here\n\nsecond part\n\nTHIRD PART\nlast words"
    df = pair(spark, text, text.replace("second", "2nd").replace("last", "final"), algorithm="myers")
    df = df.withColumns({"p": select.paragraph_spans(F.col("original")), "s": select.section_spans(F.col("original"))})
    ops = ops_table(df, ("pair_id", "p", "s"))
    texts = lambda c: {r.original_text for r in ops.where(c & select.deletions()).collect()}
    assert texts(select.paragraphs(F.col("p"), 1)) == {"second"}
    assert texts(select.sections(F.col("s"), "third")) == {"last"}
    assert texts(select.all_of()) == set() and texts(select.any_of(select.whole())) == {"second", "last"}


def test_naive_bayes(spark):
    rows = [(i, "Insert" if i % 2 else "Delete", None if i % 2 else "word" * (i % 3 + 1), "text" * (i % 4 + 1) if i % 2 else None, "x" if i % 2 else "y") for i in range(20)]
    samples = naive_bayes.features(spark.createDataFrame(rows, "i long, edit_type string, original_text string, modified_text string, label string"))
    assert len(samples.first().features) == 16
    model = naive_bayes.train(samples)
    found = naive_bayes.predict(samples, model).collect()
    assert all(r.predicted == r.label and 0 <= r.confidence <= 1 for r in found)
    assert naive_bayes.predict(samples, model.limit(0)).first().predicted == "Unknown"


@pytest.mark.parametrize(
    ("values", "threshold", "mean", "median"),
    [([0.3] * 20 + [0.8] * 20, 0.5, 0.55, 0.8), ([0.2] * 30 + [0.8] * 30, 0.44, 0.5, 0.8), ([0.5, 0.7, 0.6] + [0.5 + 0.02 * i for i in range(10)], 0.6, 0.592308, 0.6)],
)
def test_training(spark, values, threshold, mean, median):
    learned = semantic.train(spark.createDataFrame(list(enumerate(values)), "seq long, similarity double"))
    assert (learned.threshold, learned.mean, learned.median) == (pytest.approx(threshold, abs=1e-6), pytest.approx(mean, abs=1e-6), pytest.approx(median))
    assert semantic.Learned.from_json(learned.to_json()) == learned


def test_training_needs_samples(spark):
    with pytest.raises(semantic.TooFewSamples):
        semantic.train(spark.createDataFrame([(i, 0.5) for i in range(9)], "seq long, similarity double"))


def test_judging(spark):
    rows = spark.createDataFrame([(0.3,), (0.7,), (0.2,)], "s double").select(semantic.judge(F.col("s")).alias("j")).collect()
    assert [r.j.drifted for r in rows] == [True, False, True]
    assert rows[2].j.z == pytest.approx(-3.333333, abs=1e-6) and rows[2].j.outlier


def test_trends(spark):
    rows = [("g", i, str(i), s, 0.1) for i, s in enumerate([0.2, 0.4, 0.6])] + [("h", 0, "0", 0.5, 0.1)]
    found = {r.grp: r for r in group.trends(spark.createDataFrame(rows, "grp string, seq long, pair_id string, semantic_similarity double, change_percentage double")).collect()}
    assert found["g"].semantic_similarity_trend == "increasing" and found["g"].semantic_similarity_moving == pytest.approx(0.5)
    assert found["h"].semantic_similarity_trend == "insufficient_data"


def test_clusters_stop_as_in_sql(spark, monkeypatch, tmp_path):
    points = np.random.RandomState(94).rand(2000, 7)[:, :2]
    points = points[np.hypot(*(points - 0.5).T) < 0.5]
    centres, sizes = points[:3], {}
    for moves in range(101):  # these points are at rest after 71
        near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        sizes[moves] = np.bincount(near).tolist()
        centres = np.array([points[near == k].mean(0) for k in range(3)])
    assert sizes[60] != sizes[100]
    rows = [(str(i), i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    diffs = spark.createDataFrame(rows, "pair_id string, seq long, semantic_similarity double, change_percentage double")
    diffs = diffs.withColumns({c: F.lit(0.0) for c in ("insertions", "deletions", "modifications", "stylistic_change", "readability_change", "o_char_count")})
    with monkeypatch.context() as m:
        m.setattr(queries, "turn_pairs", lambda spark, sf_dir: None)
        m.setattr(queries, "compute_diff", lambda pairs: diffs)
        assert [r["size"] for r in queries.QUERIES["grp_clusters"](spark, "").orderBy("cluster").collect()] == sizes[60]
    same = [(i, turn, "user", "the same words") for i in range(3) for turn in range(3)]
    spark.createDataFrame(same, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.cluster, r["size"]) for r in queries.QUERIES["grp_clusters"](spark, str(tmp_path)).collect()] == [(0, 6)]


def test_groups_and_reports(spark):
    rows = [(i, i, "hello", "hello world " * (i + 1)) for i in range(5)]
    diffs = compute_diff(spark.createDataFrame(rows, "pair_id long, seq long, original string, modified string"))
    stats = group.statistics(diffs).first()
    assert stats.diff_count == 5 and stats.avg_deletions == 0
    assert {r.name for r in group.patterns(diffs).collect()} >= {"expansion", "Insert"}
    assert sum(r["size"] for r in group.clusters(diffs, 2).collect()) == 5
    assert group.clusters(diffs, 9).count() == 0
    report = single.Report(diffs)
    assert report.by_analyzer("edit_intent").first().metadata["primary_intent"] == "expansion"
    assert {r.metric for r in report.summary().collect()} >= {"word_overlap", "semantic_similarity"}


def test_result_averages(spark):
    rows = spark.createDataFrame([("a", {"metric1": 0.5}), ("b", {"metric1": 1.0})], "analyzer string, metrics map<string,double>")
    assert [(r.metric, r.average, r.n) for r in single.summary(rows).collect()] == [("metric1", 0.75, 2)]


def token(text, lemma, pos, dep, tag=None, head=0):
    return {"text": text, "lemma": lemma, "pos": pos, "tag": tag or pos, "dep": dep, "head": head, "is_stop": False, "is_punct": False}


def kinds(a, b):
    return [x["kind"] for x in syntax.align_tokens(a, b)]


def test_token_alignment():
    the, big, red, car = token("The", "the", "DET", "det"), token("big", "big", "ADJ", "amod"), token("red", "red", "ADJ", "amod"), token("car", "car", "NOUN", "ROOT")
    assert sorted(kinds([the, big, red, car], [the, red, big, car])) == ["Match", "Match", "Reorder", "Reorder"]
    she, do, does = token("She", "she", "PRON", "nsubj"), token("do", "do", "AUX", "aux", "VBP"), token("does", "do", "AUX", "aux", "VBZ")
    assert sorted(kinds([she, do, car], [she, does, car, red])) == ["Insertion", "Match", "Match", "Replacement"]
    assert sorted(kinds([the], [car])) == ["Deletion", "Insertion"]
    assert kinds([car], [the, car]) == ["Match", "Insertion"]
    assert kinds([], []) == []


def test_syntax(spark):
    o = [token("She", "she", "PRON", "nsubj", head=1), token("go", "go", "VERB", "ROOT", "VBP")]
    m = [token("She", "she", "PRON", "nsubj", head=1), token("goes", "go", "VERB", "ROOT", "VBZ")]
    df = spark.createDataFrame([(1, o, m), (2, None, m)], f"pair_id long, o array<{syntax.TOKEN}>, m array<{syntax.TOKEN}>").withColumn("al", syntax.alignment("o", "m"))
    args = (F.col("al"), F.col("o"), F.col("m"))
    found = df.select("pair_id", *(a(*args).alias(n) for n, a in syntax.ANALYZERS.items()), syntax.clauses(F.col("m")).alias("c")).orderBy("pair_id").collect()
    assert found[0].spacy_grammar.metrics["total_fixes"] == 2 and found[0].spacy_grammar.metrics["tense_corrections"] == 1
    assert found[0].c == ["She [goes]"] and found[0].spacy_structural.metrics["structural_similarity"] == 0.5
    assert found[1].spacy_pos.confidence == 0.0 and found[1].spacy_pos.metadata["status"] == "no annotation"


def test_maps(spark):
    df = spark.createDataFrame([("a  é",)], "t string").select(mapping.character_map("whitespace")("t").alias("w"), mapping.character_map("lowercase")("t").alias("l"))
    r = df.select(mapping.spans(F.col("w"), F.lit(0), F.lit(2)).alias("s"), mapping.positions(F.col("w"), F.lit(1)).alias("p"), mapping.compose(F.col("l"), F.col("w")).alias("c"), F.col("l")).first()
    assert [(x.start, x.end) for x in r.s] == [(0, 3)] and r.p == [1, 2]
    assert [x.kind for x in r.c][:2] == ["direct", "collapsed"] and [x.kind for x in r.l][-2:] == ["expanded", "expanded"]


def test_unified(spark):
    df = pair(spark, "a b", "a c", algorithm="myers")
    text = df.select(render.unified(F.lit("x"), F.lit("y"), F.array(render.token_hunk(F.col("ops")))).alias("u")).first().u
    assert text == "--- x\n+++ y\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"


def test_metrics_stay_in_the_jvm(spark):
    df = metrics.pair_metrics(spark.createDataFrame([("a", "b")], "original string, modified string"), only={"word_overlap"}).select("word_overlap")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "levenshtein" not in plan and "regexp_count" not in plan


def test_stream(spark, tmp_path):
    from textdelta.streaming.diffs import diff_stream, windowed_statistics

    rows = spark.createDataFrame([("1", "a b", "a c", "2024-01-01 00:00:01")], "pair_id string, original string, modified string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = diff_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = windowed_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stats").first().diff_count == 1


def test_spans_of_paragraphs_and_sections(spark):
    for text, starts in (("a b\n\nc d", [0, 5]), ("a b\r\n\r\nc d", [0, 7]), ("a b\n\t\nc d", [0, 6]), ("\n\n", []), ("", []), ("x\ny\n", [0])):
        assert [s.start for s in one(spark, text, select.paragraph_spans)] == starts
    found = one(spark, "intro\n# One\nbody\nTWO WORDS\r\nmore", select.section_spans)
    assert [(s.start, s.end, s.title) for s in found] == [(6, 17, "# One"), (17, 32, "TWO WORDS")]


def test_long_distances(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcé😀") for _ in range(n))
    pairs = [(text(rng.randint(0, 60)), text(rng.randint(0, 60))) for _ in range(200)] + [("", ""), ("a", ""), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("x"), align.edit_distance("a", "b").alias("y")).collect()
    assert all(r.x == r.y for r in got)
    long = text(20000)
    r = pair(spark, long, long[:9000] + "zz" + long[9100:]).first()
    assert r.levenshtein_distance == 100 and r.char_similarity == pytest.approx(0.995)


def test_linear_rows_give_the_same_script(monkeypatch):
    rng = random.Random(2)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 80))] for _ in range(2))
        whole = align.myers(a, b)
        monkeypatch.setattr(align, "ROWS", 1)
        assert align.myers(a, b) == whole
        monkeypatch.undo()


def test_injected_metrics_counts_and_distinct_pairs(spark):
    rows = [(1, "a b c", "a x c"), (2, "a b c", "a x c"), (3, "same", "same"), (4, None, "x")]
    df = spark.createDataFrame(rows, "pair_id long, original string, modified string")
    counted = {r.pair_id: r for r in compute_diff(df, DiffConfig(operations=False)).collect()}
    whole = {r.pair_id: r for r in compute_diff(df).collect()}
    names = ("insertions", "deletions", "modifications", "edit_distance", "change_percentage")
    assert all(counted[i][n] == whole[i][n] for i in (1, 2, 3) for n in names) and "ops" not in counted[1].asDict()
    given = compute_diff(df.withColumn("word_overlap", F.lit(0.25))).where("pair_id = 1").first()
    assert given.word_overlap == 0.25 and given.semantic_similarity == 0.25
    once = {r.pair_id: r for r in compute_distinct(df.where("pair_id < 4")).collect()}
    assert len(once) == 3 and once[2].ops == whole[2].ops


def test_extension_points(spark):
    align.CUSTOM_ALGORITHMS["replace_all"] = lambda a, b: [("-", i, None) for i in range(len(a))] + [("+", None, j) for j in range(len(b))]
    tokens.TOKENIZERS["long_words"] = tokens.at_least(tokens.words(), 3)
    try:
        r = pair(spark, "one of two", "one of two", algorithm="replace_all", tokenizer="long_words", classifiers=("rule_based",)).first()
        assert (r.insertions, r.deletions) == (2, 2) and r.ops[0].rule_based.category == "Semantic"
    finally:
        del align.CUSTOM_ALGORITHMS["replace_all"], tokens.TOKENIZERS["long_words"]
    for bad in ({"algorithm": "none"}, {"tokenizer": "none"}, {"context_lines": -1}):
        with pytest.raises(ValueError):
            DiffConfig(**bad)
    grams = pair(spark, "ab  cd ab", "ab cd", tokenizer="word_bigram", algorithm="myers").first()
    assert [(o.original_start, o.original_end, o.modified_end) for o in grams.ops] == [(0, 6, 5), (4, 9, None)]


def test_hunks_by_context(spark):
    name = lambda i, c="t": c + chr(97 + i // 10) + chr(97 + i % 10)
    a, b = " ".join(map(name, range(30))), " ".join(name(i, "x" if i in (3, 20) else "t") for i in range(30))
    df = pair(spark, a, b, algorithm="myers")
    for context, n in ((1, 2), (3, 2), (9, 1)):
        found = df.select(render.hunks(F.col("ops"), context).alias("h")).first().h
        assert len(found) == n
    first = df.select(render.hunks(F.col("ops"), 2).alias("h")).first().h[0]
    assert (first.original_start, first.original_count, first.modified_start, first.modified_count) == (2, 5, 2, 5)
    assert first.lines == [" tab", " tac", "-tad", "+xad", " tae", " taf"]
    assert pair(spark, "a", "a").select(render.hunks(F.col("ops")).alias("h")).first().h == []


def test_global_trend(spark):
    rows = [(f"p{i:03}", i, i / 100, 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "pair_id string, seq int, semantic_similarity double, change_percentage double").repartition(5)
    r = group.trends(df, by=None).first()
    assert r.n == 100 and r.semantic_similarity_slope == pytest.approx(0.01) and r.change_percentage_trend == "stable"
    assert r.semantic_similarity_moving == pytest.approx(sum(i / 100 for i in range(83, 100)) / 17)


def test_unicode_forms_and_layers(spark):
    assert one(spark, "é ﬁ", normalize.unicode_form("NFC")) == "é ﬁ" and one(spark, "ﬁ", normalize.unicode_form("NFKC")) == "fi"
    assert one(spark, "a\r\nb\rc d", normalize.newlines) == "a\nb\nc\nd" and one(spark, "a.b,c", normalize.without(".,")) == "abc"
    with pytest.raises(ValueError):
        normalize.unicode_form("NF")
    steps = normalize.Pipeline.of(["lowercase"]).add("reverse", lambda c: F.reverse(c))
    layers = mapping.LayerSet(steps, F.col("t"))
    r = spark.createDataFrame([("ABC",)], "t string").select(layers.final_layer().alias("a"), layers.map_to_original(2, F.lit(1)).alias("b"), layers.map_to_original(9, F.lit(1)).alias("c"), layers.all_texts().alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("cba", [1], [], ["ABC", "abc", "cba"])
    assert mapping.place_by_place(1, 2)[1] == {"norm": 1, "kind": "inserted", "orig": []}


def test_spans_are_picked_before_operations(spark):
    text = "# A License\none\n\n# Other\ntwo\n# late LICENSE\nthree"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(select.titled(select.section_spans(F.col("t")), "license").alias("s"), select.paragraph_numbers(select.paragraph_spans(F.col("t")), 1).alias("p"), select.paragraph_numbers(select.paragraph_spans(F.col("t"))).alias("none")).first()
    assert [(s.start, s.end) for s in r.s] == [(0, 17), (29, 49)]
    assert [(s.start, s.end) for s in r.p] == [(17, 49)] and r.none == []


def test_characters_of_an_empty_text_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "aé"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["tok_char"](spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: None}
