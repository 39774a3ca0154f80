import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from shoplens.operators import graph, mining, topics
from shoplens.operators.tokens import filter_tokens, token_sentiment, tokenize, vector_terms
from shoplens.plans.reports import analyze_text


def docs(spark, *tokens):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(tokens)], "id long, tokens array<string>")


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def tokens_of(df):
    return [r.tokens for r in df.orderBy("id").collect()]


def test_english_tokens(spark):
    df = texts(spark, "Hello, a1b big_ones über straße", "The cat sat", None)
    assert tokens_of(tokenize(df, "text")) == [["hello", "big", "ones", "ber", "stra"], ["cat", "sat"], []]
    assert tokens_of(tokenize(df, "text", stopwords=["cat"]))[1] == ["sat"]


def test_lemmas_come_before_stopwords(spark):
    df = texts(spark, "cats runs cats", "the", "")
    lemmas = spark.createDataFrame([("cats", "catt"), ("cats", "cat"), ("runs", "the"), (None, "x")], "token string, lemma string")
    assert tokens_of(tokenize(df, "text", lemmas=lemmas)) == [["cat", "cat"], [], []]


def test_other_scripts(spark):
    assert tokens_of(tokenize(texts(spark, "很好吃 a 好 价格"), "text", "zh", ["价格"])) == [["很好吃"]]
    assert tokens_of(tokenize(texts(spark, "とても良い!犬 ok"), "text", "ja")) == [["とても良い"]]
    with pytest.raises(ValueError):
        tokenize(texts(spark, "가"), "text", "ko")


def tagged(text):
    """Stands for a morphological analyzer: words of the form form/tag."""
    return F.transform(F.split(text, " "), lambda w: F.struct(
        F.get(F.split(w, "/"), F.lit(0)).alias("form"), F.get(F.split(w, "/"), F.lit(1)).alias("tag")))


def test_analyzer_and_tag_filter(spark, rows):
    df = texts(spark, "배송/NNG 좋/VA 값/NNG 상품/NNP 달리/VV 것들/NNG")
    assert tokens_of(tokenize(df, "text", "ko", ["것들"], analyzer=tagged)) == [["배송", "상품"]]
    table = spark.createDataFrame(
        [(1, 0, "배송", "NNG"), (1, 1, "값", "NNG"), (1, 2, "달리", "VV"), (1, 3, "것들", "NNG")],
        "doc_id long, pos int, form string, tag string")
    assert rows(filter_tokens(table, stopwords=["것들"]), "form") == [("배송",)]
    assert rows(filter_tokens(table, pos_tags=["VV"]), "form") == [("달리",)]


def test_token_sentiment(spark, rows):
    lexicon = [("great", 1), ("greatest", 2), ("bad", -1)]
    df = token_sentiment(docs(spark, "bad bad great", "the greatest", ""), lexicon)
    assert rows(df, "id", "score", "label") == [(0, -1, "negative"), (1, 2, "positive"), (2, 0, "neutral")]
    assert [r.n for r in mining.token_sentiment_distribution(df).collect()] == [1, 1, 1]
    shown = mining.token_sentiment_examples(df.withColumn("text", F.lit("x" * 130)), "text", "id")
    assert {(r.label, r.id, len(r.example)) for r in shown.collect()} == {("negative", 0, 120), ("positive", 1, 120)}


def test_word_counts(spark, rows):
    df = docs(spark, "b a b", "b c", "")
    assert rows(mining.word_freq(df, 2), ordered=True) == [("b", 3), ("a", 1)]
    assert rows(mining.cloud_weights(mining.word_freq(df), [("a", -2)], 2)) == [("a", 1, "negative"), ("b", 3, "neutral")]


def test_tfidf(spark, rows):
    got = rows(mining.tfidf_keywords(docs(spark, "red red blue", "red", "")), ordered=True)
    assert got == [(1, "red", 0.6119), (2, "blue", 0.1831)]
    assert rows(mining.tfidf_keywords(docs(spark, "red red blue", "red", ""), vocab=1)) == [(1, "red", 0.6667)]
    assert mining.tfidf_keywords(docs(spark, "", "")).count() == 0


def test_ngrams(spark, rows):
    df = docs(spark, "aa bb aa bb", "aa", "")
    assert rows(mining.ngrams(df, 2), ordered=True) == [(2, 1, "aa + bb", 2), (2, 2, "bb + aa", 1)]
    assert rows(mining.ngrams(df, 3)) == [(3, 1, "aa + bb + aa", 1), (3, 2, "bb + aa + bb", 1)]
    assert mining.ngrams(df, 2, min_tokens=10).count() == 0
    assert mining.ngrams(docs(spark, *["a b"] * 5), 2, min_tokens=10).count() == 1


def test_edges(spark, rows):
    df = docs(spark, "aa bb cc", "aa bb", "bb aa aa", "dd", "")
    assert rows(mining.cooccurrence(df)) == [("aa", "bb", 3)]
    assert rows(mining.cooccurrence(df, min_count=1)) == [("aa", "bb", 3), ("aa", "cc", 1), ("bb", "cc", 1)]
    assert rows(mining.cooccurrence(df, top_n=1)) == []


# -- graphs --------------------------------------------------------------------------


def edges(spark, *rows):
    return spark.createDataFrame([(*sorted(r), 1) for r in rows], "w1 string, w2 string, weight long")


def test_centrality(spark):
    schema = "w1 string, w2 string, weight long"
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("c", "d", 2), ("b", "d", 5)], schema)
    assert {r.node: round(r.degree, 4) for r in graph.degree_centrality(e).collect()} == {
        "a": 0.3333, "b": 1.0, "c": 0.6667, "d": 0.6667}
    assert {r.node: round(r.betweenness, 4) for r in graph.betweenness(e).collect()} == {
        "a": 0.0, "b": 0.6667, "c": 0.6667, "d": 0.0}
    inverse = {r.node: round(r.betweenness, 4) for r in graph.betweenness(e, "inverse").collect()}
    assert inverse == {"a": 0.0, "b": 0.6667, "c": 0.0, "d": 0.0}
    two = spark.createDataFrame([("a", "b", 2)], schema)
    assert {r.betweenness for r in graph.betweenness(two).collect()} == {0.0}


def brute_betweenness(nodes, weights):
    """All simple paths; shares of the shortest ones."""
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths = []
        for r in range(len(nodes) - 1):
            for middle in itertools.permutations([x for x in nodes if x not in (s, t)], r):
                walk = (s, *middle, t)
                steps = [weights.get(frozenset(p)) for p in itertools.pairwise(walk)]
                if None not in steps:
                    paths.append((sum(steps), middle))
        if paths:
            best = min(length for length, _ in paths)
            shortest = [m for length, m in paths if length == best]
            for m in shortest:
                for x in m:
                    score[x] += 1 / len(shortest)
    n = len(nodes)
    return {x: v / ((n - 1) * (n - 2)) for x, v in score.items()}


@pytest.mark.parametrize("seed", range(3))
def test_betweenness_against_all_paths(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdef"
    weights = {frozenset(p): rng.randint(1, 3) for p in itertools.combinations(nodes, 2) if rng.random() < 0.6}
    e = spark.createDataFrame([(*sorted(p), w) for p, w in weights.items()], "w1 string, w2 string, weight long")
    used = sorted({x for p in weights for x in p})
    got = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert got == pytest.approx(brute_betweenness(used, weights))


def test_betweenness_of_two_hundred_thousand_edges(spark, monkeypatch):
    """A hub joins two dense halves: all paths between them pass it, no other node lies on a shortest path."""
    half = 448
    pairs = spark.range(half).select(F.col("id").alias("i")).join(spark.range(half).select(F.col("id").alias("j")), F.expr("i < j"))
    sides = pairs.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), "i", "j")
    inner = sides.select(F.format_string("%s%03d", "side", "i").alias("w1"), F.format_string("%s%03d", "side", "j").alias("w2"))
    outer = inner.select(F.explode(F.array("w1", "w2")).alias("w1")).distinct().select("w1", F.lit("hub").alias("w2"))
    edges = inner.unionByName(outer).withColumn("weight", F.lit(2)).persist()
    assert edges.count() > 200_000
    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(edges), name, lambda *a, **k: pytest.fail("rows reached the driver"))
    found = graph.betweenness(edges)
    monkeypatch.undo()
    got = {r.node: r.betweenness for r in found.collect()}
    n = 2 * half + 1
    assert len(got) == n and got.pop("hub") == pytest.approx(2 * half * half / ((n - 1) * (n - 2)))
    assert set(got.values()) == {0.0}
    edges.unpersist()


def test_betweenness_bounds(spark, monkeypatch):
    schema = "w1 string, w2 string, weight long"
    assert graph.betweenness(spark.createDataFrame([], schema)).collect() == []
    monkeypatch.setattr(graph, "MAX_EDGES", 1)
    with pytest.raises(ValueError, match="more than 1 edges"):
        graph.betweenness(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], schema))


def modularity(pairs, groups):
    m = len(pairs)
    degree = {x: sum(x in p for p in pairs) for p in pairs for x in p}
    return sum(sum(a in g and b in g for a, b in pairs) / m - (sum(degree[x] for x in g) / (2 * m)) ** 2 for g in groups)


def brute_greedy(pairs):
    """Try every connected merge, keep the best, until modularity would fall."""
    groups = [frozenset(x) for x in sorted({x for p in pairs for x in p})]
    while len(groups) > 1:
        now, options = modularity(pairs, groups), []
        for a, b in itertools.combinations(groups, 2):
            if any((p in a and q in b) or (p in b and q in a) for p, q in pairs):
                merged = [g for g in groups if g not in (a, b)] + [a | b]
                names = tuple(sorted((max(a), max(b))))
                options.append((-round(modularity(pairs, merged) - now, 12), names, merged))
        if not options or min(options)[0] > 0:
            break
        groups = min(options)[2]
    return {frozenset(g) for g in groups}


def test_communities_against_all_merges(spark):
    graphs = {}
    for seed in range(6):
        rng = random.Random(seed)
        graphs[str(seed)] = [p for p in itertools.combinations("abcdefgh", 2) if rng.random() < 0.4]
    e = spark.createDataFrame([(g, *p) for g, pairs in graphs.items() for p in pairs], "g string, w1 string, w2 string")
    found = {}
    for r in graph.communities(e, by="g").collect():
        found.setdefault((r.graph, r.group), set()).add(r.node)
    for g, pairs in graphs.items():
        got = {frozenset(nodes) for (name, _), nodes in found.items() if name == g}
        assert math.isclose(modularity(pairs, got), modularity(pairs, brute_greedy(pairs)), abs_tol=1e-9)


def test_communities(spark, rows):
    triangles = ["ab", "bc", "ac", "cd", "de", "ef", "df"]
    e = edges(spark, *triangles).withColumn("lang", F.lit("en"))
    e = e.unionByName(edges(spark, "xy").withColumn("lang", F.lit("fr")))
    got = rows(graph.communities(e, by="lang"))
    assert got == [("en", x, 1) for x in "abc"] + [("en", x, 2) for x in "def"] + [("fr", x, 1) for x in "xy"]
    assert graph.communities(e.limit(0)).count() == 0


def test_components(spark, rows):
    e = edges(spark, "ab", "cd")
    assert rows(graph.components(e)) == [("all", "a", "a"), ("all", "b", "a"), ("all", "c", "c"), ("all", "d", "c")]
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    assert {r.component for r in graph.components(edges(spark, *chain)).collect()} == {"n00"}


def test_keyword_network(spark, rows):
    df = docs(spark, *["red blue green"] * 2, *["blue gold"] * 2)
    got = rows(graph.keyword_network(df), ordered=True)
    assert [r[:4] for r in got] == [(1, "blue", 1.0, 0.6667), (2, "green", 0.6667, 0.0), (3, "red", 0.6667, 0.0), (4, "gold", 0.3333, 0.0)]
    with pytest.raises(ValueError):
        graph.keyword_network(docs(spark, "red", "blue"))


# -- topics and the report -----------------------------------------------------------


@pytest.fixture(scope="module")
def two_themes(spark):
    return docs(spark, *["sun sea sand wave"] * 20, *["code bug test loop"] * 20, "")


def test_topics_separate_disjoint_words(spark, two_themes):
    fitted = topics.fit_topics(two_themes, "id", k=2, passes=20)
    words = {}
    for r in topics.lda_topics(fitted, 4).collect():
        words.setdefault(r.topic, set()).add(r.word)
    assert sorted(map(sorted, words.values())) == [["bug", "code", "loop", "test"], ["sand", "sea", "sun", "wave"]]
    assigned = {r.id: r.topic for r in topics.lda_doc_topics(fitted, "id").collect()}
    assert len({assigned[i] for i in range(20)}) == 1 and assigned[0] != assigned[20] and assigned[40] == 1
    share = topics.topic_share(fitted, "id").collect()
    assert [r.topic for r in share] == [1, 2] and sum(r.n for r in share) == 41
    again = topics.fit_topics(two_themes, "id", k=2, passes=20)
    assert topics.lda_topics(again, 4).collect() == topics.lda_topics(fitted, 4).collect()


def test_topics_of_many_documents_are_those_of_each_alone():
    """Documents inferred at once, drawn twice or slow to settle get what one by one gives."""
    rng = np.random.default_rng(5)
    shares = rng.gamma(0.3, 1.0, (3, 60)) + 1e-6
    sizes = np.concatenate([[0, 1, 60], rng.integers(0, 40, 700)])
    words = np.concatenate([rng.choice(60, n, replace=False) for n in sizes])
    counts = rng.integers(1, 50, len(words)).astype(float)
    times = rng.integers(1, 4, len(sizes))
    start = rng.gamma(100, 0.01, (3, len(sizes)))
    weights, theta = topics.infer(shares, sizes, words, counts, start)
    found = topics.word_shares(shares, sizes, words, counts, theta, times)
    total, ends = np.zeros_like(shares), np.cumsum(sizes)
    for d, (begin, end) in enumerate(zip(ends - sizes, ends)):
        own, n, now = shares[:, words[begin:end]], counts[begin:end], start[:, d]
        change = 1.0 if len(n) else 0.0
        while change > 1e-3:
            mixed = topics._expected(now)
            last, now = now, mixed * (own @ (n / (mixed @ own))) + 1 / 3
            change = np.abs(now - last).mean()
        if len(n):
            assert np.allclose(weights[:, d], now, rtol=1e-6)
            mixed = topics._expected(now)
            np.add.at(total.T, words[begin:end], (times[d] * mixed[:, None] * own * (n / (mixed @ own))).T)
        else:
            assert weights[:, d].tolist() == [1 / 3] * 3
    assert np.allclose(found, total, rtol=1e-6)


def test_topics_are_drawn_with_replacement(spark):
    """As often as Poisson numbers say, of which the mean and the share of rows left out are known."""
    rows = spark.range(40000).select(topics._times(0.5, 7).alias("times")).groupBy("times").count().collect()
    drawn = {r.times: r["count"] / 40000 for r in rows}
    assert abs(sum(n * x for n, x in drawn.items()) - 0.5) < 0.02
    assert abs(drawn[0] - math.exp(-0.5)) < 0.02 and abs(drawn[2] - math.exp(-0.5) / 8) < 0.01


def test_topics_are_those_of_sparks_lda(spark, two_themes):
    fitted = topics.fit_topics(two_themes, "id", k=2, passes=20)
    model = LDA(k=2, optimizer="online", maxIter=40, subsamplingRate=0.5, learningOffset=10.0, learningDecay=0.7, seed=42,
                docConcentration=[0.5, 0.5], topicConcentration=0.5, optimizeDocConcentration=False).fit(fitted.vectors)
    known = model.topicsMatrix().toArray().T
    ours, theirs = (x / x.sum(axis=1, keepdims=True) for x in (fitted.weights, known))
    assert np.abs(ours - theirs).max() < 0.02


def test_topics_need_data(spark):
    with pytest.raises(ValueError):
        topics.fit_topics(docs(spark, "one one"), "id")


def test_text_report(spark):
    df = texts(spark, *["the best red apple", "sad green apple pie"] * 6)
    tables, errors = analyze_text(df, "id", analyses=["tfidf", "network", "wordcloud", "sentiment"], lexicon=[("best", 2), ("sad", -1)])
    assert errors == []
    assert {"word_freq", "overview", "tfidf", "bigrams", "trigrams", "edges", "network", "cloud", "sentiment_distribution"} <= set(tables)
    o = tables["overview"].first()
    assert (o.n_docs, o.n_words, o.text_column, o.language) == (12, 6, "text", "en")
    assert [r.n for r in tables["sentiment_distribution"].collect()] == [6, 6, 0]


def test_a_failing_part_leaves_the_others(spark):
    tables, errors = analyze_text(texts(spark, "red apple"), "id", analyses=["tfidf", "lda", "network", "sentiment"])
    assert [name for name, _ in errors] == ["lda", "network", "sentiment"]
    assert tables["tfidf"].count() == 2 and tables["bigrams"].count() == 1


def test_vector_terms(spark):
    """What a word-count vectorizer with its usual token pattern makes of the joined tokens."""
    given = [["USB케이블", "Wi-Fi", "a", "한_글", "x1"], ["ÉTÉ", "3.5인치", "가"], [], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id long, tokens array<string>")
    got = [r.tokens for r in vector_terms(df).orderBy("id").collect()]
    assert got == [re.findall(r"(?u)\b\w\w+\b", " ".join(t).lower()) if t is not None else None for t in given]
    assert got[0] == ["usb케이블", "wi", "fi", "한_글", "x1"]


def test_report_counts_terms_of_analyzed_tokens(spark):
    """Forms that differ in case are one term of the weights, and two tokens of the frequencies."""
    df = spark.createDataFrame([(i, f"{w} 케이블 연결") for i, w in enumerate(("USB", "usb", "Wi-Fi"))], "id long, text string")

    def analyzer(body):
        return F.transform(F.split(body, " "), lambda t: F.struct(t.alias("form"), F.lit("NNG").alias("tag")))

    tables, errors = analyze_text(df, "id", "text", lang="ko", analyses=("tfidf",), analyzer=analyzer)
    assert errors == []
    assert {"USB", "usb", "Wi-Fi"} < {r.word for r in tables["word_freq"].collect()}
    assert {r.term for r in tables["tfidf"].collect()} == {"usb", "wi", "fi", "케이블", "연결"}
