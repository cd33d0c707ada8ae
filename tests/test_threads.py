"""Similar pairs and single linkage of a symbol with more articles than the clustering limit."""

import pytest
from sqlcheck import ordered

from asofline.operators import threads
from asofline.plans import catalog


@pytest.mark.parametrize("name", ["t3_similar", "t4_single_linkage"])
def test_all_articles_of_a_symbol(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(threads, "TOKEN_DOCS", 50)  # frequent tokens take several blocks
    rows = [(25 * k, f"w{k // 2} x{k % 7} y{k % 11} every z{(k + 1) // 2 % 90}") for k in range(430)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/written")
    spark.read.parquet(f"{tmp_path}/written").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.SQL[name]
    expected = ordered(sql_rows(sql, tmp_path))
    assert ordered(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == expected
    assert len(expected[1]) >= 430


def sql_rows(sql, folder):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return c.sql(sql).fetchdf()


def plain_linkage(v, least):
    """The plain greedy: all pairs of clusters are looked at before each merge."""
    import numpy as np

    v = np.array(v, float)
    n = np.sqrt((v * v).sum(1))
    cos = (v / np.where(n == 0, 1, n)[:, None]) @ (v / np.where(n == 0, 1, n)[:, None]).T
    clusters, log = [[k] for k in range(len(v))], []
    mean = lambda a, b: cos[np.ix_(a, b)].sum() / (len(a) * len(b))
    while len(clusters) > 1:
        pairs = [(mean(clusters[a], clusters[b]), a, b) for a in range(len(clusters)) for b in range(a + 1, len(clusters))]
        s, a, b = max(pairs, key=lambda p: (round(p[0], 9), -p[1], -p[2]))
        if not s > least:
            break
        log.append((round(s, 6), clusters[a][0], clusters[b][0]))
        clusters[a] += clusters.pop(b)
    near = sorted((round(mean(clusters[a], clusters[b]), 6) for a in range(len(clusters)) for b in range(a + 1, len(clusters))), reverse=True)[:5]
    return [sorted(c) for c in clusters], log, near


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_equals_the_plain_greedy(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    v = r.normal(size=(40, 3)) if seed % 2 else r.integers(-1, 2, (40, 3))  # small whole numbers make many ties
    for least in (0.75, 0.2):
        clusters, log, near = threads._merges([list(map(float, x)) for x in v], least)
        want = plain_linkage(v, least)
        if seed % 2:
            assert sorted(sorted(c) for c in clusters) == sorted(want[0])
            assert [(round(s, 6), a, b) for s, a, b in log] == want[1]
            assert [round(x[0], 6) for x in near] == pytest.approx(want[2], abs=2e-6)
        assert all(s > least for s, *_ in log) and all(not x[0] > least for x in near)
    assert threads._merges([], 0.5) == ([], [], []) and threads._merges([[1.0]], 0.5)[0] == [[0]]


def test_tied_merges_take_the_first_pair():
    clusters, log, near = threads._merges([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]], 0.5)
    assert [(a, b) for _, a, b in log] == [(0, 2), (0, 4), (1, 3)] and sorted(map(sorted, clusters)) == [[0, 2, 4], [1, 3]] and len(near) == 1


def test_linkage_log_of_the_sample(spark):
    from asofline.plans import topics
    from asofline.sources import tables as T

    v = T.vectors(spark, "/root/testdata/sf0.001").withColumnRenamed("article_id", "id")
    docs = threads.newest(T.news(spark, "/root/testdata/sf0.001").join(v, "id"))
    got = topics.t5_linkage_log(spark, "/root/testdata/sf0.001").collect()
    assert any(r.kind == "rejected" for r in got)
    by = {}
    for r in docs.orderBy("symbol", "pos").collect():
        by.setdefault(r.symbol, []).append(r)
    for symbol, rows in by.items():
        log = plain_linkage([r.vector for r in rows], 0.2)[1]
        mine = sorted((r for r in got if r.symbol == symbol and r.kind == "merged"), key=lambda r: r.step)
        assert [(round(r.similarity, 6), r.a, r.b) for r in mine] == [(s, rows[a].id, rows[b].id) for s, a, b in log]


def test_vector_sums_of_a_hot_key(spark):
    import numpy as np
    from pyspark.sql import functions as F

    members = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), F.col("id").cast("string").alias("id"))
    vectors = spark.range(4990).select(F.col("id").cast("string").alias("article_id"), F.array(*[(F.col("id") * (j + 1) % 7 - 3).cast("float") for j in range(20)]).alias("vector"))
    got = {r.k: (r.n, r.sum) for r in threads.vector_sums(members, vectors, ["k"]).collect()}
    of = {}
    for i in range(4990):
        of.setdefault("hot" if i % 3 == 0 else str(i % 50), []).append([i * (j + 1) % 7 - 3 for j in range(20)])
    assert got.keys() == of.keys()
    for k, v in of.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.sum(v, 0))


def test_blocks_of_similar_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(threads, "BLOCK_TOKENS", 120)
    rows = [("ab"[k % 2], str(k), f"word{k // 24} xx{k % 5} every zz{k % 9 // 4} uu{k}") for k in range(200)] + [("c", "1", "alone here")]
    docs = spark.createDataFrame(rows, "symbol string, id string, text string")
    w = threads.weights(docs, F.col("text"))
    vector = {}
    for r in w.collect():
        vector.setdefault((r.symbol, r.id), {})[r.token] = r.weight
    size = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in vector.items()}
    want = {}
    for (s, a), v in vector.items():
        for (o, b), u in vector.items():
            if s == o and a < b and (x := sum(v[t] * u[t] for t in v.keys() & u) / size[s, a] / size[s, b]) > 0.25:
                want[s, a, b] = round(x, 9)
    assert threads.block_pairs(threads.unit_vectors(w)).select("symbol", "_i", "_j").distinct().count() > 6
    assert {(r.symbol, r.a, r.b): round(r.similarity, 9) for r in threads.similar(w).collect()} == want
    edges = {(r.symbol, r.a, r.b) for r in threads.similar(w, forest=True).collect()}

    def parts(pairs):
        of = {k: k for k in vector}
        for s, a, b in pairs:
            x, y = of[s, a], of[s, b]
            of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        return of

    assert edges <= set(want) and parts(edges) == parts(want)
    monkeypatch.setattr(threads, "BLOCK_TOKENS", 1_000_000)
    edges = {(r.symbol, r.a, r.b) for r in threads.similar(w, forest=True).collect()}
    assert edges <= set(want) and len(edges) < len(want) and len(edges) == len(vector) - len(set(parts(want).values()))


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(threads, "QUERY_ROWS", 60)
    r = np.random.default_rng(5)
    v = [list(map(float, x)) for x in r.integers(-2, 3, (150, 4))] + [[1.0, 2.0, 0.0, 1.0]] * 60 + [[0.0] * 4, [1.0, 1.0]]
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(v)] + [("none", None)], "id string, vector array<float>")
    queries = df.where("id like '%0' or id = '211' or id = 'none'").select(F.col("id").alias("q"), "vector")
    length = [sum(x * x for x in a) ** 0.5 for a in v]
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b])) / (length[a] * length[b]) if length[a] * length[b] else 0.0
    want = {}
    for q in [k for k in range(len(v)) if k % 10 == 0 or k == 211]:
        best = sorted((-cos(q, k), str(k)) for k in range(len(v)) if k != q and cos(q, k) >= 0.2)[:7]
        want |= {(str(q), k): (round(-s, 9), n + 1) for n, (s, k) in enumerate(best)}
    found = threads.nearest(queries, df, 7, 0.2)
    assert {(x.q, x.id): (round(x.similarity, 9), x.rank) for x in found.collect()} == want
    assert "FlatMapCoGroups" in found._jdf.queryExecution().toString()  # matrix products, no row for a pair


def test_chunks_are_embedded_once_a_text(spark):
    from pyspark.sql import functions as F

    from asofline.operators import documents

    rows = spark.createDataFrame([(k, "ab" * 30 * k) for k in range(5)], "k int, text string")
    got = {r.k: r.vector for r in documents.pooled(rows, "k", "text", lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)), 50).collect()}
    assert got == {k: [60 * k / max(1, -(-60 * k // 50)), 1.0] for k in range(5)}
    plan = documents.pooled(rows, "k", "text", lambda c: F.array(F.length(c).cast("double")), 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1


def test_labels_add_up_a_threads_shares(spark):
    from pyspark.sql import functions as F

    rows = [(s, str(k), f"apple{k % 3} berry every{k}", ("berry " * (k % 4)) or None, f"t{k % 2}") for s in "ab" for k in range(12)]
    docs = spark.createDataFrame(rows, "symbol string, id string, title string, description string, thread string")
    members = docs.where("symbol = 'a' and id <> '7'")
    w = threads.weights(docs)
    want = {(r.thread, r.token): round(r.weight, 9) for r in members.join(w, ["symbol", "id"]).groupBy("thread", "token").agg(F.sum("weight").alias("weight")).collect()}
    got = threads.weighted_terms(members, docs.select("symbol", "id", "title", "description"), 100)
    assert {(r.thread, r.term): round(r.weight, 9) for r in got.collect()} == want


def test_texts_meet_as_their_weights_do(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(threads, "TOKEN_DOCS", 30)
    monkeypatch.setattr(threads, "PIECE_CHARS", 300)
    rows = [("ab"[k % 2], str(k), f"word{k // 24} xx{k % 5} every zz{k % 9 // 4} uu{k} " + "often " * (k % 3 * 200)) for k in range(200)]
    rows += [("a", "none", None), ("a", "empty", "..."), ("c", "1", "alone here"), ("d", "1", None)]
    docs = spark.createDataFrame(rows, "symbol string, id string, text string")
    w = threads.weights(docs, F.col("text"))
    found = lambda pairs: {(r.symbol, r.a, r.b): round(r.similarity, 9) for r in pairs.collect()}
    want = found(threads.similar(w))
    assert len(want) > 500 and found(threads.similar_texts(docs, F.col("text"))) == want
    edges = found(threads.similar_texts(docs, F.col("text"), forest=True))
    assert edges.items() <= want.items() and len(edges) < len(want)
    blocks = threads.text_blocks(docs, F.col("text"))
    assert {r.symbol: r.n for r in blocks.groupBy("symbol").agg(F.count_distinct("_b").alias("n")).collect()} == {"a": 4, "b": 4, "c": 1}
    assert blocks.agg(F.max("piece")).first()[0] > 3


def test_a_text_is_exchanged_in_few_bytes(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(1)
    docs = spark.createDataFrame([("a", str(k), " ".join(f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(80))) for k in range(2000)], "symbol string, id string, text string")
    entries = threads.weights(docs, F.col("text")).count()
    size = sum(F.coalesce(F.length(c), F.lit(0)) for c in ("lengths", "df", "at", "n", "shared", "total"))
    assert threads.text_blocks(docs, F.col("text")).agg(F.sum(size)).first()[0] < 5 * entries
    plan = threads.similar_texts(docs, F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of blocks, not of tokens


@pytest.mark.parametrize("often, most", [(1 / 16, 512), (1 / 40, 3), (2, 1), (0, 10_000)])
def test_frequent_and_rare_tokens_add_up(monkeypatch, often, most):
    import numpy as np

    monkeypatch.setattr(threads, "OFTEN", often)
    monkeypatch.setattr(threads, "MOST_OFTEN", most)
    r = np.random.default_rng(2)
    tokens = [np.unique(r.pareto(0.7, r.integers(1, 40)).astype(int) % 300) if k % 30 else np.zeros(0, int) for k in range(301)]
    weights = [x / np.sqrt((x * x).sum()) for x in (r.random(len(t)) + 0.1 for t in tokens)]
    full = np.zeros((301, 300))
    for k, (t, w) in enumerate(zip(tokens, weights)):
        full[k, t] = w
    cosines, lists = full @ full.T, np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    for first in (301, 140):
        got = {(k, int(o)): s for k, others, found in threads._similar_places(first, lists, np.concatenate(tokens), np.concatenate(weights), 0.25) for o, s in zip(others, found)}
        want = {(a, b): cosines[a, b] for a in range(first) for b in range(a + 1 if first == 301 else first, 301) if cosines[a, b] > 0.25}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 1000


def test_linkage_numbers_articles_without_their_texts(spark, monkeypatch):
    from sqlcheck import rows_of_sql

    numbered, seen = threads.numbered, []
    monkeypatch.setattr(threads, "numbered", lambda news: seen.append(news.columns) or numbered(news))
    monkeypatch.setattr(threads, "token_counts", None)  # no rows for tokens of documents
    got = catalog.QUERIES["t4_single_linkage"](spark, "/root/testdata/sf0.001").toPandas()
    assert seen == [["symbol", "id", "published_at"]]
    assert ordered(got) == ordered(rows_of_sql(catalog.SQL["t4_single_linkage"], "/root/testdata/sf0.001"))
