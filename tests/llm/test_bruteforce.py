"""Operators without SQL against plain versions of themselves."""

import random
from collections import Counter, defaultdict

import edge
import numpy as np
from pyspark.sql import functions as F
from test_models import corpus

from asofline.llm import minhash, quality, rules, sharding, toxicity, warc
from asofline.llm.common import table


def test_ring_against_a_walk_row_by_row(spark):
    docs = spark.createDataFrame([(k % 90 if k % 7 else None, f"text {k % 41}") for k in range(400)], "doc_id long, text string")
    shards, virtual = 7, 5
    nodes = sharding.ring(shards, virtual)
    placed = docs.select("doc_id", "text", sharding._place(F.col("doc_id")).alias("place"), F.crc32(F.col("text").cast("binary")).alias("crc"), (F.octet_length("text") + 16).alias("size"))
    rows = placed.withColumn("block", F.pmod(F.xxhash64("place", F.col("crc"), F.col("size").cast("long")), F.lit(sharding.BLOCKS)).cast("int")).collect()
    arc = lambda place: next((k for k, (p, _) in enumerate(nodes) if p >= place), 0)
    order = sorted(rows, key=lambda r: (arc(r.place), r.block, r.place, r.doc_id if r.doc_id is not None else -1, r.crc, r.size))
    base, more = divmod(len(rows), shards)
    room = [base + (s < more) for s in range(shards)]
    got, left = Counter(), []
    for r in order:
        s = nodes[arc(r.place)][1]
        if room[s]:
            room[s] -= 1
            got[(r.doc_id, r.crc, s)] += 1
        else:
            left.append(r)
    for r in left:
        at = arc(r.place)
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        got[(r.doc_id, r.crc, nodes[at][1])] += 1
    told = Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.assign(docs, shards, virtual_nodes=virtual).collect())
    assert told == got


def test_filters_against_loops():
    cnn = toxicity.Cnn.new(5)
    for words in ([], ["one"], ["one", "two"], [f"w{k % 17}" for k in range(90)]):
        b = toxicity.buckets_of(words)
        x = [sum(cnn.table[j] for j in row).astype(np.float64) for row in b]
        x += [np.zeros(toxicity.DIMENSIONS)] * (max(toxicity.WIDTHS) - 1 + toxicity.TOP)
        total = cnn.shift
        for k, w in enumerate(cnn.filters):
            for f in range(toxicity.FILTERS):
                values = [sum(float(w[j][:, f] @ x[p + j]) for j in range(len(w)) if p + j < len(x)) for p in range(len(words) + toxicity.TOP)]
                at = k * toxicity.FILTERS + f
                total += sum(max(v + float(cnn.bias[at]), 0) * float(o) for v, o in zip(sorted(values, reverse=True)[: toxicity.TOP], cnn.out[at]))
        assert abs(cnn.logit(cnn.columns(b)) - total) < 1e-4


def test_views_tell_each_other_their_surest_rows(spark):
    docs, labels = corpus(spark)
    labels = labels.where("doc_id % 3 = 0")
    rows = quality.featured(docs.withColumn("n_chars", F.length("text") * 7).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))))
    one, three = (quality.fit(rows, labels, most=20, rounds=k, floor=0.0) for k in (1, 3))  # by rank alone
    assert one.told == [(40, 40)] and three.told == [(40, 40)] * 3
    none = quality.fit(rows, labels, rounds=0)
    assert none.told == [] and not np.array_equal(none.views[0].weights, three.views[0].weights) and not np.array_equal(none.views[1].weights, three.views[1].weights)
    # the first round, row by row in numpy
    told = quality._surest(rows, labels, "doc_id", 20, 0.0)(none.views)
    known = {r.doc_id for r in labels.collect()}
    pool = {r._mark: r for r in rows.collect() if r.doc_id not in known}
    for k in (0, 1):
        view = none.views[1 - k]
        p = {m: round(float(quality._sigmoid(view.logit(np.frombuffer(r[f"_x{1 - k}"], np.float32).astype(np.float64)[None, :]))[0]), 9) for m, r in pool.items()}
        up, down = sorted(p, key=lambda m: (-p[m], m))[:20], sorted(p, key=lambda m: (p[m], m))[:20]
        assert sorted(told[k][1]) == sorted(p[m] for m in {*up, *down})
    # with a floor, only rows of which the view is as sure as that are told, and all of these if they are few
    floor = quality._surest(rows, labels, "doc_id", 10_000, 0.9)(none.views)
    for k in (0, 1):
        view = none.views[1 - k]
        p = [round(float(quality._sigmoid(view.logit(np.frombuffer(r[f"_x{1 - k}"], np.float32).astype(np.float64)[None, :]))[0]), 9) for r in pool.values()]
        assert sorted(floor[k][1]) == sorted(x for x in p if x >= 0.9 or x <= 0.1)


def test_an_unsure_view_tells_nothing(spark):
    """Sources, languages and lengths say nothing of the quality here: the metadata view abstains, and the content view teaches it."""
    docs, labels = corpus(spark)
    rows = quality.featured(docs.withColumns({"n_chars": F.lit(100).cast("long"), "source": F.lit("s"), "lang": F.lit("en")}))
    model = quality.fit(rows, labels.where("doc_id % 3 = 0"), most=20, rounds=2)
    assert [n for n, _ in model.told] == [0, 0] and model.told[0][1] > 0
    assert abs(model.weights[1]) < 0.2 * abs(model.weights[0])
    only = quality.featured(docs, only=("doc_id",))
    assert only.columns == ["doc_id", *quality.FEATURES] and only.count() == docs.count()


def test_copies_are_told_once(spark):
    docs, labels = corpus(spark, 200)
    few = labels.where("doc_id < 150")
    again = docs.unionByName(docs.where("doc_id >= 150").withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(docs.where("doc_id >= 150").withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.fit(again, few, most=10_000, rounds=2, floor=0.0).told == [(50, 50), (0, 0)]


def test_models_keep_extra_columns(spark):
    docs = edge.documents(spark).withColumn("_mark", F.lit("m"))
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    out = quality.annotate(docs, quality.fit(docs, labels))
    assert {"words", "key", "score", "kept"} <= set(out.columns) and out.count() == docs.count()


def test_lines_above_a_share_of_a_host(spark):
    shared = "subscribe to our letter today\n"
    body = lambda k: " ".join(f"w{k}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(60))
    rows = [(k, (shared if k < 12 else "") + (shared * 20 if k == 5 else "") + body(k), "big") for k in range(400)] + [(1000 + k, (shared if k < 5 else "") + body(k), "small") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in rules.report(docs).collect()}
    assert got[0].removed_words == 5 and got[0].kept and got[20].removed_words == 0  # 12 of 400 are more than 2 % and than five
    assert got[5].removed_words == 105 and not got[5].kept
    assert all(got[1000 + k].removed_words == 0 for k in range(10))  # five documents are not more than five
    few = {r.doc_id: r for r in rules.judged(docs, percent=5).collect()}
    assert few[0].removed_words == 0


def test_common_lines_are_the_same_for_broadcast_hosts(spark, monkeypatch):
    some, _ = edge.sample(spark)
    docs = some.withColumn("source", F.lit("one host"))
    before = sorted(map(tuple, rules.report(docs).collect()))
    monkeypatch.setattr(rules, "BIG_HOST", 10)
    assert sorted(map(tuple, rules.report(docs).collect())) == before and any(r[-1] > 0 for r in before)


def test_hot_payload_and_repeated_ids(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://x/{k}", "<p>the same page</p>") for k in range(500, 0, -1)] + [(7, "http://y", "other"), (7, "http://z", "other"), (3, "u", "own"), (1000, None, "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def plain():
        first = {}
        for page, _, html in rows:
            first[html] = min(page, first.get(html, page))
        return sorted((page, html, None if first[html] == page else first[html]) for page, _, html in rows)

    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    for limit in (500_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_IDS", limit)
        got = [(r.page_id, bytes(r.payload).decode(), r.refers_to) for r in warc.with_references(pages).collect()]
        assert sorted(got, key=key) == sorted(plain(), key=key)
    out = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == Counter((p, "response" if ref is None else "revisit", ref) for p, _, ref in plain())


def test_other_record_types_are_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", None)], "page_id long, url string, html string"), path)
    heads = warc.read(spark, path).where("record_type != 'response'")
    assert [(r.page_id, r.refers_to) for r in heads.collect()] == [(2, 1)]
    assert "Filter (" not in heads._jdf.queryExecution().executedPlan().toString()


def test_links_of_the_sample_against_all_pairs(spark):
    """Recall of op9's links against an inverted index over all pairs: 1.0 here, at least 0.99 asked."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {r.doc_id: set(minhash.shingles(r.text, 4).tolist()) for r in docs.collect()}
    own = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            own[x].append(d)
    common = Counter()
    for members in own.values():
        members.sort()
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[(a, b)] += 1
    linked = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    label = {d: d for d in sets}
    for _ in range(20):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash.deduplicate(docs, 4).collect()}
    found = sum(got[a] == got[b] for a, b in linked)
    assert linked and found / len(linked) >= 0.99
    assert all(label[got[d]] == label[d] for d in got)  # and no link that isn't one


def test_second_phase_alone_finds_the_links(spark, monkeypatch):
    """Groups whose members meet by rare shingles or by frequent ones, with a first phase of one table."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    docs, k = [], 0
    for size in (3, 40, 90):
        base = [r.choice(words) for _ in range(80)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(80)] = r.choice(words)
            docs.append((k, " ".join(copy)))
            k += 1
    from test_models import classes_of

    monkeypatch.setattr(minhash, "FIRST", 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = classes_of(docs, 4, 80)
    for low in (2, 64):
        monkeypatch.setattr(minhash, "LOW", low)
        assert {x.doc_id: x.component_id for x in minhash.deduplicate(df, 4).collect()} == expected


def test_depletion_decides_in_the_query(spark, tmp_path):
    """Texts of sixty distinct words pass the base rules; those whose lines most of their host repeats lose their words and go, in the query and in its SQL."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from sqlcheck import TABLES, ordered

    lettered = lambda t: t.translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits are all one in a normalised line
    shared = lettered("\n".join(" ".join(f"s{i}w{j}" for j in range(10)) for i in range(5)))
    own = lambda k, n: lettered(" ".join(f"d{k}x{j}" for j in range(n)))
    rows = [(k, f"{shared}\n{own(k, 12)}", "h", "en") for k in range(12)] + [(100 + k, f"{own(100 + k, 60)}", "h", "en") for k in range(30)] + [(200, f"{shared}\n{own(200, 12)}", "other", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in rules.report(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if not r.kept} == set(range(12))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    import duckdb

    assert "documents" in TABLES
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert ordered(rules.report(docs).toPandas()) == ordered(c.sql(rules.SQL).fetchdf())
