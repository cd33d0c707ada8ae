"""Operators of cases, long texts and writes against plain versions and known values."""

import datetime as dt
import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofline import storage
from asofline.functions import text as X
from asofline.operators import cases, documents, records, snapshot, threads, upsert
from asofline.plans import catalog, topics
from asofline.sources import tables as T

SF = "/root/testdata/sf0.001"
HEADING = re.compile(r"^[^\S\n]{0,8}ITEM\s+(\d+[A-Z]?)\.?\s*([^\n]{0,120})", re.I | re.M)
D = dt.date(2026, 6, 15)


def texts(spark):
    return {r.doc_id: r.text for r in T.table(spark, SF, "documents").select("doc_id", "text").collect()}


def split(text):
    if not (text or "").strip():
        return []
    found = list(HEADING.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    head = lambda m: f"ITEM {m[1].upper()}" + (f" — {m[2].strip()}" if m[2].strip() else "")
    return [(head(m), text[m.start() : e].strip()) for m, e in zip(found, ends)] or [("FULL TEXT", text)]


def sentences_of(text):
    parts = [s.strip(" ") for s in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"“(\[])', text or "", flags=re.ASCII)]
    return [s for s in parts if 40 <= len(s) <= 800]


def hits(text, terms):
    return sum(len(re.findall(rf"\b{re.escape(t)}\b", text.lower(), re.ASCII)) for t in terms)


def test_sections_of_whole_texts(spark):
    rows = [(1, "intro\n Item 1. Business\nabc\nITEM 1a\nItem 2 Risk \n\n"), (2, "no heading"), (3, None), (4, " \n "), (5, "Item 7."), (6, "see item 9 here\n\tITEM 9B: x")]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {}
    for r in documents.sections(df, "k", "text").orderBy("k", "n").collect():
        got.setdefault(r.k, []).append((r.heading, r.body))
    assert got == {k: split(t) for k, t in rows if split(t)}


def test_sentences_and_picks_of_whole_texts(spark):
    got, picked = {}, {}
    for r in catalog.QUERIES["t13_sentences"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.n] = r.sentence
    for r in catalog.QUERIES["t15_extractive_pick"](spark, SF).collect():
        picked.setdefault(r.doc_id, {})[r.n] = r.sentence
    for doc, text in texts(spark).items():
        plain = dict(enumerate(sentences_of(text)))
        assert got.get(doc, {}) == plain
        best = sorted(plain, key=lambda n: (-hits(plain[n], ("the", "and")), n))[:5]
        assert picked.get(doc, {}) == {n: plain[n] for n in best}


def test_size_ladder(spark):
    terms, budget = ("the", "and", "tion"), 40_000

    def plain(text):
        text = text or ""
        pages = -(-len(text) // 3000)
        if pages < 2:
            return pages, "full", text[:budget]
        if pages <= 8:
            out = ""
            for h, b in [s for _, s in sorted(enumerate(split(text)), key=lambda x: (-hits(x[1][0] + "\n" + x[1][1], terms), x[0]))]:
                if len(out) + len(h) + len(b) + 16 > budget:
                    break
                out += f"## {h}\n{b}\n\n"
            return pages, "sections", out.strip() or text[:budget]
        found = sentences_of(text)
        best = sorted(sorted(range(len(found)), key=lambda n: (-hits(found[n], terms), n))[:12])
        return pages, "sentences", " ".join(found[n] for n in best) or text[:budget]

    got = {r.doc_id: (r.pages, r.way, r.feeding) for r in catalog.QUERIES["t15_size_ladder"](spark, SF).collect()}
    expected = {k: plain(t) for k, t in texts(spark).items()}
    assert got == expected and {w for _, w, _ in got.values()} >= {"full", "sections"}
    long = spark.createDataFrame([(1, "Item 1 A\n" + "x" * 50_000 + "\nItem 2 B\nthe end"), (2, "word. " * 9000), (3, None)], "k long, t string")
    rows = {r.k: r for r in documents.sized(long, "k", "t", ("the",), full=2, by_section=40).collect()}
    assert rows[1].way == "sections" and rows[1].feeding == "## ITEM 2 — B\nItem 2 B\nthe end" and rows[2].feeding == ("word. " * 9000)[:40_000] and rows[3].feeding == ""


def test_batches_and_their_numbers(spark):
    turns = {}
    for r in T.table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, len(r.text or "")))
    expected = []
    for conv, rows in turns.items():
        lists, used = [[]], 0
        for turn, n in sorted(rows):
            if used and used + n > 1200:
                lists.append([])
                used = 0
            lists[-1].append(turn)
            used += n
        number = 0
        for b, own in enumerate(lists):
            first = number + 1
            for turn in own:
                number += 1
                expected.append((conv, turn, b, number, f"Batch covering articles {first}–{first + len(own) - 1}" if len(lists) > 1 else None))
    got = [(r.conv_id, r.turn, r.batch, r.number, r.covers) for r in catalog.QUERIES["t10_batches"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def greedy(items):
    groups = []
    for symbol, thread, terms in items:
        hit = next((g for g in groups if all(s != symbol for s, _ in g[1]) and len(set(g[0]) & set(terms)) >= 2), None)
        if hit is None:
            groups.append([list(terms), [(symbol, thread)]])
        else:
            hit[1].append((symbol, thread))
            hit[0] = list(dict.fromkeys(hit[0] + list(terms)))[:6]
    return sorted((g for g in groups if len({s for s, _ in g[1]}) > 1), key=lambda g: -len(g[1]))


def test_shared_groups_follow_the_order(spark):
    items = [("A", "t1", ["x", "y", "z"]), ("A", "t2", ["x", "y"]), ("B", "t1", ["y", "x", "q"]), ("B", "t2", ["x", "y"]), ("C", "t1", ["q", "z"]), ("C", "t2", ["n"]), ("D", "t1", ["m", "n"])]
    df = spark.createDataFrame([("r", f"{k:03d}", *x) for k, x in enumerate(items)], "request string, place string, symbol string, thread string, terms array<string>")
    got = {}
    for r in documents.shared_groups(df).collect():
        got.setdefault(r.group, (r.terms.split(","), []))[1].append((r.symbol, r.thread))
    assert [(list(t), i) for t, i in (got[k] for k in sorted(got))] == [(list(t), i) for t, i in greedy(items)]
    label = {(r.symbol, r.thread): r.terms for r in topics.label_terms(spark, SF).collect()}
    asked = [(s, t, label[(s, t)]) for s in topics.COMPARED for t in sorted(t for x, t in label if x == s)]
    rows = catalog.QUERIES["j23_shared_groups"](spark, SF).collect()
    assert sorted((r.group, r.symbol, r.thread) for r in rows) == sorted((k + 1, s, t) for k, (_, found) in enumerate(greedy(asked)) for s, t in found)


def member(k, category, decision="RELEVANT", source="AI", reason=None):
    return ("X", "t", str(k), f"title {k}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=k), decision, category, decision == "RELEVANT" if decision != "UNCERTAIN" else None, source, reason)


MEMBER = "symbol string, thread string, id string, title string, published_at timestamp, decision string, category string, relevant boolean, decision_source string, reason string"


def test_the_category_seen_first_wins_a_tie(spark):
    rows = [member(1, "A"), member(2, "B"), member(3, "B"), member(4, "A"), member(5, "Z", "IRRELEVANT"), member(6, "UNRELATED")]
    assert threads.attributes(spark.createDataFrame(rows, MEMBER)).first().top_category == "A"
    assert threads.attributes(spark.createDataFrame(rows[:3], MEMBER)).first().top_category == "B"


def test_category_basis(spark):
    basis = lambda *rows: tuple(records.category_basis(spark.createDataFrame(list(rows), MEMBER)).first())[2:]
    rule = [member(1, "A", source="RULE", reason='term "loss" found'), member(2, "A", source="RULE", reason='term "gain" found'), member(3, "B", source="AI")]
    assert basis(*rule) == ("rule:keyword 'gain'", "2 of 3 rated members classified A by keyword rule (matched 'gain')")
    assert basis(member(1, "A"), member(2, "B", "IRRELEVANT"), member(3, "C", "UNCERTAIN")) == ("ai:gemini-verdict", "1 of 2 rated members classified A by AI verdicts")
    assert basis(member(1, "A", source="USER")) == ("user-admitted", "1 of 1 rated members classified A (user-admitted)")
    assert basis(member(1, "A", "IRRELEVANT")) == ("", "")


def test_threads_without_a_span_ride_along(spark):
    at = lambda day: dt.datetime.combine(D + dt.timedelta(day), dt.time())
    rows = [("X", "in", "A", 2, at(-30), at(-20)), ("X", "before", "A", 2, at(-40), at(-21)), ("X", "after", "A", 2, at(1), at(2)), ("X", "undated", None, 1, None, None), ("X", "half", "A", 1, at(5), None)]
    t = spark.createDataFrame(rows, "symbol string, thread string, category string, n_articles long, span_start timestamp, span_end timestamp")
    peaks = spark.createDataFrame([("X", D, 1.0, 0.5, ["spike"], "unknown", None)], "symbol string, date date, daily_return_pct double, score double, flags array<string>, sentiment_direction string, sentiment_mean double")
    none = lambda ddl: spark.createDataFrame([], ddl)
    evidence = none("symbol string, date date, news_count long, n_8k long, n_10 long, n_filings long, events array<string>, relevance double, filing_sentiment double")
    case = cases.freeze(peaks, t, none("symbol string, date date, regime string"), evidence, none("symbol string, date date, close double"))
    row = cases.completeness(case).first()
    assert {x.thread: (x.category, x.dated) for x in row.threads} == {"in": ("A", True), "undated": ("", False), "half": ("A", False)}
    assert row.completeness == {"threads": "partial", "regimes": "missing", "evidence": "partial", "sentiment": "missing", "reaction": "missing"} and row.projection == "hcp-v1"
    vector = cases.structural(cases.signals(case)).first().vector
    assert len(vector) == 96 and vector[72] == 0 and vector[95] == 0 and vector[15] > 0 and abs(sum(x * x for x in vector) - 1) < 1e-12


def test_broken_rows_of_the_registry_are_no_cases(spark):
    rows = spark.createDataFrame([("A", "X", D, "{not json"), ("B", "X", D, None), ("C", "X", D, " "), ("D", "X", D, '{"score": 1.5, "flags": ["spike"]}')], "case_id string, symbol string, peak date, body string")
    got = cases.from_registry(rows, "struct<score: double, flags: array<string>, _broken: string>").collect()
    assert [(r.case_id, r.score, r.flags) for r in got] == [("D", 1.5, ["spike"])]


def test_frozen_and_live(spark):
    make = lambda *rows: spark.createDataFrame(rows, "case_id string, projection string, threads array<string>")
    frozen = make(("A", "hcp-v1", ["t"]), ("B", None, ["t"]), ("C", "hcp-v1", []), ("D", "hcp-v1", []))
    live = make(("A", "hcp-v1", ["u"]), ("B", "hcp-v1", ["t"]), ("C", "hcp-v1", ["t"]))
    assert {r.case_id: r.matches for r in cases.matches_frozen(frozen, live).collect()} == {"A": True, "B": False, "C": False, "D": False}


def test_merged_hits(spark):
    hits = lambda *rows: spark.createDataFrame(list(rows), "q string, case_id string, similarity double")
    structural = hits(*[("q", f"s{k}", 0.99 - k / 100) for k in range(5)], ("q", "both", 0.9))
    hybrid, narrative = hits(("q", "both", 0.95), ("q", "h", 0.97)), hits(("q", "n", 0.8), ("q", "both", 0.99), ("q", "late", 1.0))
    peaks = spark.createDataFrame([(c, D + dt.timedelta(c == "late")) for c in ("q", "both", "h", "n", "late", *(f"s{k}" for k in range(5)))], "case_id string, peak date")
    got = [(r.rank, r.case_id, r.kind, r.similarity) for r in cases.merged(structural, hybrid, narrative, peaks).orderBy("rank").collect()]
    assert got == [(1, "both", "strong", 0.95), (2, "s0", "pattern", 0.99), (3, "s1", "pattern", 0.98), (4, "s2", "pattern", 0.97)]  # the fifth, a later peak, goes


def test_points_have_fixed_ids(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "ref string, vector array<double>")
    got = upsert.vector_points(rows, "hype-threads", 2).collect()
    assert [(r.point, r.ref) for r in got] == [(str(uuid.UUID(bytes_le=hashlib.md5(b"hype-threads|a").digest())), "a")]


def test_duplicate_keys_are_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "symbol string")
    assert upsert.unique(rows, "symbol").count() == 2
    with pytest.raises(Exception, match="duplicate symbol: a"):
        upsert.unique(rows.union(rows.limit(1)), "symbol").collect()


def test_quantiles_by_place(spark):
    values = [round(float(x), 6) for x in np.random.default_rng(3).normal(0, 1, 997)] + [0.25] * 40 + [7.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    s = sorted(values)
    at = lambda q: round(s[min(len(s) - 1, int(q * len(s)))], 4)
    for parts in (1, 7, 1000):
        assert tuple(snapshot.quantiles(rows, "x", parts).first()) == (len(s), round(s[0], 4), at(0.25), at(0.5), at(0.75), round(s[-1], 4))
    assert tuple(snapshot.quantiles(rows.limit(1), "x").first())[0] == 1
    assert {r.bucket: r.n for r in snapshot.histogram(spark.createDataFrame([(0.0,), (0.05,), (1.0,), (0.95,)], "x double"), "x").collect()} == {0: 2, 9: 2}


def test_markup(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.strip_html(F.lit("<style a>x</style><p>a &amp;&nbsp; b&#8217;s &copy;</p>\n\n\n\n<b>c</b> "))) == "a & b’s ©\n\nc"
    assert one(X.estimated_tokens(F.lit("abcdef"))) == 1.5 and one(X.estimated_tokens(F.lit(""))) == 1.0


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_folder(Session)


def test_brief_news_of_whole_texts(spark):
    names = {r.symbol: r.name for r in T.companies(spark, SF).collect()}
    expected = set()
    for r in T.news(spark, SF).collect():
        text = f"{names[r.symbol]}{' take over and Revenue ' if int(r.id) % 3 == 0 else ' '}{r.title or ''}\n{r.description or ''}".lower()
        found = next(((c, t) for c, terms in X.MATERIAL_TERMS.items() for t in terms if re.search(rf"\b{re.escape(t)}\b", text, re.ASCII)), None)
        if found:
            expected.add((r.id, *found))
    assert expected and {tuple(r) for r in catalog.QUERIES["p8_brief_news"](spark, SF).collect()} == expected


def test_terms_are_told_apart():
    terms = [*X._MATERIAL, *X.INDUSTRY_TERMS, *X.MACRO_TERMS]
    pattern = re.compile(r"(?i)\b(?=(" + X.any_of(tuple(terms)) + r")\b)")
    assert all(pattern.match(t)[1] == t for t in terms) and len(set(terms)) == len(terms)
    assert [m[1] for m in pattern.finditer("to acquire a cyber attack, price cuts")] == ["to acquire", "acquire", "cyber attack"]


def test_as_of_join_over_periods(spark):
    from asofline.operators.joins import as_of_join

    r = np.random.default_rng(4)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(int(n))
    right = sorted({(s, day(n)) for s, n in zip(r.choice(list("ab"), 60), r.integers(0, 400, 60))})
    left = [(k, s, day(n)) for k, (s, n) in enumerate(zip(r.choice(list("abc"), 200), r.integers(0, 420, 200)))] + [(500, "a", None)]
    rows = as_of_join(spark.createDataFrame(left, "k int, s string, d date"), spark.createDataFrame([(*x, str(x[1])) for x in right] + [("a", None, "lost")], "s string, t date, v string"), "s", "d", "t", ["v"])
    expected = {k: max((t for x, t in right if x == s and d is not None and t <= d), default=None) for k, s, d in left}
    got = {x.k: (x.t_as_of, x.v_as_of) for x in rows.collect()}
    assert got == {k: (t, None if t is None else str(t)) for k, t in expected.items()}
