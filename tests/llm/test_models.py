import random

import edge
import numpy as np
import pytest

from asofline.llm import minhash, quality, toxicity
from asofline.llm.components import components


def classes_of(docs, width, percent):
    """Smallest id linked with each row, by brute force."""
    sets = {}
    for i, text in docs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.setdefault(i, set()).update([tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else [])
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    for _ in range(len(ids)):
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs, k = [], 0
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append((k, " ".join(copy)))
            k += 1
    docs += [(k, "same words here again"), (k + 1, "SAME words here again"), (k + 2, "a b"), (k + 3, "a b"), (k + 4, None), (k + 5, "  ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (4, 5):
        got = {x.doc_id: x.component_id for x in minhash.deduplicate(df, width).collect()}
        assert got == classes_of(docs, width, 80)


def test_near_duplicates_of_edge_rows(spark):
    docs = edge.documents(spark)
    got = minhash.deduplicate(docs).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert kept[5] == (5, True) and kept[6] == (5, False) and kept[1] == (1, True) and kept[2] == (2, True)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert minhash.deduplicate(docs.where("false")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(None, 3), (7, 7), (200, 201), (201, 200)]
    label = {k: k for e in edges if None not in e and e[0] != e[1] for k in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(spark, n=600):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con") for b in ("um", "or", "et", "is", "a")]
    rows, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic, junk = r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(["vermin", "verminous", "verminly", "scumbag"])
        if junk:
            text = [w + r.choice(["###", "$$$"]) for w in text]
        rows.append((k, " ".join(text), "en", "s", 5, "x"))
        labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(rows, labels):
    return [r for r in rows if r.held_out], {r.doc_id: r for r in labels.collect()}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.report(docs, labels).collect()
    held, y = held_out(rows, labels)
    assert 150 < len(held) < 250 and np.mean([r.predicted == y[r.doc_id].toxic for r in held]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = quality.report(docs, labels).collect()
    held, y = held_out(rows, labels)
    assert np.mean([r.kept == bool(y[r.doc_id].quality) for r in held]) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_models_of_edge_rows(spark, module):
    docs, labels = edge.documents(spark), spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert module.report(docs, labels).count() == docs.count()
    assert module.report(docs.where("false"), labels).count() == 0
    none = module.report(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and ({r.score for r in none} == ({0.0} if module is toxicity else {1.0}))
    again = module.report(docs, labels)
    assert len({r.score for r in again.where("doc_id = 6").collect()}) == 1


def test_long_texts_go_through_in_windows(monkeypatch):
    cnn = toxicity.Cnn.new(3)
    c = cnn.columns(toxicity.buckets_of([f"word{k}" for k in range(500)]))
    whole = cnn.logit(c)
    monkeypatch.setattr(toxicity, "WINDOW", 37)
    assert abs(cnn.logit(c) - whole) < 1e-5
