"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import public_tokenizers as P
import pytest

from asofline.llm import alignment, mixing, variants

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["a  b", " x", "x ", "a\0b ▁c", "日本語 text…  \n\n a   b", "<s> hi </s> <|endoftext|> <0x41>", "=-" * 300, "a" * 5000, "é́ x ́y z", "᠎ a ​ b c d", " ", "", None, "aaaaaaa bb " * 50, "Ünïted 12,345.67 naïve ﬁ 🎉🎉", "x▁y"]


def plain_alignments(texts):
    """Counts, groups and links of whole texts, each token walked by itself."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [k for k in range(256) if k not in plain]
    byte = {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(other)}
    bytes_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for text in texts:
        row = {"n": (0, 0, 0, 0), "sha": "", "links": Counter()}
        rows.append(row)
        if not text:
            continue
        x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(map(bytes_a, x)) != raw or b"".join(map(bytes_b, y)) != raw:
            continue
        ends = lambda ids, size: np.cumsum([len(size(i)) for i in ids]).tolist()
        ex, ey = ends(x, bytes_a), ends(y, bytes_b)
        shared, told = sorted(set(ex) & set(ey)), []
        low = 0
        for high in shared:
            gx, gy = ([i for i, e in zip(ids, es) if low < e <= high] for ids, es in ((x, ex), (y, ey)))
            told.append(f"{','.join(map(str, gx))}|{','.join(map(str, gy))}")
            row["links"].update((i, j) for i in gx for j in gy)
            low = high
        row["n"], row["sha"] = (len(x), len(y), len(shared), sum(row["links"].values())), hashlib.sha256(";".join(told).encode()).hexdigest()
    held = Counter(p for r in rows for p in r["links"])
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(*r["n"], sum(k for p, k in r["links"].items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in r["links"].items()), r["sha"]) for r in rows]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 1, 50])
def test_alignments_equal_plain_ones(spark, monkeypatch, heavy):
    """Whatever part of the pairs is looked up and what is joined."""
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    docs, _ = edge.sample(spark)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + TEXTS + TEXTS[:4]
    got = alignment.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).drop("n_overlaps").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_alignments(texts)


def test_alignments_of_odd_rows(spark):
    docs = edge.documents(spark)
    got = alignment.scored(docs, A, B)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [(r.n_a, r.groups_sha256) for r in rows if r.doc_id == 1] == [(0, "")]
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (5, 6)}) == 1
    assert alignment.scored(docs.where("false"), A, B).count() == 0


def test_a_cache_that_is_too_small(spark, monkeypatch):
    texts = TEXTS * 2
    both = alignment.Aligner(A, B)
    expected = both.documents(texts)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 3)
    for begin in range(0, len(texts), 5):
        counts, told, *_ = both.documents(texts[begin : begin + 5])
        assert told == expected[1][begin : begin + 5] and counts.tolist() == expected[0][begin : begin + 5].tolist()


def plain_variants(rows, least=7):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}

    holes = defaultdict(set)  # a word with a code point left out, or replaced by a mark
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
            holes["-" + w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            near[w] |= holes[w[:k] + "*" + w[k + 1 :]] - {w}
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    out = {}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * k else None
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (k, len(near[w]), form[w], form[w] and n[form[w]], root)
    return out


def check_variants(spark, rows):
    got = variants.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len({r.word for r in got})
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(rows)
    return got


def test_variants_equal_plain_ones(spark):
    docs, _ = edge.sample(spark)
    got = check_variants(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.n_near > 0 for r in got) > 20


def test_variants_of_every_kind(spark):
    """Replaced, left out and doubled letters at each place, runs of one letter, anagrams, ties, chains and Latin letters beyond ASCII."""
    base = ["balances", "ÀÉÿ×÷abc", "aaaaaaa", "aaaaaaaa", "kitchen", "chicken", "listens", "silents", "enlists"]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "é" + w[k + 1 :]}
    rows = [(None, None), (1, ""), *((k, " ".join([w] * 3)) for k, w in enumerate(sorted(words)))]
    rows += [(1000 + k, "balances kitchen1KITCHEN") for k in range(40)] + [(2000 + k, "balancesq balancesqq " * 3) for k in range(200)] + [(3, "x " + "ab" * 5000)] * 2 + [(None, "nothing Nothing nothinG")]
    got = {r.word: r for r in check_variants(spark, rows)}
    assert got["balances"].form and got["abalances"[1:]].root != "balances"


def test_chains_of_forms(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [("x", "w20")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in chain}


def test_variants_of_odd_rows(spark):
    docs = edge.documents(spark)
    check_variants(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert variants.grouped(docs).count() == variants.grouped(docs.select("doc_id", "text")).count()
    assert variants.grouped(docs.where("false")).count() == 0


def plain_targets(sizes):
    """Words by source to targets: shares by weight, what is above twice the size is shared out again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and w and left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else left * weight[s] / w if w else 0.0 for s in names}
        full |= over
        left -= sum(2 * sizes[s] for s in over)


def check_mix(rows, docs):
    of = {}
    size = Counter()
    for r in docs:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        of[r.doc_id] = r.source
    targets = plain_targets(dict(size))
    taken = Counter()
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - targets[s]) <= max(2, 0.01 * size[s]), (s, taken[s], targets[s])


def test_a_mix_comes_near_its_targets(spark):
    docs, _ = edge.sample(spark)
    docs = docs.select("doc_id", "text", "source")
    small = spark.createDataFrame([(9001, "one two three", "tiny"), (9002, "a b", None), (9003, None, "none"), (9004, " word " * 9, None)], docs.schema)
    docs = docs.unionByName(small)
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows, docs.collect())
    again = mixing.report(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shards_are_equal_and_draws_disjoint(spark):
    docs = edge.sample(spark)[0].select("doc_id", "text", "source")
    mix = mixing.mixed(docs, shards=5).cache()
    pieces = mix.selectExpr("doc_id", "size", "source_size", "explode(pieces) p").select("doc_id", "size", "source_size", "p.*").collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    blocks, covered = defaultdict(set), defaultdict(list)
    for p in pieces:
        assert 0 <= p.start and p.length > 0 and p.start + p.length <= p.size
        blocks[p.shard].add((source[p.doc_id], p.epoch, p.block))
        covered[p.doc_id, p.epoch].append((p.start, p.start + p.length))
    n = [len(blocks[s]) for s in range(5)]
    assert max(n) - min(n) <= 1 and sum(n) == len(set().union(*blocks.values()))  # no block is in two shards
    for runs in covered.values():
        runs.sort()
        assert all(x[1] <= y[0] for x, y in zip(runs, runs[1:]))
    laid = mixing.laid_out(mix).collect()
    assert sorted((r.shard, r.place) for r in laid) == [(s, k) for s in range(5) for k in range(sum(p.shard == s for p in pieces))]
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    told = mixing.texts(mixing.laid_out(mix), docs).collect()
    assert len(told) == len(pieces) and all(r.words == " ".join(words[r.doc_id][r.start : r.start + r.length]) for r in told)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations(n):
    blocks = np.arange(n)
    for key in (1, 2):
        places = mixing.permuted(blocks, np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(places.tolist()) == blocks.tolist()


def test_the_tree_keeps_quotas(spark):
    quota = [0, 1, 7, 1000, 123456, 50]
    rows = mixing.divided(spark.createDataFrame(list(enumerate(quota)), "_rank long, _quota long"), 7).collect()
    by = {r._rank: np.diff([0, *r._ends]) for r in rows}
    assert {k: int(v.sum()) for k, v in by.items()} == dict(enumerate(quota))
    shards = sum(by.values())
    assert shards.max() - shards.min() <= 1
    assert abs(by[4] / 123456 - 1 / 7).max() < 0.01


def test_mix_of_odd_rows(spark):
    docs = edge.documents(spark)
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.report(docs.where("false")).count() == 0
    assert {(r.size, r.target, r.taken) for r in mixing.report(docs.where("doc_id in (1, 2, 3)")).collect()} == {(0, 0.0, 0)}


def test_many_sources_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k % 50), f"s{k % 300}") for k in range(1500)], "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.report(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    rows = mixing.report(docs).collect()
    check_mix(rows, docs.collect())
    assert [r[:4] for r in few] == [r[:4] for r in sorted(map(tuple, rows))]
