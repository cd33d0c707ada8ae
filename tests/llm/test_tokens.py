import hashlib
import struct
import zlib

import edge
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from asofline.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make", ["trie", "fast"])
def test_ids_of_odd_texts(make):
    texts = ["", " ", "<|endoftext|>a<|startoftext|> <|endoftext|", "ΣΑΣ Σ İstanbul ﬁ x́ é a'll don't 'S 12345 ½", "日本語 🎉🎉 \x00 \x1c a\x1fb \x85 \xa0c ​d \U0001f468‍\U0001f469", "a" * 3000, "aaab" * 500, "!?'s'"]
    encode = (lambda t: list(np.frombuffer(bpe.encoder(PATH).batch([t], bpe.ids_of)[0], "<u4"))) if make == "trie" else (lambda t: list(packing.fast_ids(PATH).ids(t)))
    for t in texts:
        assert encode(t) == library_ids(t), t


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))  # letters that both Unicode versions know
def test_ids_of_any_text(text):
    assert list(np.frombuffer(bpe.encoder(PATH).batch([text], bpe.ids_of)[0], "<u4")) == library_ids(text)
    assert list(packing.fast_ids(PATH).ids(text)) == library_ids(text)


def test_digests_of_edge_rows(spark):
    docs = edge.documents(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect())
    expected = []
    for r in docs.collect():
        ids = library_ids(r.text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id if r.doc_id is not None else -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.digests(docs.where("false"), PATH).count() == 0
    assert bpe.with_ids(docs, PATH).where("doc_id = 5").first().ids == library_ids(edge.BASE)


def least_bins(lengths, budget):
    """Fewest sequences by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + lengths[k] <= budget:
                bins[i] += lengths[k]
                go(k + 1, bins)
                bins[i] -= lengths[k]
        go(k + 1, bins + [lengths[k]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_packing_against_search(lengths):
    budget = 20
    where, offset, used = packing.best_fit_decreasing(np.array(lengths), budget)
    best = least_bins(lengths, budget)
    assert packing.lower_bound(np.bincount(lengths, minlength=budget + 1), budget) <= best <= len(used)
    assert used.max() <= budget
    for b in range(len(used)):
        spans = sorted((offset[k], lengths[k]) for k in range(len(lengths)) if where[k] == b)
        assert [o for o, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1])


def check_packing(rows, texts, budget):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) <= budget
    expected = []
    for key, text in texts:
        ids = np.array([*library_ids(text), 0], "<u4")
        expected += [(key, k // budget, k, len(ids[k : k + budget]), zlib.crc32(ids[k : k + budget].tobytes())) for k in range(0, len(ids), budget)]
    null = lambda x: -1 if x is None else x
    assert sorted((null(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((null(e[0]), *e[1:]) for e in expected)
    return len(by), sum(e[3] for e in expected)


def test_packing_of_edge_rows_and_rounds(spark):
    docs = edge.documents(spark)
    check_packing(packing.packed_documents(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert packing.packed_documents(docs.where("false"), PATH).count() == 0
    some, _ = edge.sample(spark)
    items = packing.pieces(some, PATH, 256).cache()
    apart = packing.pack(items, 256, partition_pieces=60).collect()  # many partitions that exchange
    n, tokens = check_packing(apart, [(r.doc_id, r.text) for r in some.collect()], 256)
    together = len({r.sequence_id for r in packing.pack(items, 256).collect()})
    assert n <= together * 1.02 + 1 and n >= -(-tokens // 256)


def test_exchange_keeps_partitions_bounded(spark, monkeypatch, tmp_path):
    """Two or three pieces fill a sequence unevenly, so that most partitions miss their bound."""
    real, out = packing._packer, str(tmp_path)

    def noted(*options):
        inner = real(*options)

        def pack(group, table):
            with open(f"{out}/{group[0].as_py()}-{group[1].as_py()}-{table.num_rows}", "w"):
                return inner(group, table)

        return pack

    monkeypatch.setattr(packing, "_packer", noted)
    lengths = [int(x) for x in np.random.default_rng(3).integers(27, 50, 1600)]
    items = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, 100, partition_pieces=50).collect()
    groups = [tuple(map(int, p.name.split("-"))) for p in tmp_path.iterdir()]
    assert max(r for r, _, _ in groups) > 1  # pieces were left to exchange
    assert max(n for _, _, n in groups) <= 100, groups
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) <= 100


def test_batch_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 6)
    encoder = bpe.TrieBpe(PATH)
    for text in ["alpha beta", "alpha beta gamma delta epsilon zeta eta theta iota", "iota kappa", "alpha"]:
        assert list(np.frombuffer(encoder.batch([text], bpe.ids_of)[0], "<u4")) == library_ids(text)
