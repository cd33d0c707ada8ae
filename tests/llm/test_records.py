import base64
import gzip
import hashlib
import io

import edge
import pytest
from pyspark.sql import functions as F

from asofline.llm import chat, rules, sharding, simhash, warc


def test_ring_places_every_row_once(spark):
    docs = edge.documents(spark)
    rows = sharding.assign(docs, 4).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.report(docs.where("false")).count() == 0
    some, _ = edge.sample(spark)
    got = sharding.report(some).join(some, "doc_id").select("size", F.octet_length("text").alias("n"), "law", "grown_shard").collect()
    assert all(r.size == r.n + 16 and r.law == "rows" and r.grown_shard is None for r in got)


def test_growing_the_ring_moves_few_rows(spark):
    some, _ = edge.sample(spark)
    one, two = ({r.doc_id: r.shard for r in sharding.assign(some, n, slack=0.5).collect()} for n in (8, 9))
    assert sum(one[k] != two[k] for k in one) < 0.5 * len(one)
    sizes = [list(one.values()).count(s) for s in range(8)]
    assert max(sizes) <= 1.5 * len(one) / 8 + 1


def fingerprint(spark, text):
    return simhash.fingerprints(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").first().fp


def test_edited_texts_and_neighbours(spark):
    docs = edge.documents(spark).where("doc_id is not null and doc_id not in (6, 10)")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in simhash.report(docs).collect()}
    assert len(got) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, more = r.text or "", after.text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + more[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = int(g.fingerprint, 16), int(g.edited_fingerprint, 16), int(got[after.doc_id].fingerprint, 16)
        assert b == fingerprint(spark, edited) % 2**64
        assert g.near_edited == 1 - bin(a ^ b).count("1") / 64 and g.near_next == 1 - bin(a ^ c).count("1") / 64
    assert simhash.report(docs.where("false")).count() == 0
    assert simhash.report(edge.documents(spark)).count() == edge.documents(spark).count()


def test_buckets_make_no_difference(spark, monkeypatch):
    some, _ = edge.sample(spark)
    whole = {r.doc_id: r for r in simhash.report(some).collect()}
    monkeypatch.setattr(simhash, "BUCKET_DOCS", 7)
    assert {r.doc_id: r for r in simhash.report(some).collect()} == whole


def test_block_tables_find_all_within_the_radius(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(15)] + base[:3]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {x.fp: x.n_near for x in simhash.near_counts(df, df.limit(40)).collect()}
    for q in {x.fp for x in df.limit(40).collect()}:
        assert got[q] == sum(bin((q ^ p) % 2**64).count("1") <= 3 for p in signed)


def test_warc_round_trip_and_predicates(spark, tmp_path):
    rows = [(5, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, None), (8, "http://c\r\nx", ""), (None, "http://d", "<p>same</p>"), (7, "http://e", "ü" * 300_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/archive"
    warc.write(pages, path)
    got = warc.read(spark, path, payload=True, verify=True).collect()
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted(["<p>same</p>", "<p>same</p>", "<p>same</p>", "", "ü" * 300_000])
    for r in got:
        text = {5: "<p>same</p>", 3: "<p>same</p>", 9: "", 8: "", 7: "ü" * 300_000, None: "<p>same</p>"}[r.page_id].encode()
        assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(5, 3), (9, 8)}
    few = warc.read(spark, path).where("record_type = 'revisit' and page_id = 9")
    assert [r.refers_to for r in few.collect()] == [8]
    assert warc.read(spark, path).where("url like 'http://a%' or page_id > 8").count() == 2
    empty = f"file://{tmp_path}/empty"
    warc.write(pages.where("false"), empty)
    assert warc.read(spark, empty).count() == 0


def test_other_archives_are_read(spark, tmp_path):
    records = [warc.record(k, f"http://x/{k}", b"payload %d" % k * 50, None) for k in range(3)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read(spark, str(tmp_path), payload=True, verify=True).where("page_id >= 1").collect()
    assert sorted(r.page_id for r in got) == [1, 1, 2, 2] and all(bytes(r.payload) == b"payload %d" % r.page_id * 50 for r in got)


def test_unwanted_payloads_are_not_inflated():
    body = b"z" * 5_000_000
    data = b"".join(warc.member(warc.record(k, "u", body, None)) for k in range(3))

    class File(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

    rows = list(warc.read_records(File(data), lambda r: r["page_id"] == 1, lambda r: False))
    assert [(r["page_id"], p) for r, p in rows] == [(1, None)]
    with pytest.raises(ValueError):
        list(warc.read_records(File(b"junk"), lambda r: True, lambda r: True))


def snapshots(spark):
    turn = lambda c, k, text: (c, k, "user" if k % 2 else "assistant", text, "extra")
    rows = [turn(c, k, f"turn {k}") for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for k in range(n)]
    rows += [turn(5, 0, "turn 0"), turn(5, 1, "other"), (6, None, None, None, "e"), (None, 0, "user", "lost", "e"), (7, 0, "user", "<|im_end|> x", "e"), (7, 0, "user", "<|im_end|> x", "e")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long_".replace("long_", "string"))


def test_snapshots_collapse(spark):
    got = {r.conv_id: r for r in chat.rendered(snapshots(spark)).collect()}
    assert set(got) == {2, 5, 6, 7}
    assert got[2].n_copies == 2 and got[2].n_turns == 4 and got[2].text.startswith("<|im_start|>assistant\nturn 0<|im_end|>\n<|im_start|>user\nturn 1")
    assert got[6].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[7].n_turns == 2 and got[7].text.count("<|im_end|>") == 2 and "< |im_end|> x" in got[7].text
    assert chat.rendered(snapshots(spark).where("false")).count() == 0


def test_line_frequency(spark):
    common = "Share this page with all of your friends now\n"
    body = lambda k: " ".join(f"w{chr(97 + k)}x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)) + "\n"
    rows = [(k, common + body(k), "h1") for k in range(6)] + [(10, common * 8 + "only few own words " * 1, "h1"), (11, common + body(11), "h2"), (12, body(0), "h1"), (13, None, None), (14, common + body(0), "h1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, kept string")
    got = {r.doc_id: r for r in rules.judged(docs, max_documents=5).collect()}
    assert all(got[k].kept and got[k].removed_words == 9 for k in range(6))
    assert got[11].removed_words == 0 and got[11].kept and not got[13].kept and got[13].base_failed
    assert got[10].removed_words == 72 and not got[10].kept
    clean = {r.doc_id: r.text for r in rules.clean(docs, max_documents=5).collect()}
    assert clean[1] == body(1) and clean[11] == common + body(11) and 10 not in clean
    exact = {r.doc_id: r for r in rules.judged(docs, max_documents=100).collect()}
    assert exact[1].removed_words == 0


def repeated(words):
    found = {}
    for k in range(len(words) - 2):
        found.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + j for places in found.values() if len(places) > 1 for k in places for j in range(3)})


def test_base_counts_of_edge_rows(spark):
    import re

    for r in rules.report(edge.documents(spark)).join(edge.documents(spark).select("doc_id", "text"), "doc_id").where("doc_id not in (6, 10)").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeated(words)
    assert rules.report(edge.documents(spark)).count() == edge.documents(spark).count()
    assert rules.report(edge.documents(spark).where("false")).count() == 0


def test_fingerprints_of_long_words(spark):
    texts = ["short words and one " + "x9" * 50_000, " ".join(c * 20_000 + " a few between" for c in "abcdefgh"), "y" * 46_343, "plain words only"]
    words = sorted({w for t in texts for w in t.lower().split()})
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    expected = []
    for text in texts:
        votes, whole = [0] * 64, 0
        for w in text.lower().split():
            weight = max((len(w) - 2) ** 2 if len(w) > 2 else 0, 1)
            whole += weight
            for j in range(64):
                votes[j] += weight * (hashes[w] >> j & 1)
        expected.append(sum(1 << j for j in range(64) if 2 * votes[j] > whole))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.fp % 2**64 for r in simhash.fingerprints(rows, ["k"], "text").collect()}
    assert [got[k] for k in range(len(texts))] == expected


def test_near_documents_are_named(spark):
    prints = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 15), (5, -1), (6, -2)], "doc_id long, fp long")
    asked = prints.where("doc_id in (1, 5)")
    pairs = simhash.near_pairs(prints, asked)
    assert sorted((r.fp, r.near_fp, r.distance, r.n_rows) for r in pairs.collect()) == [(-1, -2, 1, 1), (-1, -1, 0, 1), (0, 0, 0, 2), (0, 7, 3, 1)]
    assert sorted((r.near_fp, r.doc_id) for r in simhash.members(prints, pairs).collect()) == [(-2, 6), (-1, 5), (0, 1), (0, 2), (7, 3)]
