"""Quality rules: document counts, and line frequencies across the documents of a host.

Lines are normalised (lower case, single blanks, digits as 0) and hashed.  For every host the number of
distinct documents with a line is counted; equal texts are one document.  Lines above the limit, which is a share of
the host's distinct documents, are removed, and a document is rejected as depleted when too few of its words are
left.  Counts are summed before the shuffle.  Removed lines are few a host (each is in a share of its documents) and are
joined in SALTS parts, so the documents of one line are not one group; hosts of BIG_HOST documents and more,
whose number is bounded by that, are broadcast, so the lines of one host aren't one either.

Defined results: a null text has no words and fails the base rules; a null source is the source named by
an empty text; repeated rows are judged alike; ids aren't needed and may be null; extra columns with clashing
names are not read by report() and kept by clean(), whose own columns replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, cached_by, in_tasks, saved

#: A line is removed if more distinct documents of its host have it than this number and this percentage of them.
MAX_DOCUMENTS, PERCENT = 5, 2
#: Distinct documents from which a host is broadcast, and parts of the documents that a removed line meets.
BIG_HOST, SALTS = 100_000, 16
#: A document is depleted with less than this share of its words left.
LEFT = 0.5
#: Base rules: words at least, and percent of words in repeated windows at most.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
CACHE_WORDS = 200_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_DIGITS = regex.compile(r"\d")
#: Fields of a measured row.
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, t1 long, t2 long, lines array<struct<line: long, words: int>>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ w[k : k + n]) * np.uint64(_ODD[k])
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= found
    return int(covered.sum())


def normal_line(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int, list[tuple[int, int]]]:
    """The fields of MEASURES of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines: dict[int, int] = {}
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            repeats += line in seen
            seen.add(line)
            key = xxhash.xxh3_64_intdigest(normal_line(line)) - 2**63
            lines[key] = lines.get(key, 0) + n
    both = xxhash.xxh3_128_intdigest(raw)
    return (
        len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words),
        (both >> 64) - 2**63, (both & (2**64 - 1)) - 2**63, list(lines.items()),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and the measures of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("rules", forget)
        struct = pa.struct([("line", pa.int64()), ("words", pa.int32())])
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(2)]
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            flat = [x for r in rows for x in r[7]]
            ends = np.cumsum([0, *[len(r[7]) for r in rows]]).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32())], fields=list(struct))
            names = [key, "host", *(f.split()[0] for f in MEASURES.split(", ")[:7]), "lines"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.ListArray.from_arrays(pa.array(ends), fields)], names=names)

    rows = docs.select(key, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("_text"))
    return in_tasks(rows, run, f"`{key}` {kind}, host string, {MEASURES}")


def common_lines(lines: DataFrame, texts: DataFrame, max_documents: int = MAX_DOCUMENTS, percent: float = PERCENT) -> DataFrame:
    """host, line of the lines above the limit; lines: host, t1, t2, line, once for each distinct text; texts: host, t1, t2."""
    often = lines.groupBy("host", "line").agg(F.count("*").alias("_n")).where(F.col("_n") > max_documents)
    hosts = texts.groupBy("host").agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_documents)
    big = hosts.where(F.col("_docs") >= BIG_HOST).select("host", F.col("_docs").alias("_many"))
    both = often.join(F.broadcast(big), "host", "left")
    above = lambda df, n: df.where(100 * F.col("_n") > percent * F.col(n)).select("host", "line")
    return above(both.where("_many is not null"), "_many").unionByName(above(both.where("_many is null").join(hosts, "host"), "_docs"))


def depleted_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, percent: float = PERCENT) -> DataFrame:
    """host, t1, t2 of the texts that lose lines, with removed_words and the removed lines' hashes."""
    texts = rows.groupBy("host", "t1", "t2").agg(F.first("lines").alias("lines"))
    lines = texts.select("host", "t1", "t2", F.explode("lines").alias("_l")).select("host", "t1", "t2", "_l.line", "_l.words")
    common = common_lines(lines, texts, max_documents, percent).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_salt", F.pmod("t1", F.lit(SALTS)).cast("int"))
    return salted.join(common, ["host", "line", "_salt"]).groupBy("host", "t1", "t2").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))


def judged(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, left: float = LEFT, key: str = "doc_id", text: str = "text", host: str = "source", percent: float = PERCENT) -> DataFrame:
    """key, host, t1, t2, the base measures, base_failed, kept, removed_words and removed of each row."""
    rows = saved(measured(docs, key, text, host), "measured")
    out = rows.drop("lines").join(depleted_lines(rows, max_documents, percent), ["host", "t1", "t2"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left * F.col("n_words")))


def clean(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, left: float = LEFT, text: str = "text", host: str = "source", percent: float = PERCENT) -> DataFrame:
    """The documents that pass all rules, without the lines above the limits."""
    verdicts = judged(docs.withColumn("_key", F.lit(0)), max_documents, left, "_key", text, host, percent).where("kept").groupBy("host", "t1", "t2").agg(F.first("removed").alias("_removed"))
    names = docs.columns

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [xxhash.xxh3_128_intdigest((t.as_py() or "").encode()) for t in b.column(b.schema.get_field_index(text))]
            cols = [pa.array([(x >> 64) - 2**63 for x in both], pa.int64()), pa.array([(x & (2**64 - 1)) - 2**63 for x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "_t1", "_t2"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, gone = b.schema.get_field_index(text), b.column(b.schema.get_field_index("_removed"))
            texts = []
            for t, r in zip(b.column(at).to_pylist(), gone.to_pylist()):
                drop = set(r or ())
                texts.append("\n".join(x for x in t.split("\n") if xxhash.xxh3_64_intdigest(normal_line(x)) - 2**63 not in drop) if drop else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else b.column(b.schema.get_field_index(n)) for n in names], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = in_tasks(docs, identify, schema + ", _t1 long, _t2 long").withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    v = verdicts.select(F.col("host").alias("_host"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_removed")
    return in_tasks(keyed.join(v, ["_host", "_t1", "_t2"]).select(*names, "_removed"), strip, schema)


def report(docs: DataFrame) -> DataFrame:
    """op4's result."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM d),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
lines AS (SELECT rid, host, text, line, pos,
    len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
    regexp_replace(trim(regexp_replace(lower(line), '\\s+', ' ', 'g')), '[0-9]', '0', 'g') AS norm FROM raw),
dup AS (SELECT rid, count(*) AS n FROM (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS k FROM lines WHERE words > 0) WHERE k > 1 GROUP BY rid),
win AS (SELECT rid, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS k FROM t WHERE len(ws) >= 3)),
twice AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
often AS (SELECT host, norm, count(DISTINCT text) AS n FROM lines WHERE words > 0 GROUP BY host, norm),
common AS (SELECT o.host, o.norm FROM often o JOIN hosts h USING (host) WHERE o.n > {MAX_DOCUMENTS} AND 100 * o.n > {PERCENT} * h.n),
gone AS (SELECT l.rid, sum(l.words) AS n FROM lines l JOIN common c USING (host, norm) WHERE l.words > 0 GROUP BY l.rid),
m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM t LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words - removed_words >= {LEFT} * n_words AS kept
FROM m
"""
