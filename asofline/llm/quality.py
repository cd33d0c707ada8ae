"""Quality classifier by co-training of two views.

The content view reads the text alone: shares of symbols, letter cases and digits, word lengths, how far
words, lines and windows repeat, and a few hashed word shapes.  The metadata view never sees the text: it has the
language, the source and the number of characters.  Each view is a logistic model fitted in numpy on a
bounded sample of labelled rows of the training fold (MAX_TRAIN).

The features of all documents are written once.  In every round both views score every document without a label,
in the tasks, and each tells the other the EXCHANGED rows of each kind of which it is surest, that it hasn't told
before, and of which it is CONFIDENT: its calibrated probability of the kind is as high as that.  Of other rows it says
nothing, and a view that is sure of none tells none; equal rows count once.  A told label is that probability, and
weighs the more the further it is from one half.  Both views are fitted again on what they were told.  After the rounds they are calibrated on held-back rows, combined by a logistic model of
their logits, and score all documents over whole texts.

The score is the probability of good quality.  The threshold rejects where the score is low, and is lowered
so that KEEP of the good held-back rows stay.

Defined results: null or empty texts have the features of no words; null languages and sources are values of
their own; a null n_chars is the text's length; a row with a null id is scored and is part of the unlabelled rows;
without labels of both kinds every score is 1 and every row is kept; an empty table has no rows and no model;
repeated rows have equal scores; extra columns are kept by annotate(), whose own names replace clashing ones.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .common import cached_by, in_tasks, saved
from .rules import repeated_words
from .toxicity import _platt, training_ids

LOG = logging.getLogger(__name__)
#: Labelled rows that the models learn from at most.
MAX_TRAIN = 6000
#: Rounds of exchange; rows that a view tells the other in a round, of each kind; weight of a sure told row.
ROUNDS, EXCHANGED, TOLD_WEIGHT = 3, 200, 0.3
#: Calibrated probability of a kind from which a view tells a row as of that kind.
CONFIDENT = 0.95
#: Share of the good held-back rows whose scores the threshold leaves.
KEEP = 0.995
SYMBOLS = "#*$%&|<>!?.,;:-_/\\@=+~^\"'()[]{}"
SHAPES, TAGS = 64, 128
_SHAPE = str.maketrans({c: "0" for c in "0123456789"})


def content(text: str | None) -> np.ndarray:
    """Features of a whole text."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    digits = sum(map(text.count, "0123456789"))
    letters = len(text) - digits - sum(map(text.count, SYMBOLS + " \t\r\n"))
    upper = sum(map(str.isupper, words))
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    dense = [
        *(math.sqrt(text.count(c) / m) for c in SYMBOLS),
        math.log1p(len(words)), letters / n, upper / m, digits / n, (len(text.encode()) - len(text)) / n,
        lengths.mean() / 10, lengths.std() / 10, lengths.max() / 50, len(counts) / m, len(counts) / m**0.8, *(c / m for _, c in top), *(0,) * (3 - len(top)),
        repeated_words(raw) / m, sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))), len(lines) / m,
        sum(not w[-1].isalnum() for w in words) / m, sum(len(w) == 1 for w in words) / m, float(not words),
    ]
    hashed = np.zeros(SHAPES)
    for word, c in counts.items():
        if not word.isalpha():
            shape = "".join(sorted({ch for ch in word.translate(_SHAPE) if not ch.isalpha()}))
            hashed[zlib.crc32(shape.encode()) % SHAPES] += c
    return np.concatenate([dense, np.sqrt(hashed / m)])


def metadata(lang: str | None, source: str | None, n_chars: int) -> np.ndarray:
    """Features of a row's metadata."""
    tags = np.zeros(TAGS)
    tags[zlib.crc32(f"lang {lang}".encode()) % TAGS] = 1
    tags[zlib.crc32(f"source {source}".encode()) % TAGS] = 1
    size = math.log1p(max(0, n_chars))
    bins = np.zeros(12)
    bins[min(11, int(size))] = 1
    return np.concatenate([tags, bins, [size / 10, (size / 10) ** 2]])


@dataclass
class View:
    """Logistic model of standardised features, with its calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 1.0, steps: int = 25) -> View:
        mean, spread = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), pull)
        ridge[-1] = 1e-3
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            s = np.maximum(weight * p * (1 - p), 1e-6)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        return cls(mean, spread, w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Quality:
    views: list[View] | None
    weights: np.ndarray  # of the calibrated logits, and a shift
    threshold: float
    #: by round: how many rows the content view and the metadata view were told
    told: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        if self.views is None:
            return np.ones(len(xs[0]))
        return _sigmoid(np.clip(sum(w * v.logit(x) for w, v, x in zip(self.weights, self.views, xs)) + self.weights[-1], -30, 30))


#: What a view was told: features by view, probability and weight of each row.
Told = tuple[list[np.ndarray], np.ndarray]


def train(xs: list[np.ndarray], y: np.ndarray, surest: Callable[[list[View]], list[Told]], rounds: int = ROUNDS, seed: int = 11) -> Quality:
    """xs: features of the labelled rows, by view; surest: what each view is told by the other, given both, once a round."""
    if len(set(y.tolist())) < 2:
        return Quality(None, np.zeros(3), 0.0)
    r = np.random.default_rng(seed)
    back = r.permutation(len(y)) % 4 == 0  # held back for calibration
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.zeros(len(y), bool)
    held = back if back.any() else ~back
    told: list[list[Told]] = [[], []]

    def fitted() -> list[View]:
        views = []
        for k, x in enumerate(xs):
            more = np.concatenate([p for _, p in told[k]]) if told[k] else np.zeros(0)
            both = np.vstack([x[~back], *(t[k] for t, _ in told[k])])
            weight = np.concatenate([np.ones((~back).sum()), TOLD_WEIGHT * np.abs(2 * more - 1)])
            view = View.fit(both, np.concatenate([y[~back], more]), weight, 3.0)
            view.slope, view.shift = _platt(view.raw(x[held]), y[held])
            views.append(view)
        return views

    views, counts = fitted(), []
    for _ in range(rounds):
        new = surest(views)
        counts.append((len(new[0][1]), len(new[1][1])))
        LOG.info("the content view was told %d rows, the metadata view %d", *counts[-1])
        if not any(counts[-1]):
            break
        for k in (0, 1):
            told[k].append(new[k])
        views = fitted()
    z = np.stack([v.logit(x[held]) for v, x in zip(views, xs)], 1)
    joint = View.fit(z, y[held], np.ones(held.sum()), 1.0)
    scale = joint.weights[:-1] / joint.spread
    weights = np.append(scale, joint.weights[-1] - (scale * joint.mean).sum())
    model = Quality(views, weights, 0.5, counts)
    good = model.scores([x[held] for x in xs])[y[held] == 1]
    model.threshold = float(min(0.5, np.quantile(good, 1 - KEEP) * 0.999))
    return model


#: Columns of featured(): float32 features of both views, and a hash that is the same for equal ones.
FEATURES = ("_x0", "_x1", "_mark")


def _unpacked(columns: list[pa.Array]) -> list[np.ndarray]:
    """Features, by view, of a batch's packed columns."""
    return [np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(len(c), -1).astype(np.float64) for c in columns]


def featured(docs: DataFrame, text: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or the named columns of them, with FEATURES, written once; what reads the rows later doesn't read the texts again."""
    have, names = set(docs.columns), [c for c in docs.columns if c.lower() not in FEATURES and (only is None or c in only)]
    column = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    inputs = [column("lang", "string").alias("_in_lang"), column("source", "string").alias("_in_source"), column("n_chars", "long").alias("_in_n"), F.col(text).cast("string").alias("_in_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("rules", rules.forget)
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part = b.slice(begin, 500)
                x0, x1, marks = [], [], []
                for lang, source, n, t in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_in_lang", "_in_source", "_in_n", "_in_text"))):
                    x0.append(content(t).astype(np.float32).tobytes())
                    x1.append(metadata(lang, source, len(t or "") if n is None else n).astype(np.float32).tobytes())
                    marks.append(xxhash.xxh3_64_intdigest(x0[-1] + x1[-1]) - 2**63)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(x0, pa.binary()), pa.array(x1, pa.binary()), pa.array(marks, pa.int64())], names=[*names, *FEATURES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return saved(in_tasks(docs.select(*[F.col(f"`{c}`") for c in names], *inputs), run, schema + ", _x0 binary, _x1 binary, _mark long"), "features")


def _scored(rows: DataFrame, views: list[View], key: str) -> DataFrame:
    """_id, _mark and the calibrated probability of each view (p0, p1) of featured rows."""
    shared = rows.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = [np.round(_sigmoid(v.logit(x)), 9) for v, x in zip(shared.value, _unpacked([b.column(2), b.column(3)]))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, p)], names=["_id", "_mark", "p0", "p1"])

    return in_tasks(rows.select(F.col(key).cast("long").alias("_id"), "_mark", "_x0", "_x1"), run, "_id long, _mark long, p0 double, p1 double")


def _surest(rows: DataFrame, labels: DataFrame, key: str, most: int, floor: float = CONFIDENT) -> Callable[[list[View]], list[Told]]:
    """The exchange of a round over all featured rows without a label, of those whose probability of a kind is `floor` or more; equal rows are told once in each direction."""
    known = labels.select(F.col(key).cast("long").alias("_id")).where("_id is not null").distinct()
    before: list[set[int]] = [set(), set()]  # marks that each view was told, 2 * most more a round

    def ask(views: list[View]) -> list[Told]:
        pool = _scored(rows, views, key).join(known, "_id", "left_anti").groupBy("_mark").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
        pool = saved(pool, "pool")  # slim, and looked at for each kind and view
        chosen = []
        for k in (0, 1):
            new = pool.where(~F.col("_mark").isin(*before[k])) if before[k] else pool
            p = F.col(f"p{1 - k}")
            for sure, enough in ((p.desc(), p >= floor), (p.asc(), p <= 1 - floor)):
                chosen.append(new.where(enough).orderBy(sure, "_mark").limit(most).select(F.lit(k).alias("k"), "_mark", p.alias("p")))
        told = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).unionByName(chosen[3]).distinct().toArrow().sort_by([("k", "ascending"), ("_mark", "ascending")]).to_pylist()
        marks = {r["_mark"] for r in told}
        if not marks:
            return [([np.zeros((0, 1))] * 2, np.zeros(0))] * 2
        wanted = rows.sparkSession.createDataFrame([(m,) for m in sorted(marks)], "_mark long")  # 4 * most at most
        got = rows.select("_mark", "_x0", "_x1").join(F.broadcast(wanted), "_mark").groupBy("_mark").agg(F.first("_x0").alias("_x0"), F.first("_x1").alias("_x1")).toArrow()
        xs = _unpacked([got["_x0"], got["_x1"]])
        at = {m: i for i, m in enumerate(got["_mark"].to_pylist())}
        out = []
        for k in (0, 1):
            mine = [r for r in told if r["k"] == k]
            before[k].update(r["_mark"] for r in mine)
            place = np.array([at[r["_mark"]] for r in mine], int)
            out.append(([x[place] for x in xs], np.array([r["p"] for r in mine])))
        return out

    return ask


def _ready(docs: DataFrame) -> DataFrame:
    return docs if {*FEATURES} <= {*docs.columns} else featured(docs)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", most: int = EXCHANGED, rounds: int = ROUNDS, floor: float = CONFIDENT) -> Quality:
    """The model of docs, plain or featured(): a bounded sample of labelled ones of the training fold, and exchange over all unlabelled ones."""
    rows = _ready(docs)
    sample = training_ids(labels, label, MAX_TRAIN, key)
    got = rows.select(F.col(key).alias("_id"), "_x0", "_x1").join(F.broadcast(sample), "_id").toArrow().sort_by("_id")
    if not got.num_rows:
        return Quality(None, np.zeros(3), 0.0)
    return train(_unpacked([got["_x0"], got["_x1"]]), got["_y"].to_numpy().astype(np.int64), _surest(rows, labels, key, most, floor), rounds)


def annotate(docs: DataFrame, model: Quality) -> DataFrame:
    """docs, plain or featured(), with score and kept."""
    rows = _ready(docs)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c.lower() not in (*FEATURES, "score", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                s = np.round(m.scores(_unpacked([b.column(b.schema.get_field_index(c)) for c in FEATURES[:2]])), 12)  # equal rows, equal scores, whatever their batch
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(s), pa.array(s >= m.threshold)], names=[*names, "score", "kept"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    return in_tasks(rows, run, ", ".join([*schema, "score double", "kept boolean"]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10's result: doc_id, held_out, score (probability of good quality), predicted and kept of every document."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = featured(docs.select("doc_id", "text", "lang", "source", "n_chars"), only=("doc_id",))
    return annotate(rows, fit(rows, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "kept")
