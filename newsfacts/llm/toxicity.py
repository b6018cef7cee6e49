"""Counterfactually regularised toxicity classifier.

A text's features are the words it has and their beginnings of 4 to 6 bytes, hashed. The score is a logistic
regression over features scaled by their log odds. For each labelled text that names a group, the text with
its identity terms swapped for others is made, and the squared change of the score's logit is penalised, so
that the weight of a group's name is drawn to that of any other and neutral mentions do not count.

It is fitted on a bounded sample of the labelled rows, in one task. Scoring reads all texts once, each
task by itself, with the weights as a broadcast of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.text import LETTERS, Words, groups, mix, texts
from newsfacts.session import ship

BUCKETS = 1 << 18

# Names of groups of people, by kind, in English, German, French and Spanish. A term is swapped
# for the next one of its list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
_NEXT = {t.encode(): group[(i + 1) % len(group)].encode() for group in IDENTITY_TERMS for i, t in enumerate(group)}
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Fit:
    """``sample``: most labelled rows to fit on. ``least``: texts of the sample a feature must be in."""

    sample: int = 16000
    least: int = 5
    ridge: float = 0.001
    fairness: float = 10.0
    steps: int = 60


def swapped(text: bytes) -> bytes | None:
    """The text with each identity term replaced by the next of its kind; None if it names no group."""
    found = False

    def other(match):
        nonlocal found
        term = _NEXT.get(match[0].decode("utf-8", "ignore").lower().encode())
        found = found or term is not None
        return match[0] if term is None else term

    out = _WORD.sub(other, text)
    return out if found else None


def features(parts: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct features of some texts, only those with a weight if given."""
    words = Words(parts, LETTERS)
    owner = words.owner().astype(np.int64)
    size = words.end - words.start
    first = np.zeros(len(size), np.uint64)
    hashes, owners = [words.hash], [owner]
    padded = np.r_[words.buf, np.zeros(8, np.uint8)]
    for k in range(6):
        b = padded[words.start + k].astype(np.uint64)
        b += np.uint64(32) * ((b >= 65) & (b <= 90))
        first = first | (b << np.uint64(8 * k))
        if k >= 3:
            some = size > k
            hashes.append(mix(first[some] + np.uint64((k + 1) << 56)))
            owners.append(owner[some])
    bucket = (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)
    owner = np.concatenate(owners)
    if weights is not None:
        some = weights[bucket] != 0
        bucket, owner = bucket[some], owner[some]
    both = np.unique(owner * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, parts = batch.column(0).to_pylist(), texts(batch.column(1))
        own, other = [], []
        for text in parts:
            own.append(features([text])[1].astype(np.int32).tobytes())
            changed = swapped(text)
            other.append(None if changed is None else features([changed])[1].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(own, pa.binary()), pa.array(other, pa.binary())],
            names=["label", "own", "other"])


def _minimise(value, start: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``value`` gives loss and gradient."""
    x, (loss, g), history = start, value(start), []
    for _ in range(steps):
        d = -g
        stack = []
        for s, y, r in reversed(history):
            a = r * (s @ d)
            d = d - a * y
            stack.append(a)
        if history:
            s, y, _ = history[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(history, reversed(stack)):
            d = d + s * (a - r * (y @ d))
        slope, rate = g @ d, 1.0
        if slope >= -1e-12:
            break
        while True:
            new_loss, new_g = value(x + rate * d)
            if new_loss <= loss + 1e-4 * rate * slope:
                break
            rate /= 2
            if rate < 1e-8:
                return x
        s, y = rate * d, new_g - g
        if s @ y > 1e-10:
            history = [*history[-7:], (s, y, 1 / (s @ y))]
        done = loss - new_loss < 1e-7 * max(1.0, loss)
        x, loss, g = x + s, new_loss, new_g
        if done:
            break
    return x


def fit_weights(labels: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None], fit: Fit) -> np.ndarray:
    """BUCKETS weights and the constant last. Without both labels, no weights and the smoothed rate."""
    y = labels.astype(float)
    out = np.zeros(BUCKETS + 1)
    rate = (y.sum() + 1) / (len(y) + 2)
    out[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return out
    doc = np.repeat(np.arange(len(own)), [len(f) for f in own])
    flat = np.concatenate(own)
    among = np.bincount(flat, minlength=BUCKETS)
    toxic = np.bincount(flat, y[doc], BUCKETS)
    kept = np.flatnonzero(among >= fit.least)
    number = np.full(BUCKETS, -1)
    number[kept] = np.arange(len(kept))
    odds = np.log((toxic[kept] + 1) / (y.sum() + 2)) - np.log(
        (among[kept] - toxic[kept] + 1) / (len(y) - y.sum() + 2))
    column = number[flat]
    doc, column = doc[column >= 0], column[column >= 0]
    pairs = [(a, b) for a, b in zip(own, other) if b is not None]
    gone = [number[np.setdiff1d(a, b)] for a, b in pairs]
    come = [number[np.setdiff1d(b, a)] for a, b in pairs]
    pair = np.repeat(np.arange(2 * len(pairs)) % max(1, len(pairs)), [len(x) for x in gone + come])
    sign = np.repeat([1.0, -1.0], [sum(map(len, gone)), sum(map(len, come))])
    moved = np.concatenate(gone + come) if pairs else np.zeros(0, np.int64)
    pair, sign, moved = pair[moved >= 0], sign[moved >= 0], moved[moved >= 0]

    def value(w):
        scaled = w[:-1] * odds
        z = np.bincount(doc, scaled[column], len(y)) + w[-1]
        loss = np.mean(np.logaddexp(0, z) - y * z)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        grad = np.append(np.bincount(column, error[doc], len(kept)) * odds, error.sum())
        loss += fit.ridge / 2 * (w[:-1] @ w[:-1])
        grad[:-1] += fit.ridge * w[:-1]
        if len(moved):
            change = np.bincount(pair, sign * scaled[moved], len(pairs))
            loss += fit.fairness * np.mean(change**2)
            grad[:-1] += np.bincount(
                moved, 2 * fit.fairness / len(pairs) * change[pair] * sign, len(kept)) * odds
        return loss, grad

    w = _minimise(value, np.append(np.zeros(len(kept)), out[-1]), fit.steps)
    weights = w[:-1] * odds
    out[kept] = np.where(np.abs(weights) < 1e-3, 0, weights)
    out[-1] = w[-1]
    return out


def _fit(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, own, other = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            own += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            other += [None if x is None else np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        order = sorted(range(len(labels)), key=lambda i: (own[i].tobytes(), labels[i]))  # rows come in any order
        labels, own, other = ([x[i] for i in order] for x in (labels, own, other))
        weights = fit_weights(np.array(labels), own, other, fit) if labels else np.zeros(BUCKETS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()])], names=["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit: Fit = Fit(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> np.ndarray:
    """Weights from the labelled rows for which ``learn`` (over the id) holds.

    Of more than ``fit.sample`` labelled ids those with the smallest hashes are taken. Null ids and labels are
    not used; an id with several labels counts as toxic if one says so. Rows that repeat an id are all
    used. Without labelled rows every score is one half.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id").agg(F.max("label").alias("label")).withColumnRenamed("id", id_col).filter(learn)
        .orderBy(F.xxhash64(id_col), id_col).limit(fit.sample)
    )
    sample = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), id_col)  # at most fit.sample ids
    # Features are made where the texts are; one task gets those of the sample only.
    features_ = sample.select("label", "text").mapInArrow(_sample_features, "label int, own binary, other binary")
    rows = features_.repartition(1).mapInArrow(_fit(fit), "weights binary")
    return np.frombuffer(rows.first()["weights"], np.float32)


def _scores(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            parts, z = texts(batch.column(0)), []
            for lo, hi in groups(parts):
                owner, bucket = features(parts[lo:hi], w)
                z.append(np.bincount(owner, w[bucket], hi - lo))
            z = np.concatenate(z) + w[-1] if z else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))
            columns = [*batch.columns[1:], pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score_col``, 0 to 1, one row per row.

    Null and empty texts have no features and get the score of the constant. Equal texts have equal scores; a very
    long text is scored whole by one task. Of the input only the text is used for a score. A kept column named like
    ``score_col`` is replaced.
    """
    ship(docs.sparkSession)
    keep = [c for c in keep if c.lower() != score_col.lower()]
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    rows = docs.select(F.col(text_col), *columns).toDF("text", *[f"c{i}" for i in range(len(keep))])
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]] + ["double"]
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(weights)), schema).toDF(*keep, score_col)
