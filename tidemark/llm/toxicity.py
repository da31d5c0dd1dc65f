"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table
from tidemark.llm.rules import labelled_sample

SAMPLE = 9000
"""At most so many labelled training rows (of each label at most this many) teach lexicon, trees and calibration."""
LEXICON = 64
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 3, 0.2, 32, 20
THRESHOLD = 0.7

# Look-alikes that are read as letters, and words of address.
LOOKALIKES = str.maketrans("0134578@$!", "oleastbasi")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre usted tú ti te vosotros".split())
EDGES = ".,;:!?\"'()[]{}<>*#%&|/\\-_"
NEAR = 5

TRAINING = "not (crc32(cast(doc_id as string)) % 3 = 1)"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1 if doc_id is not None else False


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


STEM = 4
"""Inflected forms share their first letters: a lexicon entry ``abcd*`` stands for all longer words that begin so."""


def known(word: str, lexicon: frozenset[str]) -> bool:
    return word in lexicon or (len(word) > STEM and word[:STEM] + "*" in lexicon)


def features(text: str, lexicon: frozenset[str]) -> list[float]:
    """Densities per word or character; an empty text has zeros."""
    words = plain_words(text)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if known(w, lexicon)]
    hidden = 0
    for i, w in enumerate(words):
        if w and not w.isalpha() and not known(w, lexicon):
            bare = w.translate(LOOKALIKES)
            squeezed = bare.replace("*", "").replace(".", "").replace("-", "").replace("_", "")
            if known(bare, lexicon) or known(squeezed, lexicon):
                hidden += 1
                hits.append(i)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    return [
        len(hits) / n,
        min(len(hits), 20),
        len({words[i] for i in hits}),
        near / n,
        sum(w in SECOND_PERSON for w in words) / n if hits else 0.0,
        sum(map(str.isupper, text)) / chars,
        text.count("!") / chars,
        (text.count("?") + text.count(",") + text.count(".")) / chars,
        hidden / n,
        np.log1p(n),
    ]


class Boosted:
    """Trees of fixed depth on binned features, fitted to the log loss by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        binned, raw = self._binned(x), np.full(len(y), self.start)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)])

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        node = np.zeros(len(g), int)
        split_f, split_b = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS, int)
        for at in range(2**DEPTH - 1):
            mine = np.flatnonzero(node == at)
            best = 1e-6
            if len(mine) >= 2 * LEAST_ROWS:
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for f in range(binned.shape[1]):
                    b = binned[mine, f]
                    lg, lh, ln = (np.cumsum(np.bincount(b, weights=v, minlength=BINS))[:-1] for v in (g[mine], h[mine], np.ones(len(mine))))
                    gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                    gain[(ln < LEAST_ROWS) | (len(mine) - ln < LEAST_ROWS)] = 0
                    if gain.max() > best:
                        best, split_f[at], split_b[at] = gain.max(), f, int(gain.argmax())
            node[mine] = 2 * at + 1 + (binned[mine, split_f[at]] > split_b[at])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        return (split_f, split_b, value), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out, every = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for split_f, split_b, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[every, split_f[node]] > split_b[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising fit (pool adjacent violators); equal scores are pooled first."""
    at, group = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []
    for x, total, n in zip(at, np.bincount(group, weights=y), np.bincount(group), strict=True):
        blocks.append([total, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2], high]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0] / b[1],) * 2])


class Model:
    """Lexicon, trees and calibration. The trees learn from the rows out of ``fold``, the calibration from those in it."""

    def __init__(self, lexicon: frozenset[str], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        self.lexicon = lexicon
        self.boosted = Boosted(x[~fold], y[~fold])
        # Equal raw scores meet in the calibration however little they differ by.
        self.points = isotonic(np.round(self.boosted.raw(x[fold]), 3), y[fold])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t or "", self.lexicon) for t in texts])
        return np.clip(np.interp(np.round(self.boosted.raw(x), 3), *self.points), 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int) -> DataFrame:
    """(_id, text, _label, fold) of at most ``sample`` toxic and ``sample`` other labelled ids outside the held-out third.

    An id with several labels has the largest, one with several texts the smallest. ``fold`` hangs on the text.
    """
    where = TRAINING.replace("doc_id", f"`{id_col}`")
    kinds = [labelled_sample(docs, labels.where(F.col(label) == k), id_col, label, sample, where) for k in (1, 0)]
    chosen = F.broadcast(kinds[0].union(kinds[1]))  # bounded by the parameter
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, F.col("id") == F.col("_id"))
    one = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    return keep(one.withColumn("fold", F.crc32("text") % 3 == 0), "labelled")


def lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> frozenset[str]:
    """Words held by far more toxic texts than others, as they stand and as stems; counted over ``rows`` in tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for i, (text, label) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist(), strict=True)):
                own = set(plain_words(text))
                own |= {w[:STEM] + "*" for w in own if len(w) > STEM}
                words += own
                toxic += [label] * len(own)
                if len(words) > 100_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"])
                    words, toxic = [], []

    counted = rows.select("text", "_label").mapInArrow(held, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))
    rate = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    able = counted.where((F.col("word") != "") & (F.col("toxic") >= max(3, 0.01 * n_toxic))).withColumn("rate", rate).where(F.col("rate") > float(np.log(8)))
    return frozenset(r.word for r in able.orderBy((F.col("rate") * F.col("toxic")).desc(), "word").limit(LEXICON).collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` toxic and ``sample`` other labelled rows outside the held-out third.

    None where a kind has under 6 rows or is missing from the part for the trees or from the part for the
    calibration. Texts stay in tasks: the driver gets the lexicon and ten numbers a row.
    """
    rows = labelled(docs, labels, id_col, text, label, sample)
    n = {(r._label, r.fold): r.n for r in rows.groupBy("_label", "fold").agg(F.count("*").alias("n")).collect()}
    if any(not n.get((k, False)) or not n.get((k, True)) or n[k, False] + n[k, True] < 6 for k in (0, 1)):
        return None
    words = lexicon(rows.where("not fold"), n[1, False], n[0, False])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("fold"), pa.array(own, pa.list_(pa.float64()))], names=["_label", "fold", "features"])

    found = rows.select("text", "_label", "fold").mapInArrow(measure, "_label int, fold boolean, features array<double>").collect()
    found = sorted((tuple(r.features), r._label, r.fold) for r in found)  # sums do not hang on the order of tasks
    return Model(words, np.array([r[0] for r in found]), np.array([r[1] for r in found], float), np.array([r[2] for r in found], bool))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted``.

    Only the text enters a score. Null and empty texts get the score of an empty text. A null id is not held
    out. Without enough labels of both kinds (``fit``) every score is 0. One scan of all texts; only the labelled
    sample is shuffled.
    """
    model = fit(docs, labels, id_col, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("text").to_pylist()) if model else np.zeros(batch.num_rows)
            out = [held_out(i) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(apply, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in a single pass over whole rows."""
    model = fit(docs, labels, text=text)
    if model is None:
        return docs

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(text).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(apply, docs.schema)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
