"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import _text as T

UNDETERMINED = "und"
BUCKETS, DIMENSIONS = 1 << 14, 16
#: Bound of the sample of labelled documents that the model is fitted on; each label has an equal part of it.
TRAIN_ROWS = 3000
#: Share of the sample kept out of the gradient steps, for calibration.
CALIBRATION = 0.2
#: The rejection threshold leaves at least this share of calibration documents above it ...
KEEP_SHARE = 0.9995
#: ... and otherwise this share of their scrambled counterparts, which stand for unknown languages, below it.
REJECT_SHARE = 0.99
#: Standard deviations below what calibration documents reach, as those are few.
MARGIN = 2.0


def _grams(data: np.ndarray, begins: int) -> list[np.ndarray]:
    """Buckets of the byte n-grams (1 to 4) that begin at the first ``begins`` bytes; the data's end cuts them off."""
    value = np.zeros(len(data), np.uint32)
    out = []
    for n in range(1, 5):
        if len(data) < n:
            break
        value = value[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :].astype(np.uint32) + np.uint32(n)
        mixed = value[:begins] * np.uint32(0x9E3779B1)
        out.append((mixed >> np.uint32(18)).astype(np.int64))
    return out


def _normal(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z; digits, ASCII punctuation and white space become single-byte spaces."""
    lower = T.lower_bytes(data)
    letter = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    return np.where(letter, lower, 32).astype(np.uint8)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each bounded chunk of texts: its first row and the normalised n-gram counts, one row per text."""
    for row, end, data, offsets in T.chunks(column):
        plain = _normal(data)
        for first in range(row, end, 256):
            last = min(first + 256, end)
            out = np.zeros((last - first, BUCKETS), np.float32)
            for i in range(first, last):
                # very long texts are counted in pieces, which see the three bytes after them, and their counts added up
                lo, hi = offsets[i - row], offsets[i - row + 1]
                counts = np.zeros(BUCKETS, np.int64)
                for at in range(lo, hi, T.CHUNK_BYTES):
                    for grams in _grams(plain[at : min(hi, at + T.CHUNK_BYTES + 3)], T.CHUNK_BYTES):
                        counts += np.bincount(grams, minlength=BUCKETS)
                out[i - first] = counts / max(1, counts.sum())
            yield first, out


@dataclass
class Model:
    """A fitted model; ``table`` is the product of embeddings and output weights, a row per bucket.

    ``usual`` is the logarithm of each bucket's share in each label's training
    texts; a text's mean of it says how usual its n-grams are for that label.
    """

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    usual: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    least_usual: float = -np.inf

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's best label, its probability, and how usual the row is for it."""
        p = _softmax((x @ self.table + self.bias) / self.temperature)
        best = p.argmax(1)
        return best, p.max(1), (x @ self.usual)[np.arange(len(x)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(x: SparseRows, labels: list[str], seed: int = 5, epochs: int = 12, batch: int = 64, rate: float = 40.0) -> Model:
    """Fit embeddings and softmax by stochastic gradient descent, then calibrate.

    A temperature, chosen by log loss on the documents held back for
    calibration, makes the scores probabilities.  The rejection threshold is the
    confidence that REJECT_SHARE of the held back documents stay below once
    their n-grams are scrambled (buckets permuted, so that they look like no
    language), at least a half, but never more than KEEP_SHARE of the documents
    themselves exceed, less MARGIN standard deviations.  A softmax can be sure
    of a language that it never saw, so a text must also be as usual for its
    label as KEEP_SHARE of them are, less the same margin.
    """
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_cal = int(len(y) * CALIBRATION) if len(y) >= 10 else 0
    held, train = order[:n_cal], order[n_cal:]
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    prior = np.bincount(y[train], minlength=len(names)) / max(1, len(train))
    weight = 1 / np.maximum(prior * len(names), 1e-3)  # a rare language counts as much as a common one
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            own = x[rows]
            hidden = own @ embed
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= np.minimum(weight[y[rows]], 10)[:, None].astype(np.float32) / len(rows)
            back = error @ out.T
            out -= step * 0.05 * (hidden.T @ error)
            bias -= step * 0.005 * error.sum(0)
            embed -= step * (own.T @ back)
    table = embed @ out
    shares = np.full((BUCKETS, len(names)), 1e-7)
    for at in range(0, len(train), batch):
        rows = train[at : at + batch]
        np.add.at(shares.T, y[rows], x[rows])
    model = Model(names, table, bias, np.log(shares / shares.sum(0)).astype(np.float32))
    test = held if n_cal else train
    scores = lambda weights: np.concatenate([x[test[at : at + batch]] @ weights + bias for at in range(0, len(test), batch)])
    if len(test):
        z = scores(table)
        loss = lambda t: float(-np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean())
        model.temperature = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=loss)
        known = _softmax(z / model.temperature).max(1)
        strange = _softmax(scores(table[rng.permutation(BUCKETS)]) / model.temperature).max(1)
        usual = np.concatenate([model.judge(x[test[at : at + batch]])[2] for at in range(0, len(test), batch)])
        model.least_usual = float(np.quantile(usual, 1 - KEEP_SHARE) - MARGIN * usual.std())
        model.threshold = float(min(np.quantile(known, 1 - KEEP_SHARE) - MARGIN * known.std(), max(0.5, np.quantile(strange, REJECT_SHARE))))
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = 5) -> Model | None:
    """Fit on a bounded sample of the rows with a text and a label; None where there are none.

    Distinct pairs of text and label are drawn by a hash of the text, about
    ``rows`` of them and as many of each label, so that rare labels are learned,
    copies don't fill the sample, and it doesn't depend on partitions; counts
    are made on the executors, and that many sparse rows reach the driver.  The
    labels' list does too, as a model has a column for each.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    usable = usable.where(F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64(F.lit(seed), "text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    part = rows / len(sizes)
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int((1 << 30) * min(1.0, part / max(1, n))))))
    sample = usable.where(F.pmod(F.col("draw"), F.lit(1 << 30)) <= F.element_at(shares, F.col("lang"))).dropDuplicates(["lang", "draw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in features(batch.column(1)):
                places = [np.flatnonzero(r).astype(np.int32) for r in x]
                values = [r[p] for r, p in zip(x, places, strict=True)]
                own = [batch.column(i).slice(first, len(x)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "draw", "places", "values"])

    found = sample.mapInArrow(run, "lang string, draw long, places array<int>, values array<float>").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    return fit(SparseRows(found), found.column("lang").to_pylist(), seed)


class SparseRows:
    """Rows of n-gram shares that become dense when a batch is taken."""

    def __init__(self, table: pa.Table):
        self._places = [x.values.to_numpy() for x in table.column("places")]
        self._values = [x.values.to_numpy() for x in table.column("values")]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for to, i in enumerate(rows):
            out[to, self._places[i]] = self._values[i]
        return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicted language of every whole text.

    Returns ``doc_id``, ``lang_pred`` (a learned label; ``und`` where the text is
    null or has no letter, or nothing was learned), ``score`` (calibrated, 0 to
    1; 0 for ``und``) and ``accepted`` (not ``und``, confident and usual enough), one
    row for each input row.  Only the text is looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    shared = spark.sparkContext.broadcast(model)  # a table of BUCKETS rows and a column per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, x in features(batch.column(2)):
                lettered = batch.column(1).slice(first, len(x)).to_numpy(zero_copy_only=False)
                if model is None:
                    langs, score, good = [UNDETERMINED] * len(x), np.zeros(len(x)), np.zeros(len(x), bool)
                else:
                    best, p, usual = model.judge(x)
                    langs = [model.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                    score = np.where(lettered, p, 0.0).astype(np.float64)
                    good = lettered & (score >= model.threshold) & (usual >= model.least_usual)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), pa.array(langs, pa.string()), pa.array(score), pa.array(good)], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from three quarters of the labelled documents and predict all of them.

    Documents whose crc32(id as text) mod 4 is 2 are held out of training
    (``held_out``); a document without an id is neither held out nor learned
    from.  Returns ``doc_id``, ``held_out``, ``lang_pred``, ``score`` and
    ``accepted``; see ``predict``.  An empty table gives an empty result;
    columns beside the three named are ignored.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    model = train(docs.where(remainder != 2), text_col, lang_col, **options)
    found = predict(docs, model, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def accepted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language is determined with enough confidence, with all their columns.

    Rows that have one id in common stand or fall together: one that is accepted keeps them.
    """
    good = identify(docs, id_col, text_col, lang_col, **options).where("accepted").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
