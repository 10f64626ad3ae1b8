"""Quality classifier by compression: zstandard dictionaries of good and bad labelled texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, emptied, slices, strings

LEVEL = 6
#: Where the calibration line may bend, in shares of the calibration texts.
BENDS = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass
class CompressionClassifier:
    """Two dictionaries, and the calibration of the difference of a text's compressed sizes with them."""

    bad: bytes
    good: bytes
    bends: tuple[tuple[float, ...], tuple[float, ...]]
    weights: tuple[float, ...]

    def scorer(self):
        """texts -> scores; the dictionaries are loaded once."""
        size = sizer(self.bad, self.good)
        return lambda texts: calibrated(differences(size(texts)), self.bends, np.asarray(self.weights))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scorer()(texts)


def sizer(bad: bytes, good: bytes):
    """texts -> (bytes with the bad dictionary, bytes with the good one, plain bytes) of each whole text."""
    press = []
    for d in (bad, good):
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None
        press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress)
    return lambda texts: np.asarray([(len(press[0](t)), len(press[1](t)), len(t)) for t in (t.encode() for t in texts)], dtype=float).reshape(-1, 3)


def differences(size: np.ndarray) -> np.ndarray:
    """The size difference, normalised by the compressed bytes and by the bytes of text: all that a score knows of a text.
    Empty texts have none."""
    diff = size[:, 0] - size[:, 1]
    return np.column_stack([diff / np.maximum(size[:, :2].sum(axis=1), 1), diff / np.maximum(size[:, 2], 1)])


def features(diff: np.ndarray, bends) -> np.ndarray:
    """1, the two differences, and how far each is beyond each of its bends: the calibration is a line that bends there."""
    return np.column_stack([np.ones(len(diff)), diff, *[np.maximum(diff[:, i] - b, 0) for i, own in enumerate(bends) for b in own]])


def calibrated(diff: np.ndarray, bends, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(diff, bends) @ weights, -30, 30)))


def fitted_weights(x: np.ndarray, labels: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic calibration by Newton steps with a small ridge; a step that does not lower the loss is halved."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-3)

    def loss(w):
        return np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w)).sum() + (ridge * w * w).sum() / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[str], size: int) -> bytes:
    """A raw-content dictionary: the last ``size`` bytes of the texts, one after the other."""
    return b"".join(t.encode() for t in texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = 1000, calibration: int = 4000, longest: int = 32768, dictionary_bytes: int = 1 << 20) -> CompressionClassifier:
    """Learn from a bounded sample of labelled rows, whatever the tables' size.

    A hash of the id deals labelled documents to two halves. Of the one, the first ``per_class`` of each class
    (by another hash) make that class's dictionary, of ``dictionary_bytes`` at most; of the other, the first ``calibration``
    in their natural mix calibrate the score: logistic on the normalised size differences, along a line that may bend at a
    few of their quantiles. Documents over ``longest`` characters take no part. Only those at most
    2 ``per_class`` + ``calibration`` texts come to the driver. Only texts are learned from.

    Null labels, ids and texts take no part; an id with several labels counts with its largest, one with
    several texts with the smallest. Without labelled rows the dictionaries are empty and every score is 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where("i IS NOT NULL").withColumn("train", F.pmod(F.xxhash64(F.lit("half"), "i"), F.lit(2)) == 0)
    order = F.xxhash64(F.lit("order"), "i")
    parts = [(known.where(f"train AND y = {y}"), per_class) for y in (0, 1)] + [(known.where("NOT train"), calibration)]
    picked = None
    for rows, most in parts:
        part = rows.orderBy(order, "i").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where(F.length("t") <= longest)
    # ``picked`` has at most 2 per_class + calibration rows of three numbers.
    sample = texts.join(F.broadcast(picked), "i").groupBy("i", "train", "y").agg(F.min("t").alias("t")).orderBy("i").collect()
    bad, good = (dictionary([r["t"] for r in sample if r["train"] and r["y"] == y], dictionary_bytes) for y in (0, 1))
    rest = [(r["t"], r["y"]) for r in sample if not r["train"]]
    if not rest:
        return CompressionClassifier(bad, good, ((), ()), (0.0, 0.0, 0.0))
    diff = differences(sizer(bad, good)([t for t, _ in rest]))
    bends = tuple(tuple(float(b) for b in np.unique(np.quantile(diff[:, i], BENDS))) for i in range(2))
    weights = fitted_weights(features(diff, bends), np.asarray([y for _, y in rest], dtype=float))
    return CompressionClassifier(bad, good, bends, tuple(float(w) for w in weights))


def quality_scores(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``threshold``) of every whole text.

    One pass without any shuffle; the model is two megabytes. A null text is scored as the
    empty one; rows with equal or null ids each get their row; an empty table gives no rows. With ``carry``
    there are ``text`` and ``row`` (all other columns, whatever their names) in place of the id.
    """
    own = docs.select(F.col(f"`{text_col}`").alias("text"), *carried(docs, id_col, text_col, carry))
    result = own if carry else own.drop("text")

    def rows(batches):
        emptied()
        scores = model.scorer()
        for batch in batches:
            for b in slices(batch):
                score = scores(strings(b.column(0)))
                yield pa.RecordBatch.from_arrays([*b.columns[0 if carry else 1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=names)

    names = [*result.columns, "score", "predicted"]
    return own.mapInArrow(rows, T.StructType([*result.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % 5 == 0, F.lit(False))
