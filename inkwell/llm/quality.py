"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import free_name, materialise


#: The most labelled documents that a fit takes of either class; a fit has this bound at every size.
MOST_OF_CLASS = 3000
#: The most bytes of features, four a feature, that a fit takes of either class; the first document always counts.
MOST_BYTES_OF_CLASS = 32 << 20
#: Hashed features, and the bias behind them.
WIDTH = 1 << 18
_U = np.uint64


class Featuriser:
    """The distinct n-grams of whole texts, as hashed numbers: of bytes, n to 3, and of the repeats in the run of words, n to 4.

    The words become a run of marks: which of the four words before a word it equals, if any. Vocabulary plays no part, so that a
    language of which few labels exist is judged by the same marks.
    """

    def __init__(self, width: int = WIDTH):
        self.width, self._seen = width, np.zeros(width, np.int64)

    def _hashed(self, grams: np.ndarray, kind: int) -> np.ndarray:
        x = (grams.astype(np.uint64) + _U(kind << 40)) * _U(0x9E3779B97F4A7C15)
        return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(34)).astype(np.int64) % self.width

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        grams = [self._hashed(raw, 1)]
        if len(raw) > 1:
            two = raw[:-1] << 8 | raw[1:]
            grams.append(self._hashed(two, 2))
        if len(raw) > 2:
            grams.append(self._hashed(two[:-1] << 8 | raw[2:], 3))
        words = text.split()
        if len(words) > 1:
            number: dict[str, int] = {}
            w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
            mark = np.zeros(len(w), np.uint32)
            for lag in (4, 3, 2, 1):
                if len(w) > lag:
                    mark[lag:][w[lag:] == w[:-lag]] = lag
            if mark.any():
                for n in range(1, 5):
                    run = np.zeros(max(0, len(mark) - n + 1), np.uint32)
                    for k in range(n):
                        run = run << 3 | mark[k : k + len(run)]
                    grams.append(self._hashed(run, 3 + n))
        found = np.concatenate(grams)
        place = np.arange(len(found))
        self._seen[found] = place  # of equal numbers the last keeps its place
        return found[self._seen[found] == place].astype(np.int32)


class Model(NamedTuple):
    """Weights of width + 1 features, the last one the bias, and the log-count ratios that scale them."""

    weights: np.ndarray
    ratios: np.ndarray
    slope: float

    def margin(self, features: np.ndarray) -> float:
        if not self.slope:
            return 0.0
        scaled = self.ratios[features]
        length = float(np.sqrt(scaled @ scaled)) or 1.0
        return float(self.weights[features] @ scaled) / length + float(self.weights[-1])

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features), -40, 40))))


def fit(examples: list[np.ndarray], labels: np.ndarray, width: int = WIDTH, cost: float = 4.0, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> Model:
    """The model of examples with labels 1 and 0; both classes weigh the same. Without examples of both it scores 0.5 throughout."""
    signs = np.where(labels == 1, 1.0, -1.0)
    if not (signs > 0).any() or not (signs < 0).any():
        return Model(np.zeros(width + 1), np.zeros(width), 0.0)
    counts = np.full((2, width), smooth)
    for x, s in zip(examples, signs, strict=True):
        counts[int(s > 0), x] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])
    scaled = []
    for x in examples:
        v = ratios[x]
        scaled.append(v / (float(np.sqrt(v @ v)) or 1.0))
    share = np.array([(signs < 0).mean(), (signs > 0).mean()])
    caps = cost * 0.5 / share[(signs > 0).astype(int)]
    weights, duals = np.zeros(width + 1), np.zeros(len(examples))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            x, v, s = examples[i], scaled[i], signs[i]
            slack = s * (weights[x] @ v + weights[-1]) - 1
            dual = min(max(duals[i] - slack / (1.0 + v @ v), 0.0), caps[i])
            if dual != duals[i]:
                step = (dual - duals[i]) * s
                weights[x] += step * v
                weights[-1] += step
                duals[i] = dual
    return Model(weights, ratios, 2.0)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_OF_CLASS, most_bytes: int = MOST_BYTES_OF_CLASS) -> Model:
    """The model of the labelled documents that are not held out, at most `most` of either class, and most_bytes of features: those least by a hash of doc_id.

    labels: doc_id, quality. Rows with crc32(doc_id as text) mod 3 = 1 are held out; a null label or doc_id teaches nothing, nor does
    a label without a document. Of repeated rows the least text counts. Features are made where the texts are; the driver gets the
    numbers of at most 2 * most documents, 2 * most_bytes in all.
    """
    teach = labels.filter("doc_id is not null and quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = [teach.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    # of proven size: 2 * most rows
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches):
        make = Featuriser()
        for batch in batches:
            features = [make(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([f.tobytes() for f in features], pa.binary())], ["doc_id", "quality", "features"])

    made = materialise(found.mapInArrow(run, "doc_id long, quality int, features binary"))
    # a window over at most `most` rows of a class
    first = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    bounded = made.withColumn("size", F.sum(F.octet_length("features")).over(first)).withColumn("n", F.row_number().over(first))
    rows = sorted(bounded.filter((F.col("size") <= most_bytes) | (F.col("n") == 1)).select("doc_id", "quality", "features").collect())
    return fit([np.frombuffer(r.features, np.int32) for r in rows], np.array([r.quality for r in rows]))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1: of whole texts and nothing else; a null text counts as empty. A column of the same name gives way."""
    kept, body = [c for c in docs.columns if c != score], free_name("__text", docs.columns)
    # a fixed size: width + 1 weights
    shipped = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.slope))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches):
        make, own = Featuriser(), shipped.value
        for batch in batches:
            made = pa.array([own.score(make(t.as_py() or "")) for t in batch.column(body)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, score])

    return docs.select(*kept, docs["text"].alias(body)).mapInArrow(run, schema)


def documents_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; an empty table stays empty."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    made = scored(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, as they are, whatever their columns' names.

    Repeated rows are judged one by one and alike; a null text counts as empty; without labels of both classes all stay; an empty table stays empty.
    """
    score = free_name("__score", docs.columns)
    return scored(docs.withColumn(score, F.lit(None).cast("double")), train(docs, labels), score).filter(F.col(score) >= 0.5).select(*docs.columns)
