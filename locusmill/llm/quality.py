"""Quality classifier: how much better a dictionary of good text compresses a text than one of bad text, and nothing else."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import fresh, ready, slices

#: The bounded sample that is fitted: documents of each label for the dictionaries, documents of any label for the
#: calibration, and code points of a run of each. Scoring has no bound.
DICT_DOCS, CALIBRATION_DOCS, SAMPLE_CHARS = 1000, 4000, 16_384
#: Bytes of a dictionary, bytes that are compressed at a time (so that the dictionary, not what the text itself has said
#: before, decides the size throughout a long text), and level.
DICT_BYTES, CHUNK, LEVEL = 1 << 20, 512, 9
#: Bytes of ordinary text that every text is taken to hold besides: of a few words the sizes tell little.
ORDINARY = 50
THRESHOLD = 0.3


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    bare = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**bare)
    return zstandard.ZstdCompressor(**bare, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


@dataclass
class Compressors:
    good: zstandard.ZstdCompressor
    bad: zstandard.ZstdCompressor

    @classmethod
    def of(cls, good: bytes, bad: bytes) -> Compressors:
        return cls(compressor(good), compressor(bad))

    def difference(self, texts: list[bytes], usual: float | None = None) -> np.ndarray:
        """The normalised difference of the compressed sizes, (good - bad) in bytes a byte of text, with ORDINARY bytes of
        the usual difference added; none is added where usual is None."""
        out, more = np.empty(len(texts)), 0 if usual is None else ORDINARY
        for i, t in enumerate(texts):
            parts = [t[k : k + CHUNK] for k in range(0, max(1, len(t)), CHUNK)]
            g, b = (sum(map(len, map(c.compress, parts))) for c in (self.good, self.bad))
            out[i] = (g - b + more * (usual or 0.0)) / max(len(t) + more, 1)
        return out


def expand(d: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Columns of the calibration: a broken line in the difference."""
    return np.stack([np.ones(len(d)), d, *(np.maximum(d - k, 0) for k in knots)], axis=1)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    knots: np.ndarray
    weights: np.ndarray
    #: Least and largest difference in the calibration, to which those of a text are drawn.
    low: float
    high: float
    #: Median difference in the calibration.
    usual: float

    def score(self, texts: list[bytes], compressors: Compressors | None = None) -> np.ndarray:
        c = compressors or Compressors.of(self.good, self.bad)
        x = expand(np.clip(c.difference(texts, self.usual), self.low, self.high), self.knots)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def dictionary(texts: list[bytes]) -> bytes:
    """A raw-content dictionary: of each text an equal share of DICT_BYTES, from a place that its checksum tells."""
    share = max(256, DICT_BYTES // max(1, len(texts)))
    starts = (zlib.crc32(t) % max(1, len(t) - share + 1) for t in texts)
    return b"\n".join(t[k : k + share] for t, k in zip(texts, starts, strict=True))[-DICT_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression on standardised columns (the first is constant) by damped Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and (new := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * (1 + now):
            break
        w, now = w + size * step, new
    w = w / scale
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def sample(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> list[tuple[int, int, bytes]]:
    """(use, label, text) of labelled documents outside the held-out fold; use 0: dictionaries, 1: calibration.

    A hash of the id tells the use and the order: at most DICT_DOCS of each label, and CALIBRATION_DOCS of any, and
    of a longer text a run of SAMPLE_CHARS. An id whose labels disagree isn't used; null labels and texts aren't either.
    """
    per = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id_"))
    per = per.agg(F.min("quality").alias("q_"), F.max("quality").alias("z_")).where("q_ = z_")
    per = per.where(F.crc32(F.col("id_").cast("string").cast("binary")) % folds != held_out).select("id_", "q_", F.xxhash64("id_").alias("o_")).withColumn("use_", F.pmod("o_", F.lit(2)).cast("int"))
    few = per.where("use_ = 1").orderBy("o_").limit(CALIBRATION_DOCS)
    for q in (0, 1):
        few = few.union(per.where((F.col("use_") == 0) & (F.col("q_") == q)).orderBy("o_").limit(DICT_DOCS))
    got = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), F.col("doc_id") == F.col("id_"))  # a few thousand ids
    place = F.pmod("o_", F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    got = got.select("o_", "use_", "q_", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text"))
    out = {(o, t): (use, int(q), t.encode()) for o, use, q, t in got.toLocalIterator()}
    return [out[k] for k in sorted(out)]


def fit(rows: list[tuple[int, int, bytes]]) -> QualityModel:
    good, bad = (dictionary([t for use, y, t in rows if use == 0 and y == q]) for q in (1, 0))
    rest = [(y, t) for use, y, t in rows if use == 1]
    c, texts = Compressors.of(good, bad), [t for _, t in rest] or [b""]
    usual = float(np.median(c.difference(texts)))
    d = c.difference(texts, usual)
    knots = np.quantile(d, [0.5, 0.9])
    x = expand(d, knots)
    weights = logistic(x, np.array([y for y, _ in rest], dtype=float)) if rest else np.zeros(x.shape[1])
    return QualityModel(good, bad, knots, weights, float(d.min()), float(d.max()), usual)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> QualityModel:
    return fit(sample(docs, labels, held_out))


def scored(docs: DataFrame, model: QualityModel, keep: list[str], score: str) -> DataFrame:
    """Columns `keep` of docs with their score, from the whole text (null: empty)."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        c = Compressors.of(m.good, m.bad)
        for batch in batches:
            for lo, hi, texts in slices(batch):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, len(keep) + 1)), pa.array(m.score(texts, c))], names=[*keep, score])

    return docs.select("text", *[F.col(c).alias(f"{c}_kept") for c in keep]).mapInArrow(run, f"{kind}, `{score}` double")


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (score >= threshold).

    Without labels of both kinds the score says little but is defined (0.5 without any). Empty and null texts get the
    score of the usual text, equal texts equal scores.
    """
    out = scored(docs, train(docs, labels, held_out), ["doc_id"], "score_")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == held_out
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay."""
    score = fresh(docs.columns, "score_")
    out = scored(docs, train(docs, labels, held_out), docs.columns, score)
    return out.where(F.col(score) >= threshold).select(*docs.columns)
