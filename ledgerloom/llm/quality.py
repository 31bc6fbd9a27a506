"""Compression classifier: zstandard dictionaries of good and bad text.

A text's blocks are compressed with either dictionary. The difference of the compressed
sizes, normalised by the text's size and by the compressed size, becomes a score by a
logistic calibration on labelled rows that the dictionaries didn't see. Nothing else
about a text goes into its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._labels import FOLDS, SAMPLE_BYTES, SAMPLE_ROWS, Logistic, held_out, sample
from ledgerloom.llm._shared import small_batches, trimmed

BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    """Cuts of the whole text, all of BLOCK bytes but the last."""
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Compressors:
    """A compressor for either dictionary, good and bad."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for data in (good, bad):
            known = {"dict_data": zstandard.ZstdCompressionDict(data), "write_dict_id": False} if data else {}
            if known:
                known["dict_data"].precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, **known))

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed sizes of the whole text, block by block, with the good and the bad dictionary."""
        cuts = blocks(text)
        good, bad = (sum(len(c.compress(b)) for b in cuts) for c in self.both)
        return good, bad

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The difference over the size of the text and over the lesser compressed size, and as a ratio of logarithms; 0 for empty texts."""
        out = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            good, bad = self.sizes(text)
            out[k] = ((bad - good) / max(1, len(text)), (bad - good) / max(1, min(good, bad)), np.log((bad + 1) / (good + 1)))
        return out


class QualityModel:
    """Dictionaries from half of the sample, calibration from the other half, both classes weighed alike."""

    def __init__(self, texts: list[bytes], y: np.ndarray):
        half = np.arange(len(y)) % 2 == 0
        good, bad = ([t for t, own, v in zip(texts, half, y, strict=True) if own and v == k] for k in (1, 0))
        self.good, self.bad = _dictionary(good), _dictionary(bad)
        rest = [t for t, own in zip(texts, half, strict=True) if not own]
        self.calibration = Logistic(self.compressors().features(rest), y[~half], balanced=True)

    def compressors(self) -> Compressors:
        return Compressors(self.good, self.bad)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """A model from at most ``rows`` labelled rows a class with at most ``n_bytes`` of text."""
    return QualityModel(*sample(docs, labels, "quality", rows, n_bytes))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, held_out, score (0 to 1), predicted. A null or empty text
    has no difference and scores as such. Repeated rows score alike; null ids stay null;
    other columns aren't read. An empty table gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            x = compressors.features([t or b"" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.calibration(x))], schema.names)
        trimmed(None)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(scored, schema)
    return found.select(F.col("__id").alias(id_col), held_out(F.col("__id"), FOLDS).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' columns, whatever
    their names. A null text scores as an empty one and stays null; repeated rows stay or
    go together. An empty table gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            x = compressors.features([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(shared.value.calibration(x) >= threshold))
        trimmed(None)

    return docs.mapInArrow(kept, docs.schema)
