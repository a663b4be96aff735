"""Quality classification by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed piece by piece with each
of them; the difference of the two total sizes over their sum becomes a probability by a logistic curve, which is fitted on
labelled texts that neither dictionary has seen. Of a short text the difference says little: its weight is the compressed size
over that size plus ``LITTLE``, and the rest of the weight is on what is usual.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import chunks, held_out, sampled_texts, table, utf8

#: Texts learned from for each label, pieces of each of them, and bytes of a piece: the bound of the sample.
TEXTS_PER_LABEL = 2000
PIECES_PER_TEXT = 6
PIECE_BYTES = 1024
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Compressed bytes, both ways together, from which a difference counts more than half.
LITTLE = 200
THRESHOLD = 0.7


def _dictionary(pieces: list[bytes]) -> bytes:
    import zstandard

    pieces = [p for p in pieces if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(pieces)[-DICTIONARY_BYTES:]


@dataclass
class CompressionClassifier:
    """Dictionaries of good and bad text and the curve 1 / (1 + exp(-((slope * x + base) * w + usual * (1 - w))))."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    base: float = 0.0
    usual: float = 0.0

    def _compressors(self) -> list:
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            known = zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None
            if known is not None:
                known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Rows (x, w) of whole texts: x is (bad - good) / (bad + good) of the compressed sizes, positive where good text explains better; w its weight."""
        good, bad = self._compressors()
        out = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
            a, b = (sum(len(c.compress(p)) - 6 for p in pieces) for c in (good, bad))
            out[k] = (b - a) / max(1, a + b), (a + b) / (a + b + LITTLE)
        return out

    def calibrate(self, texts: list[bytes], y: np.ndarray) -> None:
        """Logistic fit by Newton steps with a slight pull towards zero; both labels count as they occur."""
        if not texts:
            return
        x, weight = self.differences(texts).T
        scale = max(float(x.std()), 1e-6)
        design, w, pull = np.stack([x * weight / scale, weight, 1 - weight], axis=1), np.zeros(3), np.array([1e-2, 1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (y - p) - pull * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.base, self.usual = float(w[0] / scale), float(w[1]), float(w[2])

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, w = self.differences(texts).T if texts else np.zeros((2, 0))
        return 1 / (1 + np.exp(-np.clip((self.slope * x + self.base) * w + self.usual * (1 - w), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionClassifier:
    """Learns from labelled rows that are not held out: ``TEXTS_PER_LABEL`` texts of each label by a hash of the id, pieces spread over the whole of each. Pieces that repeat count once; every other text builds the dictionaries, the rest calibrates. Other label values are passed over."""
    keys = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    share = keys.agg(F.avg("label")).first()[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = F.col("text").cast("binary")
    last = F.greatest(F.lit(0), F.octet_length(raw) - PIECE_BYTES)
    spread = F.array_distinct(F.array(*(F.substring(raw, (last * k / (PIECES_PER_TEXT - 1)).cast("int") + 1, F.lit(PIECE_BYTES)) for k in range(PIECES_PER_TEXT))))
    found = sampled_texts(rows, keys, "label", TEXTS_PER_LABEL).select("label", spread.alias("pieces")).collect()  # bounded by the constants
    found, seen = sorted((r[0], [bytes(p) for p in r[1]]) for r in found), set()
    # A piece counts once for each label, so that a text with many copies doesn't fill a dictionary.
    found = [(label, new) for label, pieces in found if (new := [p for p in pieces if (label, p) not in seen and not seen.add((label, p))])]
    halves = {(y, h): [p for k, (label, p) in enumerate(found) if label == y and k % 2 == h] for y in (0, 1) for h in (0, 1)}
    model = CompressionClassifier(*(_dictionary([p for pieces in halves[y, 0] for p in pieces]) for y in (1, 0)))
    rest = [(y, b"".join(pieces)) for y in (0, 1) for pieces in halves[y, 1]]
    y = np.array([a for a, _ in rest], float)
    model.calibrate([b for _, b in rest], y)
    if share and 0 < share < 1 and 0 < y.mean() < 1:  # from the evenly drawn labels back to how often they occur
        shift = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
        model.base, model.usual = model.base + shift, model.usual + shift
    return model


def predict(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted (1 from 0.7 on).

    Null and empty texts get the score of no difference. With no labelled rows every score is 0.5. A null id is not held out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, 8 << 20):
                raw = data[offsets[a] : offsets[b]].tobytes()
                at = (offsets[a : b + 1] - offsets[a]).tolist()
                score = model.score([raw[x:y] for x, y in zip(at, at[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))
