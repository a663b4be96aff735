"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read every window of ``STEPS`` bytes, one forwards and one backwards; from both states a label is
predicted at every byte. It is trained in numpy by backpropagation through time on windows spread over a bounded number of
labelled texts. A document's probabilities are the mean over all its bytes.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import chunks, giving_back, held_out, sampled_texts, table, text_key, utf8

STEPS = 64
HIDDEN = 8
#: Texts learned from for each language, and windows of each of them: the bound of the sample.
TEXTS_PER_LANGUAGE = 300
WINDOWS_PER_TEXT = 8
ROUNDS = 400
ROWS_AT_ONCE = 2048
#: ``identified`` rejects documents whose best label's mean probability is no more than this part of the way from chance (one in the number
#: of labels) to certainty.
REJECT_BELOW = 0.1


def _gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


@dataclass
class ByteTagger:
    """Weights: for each direction ``inputs`` (256 x 3H, with the biases) and ``states`` (H x 3H); ``out`` (2H x labels) and ``bias``."""

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        for d in ("f", "b"):
            self.weights[f"inputs_{d}"] = rng.normal(0, 0.5, (256, 3 * HIDDEN)).astype(np.float32)
            self.weights[f"states_{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.3, (2 * HIDDEN, len(self.labels))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(self.labels), np.float32)

    def _states(self, text: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step, (steps, rows, H), of bytes (steps, rows) read in the order given."""
        inputs, states = self.weights[f"inputs_{d}"], self.weights[f"states_{d}"]
        steps, rows = text.shape
        h, out = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32)
        gx, gh = np.empty((rows, 3 * HIDDEN), np.float32), np.empty((rows, 3 * HIDDEN), np.float32)
        for t in range(steps):
            np.take(inputs, text[t], axis=0, out=gx, mode="clip")
            np.matmul(h, states, out=gh)
            zr = gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]
            _gate(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = r * gh[:, 2 * HIDDEN :]
            n += gx[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, gh[:, 2 * HIDDEN :].copy()))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def position_probabilities(self, text: np.ndarray) -> np.ndarray:
        """Of every byte of windows (steps, rows): (steps, rows, labels)."""
        both = np.concatenate([self._states(text, "f"), self._states(text[::-1], "b")[::-1]], axis=2)
        return _softmax(both.reshape(-1, 2 * HIDDEN) @ self.weights["out"] + self.weights["bias"]).reshape(*text.shape, -1)

    def gradients(self, text: np.ndarray, known: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes where ``known`` and its gradients, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        seen = {"f": text, "b": text[::-1]}
        hf = self._states(seen["f"], "f", kept["f"])
        hb = self._states(seen["b"], "b", kept["b"])[::-1]
        both = np.concatenate([hf, hb], axis=2)
        p = _softmax(both.reshape(-1, 2 * HIDDEN) @ self.weights["out"] + self.weights["bias"]).reshape(*text.shape, -1)
        rows, weight = np.arange(text.shape[1]), known / max(1, known.sum())
        loss = -float((np.log(np.maximum(p[:, rows, target], 1e-9)) * weight).sum())
        dy = p
        dy[:, rows, target] -= 1
        dy *= weight[:, :, None]
        flat = dy.reshape(-1, dy.shape[2]).astype(np.float32)
        grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0)}
        dboth = (flat @ self.weights["out"].T).reshape(both.shape)
        for d, dh_at in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[::-1, :, HIDDEN:])):
            grads |= self._through_time(seen[d], d, kept[d], dh_at)
        return loss, grads

    def _through_time(self, text: np.ndarray, d: str, kept: list, dh_at: np.ndarray) -> dict[str, np.ndarray]:
        states = self.weights[f"states_{d}"]
        d_inputs, d_states = np.zeros((256, 3 * HIDDEN), np.float32), np.zeros_like(states)
        dh = np.zeros_like(dh_at[0])
        slope = np.float32(0.25)
        for t in range(len(text) - 1, -1, -1):
            h, z, r, n, gn = kept[t]
            dh = dh + dh_at[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * np.where((z > 0) & (z < 1), slope, 0)
            dr = dn * gn * np.where((r > 0) & (r < 1), slope, 0)
            dgx = np.concatenate([dz, dr, dn], axis=1)
            dgh = np.concatenate([dz, dr, dn * r], axis=1)
            order = np.argsort(text[t], kind="stable")
            at, first = np.unique(text[t][order], return_index=True)
            d_inputs[at] += np.add.reduceat(dgx[order], first, axis=0)
            d_states += h.T @ dgh
            dh = dh * z + dgh @ states.T
        return {f"inputs_{d}": d_inputs, f"states_{d}": d_states}

    def fit(self, text: np.ndarray, known: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, rows: int = 192, seed: int = 7) -> None:
        """Adam on random rows of windows (rows, steps); languages are drawn evenly."""
        self.start(seed)
        rng, first, second = np.random.default_rng(seed), {}, {}
        by_label = [x for k in range(len(self.labels)) if len(x := np.flatnonzero(target == k))]
        for step in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(x, max(1, rows // len(by_label))) for x in by_label])
            _, grads = self.gradients(np.ascontiguousarray(text[pick].T), known[pick].T.astype(np.float32), target[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                self.weights[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean over the bytes of each document; zeros for an empty one."""
        lengths = np.diff(offsets)
        windows = -(-lengths // STEPS)
        doc = np.repeat(np.arange(len(lengths)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(offsets[:-1], windows) + nth * STEPS
        sizes = np.minimum(STEPS, np.repeat(offsets[1:], windows) - starts)
        padded = np.concatenate([data, np.zeros(STEPS, np.uint8)])
        sums = np.zeros((len(lengths), len(self.labels)))
        steps = np.arange(STEPS)
        for at in range(0, len(doc), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            inside = steps[:, None] < sizes[part][None, :]
            text = padded[starts[part][None, :] + steps[:, None]]
            text[~inside] = 0
            p = self.position_probabilities(text)
            p[~inside] = 0
            np.add.at(sums, doc[part], p.sum(axis=0))
        return sums / np.maximum(lengths, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    np.clip(x, -40, 40, out=x)  # states are within 1, so only extreme weights reach this
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteTagger:
    """Learns from text and non-null label of rows that are not held out: ``TEXTS_PER_LANGUAGE`` texts a label, ``WINDOWS_PER_TEXT`` windows spread over the whole of each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    keys = rows.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    raw = F.col("text").cast("binary")
    last = F.greatest(F.lit(0), F.octet_length(raw) - STEPS)
    spread = F.array(*(F.substring(raw, (last * k / (WINDOWS_PER_TEXT - 1)).cast("int") + 1, F.lit(STEPS)) for k in range(WINDOWS_PER_TEXT)))
    found = sampled_texts(rows, keys, "label", TEXTS_PER_LANGUAGE).filter(F.octet_length("text") > 0).select("label", F.explode(F.array_distinct(spread)).alias("window"))
    found = sorted((r[0], bytes(r[1])) for r in found.collect())  # bounded by the two constants and the number of languages
    tagger = ByteTagger(sorted({x for x, _ in found}))
    if tagger.labels:
        text, known = np.zeros((len(found), STEPS), np.uint8), np.zeros((len(found), STEPS), bool)
        for k, (_, w) in enumerate(found):
            text[k, : len(w)], known[k, : len(w)] = np.frombuffer(w, np.uint8), True
        tagger.fit(text, known, np.array([tagger.labels.index(x) for x, _ in found]))
    return tagger


_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, tagger: ByteTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (mean probability of that label over all bytes).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. A null id is not held out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(tagger))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = pickle.loads(model.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                raw = part.tobytes()
                lettered = [bool(tagger.labels) and _has_letter(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                p = tagger.document_probabilities(part, at) if any(lettered) else np.zeros((b - a, 1))
                best = p.argmax(axis=1)
                names = [tagger.labels[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.clip(p[np.arange(b - a), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(giving_back(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without rows in no language (``und``) or of a score no better than ``reject_below`` of the way from chance to certainty. Each row goes by its own text, whatever other rows its id has."""
    from lattica.llm.shared import materialize

    keyed, tagger = docs.withColumn("__lattica_text", text_key(F.col(text_col))), train(docs, id_col, text_col, label_col)
    chance = 1 / max(1, len(tagger.labels))
    found = predict(keyed, tagger, "__lattica_text", text_col)
    away = found.filter((F.col("lang_pred") == "und") | (F.col("score") < chance + reject_below * (1 - chance))).select(F.col("doc_id").alias("__lattica_text")).distinct()
    return keyed.join(materialize(away, "unidentified"), "__lattica_text", "left_anti").select(docs.columns)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
