"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values

UNKNOWN = "und"
#: State size of each direction, and bytes of a window that the network reads both ways.
HIDDEN = 8
STEPS = 64
PAD = 256
#: The training sample: documents of each language, with their whole texts, and documents in all.
PER_LANGUAGE = 150
SAMPLE_MOST = 20_000
EPOCHS = 4
BATCH = 256
RATE = 0.01
#: Windows run side by side, and bytes gathered at once.
WIDE = 4096
BYTES = 4 << 20


def windows(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in windows of `steps`, padded with PAD, and each window's text; empty texts have none."""
    counts = np.array([-(-len(t) // steps) for t in texts], np.int64)
    out = np.full(int(counts.sum()) * steps, PAD, np.int16)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * steps
    return out.reshape(-1, steps), np.repeat(np.arange(len(texts)), counts)


class ByteGru:
    """Two gated recurrent layers, one for each direction, and a label at every position.

    h' = h + z (c - h), gate z = clip(a/4 + 1/2, 0, 1), candidate c = clip(b, -1, 1), where a
    and b are affine in the byte and in h. Padding shuts the gate.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        make = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        self.weights = {}
        for way in "fb":
            self.weights[f"E{way}"] = make(2 * hidden, 257, by=0.5)
            self.weights[f"U{way}"] = make(2 * hidden, hidden, by=0.3)
            self.weights[f"O{way}"] = make(len(labels), hidden, by=0.3)
        self.weights["bias"] = np.zeros((len(labels), 1), np.float32)

    def states(self, x: np.ndarray, way: str, keep: bool = False):
        """States after each step, in text order, for x of shape (steps, windows); keep: the gates and candidates too."""
        e, u, h = self.weights[f"E{way}"].copy(), self.weights[f"U{way}"], self.hidden
        e[:h, PAD] = -1e6
        steps, n = x.shape
        out = np.empty((steps, h, n), np.float32)
        inner = np.empty((steps, 2 * h, n), np.float32) if keep else None
        state = np.zeros((h, n), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = u @ state
            a += e.take(x[t], axis=1)
            if keep:
                inner[t] = a
            gate, new = a[:h], a[h:]
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            np.clip(new, -1, 1, out=new)
            new -= state
            new *= gate
            state = np.add(state, new, out=out[t])
        return (out, inner) if keep else out

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each window's positions of the labels' probabilities, and the number of positions."""
        x = np.ascontiguousarray(x.T)
        forth, back = self.states(x, "f"), self.states(x, "b")
        total = np.zeros((len(self.labels), x.shape[1]), np.float32)
        real = x != PAD
        for t in range(len(x)):
            p = self.weights["Of"] @ forth[t]
            p += self.weights["Ob"] @ back[t]
            p += self.weights["bias"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= real[t] / p.sum(axis=0)
            total += p
        return total, real.sum(axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        h = self.hidden
        x = np.ascontiguousarray(x.T)
        steps, n = x.shape
        real = (x != PAD).astype(np.float32)
        share = real / real.sum()
        kept = {way: self.states(x, way, keep=True) for way in "fb"}
        w = self.weights
        logits = np.einsum("lh,thn->tln", w["Of"], kept["f"][0]) + np.einsum("lh,thn->tln", w["Ob"], kept["b"][0]) + w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        hit = np.take_along_axis(p, np.broadcast_to(y, (steps, 1, n)), axis=1)[:, 0]
        loss = float((-np.log(hit + 1e-9) * share).sum())
        d = p
        np.put_along_axis(d, np.broadcast_to(y, (steps, 1, n)).copy(), (hit - 1)[:, None], axis=1)
        d *= share[:, None]
        grads = {"bias": d.sum(axis=(0, 2))[:, None]}
        for way in "fb":
            states, inner = kept[way]
            grads[f"O{way}"] = np.einsum("tln,thn->lh", d, states)
            de, du = np.zeros_like(w[f"E{way}"]), np.zeros_like(w[f"U{way}"])
            carry = np.zeros((h, n), np.float32)
            order = range(steps - 1, -1, -1) if way == "f" else range(steps)
            for t in order:
                before = t - 1 if way == "f" else t + 1
                last = states[before] if 0 <= before < steps else np.zeros((h, n), np.float32)
                dh = carry + w[f"O{way}"].T @ d[t]
                a, b = 0.25 * inner[t, :h] + 0.5, inner[t, h:]
                z, c = np.clip(a, 0, 1), np.clip(b, -1, 1)
                da = dh * (c - last) * 0.25 * ((a > 0) & (a < 1))
                db = dh * z * ((b > -1) & (b < 1))
                both = np.concatenate([da, db])
                np.add.at(de.T, x[t], both.T)
                du += both @ last.T
                carry = dh * (1 - z) + w[f"U{way}"].T @ both
            grads[f"E{way}"], grads[f"U{way}"] = de, du
        return loss, grads

    def train(self, texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over windows of the texts; returns each epoch's mean loss."""
        x, of = windows(texts)
        y = np.array([self.labels.index(v) for v in labels], np.int64)[of]
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order, each = rng.permutation(len(x)), []
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                loss, grads = self.gradients(x[part], y[part])
                each.append(loss)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(each)) if each else 0.0)
        return losses

    def predict(self, texts: list[bytes]) -> tuple[list[str | None], list[float]]:
        """The label of the highest mean probability over a text's positions, and that mean; None for empty texts."""
        total, count = np.zeros((len(texts), len(self.labels)), np.float64), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= BYTES):
                size += len(texts[to])
                to += 1
            x, of = windows(texts[at:to])
            for b in range(0, len(x), WIDE):
                p, n = self.probabilities(x[b : b + WIDE])
                np.add.at(total, of[b : b + WIDE] + at, p.T)
                np.add.at(count, of[b : b + WIDE] + at, n)
            at = to
        best = total.argmax(axis=1)
        score = np.minimum(1.0, total[np.arange(len(texts)), best] / np.maximum(count, 1))
        return [self.labels[b] if n else None for b, n in zip(best, count, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, count, strict=True)]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ByteGru | None:
    """Fits the network on a bounded sample of the labelled rows that aren't held out; None without any.

    Rows are drawn by a hash of their id at a rate that gives each language about per_language of them, SAMPLE_MOST rows at most.
    Their texts are learned from whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n)))), F.col("lang"))
    sample = rows.where(drawn < rate).select("lang", "text", F.xxhash64("id", "text").alias("by"))
    got = sample.orderBy("by", "lang", "text").limit(SAMPLE_MOST).collect()
    model = ByteGru(sorted(counts))
    model.train([r["text"].encode("utf-8") for r in got], [r["lang"] for r in got])
    return model


def identify(docs: DataFrame, model: ByteGru | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, as is all without a model.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in byte_values(batch.column(0))]
            letters = batch.column(1).to_pylist()
            at = [i for i, has in enumerate(letters) if has and told.value is not None]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if at:
                for i, v, s in zip(at, *told.value.predict([texts[i] for i in at]), strict=True):
                    lang[i], score[i] = v, s
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(F.col(text_col).cast("string").alias("_loam_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_loam_letter"), *keep)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Repeated rows are each predicted; other columns are ignored; an empty table gives no rows.
    """
    model = train_model(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, "text", ("doc_id", "held_out"))
