"""Language identification: a bidirectional gated recurrent network over bytes, trained here by backpropagation
through time.

The network reads a text's UTF-8 bytes in windows of BODY bytes with MARGIN bytes of context on either side, forwards
and backwards, and labels every byte of the body; a document's probabilities are the mean over all its labelled bytes.
Windows of many documents run side by side, so a text of any length is a number of rows and not a long loop.

White space, digits and ASCII punctuation say nothing about the language: their labels don't count towards the pool.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

BODY, MARGIN = 96, 8
#: Rows that run side by side.
ROWS = 2048

_COUNTS = np.ones(256, dtype=np.float32)
_COUNTS[:128] = 0
_COUNTS[65:91] = _COUNTS[97:123] = 1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by tanh, which doesn't overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class BiGru:
    """Weights: for each direction an input row for every byte, recurrent weights of the gates and of the candidate;
    then the output layer.  Columns of the gates: update, reset."""

    labels: list[str]
    inputs: list[np.ndarray]  # 2 x (256, 3h)
    gates: list[np.ndarray]  # 2 x (h, 2h)
    news: list[np.ndarray]  # 2 x (h, h)
    out: np.ndarray  # (2h, labels)
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> BiGru:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if shape[0] != 256 else 4)).astype(np.float32)
        return cls(labels, [draw(256, 3 * hidden) for _ in "fb"], [draw(hidden, 2 * hidden) for _ in "fb"], [draw(hidden, hidden) for _ in "fb"], draw(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))

    @property
    def hidden(self) -> int:
        return self.news[0].shape[0]

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.news, self.out, self.bias]

    def run(self, x: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, h) over x (steps, rows), in the order in which the direction reads."""
        h, w, u, v = self.hidden, self.inputs[direction], self.gates[direction], self.news[direction]
        states = np.zeros((len(x) + 1, x.shape[1], h), np.float32)
        for t, now in enumerate(x):
            state = states[t]
            a = np.take(w, now, axis=0)
            zr = a[:, : 2 * h]
            zr += state @ u
            zr = sigmoid(np.ascontiguousarray(zr))
            z, r = zr[:, :h], zr[:, h:]
            gated = r * state
            new = a[:, 2 * h :] + gated @ v
            np.tanh(new, out=new)
            states[t + 1] = new
            states[t + 1] += z * (state - new)
            if keep is not None:
                keep.append((z.copy(), r.copy(), new, gated))
        return states

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, labels) over x (steps, rows)."""
        forward = self.run(x, 0)[1:]
        backward = self.run(x[::-1], 1)[1:][::-1]
        h = self.hidden
        return forward @ self.out[:h] + backward @ self.out[h:] + self.bias

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of the counted positions and its gradients, by backpropagation through time."""
        h = self.hidden
        kept: list[list] = [[], []]
        states = [self.run(x, 0, kept[0]), self.run(x[::-1], 1, kept[1])]
        both = np.concatenate([states[0][1:], states[1][1:][::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = max(weight.sum(), 1.0)
        steps, rows = x.shape
        right = p[:, np.arange(rows), y]
        loss = float(-(np.log(right + 1e-9) * weight).sum() / total)
        p[:, np.arange(rows), y] -= 1
        p *= (weight / total)[:, :, None]
        flat = p.reshape(-1, p.shape[2])
        out = [np.zeros_like(w) for w in self.inputs], [np.zeros_like(w) for w in self.gates], [np.zeros_like(w) for w in self.news]
        d_out, d_bias = both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        d_both = p @ self.out.T
        for d in (0, 1):
            order = x if d == 0 else x[::-1]
            d_states = d_both[:, :, :h] if d == 0 else d_both[::-1, :, h:]
            carry = np.zeros((rows, h), np.float32)
            for t in range(steps - 1, -1, -1):
                z, r, new, gated = kept[d][t]
                state = states[d][t]
                g = d_states[t] + carry
                d_new = g * (1 - z) * (1 - new * new)
                d_gated = d_new @ self.news[d].T
                d_z = g * (state - new) * z * (1 - z)
                d_r = d_gated * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                carry = g * z + d_gated * r + d_zr @ self.gates[d].T
                out[2][d] += gated.T @ d_new
                out[1][d] += state.T @ d_zr
                full = np.concatenate([d_zr, d_new], axis=1)
                hot = np.zeros((256, rows), np.float32)
                hot[order[t], np.arange(rows)] = 1
                out[0][d] += hot @ full
        return loss, [*out[0], *out[1], *out[2], d_out, d_bias]


def train(texts: list[str], langs: list[str], hidden: int = 12, steps: int = 220, rows: int = 96, length: int = 64, rate: float = 0.02, seed: int = 1) -> BiGru:
    """Fit by Adam on random windows; languages are drawn alike, however rare.  Texts without letters are left out."""
    pairs = [(t.encode("utf-8"), lang) for t, lang in zip(texts, langs) if lang is not None and t and has_letter(t)]
    labels = sorted({lang for _, lang in pairs})
    model = BiGru.fresh(labels, hidden, seed)
    if len(labels) < 2:
        return model
    of = {lang: [t for t, own in pairs if own == lang] for lang in labels}
    rng = np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in model.parameters()]
    v = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        x = np.full((rows, length), 32, np.uint8)
        y = rng.integers(0, len(labels), rows)
        for i in range(rows):
            t = of[labels[y[i]]][rng.integers(len(of[labels[y[i]]]))]
            at = int(rng.integers(max(1, len(t) - length + 1)))
            part = np.frombuffer(t[at : at + length], np.uint8)
            x[i, : len(part)] = part
        x = np.ascontiguousarray(x.T)
        _, grads = model.gradients(x, y, _COUNTS[x])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(model.parameters(), grads, m, v):
            g = g * scale
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def label_positions(model: BiGru, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the label of every byte, and the pooled probabilities (texts, labels); zero if nothing counts."""
    n = len(model.labels)
    sums, counted = np.zeros((len(texts), n)), np.zeros(len(texts))
    kind = np.uint8 if n <= 256 else np.int32
    found = [np.zeros(len(t), kind) for t in texts]
    raw = np.frombuffer(b" " * MARGIN + (b" " * MARGIN).join(texts) + b" " * (BODY + MARGIN), np.uint8)
    begins = MARGIN + np.concatenate([[0], np.cumsum([len(t) + MARGIN for t in texts])])[:-1]
    blocks = np.array([-(-len(t) // BODY) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), blocks)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BODY
    ends = begins + np.array([len(t) for t in texts], dtype=np.int64)
    for at in range(0, len(owner), ROWS):
        own = owner[at : at + ROWS]
        start = begins[own] + inside[at : at + ROWS]
        places = start[None, :] + np.arange(-MARGIN, BODY + MARGIN)[:, None]
        outside = (places < begins[own]) | (places >= ends[own])
        x = raw[np.minimum(places, len(raw) - 1)]
        x[outside] = 32
        body = slice(MARGIN, MARGIN + BODY)
        logits = model.logits(x)[body]
        logits -= logits.max(axis=2, keepdims=True)
        best = logits.argmax(axis=2).astype(kind)
        np.exp(logits, out=logits)
        logits *= (_COUNTS[x[body]] * ~outside[body] / logits.sum(axis=2))[:, :, None]
        np.add.at(sums, own, logits.sum(axis=0))
        np.add.at(counted, own, (_COUNTS[x[body]] * ~outside[body]).sum(axis=0))
        for j, (doc, offset) in enumerate(zip(own.tolist(), inside[at : at + ROWS].tolist())):
            part = found[doc][offset : offset + BODY]
            part[:] = best[: len(part), j]
    return found, sums / np.maximum(counted, 1)[:, None]


def fit(docs: DataFrame, most_per_label: int = 300, most_chars: int = 2000, most_labels: int = 256, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", **options) -> BiGru:
    """A model of a bounded sample: of each of the `most_labels` most frequent languages (ties by name) the
    `most_per_label` distinct rows (id, text) with the smallest hash, and of their texts `most_chars` characters from the
    middle.  Rows with a null text or language are not learned from.  Ids may be null or repeated: it is rows with
    different hashes of (id, text) that count, so a language has a sample however its ids are made."""
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    own = own.select("lang", F.xxhash64("id", "text").alias("h"), F.expr(f"substring(text, greatest(1, int((length(text) - {most_chars}) / 2)), {most_chars})").alias("text"))
    # The hash is uniform over different rows, so a bound on it keeps about as many of these as are wanted, and twice.
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("different"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels)
    share = F.least(F.lit(1.0), F.lit(2.0 * most_per_label + 20) / F.col("different"))
    # At most `most_labels` rows: broadcast, so that no language's rows are brought together before the bound.
    likely = own.join(F.broadcast(counts), "lang").where(F.col("h") <= -(2.0**63) + share * 2.0**64).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = sorted(likely.withColumn("place", place).where(F.col("place") <= most_per_label).select("lang", "place", "text").collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def judge(model: BiGru, texts: list[str]) -> tuple[list[str], list[float], list[np.ndarray]]:
    """Language, score and byte labels of each text."""
    if not model.labels:
        return ["und"] * len(texts), [0.0] * len(texts), [np.zeros(0, np.uint8)] * len(texts)
    found, p = label_positions(model, [t.encode("utf-8") for t in texts])
    best, score = p.argmax(axis=1), p.max(axis=1)
    known = [bool(s > 0 and has_letter(t)) for t, s in zip(texts, score)]
    return [model.labels[b] if k else "und" for b, k in zip(best, known)], [min(1.0, float(s)) if k else 0.0 for s, k in zip(score, known)], found


def accepted(docs: DataFrame, model: BiGru, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of at least `least`."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: BiGru = pickle.loads(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                preds, scores, _ = judge(own, [t or "" for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array([p != "und" and s >= least for p, s in zip(preds, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: BiGru, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score; with spans also the runs of equally labelled bytes (lang, start, end).

    Predictions use the text alone.  `und` with score 0 stands for a null text, one without a letter or one whose letters
    the model can't count.  Rows are independent: repeated rows give repeated results, an empty table an empty result.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size is fixed by the layers' widths
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang:string,start:int,end:int>>" if spans else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: BiGru = pickle.loads(packed.value)
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                preds, scores, found = judge(own, part["text"].tolist())
                out = {"doc_id": part["doc_id"].to_numpy(), "lang_pred": preds, "score": scores}
                if spans:
                    out["spans"] = []
                    for f in found:
                        cuts = np.flatnonzero(np.diff(f)) + 1
                        edges = [0, *cuts.tolist(), len(f)] if len(f) else [0]
                        out["spans"].append([{"lang": own.labels[f[a]], "start": a, "end": b} for a, b in zip(edges, edges[1:])])
                yield pd.DataFrame(out)

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document's hash puts it into the quarter that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of those that aren't held out."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
