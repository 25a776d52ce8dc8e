"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``STEPS`` bytes in both directions; a byte's input
to the gates is its row of a table. A linear layer on both states labels every
position with a probability for each language. It is trained in numpy by
backpropagation through time (Adam, cross-entropy at every position) on windows
of a bounded sample of labelled texts. A document's probabilities are the mean
over all its positions; whole texts are read, window after window, many windows
of many documents at a time.

Nulls and edge cases: texts that are null or have no letter are ``und`` with
score 0; without labelled texts every text is. Ties go to the language that
sorts first. Repeated rows fare alike; of labelled rows that share a doc_id and
a language the smallest text is learned from, and texts of more than
``LONGEST`` bytes are not learned from, but read. An empty table gives no rows.
The input's columns come back in the struct ``document``, so names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.hashing import slices
from tallyspark.llm.shared import bounded_sample

UNITS = 6
STEPS = 64
SAMPLE = 250  #: labelled texts of each language that the network is trained on, at most
LONGEST = 1 << 20  #: bytes of a text that the network is trained on
ROUNDS, ROWS = 240, 128
LANES = 1024  #: windows that are read side by side
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    table: np.ndarray  #: (2, 256, 3 units): update, reset and candidate input of each byte, forwards and backwards
    turn: np.ndarray  #: (2, units, 3 units)
    out: np.ndarray  #: (2 units, languages)
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.out, self.bias]


def states(net: Network, windows: np.ndarray, way: int, keep: bool = False):
    """States (steps, units, rows) of one direction; with ``keep`` also what training needs.

    Rows are the last axis throughout, so that every operation runs over long rows of memory.
    """
    order = windows.T if way == 0 else windows.T[::-1]
    order = np.ascontiguousarray(order)
    u = net.turn.shape[1]
    h = np.zeros((u, windows.shape[0]), net.turn.dtype)
    out = np.empty((len(order), *h.shape), h.dtype)
    tape = []
    # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: halve the gates' inputs beforehand.
    scale = np.ones(3 * u, np.float32)
    scale[: 2 * u] = 0.5
    table, turn = np.ascontiguousarray((net.table[way] * scale).T), np.ascontiguousarray((net.turn[way] * scale).T)
    for t, column in enumerate(order):
        x = np.take(table, column, axis=1)
        w = turn @ h
        gates = x[: 2 * u]
        gates += w[: 2 * u]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:u], gates[u:]
        n = x[2 * u :]
        n += r * w[2 * u :]
        np.tanh(n, out=n)
        if keep:
            tape.append((h, z, r, n, w[2 * u :]))
        new = h - n
        new *= z
        new += n
        out[t] = h = new
    return (out if way == 0 else out[::-1]), tape


def label(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities (steps, languages, rows) at every position."""
    u = net.turn.shape[1]
    weights = np.ascontiguousarray(net.out.T)
    e = weights[:, :u] @ states(net, windows, 0)[0]
    e += weights[:, u:] @ states(net, windows, 1)[0]
    e += net.bias[:, None]
    e -= e.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(axis=1, keepdims=True)
    return e


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss, and its gradient by backpropagation through time."""
    u = net.turn.shape[1]
    kept = [states(net, windows, way, keep=True) for way in (0, 1)]
    both = np.concatenate([k[0] for k in kept], axis=1)
    e = net.out.T @ both + net.bias[:, None]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    d = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(truth))
    loss = float(-np.log(d[:, truth, rows] + 1e-9).mean())
    d[:, truth, rows] -= 1
    d /= d.shape[0] * d.shape[2]
    d_out = np.einsum("tub,tlb->ul", both, d)
    d_bias = d.sum(axis=(0, 2))
    d_both = net.out @ d
    d_table, d_turn = np.zeros_like(net.table), np.zeros_like(net.turn)
    for way in (0, 1):
        order = windows.T if way == 0 else windows.T[::-1]
        back = d_both[:, :u] if way == 0 else d_both[::-1, u:]
        turn, dh = net.turn[way], np.zeros((u, len(truth)), net.turn.dtype)
        inputs = np.empty((len(order), 3 * u, len(truth)), np.float32)
        for t in range(len(order) - 1, -1, -1):
            h, z, r, n, wn = kept[way][1][t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * wn * r * (1 - r)
            inputs[t] = np.concatenate([dz, dr, dn])
            dw = np.concatenate([dz, dr, dn * r])
            d_turn[way] += h @ dw.T
            dh = dh * z + turn @ dw
        one_hot = (order.reshape(-1)[:, None] == np.arange(256)).astype(np.float32)
        d_table[way] = one_hot.T @ inputs.transpose(0, 2, 1).reshape(-1, 3 * u)
    return loss, [d_table, d_turn, d_out, d_bias]


def train(texts: list[bytes], languages: list[str], rounds: int = ROUNDS, units: int = UNITS, seed: int = 5) -> Network:
    """Fit to texts and their languages."""
    random = np.random.default_rng(seed)
    names = sorted(set(languages))
    net = Network(
        names,
        (random.standard_normal((2, 256, 3 * units)) * 0.3).astype(np.float32),
        (random.standard_normal((2, units, 3 * units)) / np.sqrt(units)).astype(np.float32),
        (random.standard_normal((2 * units, len(names))) * 0.3).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    by_language = [[t for t, l in zip(texts, languages, strict=True) if l == n and t] for n in names]
    by_language = [[np.frombuffer(t, np.uint8) for t in own] or [np.full(1, 32, np.uint8)] for own in by_language]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, rounds + 1):
        truth = random.integers(len(names), size=ROWS)
        windows = np.full((ROWS, STEPS), 32, np.uint8)
        for i, k in enumerate(truth):
            text = by_language[k][random.integers(len(by_language[k]))]
            start = random.integers(max(1, len(text) - STEPS + 1))
            cut = text[start : start + STEPS]
            windows[i, : len(cut)] = cut
        _, grads = gradients(net, windows, truth)
        rate = 0.02 * (1 - step / (rounds + 1)) + 0.001
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-sizes // STEPS)
    total = np.zeros((len(texts), len(net.languages)))
    owner = np.repeat(np.arange(len(texts)), count)
    # Texts side by side, each filled up to whole windows.
    data = np.frombuffer(b"".join(t + b" " * (-len(t) % STEPS) for t in texts), np.uint8).reshape(-1, STEPS)
    for start in range(0, len(data), LANES):
        own = owner[start : start + LANES]
        p = label(net, data[start : start + LANES])
        last = np.append(own[1:] != own[:-1], start + LANES >= len(data) or owner[start + LANES] != own[-1])
        full = np.where(last, (sizes[own] - 1) % STEPS + 1, STEPS)
        for k in np.flatnonzero(full < STEPS):  # what was filled up has no say
            p[full[k] :, :, k] = 0
        np.add.at(total, own, p.sum(axis=0).T.astype(np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def fit_language(documents: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on at most ``sample`` texts of each language (documents: doc_id, text, lang)."""
    known = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    chosen = bounded_sample(known.select("doc_id", "lang"), "doc_id", ["lang"], sample)
    # A bounded number of ids is broadcast; texts are not shuffled.
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).where("text IS NOT NULL")
    # One text for each id and language, however often the table repeats them: what reaches the driver is bounded.
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "lang"])
    rows = rows[[LETTER.search(t) is not None for t in rows["text"]]]
    return train([t.encode() for t in rows["text"]], list(rows["lang"])) if len(rows) else None


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """document (struct of all input columns), lang_pred and score of each row."""
    rows = documents.select(F.struct("*").alias("document"), "text")
    schema = T.StructType([rows.schema["document"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            letters = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            held: list[int] = []
            size = 0
            for k, i in enumerate(letters):
                held.append(i)
                size += len(texts[i])
                if size >= 1 << 20 or k == len(letters) - 1:
                    p = pooled(net, [texts[j].encode() for j in held])
                    for j, best, row in zip(held, p.argmax(axis=1).tolist(), p, strict=True):
                        names[j], scores[j] = net.languages[best], float(min(1.0, row[best]))
                    held, size = [], 0
            yield pa.record_batch([batch["document"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["document", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)
