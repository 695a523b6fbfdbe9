"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read whole, in windows of ``WINDOW`` bytes. Two gated recurrent units run over each window, one from either end; from
their states every position gets class probabilities and a label, and a document's probabilities are the mean over all its
positions. The network is trained in numpy by backpropagation through time, on the driver, from windows of at most
``DOCS_PER_LANG`` labelled documents per language (the smallest by a hash of doc_id) and ``WINDOWS_PER_DOC`` windows of each, at places over the whole text.

A document is held out of training if crc32(doc_id as text) mod 4 is 2. Null texts and texts without a letter are ``und`` with score 0, and so is all if
nothing can be learnt from. Rows without a doc_id are neither held out nor trained on. Repeated rows are predicted each, and
learnt from once: of rows that share an id and a language the smallest text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bytetext import column_bytes
from corpusloom.llm.runtime import ship, trim

WINDOW = 64
HIDDEN = 8
DOCS_PER_LANG, WINDOWS_PER_DOC = 250, 12
STEPS, BATCH, RATE, SEED = 260, 192, 0.02, 7
#: Windows that run in step with each other.
LANES = 2048
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, label_share double"
Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start_weights(classes: int, seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    w: Weights = {}
    for side in "fb":
        w[f"e{side}"] = rng.normal(0, 0.5, (3 * h, 256))
        w[f"u{side}"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h))
        w[f"o{side}"] = rng.normal(0, 1 / np.sqrt(h), (classes, h))
    w["c"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _states(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each of the steps of x (steps, lanes), and what the way back needs."""
    n = HIDDEN
    h = np.zeros((n, x.shape[1]), np.float32)
    out, trace = np.empty((len(x), *h.shape), np.float32), []
    for t, byte in enumerate(x):
        i, a = e[:, byte], u @ h
        z, r = _sigmoid(i[:n] + a[:n]), _sigmoid(i[n : 2 * n] + a[n : 2 * n])
        m = np.tanh(i[2 * n :] + r * a[2 * n :])
        trace.append((h, z, r, m, a[2 * n :]))
        h = m + z * (h - m)
        out[t] = h
    return out, trace


def _back(e: np.ndarray, u: np.ndarray, x: np.ndarray, trace: list[tuple], grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of e and u, through time."""
    n = HIDDEN
    de, du = np.zeros_like(e), np.zeros_like(u)
    carry = np.zeros(grad.shape[1:], np.float32)
    hot = np.arange(256)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, m, am = trace[t]
        d = carry + grad[t]
        dm = d * (1 - z) * (1 - m * m)
        dz = d * (h - m) * z * (1 - z)
        dr = dm * am * r * (1 - r)
        into_u = np.concatenate([dz, dr, dm * r])
        du += into_u @ h.T
        de += np.concatenate([dz, dr, dm]) @ (x[t][:, None] == hot).astype(np.float32)
        carry = d * z + u.T @ into_u
    return de, du


def _probabilities(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int) -> Weights:
    """Adam on the cross-entropy of every position's label. windows: (rows, WINDOW) bytes, zero after lengths."""
    w = start_weights(classes)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(SEED)
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(c, max(1, BATCH // classes)) for c in by_class])
        x, y = windows[rows].T, labels[rows]
        weight = (np.arange(WINDOW)[:, None] < lengths[rows]).astype(np.float32)[:, None, :]
        hf, tf = _states(w["ef"], w["uf"], x)
        hb, tb = _states(w["eb"], w["ub"], x[::-1])
        p = _probabilities(w["of"] @ hf + w["ob"] @ hb[::-1] + w["c"])
        p[:, y, np.arange(len(y))] -= 1
        p *= weight / weight.sum()
        g: Weights = {"of": np.einsum("tkl,thl->kh", p, hf), "ob": np.einsum("tkl,thl->kh", p, hb[::-1]), "c": p.sum(axis=(0, 2))[:, None]}
        g["ef"], g["uf"] = _back(w["ef"], w["uf"], x, tf, w["of"].T @ p)
        g["eb"], g["ub"] = _back(w["eb"], w["ub"], x[::-1], tb, (w["ob"].T @ p)[::-1])
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in g.items():
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.01 * (d * d - second[k])
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


class Network:
    """The trained network at work: buffers of fixed size, gates as hyperbolic tangents with halved weights."""

    def __init__(self, w: Weights) -> None:
        n = HIDDEN
        half = np.ones((3 * n, 1), np.float32)
        half[: 2 * n] = 0.5
        self.e = [np.ascontiguousarray(w[k] * half, np.float32) for k in ("ef", "eb")]
        self.u = [np.ascontiguousarray(w[k] * half, np.float32) for k in ("uf", "ub")]
        self.o = np.ascontiguousarray(np.concatenate([w["of"], w["ob"]], axis=1), np.float32)
        self.c = w["c"].astype(np.float32)
        self.classes = len(self.c)

    def run(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the positions of each lane of x (WINDOW, lanes): probabilities and labels, both (classes, lanes)."""
        n, lanes = HIDDEN, x.shape[1]
        x = x.astype(np.intp)
        states = np.empty((WINDOW, 2 * n, lanes), np.float32)
        i, a = np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        for side, steps in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
            e, u, h = self.e[side], self.u[side], np.zeros((n, lanes), np.float32)
            for t in steps:
                np.take(e, x[t], axis=1, out=i, mode="clip")
                np.dot(u, h, out=a)
                gates, m = a[: 2 * n], a[2 * n :]
                gates += i[: 2 * n]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                m *= gates[n:]
                m += i[2 * n :]
                np.tanh(m, out=m)
                h -= m
                h *= gates[:n]
                h += m
                states[t, side * n : side * n + n] = h
        chance, labels = np.zeros((self.classes, lanes)), np.zeros((self.classes, lanes))
        short = bool((lengths < WINDOW).any())
        for t in range(WINDOW):
            p = self.o @ states[t]
            p += self.c
            p -= p.max(axis=0)
            np.exp(p, out=p)
            top = p == 1
            p /= p.sum(axis=0)
            if short:
                live = lengths > t
                p *= live
                top &= live
            chance += p
            labels += top
        return chance, labels

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities and shares of labels, (rows, classes)."""
        size = np.diff(offsets)
        n = np.maximum(1, -(-size // WINDOW))
        row = np.repeat(np.arange(len(size)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][row] + place * WINDOW
        length = np.minimum(WINDOW, offsets[1:][row] - at)
        padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
        chance, labels = np.zeros((len(size), self.classes)), np.zeros((len(size), self.classes))
        inside = np.arange(WINDOW)[:, None]
        for a in range(0, len(row), LANES):
            lanes = slice(a, a + LANES)
            x = padded[at[lanes] + inside]
            if (length[lanes] < WINDOW).any():
                x[inside >= length[lanes]] = 0
            p, q = self.run(x, length[lanes])
            np.add.at(chance, row[lanes], p.T)
            np.add.at(labels, row[lanes], q.T)
        total = np.maximum(size, 1)[:, None]
        return chance / total, labels / total


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offs = column_bytes(b.column(1))
        out: dict[str, list] = {"lang": [], "at": [], "doc_id": [], "bytes": []}
        for i, (doc_id, lang) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            text = raw[offs[i] : offs[i + 1]]
            last = max(0, len(text) - WINDOW)
            for k in sorted({last * j // max(1, WINDOWS_PER_DOC - 1) for j in range(WINDOWS_PER_DOC)}):
                out["lang"].append(lang)
                out["at"].append(k)
                out["doc_id"].append(doc_id)
                out["bytes"].append(text[k : k + WINDOW].tobytes())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "doc_id": pa.array(out["doc_id"], pa.int64()), "at": pa.array(out["at"], pa.int64()), "bytes": pa.array(out["bytes"], pa.binary())})


def learn(docs: DataFrame) -> tuple[list[str], Weights | None]:
    """Languages and weights from docs(doc_id, text, lang)."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    # Rows that share an id and a language share a seat.
    ranked = usable.select("doc_id", "lang", F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("seat")).where(F.col("seat") <= DOCS_PER_LANG)
    # At most DOCS_PER_LANG rows for each language.
    chosen = ranked.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    met = usable.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")))
    text = met.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    rows = text.mapInArrow(_windows, "lang string, doc_id long, at long, bytes binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("at", "ascending")])
    if not rows.num_rows:
        return [], None
    langs = sorted(set(rows["lang"].to_pylist()))
    at = {k: i for i, k in enumerate(langs)}
    pieces = rows["bytes"].to_pylist()
    windows = np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in pieces), np.uint8).reshape(-1, WINDOW)
    return langs, train(windows, np.array([len(p) for p in pieces]), np.array([at[x] for x in rows["lang"].to_pylist()]), len(langs))


def _judged(net: Network, langs: list[str], text: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Language, score and share of labels of each text."""
    raw, offs = column_bytes(text)
    chance, labels = net.documents(raw, offs)
    best = chance.argmax(axis=1)
    said, score, share = [], [], []
    for i, t in enumerate(text.to_pylist()):
        known = t is not None and any(map(str.isalpha, t))
        said.append(langs[best[i]] if known else UNKNOWN)
        score.append(min(1.0, float(chance[i, best[i]])) if known else 0.0)
        share.append(float(labels[i, best[i]]) if known else 0.0)
    return said, score, share


def _predict(langs: list[str], weights: Weights) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for b in batches:
            said, score, share = _judged(net, langs, b.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": said, "score": pa.array(score, pa.float64()), "label_share": pa.array(share, pa.float64())})
        trim()

    return run


def _confident(langs: list[str], weights: Weights, text: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for b in batches:
            said, score, _ = _judged(net, langs, b.column(text))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(said, score, strict=True)], pa.bool_()))
        trim()

    return run


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, label_share of docs(doc_id, text, lang); label_share is the part of positions labelled as predicted."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    langs, weights = learn(source)
    if weights is None:
        return source.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("label_share"))
    return source.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_predict(langs, weights), RESULT)


def confident(spark: SparkSession, docs: DataFrame, lift: float = 1.2) -> DataFrame:
    """The rows of docs, all its columns, whose language is known: a text with a letter, of which the best of n languages is ``lift`` times as probable as a guess of 1 / n.

    Decided row by row where the text is read, so rows without an id or with equal ids do not matter. With one language only texts without a letter go; where there is
    nothing to learn from, all do.
    """
    ship(spark)
    langs, weights = learn(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    if weights is None:
        return docs.where(F.lit(False))
    least = lift / len(langs) if len(langs) > 1 else 0.0
    return docs.mapInArrow(_confident(langs, weights, docs.columns.index("text"), least), docs.schema)
