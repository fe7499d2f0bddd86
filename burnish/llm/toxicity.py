"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins a word embedding and the mean embedding of its character n-grams, so that unseen forms
of a known stem are known too. Texts are cut into overlapping windows; both directions run
over each window, attention weighs its words, and the document's score comes from its highest window.
Labels are of documents: after a round on all windows, of a toxic document only those windows count as
toxic that the network finds about as toxic as its best one.

The highest of many windows is high by chance alone. Highest windows of clean documents follow a Gumbel law whose
middle grows with the logarithm of the number of windows; a document's height is counted from there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import held_out
from burnish.sources.shared import forget, written

WINDOW, STRIDE = 32, 16
HIDDEN, INPUT, ATTENTION = 8, 12, 8
GRAMS = (3, 4, 5)
LEAST_DOCUMENTS = 8  # of the sample that hold a word or n-gram, for it to have a row; all others share row 0
SAMPLE = {1: 800, 0: 2000}  # documents learned from, by label, about; drawn by a hash of their id
CALIBRATED = 4  # every so-manieth sampled document fits the final scale, by all of its windows, instead of the network
SAMPLE_WINDOWS = 12  # of each of the others, evenly spaced
LOOSE_ROUNDS, STRICT_ROUNDS, BATCH, RATE, TABLE_RATE = 1, 4, 256, 0.01, 0.01
NEAR_BEST = 1.0  # windows of a toxic document that count as toxic: within so much of its best one
PREDICTED = 0.3
CACHED_WORDS = 150_000  # words whose gates a task keeps
CHUNK = 2048  # windows that run side by side
_SEPARATORS = bytes(32 if b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SEPARATORS).split() if text else []


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover ``n`` words to the last; one window for a short or empty text."""
    return [*range(0, max(n - WINDOW, 0), STRIDE), max(n - WINDOW, 0)]


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words with their ends marked, as numbers (their bytes and n), and the word of each, in order."""
    marked = [b"^" + w + b"$" for w in words]
    octets = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    keys, owners = [], []
    for n in GRAMS:
        many = max(0, len(octets) - n + 1)
        packed = np.full(many, n << 56, dtype=np.uint64)
        for k in range(n):
            packed |= octets[k : k + many] << np.uint64(8 * k)
        inside = owner[:many] == owner[n - 1 : n - 1 + many]
        keys.append(packed[inside])
        owners.append(owner[:many][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], owner[order]


def _frequent(documents: list[np.ndarray]) -> np.ndarray:
    """What stands in at least LEAST_DOCUMENTS of the documents, sorted."""
    found, counts = np.unique(np.concatenate([np.unique(d) for d in documents]), return_counts=True)
    return found[counts >= LEAST_DOCUMENTS]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights; ``scale``, ``shift`` and ``spread`` turn a document's highest window into a score."""

    weights: dict[str, np.ndarray]
    word_rows: dict[bytes, int]
    gram_keys: np.ndarray  # sorted; row i + 1 of the table is that of key i
    scale: float = 1.0
    shift: float = 0.0
    spread: float = 0.0  # of the heights of clean windows
    cache: dict[bytes, int] = field(default_factory=dict)  # word -> row of ``known``
    known: dict[str, np.ndarray] = field(default_factory=dict)  # the gates of cached words, by direction

    @classmethod
    def start(cls, documents: list[set[bytes]], seed: int = 7) -> Network:
        """Rows for the words and n-grams of ``documents`` and small random weights."""
        counts = Counter(w for d in documents for w in d)
        word_rows = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEAST_DOCUMENTS), 1)}
        filled = [_grams(sorted(d))[0] for d in documents if d]
        gram_keys = _frequent(filled) if filled else np.empty(0, dtype=np.uint64)
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        weights = {"words": normal(len(word_rows) + 1, INPUT, by=0.01), "grams": normal(len(gram_keys) + 1, INPUT, by=0.01)}
        for way in "fb":
            weights |= {
                f"W{way}": normal(INPUT, 3 * HIDDEN, by=INPUT**-0.5), f"U{way}": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
                f"c{way}": np.zeros(3 * HIDDEN, np.float32),
            }
        weights |= {"A": normal(2 * HIDDEN, ATTENTION, by=0.3), "a": normal(ATTENTION, by=0.3), "o": normal(2 * HIDDEN, by=0.3), "q": np.zeros(1, np.float32)}
        return cls(weights, word_rows, gram_keys)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, and the table rows they come from (word rows, n-gram rows, starts)."""
        word_rows = np.array([self.word_rows.get(w, 0) for w in words], dtype=np.int64)
        keys, owner = _grams(words)
        gram_rows = np.zeros(len(keys), dtype=np.int64)
        if len(self.gram_keys):
            at = np.minimum(np.searchsorted(self.gram_keys, keys), len(self.gram_keys) - 1)
            gram_rows = np.where(self.gram_keys[at] == keys, at + 1, 0)
        lengths = np.bincount(owner, minlength=len(words))
        starts = np.cumsum(lengths) - lengths
        means = np.add.reduceat(self.weights["grams"][gram_rows], starts, axis=0) / lengths[:, None]
        return (self.weights["words"][word_rows] + means).astype(np.float32), word_rows, gram_rows, lengths

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {way: inputs @ self.weights[f"W{way}"] + self.weights[f"c{way}"] for way in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (rows of ``gates``, -1 for none), and with ``keep`` what ``backward`` needs."""
        w, (n, steps) = self.weights, at.shape
        mask = (at >= 0).astype(np.float32)
        full = bool(mask.all())
        states = np.zeros((steps, n, 2 * HIDDEN), dtype=np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        for k, way in enumerate("fb"):
            own = gates[way]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                x, hu = own[at[:, t]], h @ w[f"U{way}"]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r, hc = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hc)
                new = c + z * (h - c)
                if not full:
                    new = np.where(mask[:, t : t + 1] > 0, new, h)
                if keep:
                    kept[way].append((t, h, z, r, c, hc))
                h = new
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        squashed = np.tanh(states @ w["A"])
        energy = np.where(mask.T > 0, squashed @ w["a"], -1e9)
        attention = np.exp(energy - energy.max(0))
        attention *= mask.T
        attention /= np.maximum(attention.sum(0), 1e-9)
        context = np.einsum("tn,tnh->nh", attention, states)
        logits = context @ w["o"] + w["q"][0]
        return (logits, (mask, states, squashed, attention, context, kept)) if keep else logits

    def backward(self, inputs: np.ndarray, at: np.ndarray, saved, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights but the tables, and of ``inputs``."""
        w, (mask, states, squashed, attention, context, kept) = self.weights, saved
        grads = {"o": context.T @ d_logits, "q": d_logits.sum(keepdims=True)}
        d_context = d_logits[:, None] * w["o"]
        d_attention = np.einsum("nh,tnh->tn", d_context, states)
        d_energy = attention * (d_attention - (attention * d_attention).sum(0))
        d_squashed = d_energy[:, :, None] * w["a"] * (1 - squashed**2)
        grads["a"] = np.einsum("tn,tna->a", d_energy, squashed)
        grads["A"] = np.einsum("tnh,tna->ha", states, d_squashed)
        d_states = attention[:, :, None] * d_context[None] + d_squashed @ w["A"].T
        d_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            d_u, d_gates = np.zeros_like(w[f"U{way}"]), np.zeros((len(inputs), 3 * HIDDEN), dtype=np.float32)
            d_h = np.zeros((at.shape[0], HIDDEN), dtype=np.float32)
            for t, h, z, r, c, hc in reversed(kept[way]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t : t + 1]
                d_new = d_h * m
                d_c = d_new * (1 - z) * (1 - c**2)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_hu = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_u += h.T @ d_hu
                np.add.at(d_gates, at[:, t], np.concatenate((d_z, d_r, d_c), axis=1))
                d_h = d_h * (1 - m) + d_new * z + d_hu @ w[f"U{way}"].T
            grads[f"U{way}"], grads[f"W{way}"], grads[f"c{way}"] = d_u, inputs.T @ d_gates, d_gates.sum(0)
            d_inputs += d_gates @ w[f"W{way}"].T
        return grads, d_inputs

    def highest(self, texts: list[list[bytes]]) -> np.ndarray:
        """The highest logit over all windows of each text."""
        best = np.full(len(texts), -np.inf)
        owners: list[int] = []
        spans: list[list[bytes]] = []

        def run() -> None:
            if spans:
                np.maximum.at(best, owners, self.logits(spans))
                owners.clear()
                spans.clear()

        for i, words in enumerate(texts):
            for start in window_starts(len(words)):
                owners.append(i)
                spans.append(words[start : start + WINDOW])
                if len(spans) == CHUNK:
                    run()
        run()
        return best

    def logits(self, spans: list[list[bytes]]) -> np.ndarray:
        words = {w for s in spans for w in s}
        if not self.known or len(self.cache) + len(words) > CACHED_WORDS:
            self.forget_words()
            self.known = {way: np.zeros((max(CACHED_WORDS, len(words)) + 1, 3 * HIDDEN), dtype=np.float32) for way in "fb"}
        new = list(words - self.cache.keys())
        if new:
            first = 1 + len(self.cache)
            self.cache.update(zip(new, range(first, first + len(new)), strict=True))
            for way, rows in self.gates(self.inputs(new)[0]).items():
                self.known[way][first : first + len(new)] = rows
        at, get = np.full((len(spans), WINDOW), -1, dtype=np.int64), self.cache.__getitem__
        for i, s in enumerate(spans):
            at[i, : len(s)] = list(map(get, s))
        return self.forward(self.known, at)

    def logits_of(self, spans: list[list[bytes]]) -> np.ndarray:
        """Logits of many windows with the weights as they are now."""
        self.forget_words()
        return np.concatenate([self.logits(spans[a : a + CHUNK]) for a in range(0, len(spans), CHUNK)])

    def forget_words(self) -> None:
        self.cache, self.known = {}, {}

    def score(self, highest: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * (highest - self.spread * np.log(windows)) + self.shift)


class _Optimiser:
    """Adam for the small weights; scaled steps on the touched rows of the tables."""

    def __init__(self) -> None:
        self.t, self.m, self.v = 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * g * g
            by = RATE * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
            weights[name] -= (by * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def step_rows(self, table: np.ndarray, name: str, rows: np.ndarray, d: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows, starts = np.unique(rows[order], return_index=True)
        g = np.add.reduceat(d[order], starts, axis=0)
        v = self.v.setdefault(name, np.zeros(len(table), dtype=np.float32))
        v[rows] += (g * g).mean(1)
        table[rows] -= TABLE_RATE * g / (np.sqrt(v[rows])[:, None] + 1e-6)


def _round(network: Network, optimiser: _Optimiser, spans: list[list[bytes]], labels: np.ndarray, draw: np.random.Generator) -> None:
    weight = np.where(labels == 1, min(4.0, max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum()))), 1.0)
    order = draw.permutation(len(spans))
    for a in range(0, len(order), BATCH):
        chosen = order[a : a + BATCH]
        words = sorted({w for i in chosen for w in spans[i]}) or [b"none"]
        place = {w: i for i, w in enumerate(words)}
        at = np.full((len(chosen), WINDOW), -1, dtype=np.int64)
        for k, i in enumerate(chosen):
            at[k, : len(spans[i])] = [place[w] for w in spans[i]]
        inputs, word_rows, gram_rows, lengths = network.inputs(words)
        logits, saved = network.forward(network.gates(inputs), at, keep=True)
        d_logits = ((_sigmoid(logits) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
        grads, d_inputs = network.backward(inputs, at, saved, d_logits)
        for name, rows, d in (("words", word_rows, d_inputs), ("grams", gram_rows, np.repeat(d_inputs / lengths[:, None], lengths, axis=0))):
            optimiser.step_rows(network.weights[name], name, rows, d)
        optimiser.step(network.weights, grads)


def gumbel_spread(highest: np.ndarray, windows: np.ndarray) -> float:
    """The most likely spread of window heights, from the highest of each document and its number of windows."""
    if len(highest) < 2:
        return 0.0
    best, found = -np.inf, 0.0
    top = highest.max()
    for rate in np.geomspace(0.1, 10, 100):
        mass = np.log(np.sum(windows * np.exp(-rate * (highest - top)))) - rate * top
        likely = np.log(rate) - rate * highest.mean() - mass
        if likely > best:
            best, found = likely, 1 / rate
    return float(found)


def calibrate(network: Network, heights: pd.DataFrame) -> None:
    """The spread of clean documents, then the scale and shift of least logarithmic loss on a grid.

    ``heights(toxic, highest, windows)`` has a row for each document, from all of its windows."""
    heights = heights.sort_values(["toxic", "windows", "highest"])
    labels, highest, windows = (heights[k].to_numpy(dtype=float) for k in ("toxic", "highest", "windows"))
    network.spread = gumbel_spread(highest[labels == 0], windows[labels == 0])
    height = highest - network.spread * np.log(windows)
    target, best = np.where(labels == 1, 0.98, 0.02), np.inf
    for scale in (0.3, 0.5, 0.7, 1.0, 1.5):
        for middle in np.linspace(-12, 8, 161):
            p = np.clip(_sigmoid(scale * (height - middle)), 1e-6, 1 - 1e-6)
            loss = -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()
            if loss < best:
                best, network.scale, network.shift = loss, scale, -scale * middle


def trained(rows: pd.DataFrame) -> Network:
    """A network from ``rows(doc_id, toxic, nth, words)``, a row for each sampled window of a document.

    Its scale is yet to be fitted, unless documents of both labels are wanting: then scores are a constant."""
    rows = rows.sort_values(["doc_id", "nth"])
    docs, owner = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    labels = rows["toxic"].to_numpy()
    spans = [w.encode().split() for w in rows["words"]]
    held: list[set[bytes]] = [set() for _ in docs]
    for nth, span in zip(owner, spans, strict=True):
        held[nth].update(span)
    network = Network.start(held)
    if len(docs) < 8 or not 0 < labels.mean() < 1:
        network.scale, network.shift = 0.0, -3.0 if not len(labels) or labels.mean() < 0.5 else 3.0
        return network
    draw, optimiser = np.random.default_rng(11), _Optimiser()
    rounds = min(6, max(1, round(4000 / len(spans))))  # more passes over very small samples
    for turn in range((LOOSE_ROUNDS + STRICT_ROUNDS) * rounds):
        use = np.arange(len(spans))
        if turn >= LOOSE_ROUNDS * rounds:
            logits = network.logits_of(spans)
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, owner, logits)
            use = np.flatnonzero((labels == 0) | (logits >= best[owner] - NEAR_BEST))
        _round(network, optimiser, [spans[i] for i in use], labels[use].astype(np.float32), draw)
    network.forget_words()
    return network


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for doc_id, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"], strict=True):
            words = tokens(text)
            starts = window_starts(len(words))
            for nth in np.unique(np.linspace(0, len(starts) - 1, min(SAMPLE_WINDOWS, len(starts))).astype(int)):
                part = words[starts[nth] : starts[nth] + WINDOW]
                found.append((doc_id, int(toxic), int(nth), b" ".join(part).decode()))
        yield pd.DataFrame(found, columns=["doc_id", "toxic", "nth", "words"])


def _heights(network: Network):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [tokens(t) for t in batch["text"]]
            windows = [len(window_starts(len(w))) for w in words]
            yield pd.DataFrame({"toxic": batch["toxic"], "highest": network.highest(words), "windows": windows})

    return rows


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """The network from a bounded sample of labelled documents that are not held out.

    The texts of about 2,800 documents (SAMPLE) go to the shared folder. Collected are windows of WINDOW words,
    SAMPLE_WINDOWS of a document at most, and the heights of the spare documents, which the executors compute over
    all of their windows. If the spare ones have not both labels, all of the sample fit the scale.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = [SAMPLE[k] / max(1, counts.get(k, 0)) * (1 << 31) for k in (0, 1)]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 31))
    drawn = known.withColumn("spare", draw % CALIBRATED == 0).where(draw < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]))
    # About sum(SAMPLE) ids at any size of the input, so they are broadcast and no text is shuffled.
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    sample = written(sample, "toxicity-sample")
    fits = sample.where(~F.col("spare")).mapInPandas(_sampled, "doc_id long, toxic int, nth int, words string")
    network = trained(fits.toPandas())
    if network.scale:
        spare = sample.where("spare")
        both = spare.select("toxic").distinct().count() == 2
        calibrate(network, (spare if both else sample).mapInPandas(_heights(network), "toxic int, highest double, windows long").toPandas())
    forget(sample)
    return network


def _scored(network: Network):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.iloc[a : a + 512]
                words = [tokens(t) for t in part["text"]]
                windows = np.array([len(window_starts(len(w))) for w in words], dtype=float)
                score = network.score(network.highest(words).astype(float), windows)
                yield part[["doc_id", "held_out"]].assign(score=score, predicted=(score >= PREDICTED).astype(np.int32))

    return rows


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text, ...)``.

    ``labels`` has doc_id and toxic (0 or 1; other values and null ids are not learned from). Null and empty
    texts are one empty window. Without documents of both labels the score is a constant. Rows that repeat an
    id are scored each, further columns are ignored, an empty table gives no rows.
    """
    ids = F.col("doc_id").cast("string").alias("doc_id")  # pandas has no long beside nulls
    rows = docs.select(ids, "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInPandas(_scored(learn(docs, labels)), "doc_id string, held_out boolean, score double, predicted int")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
