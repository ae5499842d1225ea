"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector beside the mean vector of the character runs that begin or
end it, and the strongest association of such a run with the label; gated units read a
window of words in both directions, attention pools their states, and a logistic unit
scores the window. A text's score is its worst window's, over all overlapping windows.
Trained in numpy on a bounded sample; only a text's label is known, so each round learns
from the windows that the network finds worst, beside some drawn at random.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, kept, map_rows, small_batches

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 48, 32
#: The most bytes of a label's texts to learn from.
SAMPLE_BYTES = 64_000_000
#: Texts of each label to learn from, about; rounds; sizes of word and character vectors, of a state and of attention.
SAMPLE, ROUNDS, WORD_DIM, CHAR_DIM, STATE, ATTENTION = 700, 6, 10, 6, 8, 8
#: Lengths of the character runs that begin and that end a longer word.
HEADS, TAILS = range(3, 9), range(3, 7)
#: Texts that must hold a word or a run to give it a vector; one text in so many is kept to choose the round and the bias.
SEEN, APART = 6, 4
#: Share of label 1 at which errors are weighed for that choice.
WEIGHED = 0.25
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def word_list(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def runs(word: str) -> list[str]:
    """The character runs that begin or end a word, shorter than the word itself."""
    n = len(word)
    return [word[:k] + "*" for k in HEADS if k < n] + ["*" + word[-k:] for k in TAILS if k < n]


def association(with_label: np.ndarray, without: np.ndarray, n: list[int]) -> np.ndarray:
    """How far the share of texts that hold a thing differs between the labels, in standard
    errors, a quarter of it, from -2 to 2. n: texts of label 0 and 1."""
    p = (with_label + without + 1) / (n[0] + n[1] + 2)
    z = (with_label / n[1] - without / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    return np.clip(z / 4, -2, 2).astype(np.float32)


def windows(n: int) -> list[int]:
    """Starts of the windows that cover n words."""
    return list(range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)) if n else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters are float32 arrays in ``p``; axis 0 of the recurrent ones is the direction."""

    def __init__(self, words: dict[str, int], chars: dict[str, int], p: dict[str, np.ndarray], ties: np.ndarray, base: float):
        self.words, self.chars, self.p, self.ties, self.base = words, chars, p, ties, base

    @classmethod
    def new(cls, words: dict[str, int], chars: dict[str, int], odds: np.ndarray, ties: np.ndarray, base: float) -> Network:
        rng = np.random.default_rng(7)
        rand = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        d = WORD_DIM + CHAR_DIM + 1
        p = {"word": rand(len(words) + 1, WORD_DIM) * 0.3, "char": rand(len(chars) + 1, CHAR_DIM) * 0.3, "wx": rand(2, d, 3 * STATE), "b": np.zeros((2, 1, 3 * STATE), np.float32), "u": rand(2, STATE, 3 * STATE), "a": rand(2 * STATE, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": rand(ATTENTION), "o": rand(2 * STATE), "ob": np.zeros(1, np.float32)}
        p["word"][0] = p["char"][0] = 0
        p["word"][1:, 0] = odds
        return cls(words, chars, p, np.append(np.float32(0), ties), base)

    def char_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known character runs of all words, word of each, 1 / number of them for each word)."""
        get = self.chars.get
        found = [[i for r in runs(w) if (i := get(r))] or [0] for w in words]
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(n.sum())), np.repeat(np.arange(len(words)), n), (1 / np.maximum(n, 1)).astype(np.float32)

    def inputs(self, words: list[str]) -> np.ndarray:
        """The input vectors of words."""
        if not words:
            return np.zeros((0, WORD_DIM + CHAR_DIM + 1), np.float32)
        ids, of, scale = self.char_rows(words)
        mean = np.stack([np.bincount(of, self.p["char"][ids, k], len(words)) for k in range(CHAR_DIM)], axis=1).astype(np.float32) * scale[:, None]
        tie = np.maximum.reduceat(self.ties[ids], np.flatnonzero(np.diff(of, prepend=-1)))
        own = self.p["word"][np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))]
        return np.concatenate([own, mean, tie[:, None]], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        """Input parts of the gates, (words, 2, 3 x STATE)."""
        return (np.matmul(self.inputs(words)[None], self.p["wx"]) + self.p["b"]).transpose(1, 0, 2).copy()

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: (WINDOW, 2, windows, 3 x STATE), each direction in the order
        that it reads; mask: the same without the last axis."""
        steps, _, n, _ = gates.shape
        h = np.zeros((2, n, STATE), np.float32)
        states, trace = np.empty((steps, 2, n, STATE), np.float32), []
        u = self.p["u"]
        for t in range(steps):
            m = mask[t][..., None]
            hu = np.matmul(h, u)
            zr = sigmoid(gates[t, ..., : 2 * STATE] + hu[..., : 2 * STATE])
            z, r = zr[..., :STATE], zr[..., STATE:]
            new = np.tanh(gates[t, ..., 2 * STATE :] + r * hu[..., 2 * STATE :])
            after = h + m * (z * (new - h))
            if keep:
                trace.append((h, z, r, new, hu[..., 2 * STATE :], m))
            states[t] = h = after
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        tanh = np.tanh(both @ self.p["a"] + self.p["ab"])
        weight = tanh @ self.p["v"] + np.where(mask[:, 0] > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, both)
        logits = pooled @ self.p["o"] + self.p["ob"][0]
        return (logits, (trace, both, tanh, weight, pooled)) if keep else logits

    def gradients(self, types: np.ndarray, mask: np.ndarray, x: np.ndarray, chars: tuple, own: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss. types: (WINDOW, 2, windows) rows of x."""
        p = self.p
        flat = np.matmul(x[None], p["wx"]) + p["b"]
        gates = np.stack([flat[0][types[:, 0]], flat[1][types[:, 1]]], axis=1)
        logits, (trace, both, tanh, weight, pooled) = self.run(gates, mask, keep=True)
        d_logit = ((sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "ob": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * p["o"]
        d_weight = np.einsum("nd,tnd->tn", d_pool, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_tanh = d_score[..., None] * p["v"] * (1 - tanh**2)
        g["v"], g["ab"], g["a"] = np.einsum("tn,tna->a", d_score, tanh), d_tanh.sum(axis=(0, 1)), np.einsum("tnd,tna->da", both, d_tanh)
        d_both = weight[..., None] * d_pool + d_tanh @ p["a"].T
        d_states = np.stack([d_both[..., :STATE], d_both[::-1, :, STATE:]], axis=1)
        d_gates, g["u"], back = np.zeros_like(gates), np.zeros_like(p["u"]), np.zeros_like(trace[0][0])
        for t in range(len(trace) - 1, -1, -1):
            h, z, r, new, hn, m = trace[t]
            d = back + d_states[t]
            dm = d * m
            d_new = dm * z * (1 - new**2)
            d_z, d_r = dm * (new - h) * z * (1 - z), d_new * hn * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=2)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_hu)
            back = d - dm * z + np.matmul(d_hu, p["u"].transpose(0, 2, 1))
        d_flat = np.zeros_like(flat)
        for k in range(2):
            np.add.at(d_flat[k], types[:, k].ravel(), d_gates[:, k].reshape(-1, 3 * STATE))
        g["b"], g["wx"] = d_flat.sum(axis=1, keepdims=True), np.matmul(x.T[None], d_flat)
        d_x = np.matmul(d_flat, p["wx"].transpose(0, 2, 1)).sum(axis=0)
        ids, of, scale = chars
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], own, d_x[:, :WORD_DIM])
        np.add.at(g["char"], ids, (d_x[:, WORD_DIM:-1] * scale[:, None])[of])
        g["char"][0] = 0
        g["word"][0] = 0
        return g


def layout(starts: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows' words in both reading orders, (WINDOW, 2, windows), ``pad`` after
    a text's end; and the mask."""
    at = starts[None] + np.arange(WINDOW)[:, None]
    inside = at < ends[None]
    at = np.where(inside, at, pad)
    return np.stack([at, at[::-1]], axis=1), np.stack([inside, inside[::-1]], axis=1).astype(np.float32)


class Scorer:
    """The network with the words' gate inputs that a Python worker keeps."""

    KEPT = 150_000

    def __init__(self, network: Network):
        self.network, self.rows = network, Rows((2, 3 * STATE), np.float32, self.KEPT)

    def window_scores(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, logit) of all windows of the texts."""
        self.rows.add(set().union(*lists), self.network.projected)
        place, gates = self.rows.young.__getitem__, self.rows.table
        ids = np.fromiter((place(w) for words in lists for w in words), np.int64, sum(map(len, lists)))
        ids = np.append(ids, 0)
        text, first, ends, at = [], [], [], 0
        for k, words in enumerate(lists):
            own = windows(len(words))
            text += [k] * len(own)
            first += [at + s for s in own]
            ends += [at + len(words)] * len(own)
            at += len(words)
        text, first, ends = np.array(text, np.int64), np.array(first, np.int64), np.array(ends, np.int64)
        logits = np.zeros(len(text), np.float32)
        for lo in range(0, len(text), 512):
            places, mask = layout(first[lo : lo + 512], ends[lo : lo + 512], len(ids) - 1)
            types = ids[places]
            logits[lo : lo + 512] = self.network.run(np.stack([gates[types[:, 0], 0], gates[types[:, 1], 1]], axis=1), mask)
        return text, first, logits

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score, windows) of each text."""
        lists = [word_list(t) for t in texts]
        score = np.full(len(texts), self.network.base)
        text, _, logits = self.window_scores(lists)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logits)
        some = np.isfinite(worst)
        score[some] = sigmoid(worst[some].astype(np.float64))
        return score, np.bincount(text, minlength=len(texts))


def fit(texts: list[str], labels: list[int], base: float, rounds: int = ROUNDS) -> Network:
    """A network from labelled texts; with texts of one label only, it keeps that label's rate."""
    lists = [word_list(t) for t in texts]
    y = np.array(labels, np.float32)
    seen = [Counter(), Counter()]
    for words, label in zip(lists, labels, strict=True):
        seen[label].update(set(words))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    words = sorted(w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= SEEN)
    held = [Counter(), Counter()]
    for ws, label in zip(lists, labels, strict=True):
        held[label].update({r for w in set(ws) for r in runs(w)})
    chars = sorted(c for c in held[0].keys() | held[1].keys() if held[0][c] + held[1][c] >= SEEN)
    tie = lambda names, c: association(np.array([c[1][x] for x in names], float), np.array([c[0][x] for x in names], float), n)
    network = Network.new({w: i for i, w in enumerate(words, 1)}, {c: i for i, c in enumerate(chars, 1)}, tie(words, seen), tie(chars, held), base)
    if len(set(labels)) < 2:
        network.p["ob"][0] = np.log(max(base, 1e-3) / max(1 - base, 1e-3))
        network.p["o"][:] = 0
        return network
    rng = np.random.default_rng(11)
    types = sorted({w for ws in lists for w in ws})
    index = {w: i for i, w in enumerate(types)}
    flat = np.append(np.fromiter((index[w] for ws in lists for w in ws), np.int64), 0)
    own = np.fromiter((network.words.get(w, 0) for w in types), np.int64, len(types))
    ends_of = np.cumsum([len(ws) for ws in lists])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    apart = np.arange(len(lists)) % APART == APART - 1
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    best = (np.inf, network.p)

    def judge(text, logits):
        """Keep these parameters if a bias for them errs least."""
        nonlocal best
        worst = np.full(len(lists), -np.inf)
        np.maximum.at(worst, text, logits)
        own = (apart if apart.any() else ~apart) & np.isfinite(worst)
        cost = np.where(y[own] > 0, WEIGHED / max(1, (y[own] > 0).sum()), (1 - WEIGHED) / max(1, (y[own] == 0).sum()))
        order = np.argsort(worst[own])
        value, cost, toxic = worst[own][order], cost[order], y[own][order] > 0
        errors = np.cumsum(np.where(toxic, cost, 0)) + np.cumsum(np.where(toxic, 0, cost)[::-1])[::-1] - np.where(toxic, 0, cost)
        errors = np.append(np.where(toxic, 0, cost).sum(), errors)
        edges = np.concatenate([value[:1] - 1, (value[1:] + value[:-1]) / 2, value[-1:] + 1])
        least = np.flatnonzero(errors <= errors.min() + 1e-9)
        if errors.min() < best[0]:
            best = (errors.min(), {k: v.copy() for k, v in network.p.items()})
            best[1]["ob"] -= np.float32(edges[least].mean())

    for turn in range(rounds + 1):
        text, first, logits = Scorer(network).window_scores(lists)
        if turn:
            judge(text, logits)
        if turn == rounds:
            break
        learn = ~apart[text]
        text, first, logits = text[learn], first[learn], logits[learn]
        order = np.lexsort((-logits, text))
        text, first = text[order], first[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        chance = rng.random(len(text)) < np.where(y[text] > 0, 0, 0.15)
        chosen = np.flatnonzero((rank < np.where(y[text] > 0, 1, 2)) | chance)
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 96)):
            places, mask = layout(first[part], ends_of[text[part]], len(flat) - 1)
            used, local = np.unique(flat[places], return_inverse=True)
            local = local.reshape(places.shape)
            names = [types[i] for i in used]
            g = network.gradients(local, mask, network.inputs(names), network.char_rows(names), own[used], y[text[part]])
            step += 1
            rate = 0.02 * (1 - turn / (rounds + 1))
            for k, d in g.items():
                m, s = moments[k]
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    network.p = best[1]
    return network


def train(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> Network:
    """A network from about ``size`` texts of label 1 and twice as many of label 0, among the rows that ``keep``
    holds for, drawn by a hash of the id. Rows without text or label, and labels other than 0
    and 1, are not learned from; an id with both labels counts as 1, and one of its texts if it has several. In the order of
    the hash at most four times ``size`` texts and SAMPLE_BYTES bytes of a label come to the driver."""
    known = labels.where(keep & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    rates = F.when(F.col("label") == 1, size / max(1, counts.get(1, 0))).otherwise(2 * size / max(1, counts.get(0, 0)))
    drawn = known.where(draw < rates)  # about 3 x size rows at any size of the table
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    order = Window.partitionBy("label").orderBy(draw, "id")
    one = one.withColumn("n", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = one.where((F.col("n") <= 4 * size) & (F.col("bytes") <= SAMPLE_BYTES)).select("id", "text", "label").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r[1] for r in rows], [r[2] for r in rows], base)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, score, predicted, n_windows, *keep) of every row: the worst window's probability.

    Texts that are null, empty or without a word have no window; their score is the rate of
    label 1 among the labels learned from. Rows that repeat are scored each, texts of any
    length whole, 200 rows at a time. One narrow pass; the network's size is bounded.
    """
    small_batches(docs.sparkSession)
    name = ("toxicity", id(network), hash(network.p["word"].tobytes()))
    shared = docs.sparkSession.sparkContext.broadcast((network.words, network.chars, network.p, network.ties, network.base))

    def start():
        scorer = kept(name, lambda: Scorer(Network(*shared.value)))

        def work(keys, texts, *rest):
            found, n = scorer.texts(texts)
            return {id_col: keys, "score": found, "predicted": (found >= 0.5).astype(np.int32), "n_windows": n} | dict(zip(keep, rest, strict=True))

        return work

    kinds = dict(docs.dtypes)
    more = "".join(f", {c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in keep)
    return map_rows(docs, [id_col, text_col, *keep], f"{id_col} long, score double, predicted int, n_windows long{more}", start, rows=200)
