"""Language by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward pass; a text's is
the product over its words. Piece probabilities are fitted by expectation maximisation on a
bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, kept, map_rows, small_batches

#: Steps after which a forward pass is scaled anew; between, no number leaves the range of doubles.
SCALED = 12
#: Words of one length that a pass takes together, so that words x letters stays under this.
CELLS = 1 << 17
#: Probability of a letter that a language's pieces do not give.
FLOOR = 1e-6
#: Texts of each language that are read to fit, about, and the most bytes of them; rounds of fitting.
SAMPLE, SAMPLE_BYTES, ROUNDS = 600, 64_000_000, 4
LETTERS = regex.compile(r"\p{L}+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return LETTERS.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, in lower case, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).removeprefix("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if LETTERS.fullmatch(p))


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each letter."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return np.ascontiguousarray(raw.T).astype(np.uint64)


def longer(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of strings with one letter more."""
    with np.errstate(over="ignore"):
        out = (hashes ^ letters) * PRIME
    return out ^ (out >> np.uint64(31))


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of the words of each length, so many together that a pass over them is bounded."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, rows in groups.items():
        step = max(1, CELLS // length)
        for at in range(0, len(rows), step):
            yield rows[at : at + step]


class Model:
    """Piece probabilities, one column for each language."""

    def __init__(self, pieces: list[str], languages: list[str], weights: np.ndarray):
        self.pieces, self.languages, self.weights = pieces, languages, weights
        self.longest = max(map(len, pieces), default=1)
        index = {p: i for i, p in enumerate(pieces)}
        starts = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        hashed = np.zeros(len(starts), np.uint64)
        for rows in by_length(starts):
            h = np.zeros(len(rows), np.uint64)
            for letters in codes([starts[i] for i in rows]):
                h = longer(h, letters)
            hashed[rows] = h
        order = np.argsort(hashed)
        # what begins a piece, by its hash, and the piece that it is, if any
        self.hashes, self.piece = hashed[order], np.array([index.get(starts[i], -1) for i in order], np.int64)
        if not len(order):
            self.hashes, self.piece = np.zeros(1, np.uint64), np.full(1, -1)
        self.table = np.vstack([weights, np.full(len(languages), FLOOR)]) if len(pieces) else np.full((1, len(languages)), FLOOR)
        self.floored = np.where(self.table > 0, self.table, FLOOR)

    def matches(self, block: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(letters, rows, pieces) of all pieces that stand at ``start``. Every word has one of one
        letter, which is the table's last row if it is no piece."""
        rows, h = np.arange(block.shape[1]), np.zeros(block.shape[1], np.uint64)
        for n in range(1, min(self.longest, len(block) - start) + 1):
            h = longer(h, block[start + n - 1, rows])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            found = np.where(hit, self.piece[at], -1)
            if n == 1:
                yield n, rows, np.where(found >= 0, found, len(self.pieces))
            elif (own := found >= 0).any():
                yield n, rows[own], found[own]
            rows, h = rows[hit], h[hit]
            if not len(rows):
                return

    def step(self, ids: np.ndarray, n: int) -> np.ndarray:
        return self.floored[ids] if n == 1 else self.table[ids]

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of every word, however long, in every language, summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for rows in by_length(words):
            block = codes([words[i] for i in rows])
            ahead, scale = np.zeros((self.longest + 1, len(rows), len(self.languages))), np.zeros((len(rows), len(self.languages)))
            ahead[0] = 1
            for start in range(len(block)):
                if start and start % SCALED == 0:
                    now = ahead[0].copy()
                    ahead /= now
                    scale += np.log(now)
                for n, own, ids in self.matches(block, start):
                    ahead[n, own] += ahead[0, own] * self.step(ids, n)
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0
            out[rows] = np.log(ahead[0]) + scale
        return out


def fit(samples: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over all segmentations of the sampled texts' words, each whole. Forward
    and backward numbers are kept as logarithms; what is summed is relative to the place before."""
    languages = sorted(samples)
    counts = {lang: Counter(w for t in samples[lang] for w in word_list(t)) for lang in languages}
    words = sorted(set().union(*counts.values())) if counts else []
    whole = Model(pieces, languages, np.ones((len(pieces), len(languages))))
    blocks, seen = [], np.zeros(len(pieces) + 1, bool)
    for rows in by_length(words):
        block = codes([words[i] for i in rows])
        lattice = [[(n, own.astype(np.int32), ids.astype(np.int32)) for n, own, ids in whole.matches(block, start)] for start in range(len(block))]
        for step in lattice:
            for _, _, ids in step:
                seen[ids] = True
        blocks.append((lattice, np.array([[counts[lang][words[i]] for lang in languages] for i in rows], float)))
    used = np.flatnonzero(seen[:-1])
    if not languages or not len(used):
        return Model([], languages, np.zeros((0, len(languages))))
    table = np.vstack([np.full((len(pieces), len(languages)), 1 / len(used)), np.full(len(languages), FLOOR)])
    for _ in range(rounds):
        floored, expected = np.where(table > 0, table, FLOOR), np.zeros_like(table)
        for lattice, weight in blocks:
            length, shape = len(lattice), weight.shape
            reach = min(whole.longest, length)
            forward, backward = np.zeros((length + 1, *shape)), np.zeros((length + 1, *shape))
            ahead = np.zeros((reach + 1, *shape))
            ahead[0] = 1
            for start, step in enumerate(lattice):
                forward[start] = np.log(ahead[0]) + (forward[start - 1] if start else 0)
                ahead /= ahead[0].copy()
                for n, own, ids in step:
                    ahead[n, own] += floored[ids] if n == 1 else table[ids]
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0
            total = forward[length - 1] + np.log(ahead[0])
            after = np.zeros((reach, *shape))
            after[0] = 1
            for start in range(length - 1, -1, -1):
                now = np.zeros(shape)
                for n, own, ids in lattice[start]:
                    now[own] += (floored[ids] if n == 1 else table[ids]) * after[n - 1, own]
                backward[start] = backward[start + 1] + np.log(now)
                after[1:] = after[:-1] / now
                after[0] = 1
            for start, step in enumerate(lattice):
                for n, own, ids in step:
                    p = floored[ids] if n == 1 else table[ids]
                    gain = p * np.exp(forward[start, own] + backward[start + n, own] - total[own]) * weight[own]
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(ids, gain[:, k], len(expected))
        table[used] = expected[used] + 0.01
        table[used] /= table[used].sum(axis=0)
    return Model([pieces[i] for i in used], languages, table[used])


def sample(docs: DataFrame, keep: Column, label_col: str, id_col: str, text_col: str, size: int, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """About ``size`` texts of each label among the rows that ``keep`` holds for, drawn by a hash of the id (of the text,
    where the id is null) at a rate set from the label's number of ids; of an id with several texts one counts. In the
    order of the hash at most twice ``size`` texts and ``most_bytes`` bytes of a label come to the driver."""
    key = F.coalesce(F.col(id_col), F.xxhash64(text_col))
    labelled = docs.where(keep & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), key.alias("key"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count_distinct("key")).collect()}
    if not counts:
        return {}
    draw = (F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30))) / float(1 << 30)
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(size / n)).otherwise(rate)
    drawn = labelled.where(draw < rate).groupBy("label", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("draw", draw)
    order = Window.partitionBy("label").orderBy("draw", "key")
    drawn = drawn.withColumn("n", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out: dict[str, list[str]] = {label: [] for label in counts}
    for r in drawn.where((F.col("n") <= 2 * size) & (F.col("bytes") <= most_bytes)).select("label", "text").collect():
        out[r[0]].append(r[1])
    return {k: v for k, v in out.items() if v}


class Scorer:
    """Word scores that a Python worker keeps."""

    KEPT = 250_000

    def __init__(self, model: Model):
        self.model, self.rows = model, Rows((len(model.languages),), np.float64, self.KEPT)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, posterior, mean log probability of a letter) of each text."""
        found = [word_list(t or "") for t in texts]
        self.rows.add(set().union(*found), self.model.log_words)
        out = []
        for words in found:
            if not words or not self.model.languages:
                out.append(("und", 0.0, None))
                continue
            at = np.fromiter(map(self.rows.young.__getitem__, words), np.int64, len(words))
            logs = self.rows.table[at].sum(axis=0)
            best = int(logs.argmax())
            p = 1 / np.exp(logs - logs[best]).sum()
            out.append((self.model.languages[best], float(p), float(logs[best] / sum(map(len, words)))))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, lang_pred, score, fit, *keep) of every row: the likeliest language, its posterior and
    the mean log probability of a letter in it.

    Null texts, empty texts and texts without a letter are "und" with score 0, as is every
    text if nothing was learned; of equal languages the first by name is taken. Words of any
    length are scored over all their segmentations; texts are read whole. Rows that repeat
    are scored each. One narrow pass; the model is of bounded size and goes with the task.
    """
    small_batches(docs.sparkSession)
    name = ("language", id(model), hash(model.weights.tobytes()))
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.weights))

    def start():
        scorer = kept(name, lambda: Scorer(Model(*shared.value)))

        def work(keys, texts, *rest):
            rows = scorer.texts(texts)
            return {id_col: keys, "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "fit": [r[2] for r in rows]} | dict(zip(keep, rest, strict=True))

        return work

    kinds = dict(docs.dtypes)
    more = "".join(f", {c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in keep)
    return map_rows(docs, [id_col, text_col, *keep], f"{id_col} long, lang_pred string, score double, fit double{more}", start, rows=200)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[str, ...]:
    return tuple(vocabulary(path))


def train(docs: DataFrame, keep: Column, path: str, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> Model:
    """A model from about ``size`` texts of each label among the rows that ``keep`` holds for."""
    return fit(sample(docs, keep, label_col, id_col, text_col, size), list(pieces_of(path)))
