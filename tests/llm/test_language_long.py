import math
import random

import numpy as np
import public_tokenizers

from tracewell.llm import language

PATH = public_tokenizers.path("piece_bpe_32k.model")


def log_of_all_segmentations(word, weights, k, longest):
    """The sum over all segmentations, in exact fractions of powers of two, letter by letter."""
    from fractions import Fraction

    total = [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        for n in range(1, min(longest, end) + 1):
            part = word[end - n : end]
            p = weights[part][k] if part in weights else language.FLOOR if n == 1 else 0
            total[end] += total[end - n] * Fraction(p)
    return math.log(total[-1].numerator) - math.log(total[-1].denominator)


def test_words_of_200_letters_are_not_cut():
    random.seed(4)
    pieces = ["a", "b", "c", "ab", "abc", "cab", "bbbbbbbbbbbb", "abcabcabcabcabc", "cc"]
    rng = np.random.default_rng(5)
    weights = rng.dirichlet(np.ones(len(pieces)), 3).T
    model = language.Model(pieces, ["x", "y", "z"], weights)
    table = dict(zip(pieces, weights.tolist(), strict=True))
    for n in (1, 11, 12, 13, 48, 49, 96, 200):
        word = "".join(random.choices("abcd", k=n))
        got = model.log_words([word, "ab", word])
        for k in range(3):
            assert math.isclose(got[0, k], log_of_all_segmentations(word, table, k, 15), rel_tol=1e-9, abs_tol=1e-9), n
        assert (got[0] == got[2]).all()
    assert np.isfinite(model.log_words(["d" * 20_000])).all()


def test_all_letter_pieces_are_used():
    import sentencepiece

    raw = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = language.vocabulary(PATH)
    names = {raw.id_to_piece(i).removeprefix("▁").lower() for i in range(raw.get_piece_size())}
    assert set(pieces) == {n for n in names if language.LETTERS.fullmatch(n)}
    long = max(pieces, key=len)
    assert len(long) > 8 and language.fit({"a": [long], "b": ["q"]}, pieces).longest == len(long)


def test_fitting_reads_words_whole():
    pieces = ["a", "b", "c", "ab"]
    model = language.fit({"x": ["c" * 60 + "ab" * 200], "y": ["c" * 60 + "ba" * 200]}, pieces)
    row = dict(zip(model.pieces, model.weights.tolist(), strict=True))
    assert row["ab"][0] > 0.3 and row["c"][0] < 0.3


def test_one_round_of_fitting_against_counts_of_segmentations():
    import itertools

    pieces, words = ["a", "b", "ab", "ba"], ["abab", "ba", "aab"]
    model = language.fit({"x": words}, pieces, rounds=1)
    start = {p: 1 / 4 for p in pieces}
    want = dict.fromkeys(pieces, 0.01)
    for word in words:
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            if all(p in start for p in parts):
                found.append((math.prod(start[p] for p in parts), parts))
        total = sum(p for p, _ in found)
        for p, parts in found:
            for part in parts:
                want[part] += p / total
    sums = sum(want.values())
    for piece, row in zip(model.pieces, model.weights, strict=True):
        assert math.isclose(row[0], want[piece] / sums, rel_tol=1e-9)
