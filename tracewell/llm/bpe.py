"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has exactly one encoding, and a token can end it only if it is
compatible with the last token of the prefix before it. So one pass over the matches of
the vocabulary (an automaton over all token strings) stores a single last token for each
prefix, and the ids are read off the back-pointers. No merge is ever simulated. Pieces that
a worker has not met are taken many at a time, place by place.
"""

from __future__ import annotations

import gc
import json
from collections import deque
from collections.abc import Callable, Iterable
from functools import cached_property
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Memory, kept, map_rows, small_batches

#: Splits a text into the pieces that byte-level BPE never crosses. A fixed value of the public vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings whose encodings a Python worker keeps, in the younger half of its memory.
KEPT = 350_000
#: Longer strings are encoded without being kept.
KEPT_CHARS = 48
#: Pieces of at most so many bytes are encoded many at a time, and so many of them.
SHORT, BLOCK = 64, 8192
#: Bits of a token's id, and slots of the memory of compatible pairs.
BITS, SLOTS = 20, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """All token strings, with a link from each state to that of its longest proper suffix."""

    def __init__(self, words: dict[bytes, int]):
        edges: list[dict[int, int]] = [{}]
        token, depth = [-1], [0]
        for word, i in words.items():
            at = 0
            for b in word:
                to = edges[at].get(b)
                if to is None:
                    to = edges[at][b] = len(edges)
                    edges.append({})
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            token[at] = i
        suffix, link = [0] * len(edges), [-1] * len(edges)
        queue = deque(edges[0].values())
        while queue:
            at = queue.popleft()
            for b, to in edges[at].items():
                back = suffix[at]
                while back and b not in edges[back]:
                    back = suffix[back]
                suffix[to] = edges[back].get(b, 0)
                queue.append(to)
            link[at] = suffix[at] if token[suffix[at]] >= 0 else link[suffix[at]]
        flat = sorted((s << 8 | b, to) for s, e in enumerate(edges) for b, to in e.items())
        self.keys, self.targets = np.array([k for k, _ in flat], np.int64), np.array([t for _, t in flat], np.int32)
        self.suffix, self.link = np.array(suffix, np.int32), np.array(link, np.int32)
        self.token, self.depth = np.array(token, np.int32), np.array(depth, np.int32)
        #: The longest token that ends in a state, as a state.
        self.first = np.where(self.token >= 0, np.arange(len(edges), dtype=np.int32), self.link)
        self.root = np.array([edges[0].get(b, 0) for b in range(256)], np.int32)

    @cached_property
    def lists(self) -> tuple:
        """Steps, tokens, depths, links, longest tokens and suffixes, for one piece at a time."""
        return dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), *(x.tolist() for x in (self.token, self.depth, self.link, self.first, self.suffix))

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        out = self.root[letters]
        todo = np.flatnonzero(states)
        at = states[todo]
        while todo.size:
            wanted = at.astype(np.int64) << 8 | letters[todo]
            i = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[i] == wanted
            out[todo[hit]] = self.targets[i[hit]]
            todo, at = todo[~hit], self.suffix[at[~hit]]
            todo, at = todo[at > 0], at[at > 0]
        return out


class PrefixBpe:
    """The vocabulary's tables in one Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special, self.bytes_of = special, {i: to_bytes(s) for s, i in vocabulary.items()}
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        size = max(self.bytes_of) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            pairs.append((a << BITS | b, rank))
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        pairs.sort()
        self.pairs, self.ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        self.automaton = Automaton({self.bytes_of[i]: i for i in vocabulary.values()})
        self.met, self.keeps = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pieces = regex.compile(PIECES)

    def unmerged(self, keys: np.ndarray) -> np.ndarray:
        """Does BPE keep the border between the tokens a and b of each key? Undo the younger merge of
        the two, again and again: a pair across the border that merges before it breaks it."""
        a, b, out = keys >> BITS, keys & ((1 << BITS) - 1), np.ones(len(keys), bool)
        never = len(self.pairs) + 1
        limit, todo = np.full(len(keys), never), np.arange(len(keys))
        while todo.size:
            wanted = a[todo] << BITS | b[todo]
            i = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            broken = np.where(self.pairs[i] == wanted, self.ranks[i], never) < limit[todo]
            out[todo[broken]] = False
            todo = todo[~broken]
            ra, rb = self.rank[a[todo]], self.rank[b[todo]]
            more = (ra >= 0) | (rb >= 0)
            todo, ra, rb = todo[more], ra[more], rb[more]
            left = ra > rb
            x, y = todo[left], todo[~left]
            limit[x], limit[y] = ra[left], rb[~left] + 1
            a[x], b[y] = self.right[a[x]], self.left[b[y]]
        return out

    def compatible(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Can each token follow the one before it? Pairs met lately are looked up."""
        keys = before.astype(np.int64) << BITS | token
        slots = (keys * 0x9E3779B1 >> 7) & (SLOTS - 1)
        out, new = self.keeps[slots], np.flatnonzero(self.met[slots] != keys)
        if new.size:
            pairs, place = np.unique(keys[new], return_inverse=True)
            found = self.unmerged(pairs)
            out[new] = found[place]
            at = (pairs * 0x9E3779B1 >> 7) & (SLOTS - 1)
            # of pairs that share a slot the last one's key and answer both stand
            self.met[at] = pairs
            own = self.met[at] == pairs
            self.keeps[at[own]] = found[own]
        return out

    def encode_block(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's end): the unique last token of every prefix, then
        the way back. The pieces come longest first."""
        n = np.array([len(p) for p in pieces], np.int64)
        width, count = int(n[0]), len(n)
        letters = np.zeros((count, width), np.uint8)
        letters[np.arange(width)[None] < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        letters = np.ascontiguousarray(letters.T)
        last, size = np.full((width + 1, count), -1, np.int32), np.zeros((width + 1, count), np.int32)
        machine, state = self.automaton, np.zeros(count, np.int32)
        for end in range(1, width + 1):
            live = int(np.searchsorted(-n, -end, side="right"))
            state = machine.step(state[:live], letters[end - 1, :live])
            match = machine.first[state]
            rows = np.flatnonzero(match >= 0)
            match = match[rows]
            while rows.size:
                token, long = machine.token[match], machine.depth[match]
                before = last[end - long, rows]
                ok = long == end
                some = np.flatnonzero(before >= 0)
                ok[some] = self.compatible(before[some], token[some])
                last[end, rows[ok]], size[end, rows[ok]] = token[ok], long[ok]
                rows, match = rows[~ok], machine.link[match[~ok]]
                rows, match = rows[match >= 0], match[match >= 0]
        at, rows, steps = n.copy(), np.arange(count), []
        while rows.size:
            steps.append((rows, last[at[rows], rows]))
            at[rows] -= size[at[rows], rows]
            rows = rows[at[rows] > 0]
        tokens = np.zeros(count, np.int64)
        for rows, _ in steps:
            tokens[rows] += 1
        ends = np.cumsum(tokens)
        ids = np.zeros(int(ends[-1]), np.int32)
        for k, (rows, found) in enumerate(steps):
            ids[ends[rows] - 1 - k] = found
        return ids, ends

    def encode_long(self, piece: bytes) -> list[int]:
        """The same for one piece of any length, place by place."""
        go, token, depth, link, first, suffix = self.automaton.lists
        last, size, known, state = [-1] * (len(piece) + 1), [0] * (len(piece) + 1), {}, 0
        for end, b in enumerate(piece, 1):
            while (to := go.get(state << 8 | b)) is None and state:
                state = suffix[state]
            state = to or 0
            match = first[state]
            while match >= 0:
                start, t = end - depth[match], token[match]
                ok = not start
                if start and last[start] >= 0:
                    pair = last[start] << BITS | t
                    if pair not in known:
                        known[pair] = bool(self.unmerged(np.array([pair], np.int64))[0])
                    ok = known[pair]
                if ok:
                    last[end], size[end] = t, depth[match]
                    break
                match = link[match]
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        raw = list(map(str.encode, pieces))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [None] * len(raw)
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self.encode_long(raw[i])
        short = np.flatnonzero(size <= SHORT)
        short = short[np.argsort(-size[short], kind="stable")].tolist()
        for at in range(0, len(short), BLOCK):
            part = short[at : at + BLOCK]
            ids, ends = self.encode_block([raw[i] for i in part])
            ids, first = ids.tolist(), 0
            for i, end in zip(part, ends.tolist(), strict=True):
                out[i] = ids[first:end]
                first = end
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, nothing kept."""
        parts = self.split_special.split(text) if self.split_special else [text]
        cut = [[p] if p in self.special else self.pieces.findall(p) for p in parts]
        new = list(set(chain.from_iterable(cut)).difference(self.special))
        known = {s: [i] for s, i in self.special.items()} | dict(zip(new, self.encode_pieces(new), strict=True))
        return [i for pieces in cut for p in pieces for i in known[p]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """What texts encode to, in parts that are kept: ``value(ids, vocabulary)`` of every run of whole pieces."""

    def __init__(self, path: str, value: Callable[[list[int], PrefixBpe], object]):
        self.bpe, self.value = PrefixBpe(path), value
        self.double, self.gaps = regex.compile(r"\s\s"), regex.compile(r"(?<=\S)(?= \S)")
        self.memories = (Memory(KEPT), Memory(KEPT))
        self.specials = {s: value([i], self.bpe) for s, i in self.bpe.special.items()}

    def cut(self, text: str) -> list[tuple[int, list[str]]]:
        """The text in runs: (0, runs as they stand), (1, words after one space each), (2, special tokens). It
        is cut where one space stands between other characters; there no piece crosses, whatever follows."""
        out = []
        for part in self.bpe.split_special.split(text) if self.bpe.split_special else [text]:
            if part in self.specials:
                out.append((2, [part]))
            elif self.double.search(part):
                out.append((0, self.gaps.split(part)))
            elif part:
                head, *rest = part.split(" ")
                out += [(0, [head])] * bool(head) + [(1, rest)] * bool(rest)
        return out

    def learn(self, kind: int, runs: set[str]) -> list[str]:
        """Encodes what the memory lacks; the strings that are too long to stay in it."""
        memory, value, bpe = self.memories[kind], self.value, self.bpe
        new = memory.lacks(runs)
        before = " " if kind else ""
        single = [run for run in new if run.isalpha()]
        mixed = {run: bpe.pieces.findall(before + run) for run in set(new).difference(single)}
        others = list(set(chain.from_iterable(mixed.values())))
        found = bpe.encode_pieces([before + run for run in single] + others)
        memory.young.update(zip(single, [value(ids, bpe) for ids in found[: len(single)]], strict=True))
        ids_of = dict(zip(others, found[len(single) :], strict=True))
        memory.young.update({run: value(list(chain.from_iterable(map(ids_of.__getitem__, pieces))), bpe) for run, pieces in mixed.items()})
        gc.freeze()  # what is kept is not looked through again
        return [run for run in new if len(run) > KEPT_CHARS]

    def values(self, texts: list[str | None]) -> list[list]:
        """Each text's values in order."""
        cuts = [self.cut(t) if t else [] for t in texts]
        long = [self.learn(kind, set(chain.from_iterable(words for c in cuts for k, words in c if k == kind))) for kind in (0, 1)]
        gets = [self.memories[0].young.__getitem__, self.memories[1].young.__getitem__, self.specials.__getitem__]
        out = [list(chain.from_iterable(map(gets[k], words) for k, words in c)) for c in cuts]
        for kind, runs in enumerate(long):
            for run in runs:
                del self.memories[kind].young[run]
        return out


def spelled(ids: list[int], bpe: PrefixBpe) -> tuple[str, int, bytes]:
    """(ids as text, number of ids, decoded bytes)."""
    return ",".join(map(bpe.text_of.__getitem__, ids)), len(ids), b"".join(map(bpe.bytes_of.__getitem__, ids))


def encoder(path: str, value: Callable = spelled) -> Encoder:
    """One set of tables for each Python worker, kept between its tasks."""
    return kept(("bpe", path, value.__name__), lambda: Encoder(path, value))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; one narrow pass, no shuffle.

    Null and empty texts have no ids and decode to "". Rows that repeat are encoded each.
    A text of any length is encoded whole, in memory proportional to it. Other columns of
    ``docs``, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)

    def start():
        coder = encoder(path)

        def work(keys, texts):
            found = coder.values(texts)
            return {id_col: keys, "ids": [[int(i) for e in v for i in e[0].split(",")] for v in found], "decoded": [b"".join([e[2] for e in v]).decode("utf-8", "replace") for v in found]}

        return work

    return map_rows(docs, [id_col, text_col], f"{id_col} long, ids array<int>, decoded string", start, rows=200)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_text binary, decoded binary) like encode_documents, with the ids as
    comma-joined decimal text and the decoded text in UTF-8, which are cheaper to hash."""
    small_batches(docs.sparkSession)

    def start():
        coder = encoder(path)

        def work(keys, texts):
            out = {id_col: keys, "n_tokens": [], "ids_text": [], "decoded": []}
            for found in coder.values(texts):
                ids, n, raw = zip(*found, strict=True) if found else ((), (), ())
                out["n_tokens"].append(sum(n))
                out["ids_text"].append(",".join(ids).encode())
                out["decoded"].append(b"".join(raw).decode("utf-8", "replace").encode())
            return out

        return work

    return map_rows(docs, [id_col, text_col], f"{id_col} long, n_tokens long, ids_text binary, decoded binary", start, rows=200)
