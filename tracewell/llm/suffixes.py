"""Repeated strings by a distributed, common-prefix-aware merge sort of suffixes.

Every string of LENGTH bytes has one anchor, the place of its least gram hash, which is the
same wherever the string stands. Only suffixes at anchors are sorted, once as they read on and
once as they read back, and only anchors whose gram occurs twice. Each task sorts its suffixes
into a run, cuts it at splitters, and sends front-coded pieces (the length of the prefix shared
with the suffix before, then the rest). A piece's receiver merges its runs with a loser tree
whose entries carry the prefix shared with the last winner, so that no known prefix is compared
again. What sorted suffixes share decides which strings around their anchors repeat; suffixes whose
equals may lie beyond a partition's border are compared as whole strings.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right, insort
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows, small_batches, stage

#: Bytes of a string that is removed if it repeats, and of a gram.
LENGTH, GRAM = 400, 32
#: Places of grams in a string.
PLACES = LENGTH - GRAM + 1
#: Keys that are drawn for each receiving partition to set the splitters.
DRAWN = 40
#: Keys of one gram that stay in one partition.
WHOLE = 60_000
#: Stands after what is compared; no UTF-8 text holds it.
END = b"\xff"
_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(401).integers(0, 1 << 63, 6, dtype=np.uint64).tolist()]
_MOST = 1 << 23
#: A place and two distances of at most LENGTH before it in one long.
PACK = 9


def packed(p: str, far: str, near: str):
    return F.expr(f"shiftleft({p}, {2 * PACK}) | shiftleft({far}, {PACK}) | ({near})")


def unpacked(codes: list[int]) -> list[tuple[int, int, int]]:
    """(place, farther distance, nearer distance) of each code."""
    mask = (1 << PACK) - 1
    return [(c >> 2 * PACK, c >> PACK & mask, c & mask) for c in codes]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place on, by doubling."""
    h, n = _BYTE[raw], 1
    with np.errstate(over="ignore"):
        for k in range(5):
            h = h[:-n] * _ODD[k] + h[n:]
            h ^= h >> np.uint64(31)
            n *= 2
        h *= _ODD[5]
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, gram hash) for each run of starts with one anchor,
    in the texts that end at ``cuts`` within ``raw``. The leftmost least hash is the anchor."""
    out = []
    data = np.frombuffer(raw, np.uint8)
    for lo in range(0, max(len(data) - LENGTH + 1, 0), _MOST):
        part = data[lo : lo + _MOST + LENGTH - 1]
        h = gram_hashes(part)
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= PLACES:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < PLACES:
            least = np.minimum(least[: len(least) - (PLACES - n)], least[PLACES - n :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.arange(len(place)) + lo
        text = np.searchsorted(cuts, starts, side="right")
        ok = starts + LENGTH <= cuts[np.minimum(text, len(cuts) - 1)]
        starts, text, place = starts[ok], text[ok], place[ok]
        if len(starts):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(text) != 0) | (np.diff(starts) != 1)]))
            last = np.append(new[1:], len(starts)) - 1
            out.append((text[new], starts[new], starts[last], place[new] + lo, h[place[new]].view(np.int64)))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(5))


def find_anchors(rows: DataFrame) -> DataFrame:
    """(k, size, gram, anchor): anchors of the rows (k, size, raw), each packed with the starts it stands for."""

    def start():
        kept("suffixes", dict)  # nothing; what other stages kept is freed

        def work(keys, sizes, raws):
            ends = np.cumsum([len(r) for r in raws])
            text, lo, hi, p, gram = anchors(b"".join(raws), ends)
            base = (ends - [len(r) for r in raws])[text] if len(raws) else text
            return {"k": np.array(keys, np.int64)[text], "size": np.array(sizes, np.int64)[text], "p": p - base, "lo": lo - base, "hi": hi - base, "gram": gram}

        return work

    found = map_rows(rows.where(f"size >= {LENGTH}"), ["k", "size", "raw"], "k long, size long, p long, lo long, hi long, gram long", start, rows=100)
    return found.select("k", "size", "gram", packed("p", "p - lo", "p - hi").alias("anchor"))


def keys_of(raw: bytes, cand: list[tuple[int, int, int]]) -> list[tuple[bytes, bytes]]:
    """For each anchor (place, farthest and nearest start before it) what its strings hold from it
    on, and before it, read back: the key of either order."""
    back, n, out = raw[::-1], len(raw), []
    for p, far, near in cand:
        left = back[n - p : n - p + far]
        out.append((b"R" + raw[p : p - near + LENGTH] + END + left + END, b"L" + left + END))
    return out


def identity(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def shared_from(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 48], b[at : at + 48]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return at + m - (d.bit_length() + 7) // 8
        at += 48
    return n


def front_code(keys: list[bytes], counts: list[int]) -> bytes:
    """A sorted run: for each key the length shared with the one before, and the rest."""
    shared, before = [], b""
    for k in keys:
        shared.append(shared_from(before, k, 0))
        before = k
    tails = [k[s:] for k, s in zip(keys, shared, strict=True)]
    return struct.pack("<I", len(keys)) + np.array(shared, "<u2").tobytes() + np.array([len(t) for t in tails], "<u2").tobytes() + np.array(counts, "<u4").tobytes() + b"".join(tails)


def read_run(blob: bytes):
    """(key, length shared with the key before, count) of a front-coded run, one after another."""
    n = struct.unpack("<I", blob[:4])[0]
    shared = np.frombuffer(blob, "<u2", n, 4).tolist()
    sizes = np.frombuffer(blob, "<u2", n, 4 + 2 * n).tolist()
    counts = np.frombuffer(blob, "<u4", n, 4 + 4 * n).tolist()
    at, key = 4 + 8 * n, b""
    for s, size, count in zip(shared, sizes, counts, strict=True):
        key = key[:s] + blob[at : at + size]
        at += size
        yield key, s, count


def merge(runs: list[bytes]):
    """(key, length shared with the key before, count) of all runs in order, by a loser tree.

    Every loser keeps the prefix length that it shares with the winner that passed it. As both
    sides of a match refer to the last winner, unequal lengths decide it without a look at the
    keys; equal ones need bytes after them only.
    """
    streams = [read_run(r) for r in runs]
    width = 1
    while width < max(len(streams), 1):
        width *= 2
    keys: list[bytes | None] = [None] * width
    counts, losers, known = [0] * width, [-1] * width, [0] * width

    def advance(i: int) -> int:
        key, s, count = next(streams[i], (None, 0, 0))
        keys[i], counts[i] = key, count
        return s

    for i in range(len(streams)):
        advance(i)

    def match(i: int, hi: int, j: int, hj: int) -> tuple[int, int, int, int]:
        """(winner, its length, loser, its length shared with the winner)."""
        if keys[i] is None:
            return j, hj, i, 0
        if keys[j] is None:
            return i, hi, j, 0
        if hi > hj:
            return i, hi, j, hj
        if hi < hj:
            return j, hj, i, hi
        a, b = keys[i], keys[j]
        s = shared_from(a, b, hi)
        if s == len(a) or (s < len(b) and a[s] < b[s]):
            return i, hi, j, s
        return j, hj, i, s

    winners = list(range(width))
    heights = [0] * width
    level, nodes = winners, width
    while nodes > 1:
        nodes //= 2
        new, lengths = [], []
        for k in range(nodes):
            w, h, loser, s = match(level[2 * k], heights[2 * k], level[2 * k + 1], heights[2 * k + 1])
            losers[nodes + k], known[nodes + k] = loser, s
            new.append(w)
            lengths.append(h)
        level, heights = new, lengths
    winner, height = level[0], heights[0]
    while keys[winner] is not None:
        yield keys[winner], height, counts[winner]
        height = advance(winner)
        node = (width + winner) // 2
        while node:
            other, ho = losers[node], known[node]
            key = keys[other]
            if key is not None:
                mine = keys[winner]
                if mine is None or height < ho:
                    losers[node], known[node] = winner, (height if mine is not None else 0)
                    winner, height = other, ho
                elif height == ho:
                    s = shared_from(mine, key, height)
                    known[node] = s
                    if s < len(mine) and (s == len(key) or key[s] < mine[s]):
                        losers[node] = winner
                        winner = other
            node //= 2


def unique(merged):
    """The merged keys, each once, with the sum of its counts."""
    last, shared, total = None, 0, 0
    for key, s, count in merged:
        if last is not None and s == len(key) == len(last):
            total += count
        else:
            if last is not None:
                yield last, shared, total
            last, shared, total = key, s, count
    if last is not None:
        yield last, shared, total


def halves(key: bytes) -> tuple[bytes, bytes]:
    right, left, _ = key[1:].split(END)
    return right, left


def partners(rows: list[tuple[bytes, int, int]], gaps: list[int], parts: list[tuple[bytes, bytes]], lo: int, hi: int) -> dict[int, list[tuple[int, int]]]:
    """For the keys lo..hi-1, which share their gram: the ranges of distances before the anchor at which
    strings match another key's.

    Keys are joined to sets, those that share most first. When two sets meet, what is before the
    anchor is compared only with its neighbours in the other set's order: no other member matches
    more of it, unless it does so with a key that it shares more with. The smaller set goes into
    the larger, so each key is compared about as often as the logarithm of their number.
    """
    order = sorted(range(lo, hi), key=lambda i: parts[i - lo][1])
    place = {i: k for k, i in enumerate(order)}
    parent, members = list(range(hi - lo)), [[place[i]] for i in range(lo, hi)]
    found: dict[int, list[tuple[int, int]]] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for at in sorted(range(lo + 1, hi), key=lambda i: -gaps[i]):
        small, large = root(at - 1 - lo), root(at - lo)
        if len(members[small]) > len(members[large]):
            small, large = large, small
        into = members[large]
        new = []
        for k in members[small]:
            spot = bisect_right(into, k)
            i = order[k]
            right, left = parts[i - lo]
            for j in ([order[into[spot - 1]]] if spot else []) + ([order[into[spot]]] if spot < len(into) else []):
                other_right, other_left = parts[j - lo]
                here = min(gaps[at] - 1, len(right), len(other_right))
                if here + min(len(left), len(other_left)) >= LENGTH:
                    there = shared_from(left, other_left, 0)
                    if here + there >= LENGTH:
                        for x in (i, j):
                            found.setdefault(x, []).append((max(0, LENGTH - here), there))
            new.append(k)
        members[large] = sorted(into + new) if len(new) > 8 else into
        if len(new) <= 8:
            for k in new:
                insort(into, k)
        members[small], parent[small] = [], large
    return found


def judge(rows: list[tuple[bytes, int, int]]) -> dict[str, list]:
    """For each sorted key (key, length shared with the one before, count): its identity, whether
    it stands twice, the longest prefix shared with another, for keys that read on the ranges of
    distances before the anchor at which strings match another's, and the most that keys beyond a
    partition's border can share from the anchor on."""
    out: dict[str, list] = {k: [] for k in ("side", "id", "twice", "best", "low", "high", "beyond", "edge")}
    n = len(rows)
    gaps = [s for _, s, _ in rows] + [0]
    first = next((i for i, r in enumerate(rows) if r[0][:1] == b"R"), n)
    parts = [halves(r[0]) for r in rows[first:]]
    found: dict[int, list[tuple[int, int]]] = {}
    lo = first
    for hi in range(first + 1, n + 1):
        if hi == n or gaps[hi] <= GRAM:
            if hi - lo > 1:
                found |= partners(rows, gaps, parts[lo - first : hi - first], lo, hi)
            lo = hi
    before, after = [0] * (n + 1), [0] * (n + 1)
    least = 1 << 30
    for i in range(first, n):
        least = least if i == 0 else min(least, gaps[i])
        before[i] = least if first == 0 else 0
    least = 1 << 30
    for i in range(n - 1, -1, -1):
        after[i] = least
        least = min(least, gaps[i])
    for i, (key, _, count) in enumerate(rows):
        best = max(gaps[i] if i else 0, gaps[i + 1])
        low, high, beyond = [], [], 0
        if key[:1] == b"R":
            right, left = parts[i - first]
            if count < 2:
                for a, b in sorted(found.get(i, [])):
                    if high and a <= high[-1] + 1:
                        high[-1] = max(high[-1], b)
                    else:
                        low.append(a)
                        high.append(b)
                beyond = max(0, min(max(before[i], after[i]) - 1, len(right)))
            best = min(best - 1, len(right))
        else:
            best = len(key) - 2 if count >= 2 else min(best - 1, len(key) - 2)
        for k, v in zip(out, (key[:1].decode(), identity(key), count >= 2, max(best, 0), low, high, beyond, None), strict=True):
            out[k].append(v)
    return out


def receive(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs that one partition received."""
    merged = list(unique(merge(rows["run"].tolist())))
    out = judge(merged)
    for i, name in ((0, "first"), (-1, "last")):
        for k, v in zip(out, (name, int(rows["target"].iloc[0]), None, None, [], [], None, merged[i][0]), strict=True):
            out[k].append(v)
    return pd.DataFrame(out)


def borders(drawn: list[bytes], parts: int, whole: int) -> list[bytes]:
    """Splitters from sorted keys, about ``parts`` - 1. Keys that share their gram stay in one partition,
    so that they are decided there; only more than ``whole`` drawn ones are split."""
    out, size, target = [], 0, max(1, -(-len(drawn) // parts))
    for gram, keys in groupby(drawn, key=lambda k: k[: 1 + GRAM]):
        keys = list(keys)
        if len(keys) > whole > 0:
            out.append(gram)
            out += [k for k, _ in groupby(keys[target::target])]
            size = len(keys) % target
        elif size >= target:
            out.append(gram)
            size = 0
        size += len(keys)
    return [k for k, _ in groupby(out)]


def sorted_suffixes(candidates: DataFrame, n_anchors: int) -> DataFrame:
    """(side, id, twice, best, low, high, beyond) of all distinct suffixes of the rows (k, raw, cand)."""
    spark = candidates.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_anchors // 25_000, 1)
    rate = min(1.0, DRAWN * parts / max(2 * n_anchors, 1))

    def draw():
        def work(keys, raws, cands):
            drawn = []
            for k, raw, cand in zip(keys, raws, cands, strict=True):
                some = [c for c in unpacked(cand) if xxhash.xxh3_64_intdigest(struct.pack("<qq", k, c[0])) < rate * 2**64]
                drawn += [x for pair in keys_of(raw, some) for x in pair]
            return {"key": drawn}

        return work

    drawn = sorted(bytes(r.key) for r in map_rows(candidates, ["k", "raw", "cand"], "key binary", draw, rows=200).collect())  # about DRAWN keys for each partition
    splitters = spark.sparkContext.broadcast(borders(drawn, parts, int(rate * WHOLE)))

    def send():
        def work(raws, cands):
            counts: dict[bytes, int] = {}
            for raw, cand in zip(raws, cands, strict=True):
                for pair in keys_of(raw, unpacked(cand)):
                    for key in pair:
                        counts[key] = counts.get(key, 0) + 1
            pieces: dict[int, list[bytes]] = {}
            at, edges = 0, splitters.value
            for key in sorted(counts):
                at = bisect_right(edges, key, at)
                pieces.setdefault(at, []).append(key)
            return {"target": list(pieces), "run": [front_code(p, [counts[k] for k in p]) for p in pieces.values()]}

        return work

    runs = map_rows(candidates, ["raw", "cand"], "target int, run binary", send, rows=2000)
    ddl = "side string, id long, twice boolean, best int, low array<int>, high array<int>, beyond int, edge binary"
    judged = stage(runs.groupBy("target").applyInPandas(receive, ddl), "suffixes")
    ends = sorted((r.id, r.side, bytes(r.edge)) for r in judged.where("edge is not null").select("id", "side", "edge").collect())  # two rows a partition
    patch = []
    for (_, _, a), (_, _, b) in zip(ends[1::2], ends[2::2], strict=False):
        if a[:1] == b[:1]:
            s = shared_from(a, b, 0) - 1
            for key in (a, b):
                size = len(halves(key)[0]) if key[:1] == b"R" else len(key) - 2
                patch.append((key[:1].decode(), identity(key), False, min(s, size), [], [], 0, None))
    return judged.where("edge is null").union(spark.createDataFrame(patch, ddl)).drop("edge")


def without(ranges: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """What of lo..hi the sorted ranges leave."""
    out = []
    for a, b in ranges:
        if a > lo:
            out.append((lo, min(hi, a - 1)))
        lo = max(lo, b + 1)
    out.append((lo, hi))
    return [(a, b) for a, b in out if a <= b]


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: list[str] = ()) -> DataFrame:
    """(id, n_bytes, low, high, kept, kept_sha256, kept_text, *carry) of every row: the maximal runs of
    bytes [low, high) that lie in a string of LENGTH bytes which also starts elsewhere, and the rest;
    kept_text is the rest as text, without the parts of characters that a run's end has cut.

    Null texts count as empty; texts shorter than LENGTH lose nothing. Repeated rows are texts of
    their own, so they lose all bytes if long enough. Texts are read whole, in memory in proportion to
    them. Rows with a null id are treated like others. Without ``keep_text``, kept is null where
    nothing is removed and kept_text is null (kept_sha256 always stands). Strings are judged on the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("raw"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("k"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    carried = [f"carry_{c}" for c in carry]
    found = stage(find_anchors(rows), "anchors")
    # written, so that the join's parts of a hot gram can be split
    often = stage(found.groupBy("gram").count().where("count > 1").select("gram"), "often")
    cand = found.join(often, "gram", "left_semi").groupBy("k", "size").agg(F.sort_array(F.collect_set("anchor")).alias("cand"))
    held = F.col("cand").isNotNull()
    joined = rows.join(cand, ["k", "size"], "left")
    base = stage(joined.select("id", "k", "size", "cand", *carried, (F.col("raw") if keep_text else F.when(held, F.col("raw"))).alias("raw"), F.when(~held, F.sha2("raw", 256)).alias("sha")), "candidates")
    some = base.where(held)
    n_anchors = some.agg(F.sum(F.size("cand"))).first()[0] or 0
    suffixes = sorted_suffixes(some, n_anchors)

    def name():
        def work(ks, sizes, raws, cands):
            out = {k: [] for k in ("k", "size", "p", "nearest", "farthest", "gram", "rid", "lid")}
            for k, size, raw, cand in zip(ks, sizes, raws, cands, strict=True):
                places = unpacked(cand)
                for (p, far, near), (right, left) in zip(places, keys_of(raw, places), strict=True):
                    gram = xxhash.xxh3_64_intdigest(raw[p : p + GRAM]) - (1 << 63)
                    for key, v in zip(out, (k, size, p, near, far, gram, identity(right), identity(left)), strict=True):
                        out[key].append(v)
            return out

        return work

    named = map_rows(some, ["k", "size", "raw", "cand"], "k long, size long, p long, nearest int, farthest int, gram long, rid long, lid long", name, rows=200)
    # written, so that the joins' parts of a hot suffix can be split
    sides = stage(suffixes.groupBy("side", "id").agg(*[F.max(c).alias(c) for c in ("twice", "best", "low", "high", "beyond")]), "sides")
    side = lambda s, key: sides.where(f"side = '{s}'").drop("side").withColumnRenamed("id", key)
    right = named.join(side("R", "rid"), "rid").where(f"twice or best + farthest >= {LENGTH}")
    left = side("L", "lid").select("lid", F.col("best").alias("back"))
    placed = right.join(left, "lid").select("k", "size", "p", "gram", "rid", "twice", F.when(F.col("twice"), F.col("nearest")).otherwise(F.greatest("nearest", LENGTH - F.col("best"))).alias("a"), F.when(F.col("twice"), F.col("farthest")).otherwise(F.least("farthest", "back")).alias("b"), "low", "high", "beyond")

    def split():
        def work(ks, sizes, ps, grams, rids, twice, los, his, lows, highs, beyonds):
            out = {k: [] for k in ("k", "size", "p", "gram", "rid", "a", "b", "sure_low", "sure_high", "open_low", "open_high")}
            for k, size, p, gram, rid, both, lo, hi, low, high, beyond in zip(ks, sizes, ps, grams, rids, twice, los, his, lows, highs, beyonds, strict=True):
                sure = [(lo, hi)] if both else [(max(a, lo), min(b, hi)) for a, b in zip(low, high, strict=True) if max(a, lo) <= min(b, hi)]
                rest = [] if both else without(sure, max(lo, LENGTH - beyond), hi)
                for key, v in zip(out, (k, size, p, gram, rid, lo, hi, [x for x, _ in sure], [x for _, x in sure], [x for x, _ in rest], [x for _, x in rest]), strict=True):
                    out[key].append(v)
            return out

        return work

    decided = stage(map_rows(placed.where("a <= b"), placed.columns, "k long, size long, p long, gram long, rid long, a int, b int, sure_low array<int>, sure_high array<int>, open_low array<int>, open_high array<int>", split), "decided")
    # written, so that the planner knows its size before it chooses the join
    span = stage(decided.where("size(open_low) > 0").groupBy("gram").agg(F.min(F.array_min("open_low")).alias("from"), F.max(F.array_max("open_high")).alias("to")), "spans")
    # one place of each suffix: at others the same strings stand
    one = decided.groupBy("rid").agg(F.min(F.struct("gram", "k", "size", "p", "a", "b", "open_low", "open_high")).alias("x")).select("x.*")
    watched = one.join(span, "gram").select("k", "size", "p", F.greatest("a", "from").alias("a"), F.least("b", "to").alias("b"), "open_low", "open_high").where("a <= b")
    questions = watched.select("k", "size", packed("p", "b", "a").alias("ask"), F.lit(None).cast("long").alias("open"))
    ranges = watched.select("k", "size", "p", F.explode(F.arrays_zip(F.col("open_low").alias("x"), F.col("open_high").alias("y"))).alias("z"))
    opens = ranges.select("k", "size", F.lit(None).cast("long").alias("ask"), packed("p", "z.y", "z.x").alias("open"))
    asked = questions.union(opens).groupBy("k", "size").agg(F.collect_list("ask").alias("ask"), F.collect_list("open").alias("open"))

    def strings():
        def work(ks, sizes, raws, asked, opens):
            out = {k: [] for k in ("k", "size", "s", "h1", "h2", "open")}
            for k, size, raw, ask, left in zip(ks, sizes, raws, asked, opens, strict=True):
                unsure = {p - d for p, far, near in unpacked(left) for d in range(near, far + 1)}
                for s in {p - d for p, far, near in unpacked(ask) for d in range(near, far + 1)}:
                    high, low = divmod(xxhash.xxh3_128_intdigest(raw[s : s + LENGTH]), 1 << 64)
                    for key, v in zip(out, (k, size, s, high - (1 << 63), low - (1 << 63), s in unsure), strict=True):
                        out[key].append(v)
            return out

        return work

    hashed = stage(map_rows(some.select("k", "size", "raw").join(asked, ["k", "size"]), ["k", "size", "raw", "ask", "open"], "k long, size long, s long, h1 long, h2 long, open boolean", strings, rows=50), "strings")
    again = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("h1", "h2")
    opened = hashed.where("open").join(again, ["h1", "h2"], "left_semi").select("k", "size", F.col("s").alias("lo"), (F.col("s") + LENGTH).alias("hi"))
    zipped = F.explode(F.arrays_zip(F.col("sure_low").alias("x"), F.col("sure_high").alias("y"))).alias("z")
    sure = decided.where("size(sure_low) > 0").select("k", "size", "p", zipped).select("k", "size", (F.col("p") - F.col("z.y")).alias("lo"), (F.col("p") - F.col("z.x") + LENGTH).alias("hi"))
    spans = sure.union(opened).groupBy("k", "size").agg(F.sort_array(F.collect_set(F.expr("shiftleft(lo, 20) | (hi - lo)"))).alias("spans"))

    def cut():
        def work(ids, sizes, raws, shas, spans, *rest):
            out = {k: [] for k in ("id", "n_bytes", "low", "high", "kept", "kept_sha256", "kept_text")}
            for i, size, raw, sha, found in zip(ids, sizes, raws, shas, spans, strict=True):
                low, high = [], []
                for a, n in ((code >> 20, code & 0xFFFFF) for code in found or []):
                    if high and a <= high[-1]:
                        high[-1] = max(high[-1], a + n)
                    else:
                        low.append(a)
                        high.append(a + n)
                parts = [] if raw is None else [raw[a:b] for a, b in zip([0, *high], [*low, len(raw)], strict=True)]
                rest_of = None if raw is None else b"".join(parts)
                text = "".join([p.decode("utf-8", "ignore") for p in parts]) if keep_text else None
                for key, v in zip(out, (i, size, low, high, rest_of if low or keep_text else None, sha if sha and not low else hashlib.sha256(rest_of).hexdigest(), text), strict=True):
                    out[key].append(v)
            return out | dict(zip(carried, rest, strict=True))

        return work

    kinds = dict(base.dtypes)
    more = "".join(f", {c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in carried)
    ddl = "id long, n_bytes long, low array<long>, high array<long>, kept binary, kept_sha256 string, kept_text string" + more
    touched = map_rows(some.join(spans, ["k", "size"], "left"), ["id", "size", "raw", "sha", "spans", *carried], ddl, cut, rows=200)
    none = F.array().cast("array<long>")
    clean = base.where(~held).select("id", F.col("size").alias("n_bytes"), none.alias("low"), none.alias("high"), F.col("raw").alias("kept"), F.col("sha").alias("kept_sha256"), (F.col("raw") if keep_text else F.lit(None)).cast("string").alias("kept_text"), *carried)
    named = {"id": id_col} | dict(zip(carried, carry, strict=True))
    return touched.union(clean).withColumnsRenamed(named)
