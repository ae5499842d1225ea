import random
import re

import numpy as np

from tracewell.llm import shingles

from .oracle import same

DDL = "doc_id long, text string, id string, key string, part string, a long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {}
    for r in rows:
        sets[r[0]] = shingle_set(r[1])
    ids = [i for i in sets if i is not None and sets[i]]
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if 100 * len(a & b) >= percent * len(a | b):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((r[0], len(shingle_set(r[1])), root(r[0]), root(r[0]) == r[0] or r[0] is None) for r in rows), key=repr)


def test_against_sql(spark):
    assert same(spark, "op2_forest") == 1000


def test_groups_and_odd_rows(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "ñ'x", "a-b"]
    text = lambda n: random.choices(vocabulary, k=n)
    rows, n = [], 0
    for size in (1, 1, 1, 2, 2, 3, 5, 8, 60):
        base = text(150)
        for _ in range(size * 2):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = "Edit" + str(random.randrange(10**6))
            rows.append((n, " ".join(w), "x", "y", "z", 1))
            n += 1
    rows += [(n + i, "  ".join(text(200)), None, None, None, None) for i in range(150)]
    n += 150
    rows += [(n, None, None, None, None, None), (n + 1, "", None, None, None, None), (n + 2, " \t\n ", None, None, None, None), (n + 3, "Two words", None, None, None, None), (n + 4, "two\nWORDS", None, None, None, None), (n + 5, " ".join(text(20_000)), None, None, None, None), (n + 6, "same same same same same same", None, None, None, None)]
    rows += [rows[0], rows[0]]
    got = shingles.near_texts(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_and_null_ids(spark):
    assert shingles.near_texts(spark.createDataFrame([], DDL)).count() == 0
    rows = [(None, "one two three", None, None, None, None), (3, "one two three", None, None, None, None)]
    assert {tuple(r) for r in shingles.near_texts(spark.createDataFrame(rows, DDL)).collect()} == {(None, 1, None, True), (3, 1, 3, True)}


def slots(n, planted, count, apart):
    """Choices of one of two words in each slot of a template: two rows differ in about half of the slots,
    row n + i differs from row i in ``apart``. All shingles are common, none is of one pair alone."""
    rng = np.random.default_rng(11)
    chosen = rng.integers(0, 2, (n, count))
    more = chosen[:planted].copy()
    for row in more:
        row[rng.choice(count, apart, replace=False)] ^= 1
    return np.concatenate([chosen, more])


def slot_groups(chosen, percent):
    """The least row of each row's component: rows that differ in d slots have 10 x count - 4 shingles each, 5 d of them apart."""
    n, (rows, count) = 10 * chosen.shape[1] - 4, chosen.shape
    links = []
    for i in range(rows):
        d = 5 * (chosen[i + 1 :] != chosen[i]).sum(axis=1)
        links += [(i, i + 1 + int(j)) for j in np.flatnonzero(100 * (n - d) >= percent * (n + d))]
    return groups(rows, links), len(links)


def linked_in_template(spark, percent, apart):
    chosen = slots(3000, 60, 48, apart)
    fixed = [[f"s{k}w{j}" for j in range(9)] for k in range(48)]
    # the slot stands amid its ten words, so that five shingles hold it
    text = lambda row: " ".join(" ".join([*fixed[k][:5], f"s{k}o{o}", *fixed[k][5:]]) for k, o in enumerate(row))
    frame = spark.createDataFrame([(i, text(r), None, None, None, None) for i, r in enumerate(chosen)], DDL)
    got = {r.doc_id: r.component_id for r in shingles.near_texts(frame, percent=percent).collect()}
    want, links = slot_groups(chosen, percent)
    missing = sum(got[i] != want[i] for i in range(len(want)))
    assert links >= 60
    return missing, links


def test_pairs_within_a_large_template(spark):
    missing, links = linked_in_template(spark, 85, 7)
    assert missing == 0, (missing, links)


def test_blocks_compare_every_pair():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(40), rng.randint(20, 40))) for _ in range(60)]
    raw = [np.array(s, np.uint64).tobytes() for s in sets]
    similar = lambda i, j: 100 * len(set(sets[i]) & set(sets[j])) >= 70 * len(set(sets[i]) | set(sets[j]))
    for right in (0, 20):
        pairs = [(i, j) for i in range(60) for j in range(i) if (not right or j < right <= i) and similar(i, j)]
        got = shingles.link_block(list(range(60)), list(range(60)), raw, right, 70)
        assert all(similar(*p) for p in got) and groups(60, got) == groups(60, pairs)


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        a, b = label[a], label[b]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label
