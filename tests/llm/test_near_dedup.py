"""Near duplicates against all pairs of full sets."""
import random
import re

import numpy as np
import pytest

from settlegrid.llm import near_dedup as N


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing every pair of documents."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        width = min(5, len(words))
        sets[doc] = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, families=25, size=12):
    r = random.Random(seed)
    pool = ["w%d" % i for i in range(400)]
    passage = [r.choice(pool) for _ in range(60)]
    rows, doc = [], 0
    for _ in range(families):
        base = [r.choice(pool) for _ in range(r.choice([3, 6, 12, 40, 150, 500]))]
        if r.random() < 0.5:
            base = base[:len(base) // 2] + passage + base[len(base) // 2:]
        for _ in range(r.randint(1, size)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, len(words) // 60, len(words) // 30, len(words) // 25])):
                words[r.randrange(len(words))] = r.choice(pool)
            rows.append((doc, (" " if r.random() < 0.5 else "\n").join(words)))
            doc += 1
    return rows + [(doc, ""), (doc + 1, None), (doc + 2, " \t\n"), (doc + 3, "One two"), (doc + 4, "one TWO")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_one_large_family_of_copies_of_copies(spark):
    r = random.Random(5)
    words = ["w%d" % r.randrange(3000) for _ in range(160)]
    rows = []
    for doc in range(300):
        copy = list(words)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(160)] = "x%d" % r.randrange(10 ** 6)
        rows.append((doc, " ".join(copy)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_short_families_of_several_lengths(spark):
    r = random.Random(3)
    rows = []
    for family in range(200):  # a text of 28-32 words, the same with a word more, and that with its second word changed
        words = ["f%dw%d" % (family, i) for i in range(r.choice([28, 28, 28, 30, 32]))]
        more = words + ["more%d" % family] * r.randint(1, 4)
        rows += [" ".join(x) for x in (words, more, more[:1] + ["other"] + more[2:])]
    rows = list(enumerate(rows))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_similar_sets_of_few_values_share_a_list(spark):
    """Sets of 21-42 values, at least one of them wholly listed, among others that make values of one side common."""
    r = random.Random(4)
    rows, pairs = [], []
    for _ in range(300):
        n = r.randint(21, 42)
        big = [r.randrange(1, 2 ** 60) for _ in range(n)]
        least = -(-3 * n // 4)
        small = r.sample(big, min(32, r.choice([least, n - 1])))
        extra = [x for x in big if x not in small] + [r.randrange(1, 2 ** 60) for _ in range(40)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, len(s), sorted(s)[:N.LISTED]) for i, s in enumerate((small, big, extra))]
    lists = {}
    for x in N.inverted_lists(spark.createDataFrame(rows, "rep long, n long, listed array<long>")).collect():
        lists.setdefault(x.rep, set()).add(x.v)
    assert all(lists[a] & lists[b] for a, b in pairs)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (2, "a b c d e f g", None, 2), (None, "a b c d e f g", "y", 3),
            (3, None, None, None), (4, "", "z", 0), (5, "q r s t u", "z", 0), (5, "k l m n o p", "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n long")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_components(docs).collect())
    assert got == sorted([("1", 3, 1, True), ("1", 3, 1, True), ("2", 3, 1, False), ("None", 3, None, True), ("3", 0, 3, True),
                          ("4", 0, 4, True), ("5", 1, 5, True), ("5", 2, 5, True)])
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert N.near_components(docs.limit(0)).count() == 0


def test_spared_values_leave_a_shared_one():
    assert N.spare_values(20, True) == 14
    r = np.random.default_rng(0)
    assert (r.binomial(32, 0.75, 200_000) > N.spare_values(32, False)).all()
