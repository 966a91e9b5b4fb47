"""Near-duplicates against all pairs of whole shingle sets."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from wavemill.llm import minhash


def shingles(text, n=5):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (n_shingles, component_id) by links between all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i) if i is not None else least[r]
    return [(i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)]


def rows_of(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=key), key


def test_against_all_pairs(docs, corpus):
    got = minhash.near_duplicates(docs)
    rows, key = rows_of(got)
    assert rows == sorted(brute(corpus), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


@pytest.mark.parametrize("seed", range(2))
def test_many_groups_near_the_threshold(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(25):
        base = [f"t{rng.integers(10**6)}" for _ in range(rng.integers(20, 120))]
        for _ in range(rng.integers(1, 14)):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, key = rows_of(minhash.near_duplicates(df))
    assert got == sorted(brute(rows), key=key)


def test_second_round_links_what_stars_miss(spark, monkeypatch):
    """Without the first round's stars all links must come from the bucket-wise comparison."""
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 4)  # buckets of several blocks
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for k in range(1, 15):  # a chain: only neighbours are alike
        base = base[:]
        base[5 * k : 5 * k + 2] = [f"c{k}a", f"c{k}b"]
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got, key = rows_of(minhash.near_duplicates(df))
    assert got == sorted(brute([(int(i), t) for i, t in rows]), key=key)


def just_below(size, rng):
    """A group of which most pairs look similar and are not, with three copies of one member that are."""
    base, rows = [f"t{k}" for k in range(1000)], []
    for k in range(size):
        copy = list(base)
        for at in rng.integers(0, len(copy), 18):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy)))
    return rows + [(size + k, f"{rows[7 * k][1]} end") for k in range(3)]


def test_a_group_below_the_threshold_makes_no_row_for_each_pair(spark, monkeypatch):
    """Rows that are made of pairs grow with the members, not with their square."""
    monkeypatch.setattr(minhash, "GROUP", 64, raising=False)  # several blocks
    made, saved = {}, minhash.Scratch.save

    def save(self, df, name, *more):
        out = saved(self, df, name, *more)
        if name.startswith(("tested", "groups-edges", "edges")):
            made[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "save", save)
    rows = just_below(200, np.random.default_rng(8))
    got, key = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(brute(rows), key=key) and len({c for _, _, c in got}) > 100
    assert max(made.values()) < 20 * len(rows) < len(rows) ** 2 / 8, made


@pytest.mark.parametrize("group, size", [(2, 10**9), (10**9, 900), (10**9, 10**9)])
def test_blocks_of_a_group_join_all_components(spark, monkeypatch, group, size):
    """Nothing but the groups' blocks links, whatever their size, also those of a large component."""
    monkeypatch.setattr(minhash, "GROUP", group)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", size)
    rng = np.random.default_rng(5)
    rows = just_below(30, rng)
    near = rows[0][1].split()
    for k in range(12):
        near[30 * k] = f"n{k}"
        rows.append((100 + k, " ".join(near)))  # a chain from one member
    texts = spark.createDataFrame(rows, "sid long, text string")
    for labels in ({i: i for i, _ in rows}, {i: 100 if 100 <= i < 108 else i for i, _ in rows}):
        groups = spark.createDataFrame([(1, i, labels[i], len(shingles(t))) for i, t in rows], "group long, sid long, label long, n_shingles long")
        found = [(r.a, r.b) for r in minhash._joined(groups, texts, 5, 75, 100).collect()]
        parent = {i: i for i in set(labels.values())}

        def find(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in found:
            parent[find(labels[a])] = find(labels[b])
        by_root = {}
        for i, _ in rows:
            by_root.setdefault(find(labels[i]), set()).add(i)
        want = {}
        for i, _, c in brute(rows):
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_repeats_nulls_and_empty(spark, nothing):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text.upper()), (None, "else"), (3, None), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([("None", 3, 7, False), ("7", 3, 7, True), ("7", 3, 7, True), ("9", 3, 7, False), ("None", 1, None, True), ("3", 0, 3, True), ("None", 0, None, True)])
    assert sorted(str(r.doc_id) for r in minhash.keep_first(df).collect()) == ["3", "7", "None", "None", "None"]
    assert minhash.near_duplicates(nothing).collect() == []


def test_sets_of_words(corpus):
    """Column-wise sets have as many shingles as plain ones, and share as many."""
    texts = [t or "" for _, t in corpus] + ["a", " a ", "a b c d", "a b c d e", "A B C D E f", "", "x\x0by\x1cz"]
    got = minhash.shingle_sets(pa.array(texts))
    plain = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(x) for x in plain]
    for (a, x), (b, y) in itertools.combinations(list(zip(got, plain))[::3], 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_classes_that_share_a_node_part(spark, docs, corpus, monkeypatch):
    """With a hash of nodes that collides nearly always, results are the same."""
    hashed, calls = minhash.F.xxhash64, []

    def poor(*cols):
        if cols[:1] != ("digest",):
            return hashed(*cols)
        calls.append(cols)
        return minhash.F.pmod(hashed(*cols), minhash.F.lit(3)) if len(calls) < 3 else hashed(*cols)

    monkeypatch.setattr(minhash.F, "xxhash64", poor)
    rows, key = rows_of(minhash.near_duplicates(docs))
    assert rows == sorted(brute(corpus), key=key) and len(calls) > 2


def test_rows_without_ids_meet_their_own_text_only(spark):
    rows = [(None, f"{k} " + " ".join(f"w{k % 40}x{j}" for j in range(40))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, key = rows_of(minhash.near_duplicates(df))
    assert got == sorted(brute(rows), key=key)


def test_recall_on_the_test_table(spark, data):
    """Of all links of an exact join none is lost: components are equal on the whole table."""
    path = f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    holders, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    shared = {}
    for ids in holders.values():
        for pair in itertools.combinations(sorted(ids), 2):
            shared[pair] = shared.get(pair, 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len(links) > 50 and got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate((a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)))
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
