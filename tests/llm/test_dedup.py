import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import components, exact_dedup, ngram_join, skew, substring_dedup


def words(n, seed, size=40):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


EXACT = [(1, "Same"), (2, "sAME"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "alone"), (None, "same"), (10, "ÉA"), (11, "Éa")]


def test_exact_dedup_equals_definition(table):
    out = {r["doc_id"]: r for r in exact_dedup.deduplicate(table(EXACT)).collect()}
    assert len(out) == len(EXACT)
    for i, text in EXACT:
        group = [j for j, t in EXACT if low(t) == low(text)]
        keep = max(j for j in group if j is not None)
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (keep, len(group), i == keep)
        assert out[i]["text_sha256"] == hashlib.sha256(low(text).encode()).hexdigest()


@pytest.mark.parametrize("hot, weak", [(1_000, False), (1, False), (1, True)])
def test_exact_dedup_judges_rows(table, monkeypatch, spark, tmp_path, hot, weak):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = [(5, "one"), (5, "ONE"), (5, "two"), (4, "two"), (9, "two"), (None, "three"), (None, "three"), (None, "one"), (3, None), (2, ""), (7, "four")] + [(i, "many") for i in range(20, 30)]
    table(rows).write.parquet(str(tmp_path / "docs"))
    digest = (lambda t: F.substring(F.sha2(F.substring(t, 1, 1), 256), 1, 4)) if weak else exact_dedup.sha256_digest
    for docs in (table(rows), spark.read.parquet(str(tmp_path / "docs"))):
        out = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(docs, digest=digest).collect()]
        same = lambda t: [i for i, x in rows if low(x) == low(t)]
        want = [(i, max((j for j in same(t) if j is not None), default=None), len(same(t))) for i, t in rows]
        assert sorted(map(str, out)) == sorted(str((*w, w[0] == w[1])) for w in want)
    if not weak:
        assert all("#" in r["keep_locator"] for r in exact_dedup.deduplicate(docs).collect())
        assert sorted(str((r["doc_id"], low(r["text"]))) for r in exact_dedup.keep_one(docs).collect()) == sorted(map(str, [(5, "one"), (9, "two"), (None, "three"), (3, ""), (7, "four"), (29, "many")]))


def test_exact_dedup_compares_bytes_on_equal_digests(table):
    weak = lambda text: F.substring(F.sha2(F.substring(text, 1, 1), 256), 1, 4)
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(table([(1, "ab"), (2, "ac"), (3, "AB"), (4, "zz")]), digest=weak).collect()}
    assert out == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_dedup_keeps_state_over_batches(spark, tmp_path, table):
    prints = exact_dedup.fingerprints(table([(1, "a"), (2, "b")]))
    for rows in ([(1, "a"), (2, "b")], [(3, "A"), (0, "b")], [(9, "c")]):
        exact_dedup.fingerprints(table(rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        exact_dedup.run_stream(spark.readStream.schema(prints.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), str(tmp_path / "out"))
    state = {(r["keep_id"], r["group_size"]) for r in exact_dedup.keyed_state(spark, str(tmp_path / "out")).collect()}
    assert state == {(3, 2), (2, 2), (9, 1)}


def test_exact_dedup_empty(table):
    assert exact_dedup.deduplicate(table([])).count() == 0
    assert {r["doc_id"] for r in exact_dedup.keep_one(table(EXACT)).collect()} == {2, 4, 5, 6, 8, 9, 11}


def shingles(text, k):
    w = low(text).split(" ") if text else []
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent, k):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_rows(seed):
    r = random.Random(seed)
    rows = []
    for base in range(6):
        w = words(60 + 20 * base, seed * 100 + base, 500)
        for _ in range(5):
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = f"z{r.randrange(99)}"
            rows.append(" ".join(v))
    rows += [None, "", " ", "a b", "A  B", "a b c", "one two three four five", rows[0], rows[0].upper()]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, hot", [(1, 64), (2, 2), (3, 3)])
def test_ngram_join_equals_brute_force(table, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = near_rows(seed)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(table(rows)).collect()}
    assert out == brute_components(rows, 80, 5)


def test_ngram_join_blocks_and_shuffled_sides(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = near_rows(4)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(table(rows)).collect()}
    assert out == brute_components(rows, 80, 5)


def test_ngram_join_empty(table):
    assert ngram_join.near_duplicates(table([])).count() == 0


def test_divide_skip_equals_counting():
    r = np.random.default_rng(5)
    for _ in range(200):
        lists = [np.sort(r.choice(40, size=r.integers(0, 30), replace=False)).astype(np.int64) for _ in range(r.integers(1, 12))]
        need = int(r.integers(1, 6))
        for long_lists in (None, 0, 1, 3):
            got = ngram_join.divide_skip(lists, need, long_lists=long_lists)
            assert got.tolist() == [v for v in range(40) if sum(v in x for x in lists) >= need]


def test_occurrences_is_a_lower_bound():
    r = random.Random(6)
    linked = 0
    for _ in range(3000):
        m = r.randrange(1, 300)
        n = r.randrange(max(1, 8 * m // 10), m + 1)
        both = r.randrange(max(1, 8 * m // 10), n + 1)
        x, y = set(range(n)), set(range(n - both, n - both + m))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        linked += 1
        order = list(x | y)
        r.shuffle(order)
        low = ngram_join.EDGES[int(ngram_join.band(n))]
        short = {t for t in [t for t in order if t in x][: ngram_join.listed_prefix(n)]}
        long = {t for t in [t for t in order if t in y][: ngram_join.asking_prefix(m, low)]}
        need = ngram_join.occurrences(n, m)
        assert len(short & long) >= need and (need >= 2 or m < 10)
    assert linked > 300


def test_sets_just_below_the_threshold_hardly_meet(spark, table, monkeypatch):
    body = words(176, 1, 10_000)
    rows = [(i, " ".join(body[:120] + [f"u{i}-{j}" for j in range(22)] + body[120:])) for i in range(300)]
    asked, rays = [], []
    star = ngram_join._rays
    monkeypatch.setattr(ngram_join, "_rays", lambda *a: rays.append(star(*a)) or rays[-1])
    search = ngram_join._search
    monkeypatch.setattr(ngram_join, "_search", lambda rows, percent: asked.append(rows.count()) or search(rows, percent))
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table(rows)).collect()}
    assert out == {i: i for i in range(300)} and asked == [0] and rays[0].isEmpty()


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 10), (7, 7), (20, 21), (21, 22), (22, 20), (None, 3)]
    found = {(r["node"], r["component"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {(2, 2), (3, 2), (4, 2), (5, 2), (10, 10), (11, 10), (20, 20), (21, 20), (22, 20)}
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert {r["component"] for r in components.components(chain).collect()} == {0}


@pytest.mark.parametrize("window", [2, 5, 8])
def test_substring_dedup_equals_brute_force(table, monkeypatch, window):
    r = random.Random(window)
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rows = [(i, " ".join(words(r.randrange(0, 60), r.randrange(12), 6))) for i in range(40)] + [(50, None), (51, ""), (52, "a  b\tc\n" * 20), (53, "A b c " * 20)]
    rows += [(5, rows[7][1]), (5, "short other text"), (5, None), (41, rows[3][1]), (41, rows[3][1]), (None, rows[3][1]), (None, "a b"), (-1, rows[8][1])]
    out = [tuple(x) for x in substring_dedup.digest(substring_dedup.remove_repeated(table(rows), window)).collect()]
    assert sorted(map(str, out)) == sorted(map(str, substring_dedup.brute_force(rows, window)))


def test_substring_dedup_null_ids_and_empty(table):
    text = " ".join(map(str, range(60)))
    out = substring_dedup.digest(substring_dedup.remove_repeated(table([(1, text), (2, text), (None, text)]))).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in out) == [(0, 0), (1, 0), (2, 60)]
    assert substring_dedup.remove_repeated(table([])).count() == 0
