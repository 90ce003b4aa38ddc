"""Components of similar texts against all pairs, and on odd rows."""

import random

import duckdb
import numpy as np
import pytest

from heatloom.llm import jaccard_join, shingle_sets

RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def brute(rows, k=5, percent=80):
    sets = []
    for _, text in rows:
        words = bytes((text or "").encode()).lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    n = len(rows)
    near = [[x is y or bool(x and y) and 100 * len(x & y) >= percent * len(x | y) for y in sets] for x in sets]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            more = [j for j in range(n) if near[todo[-1]][j] and j not in seen]
            todo.pop()
            seen.update(more)
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return out


def same(spark, rows):
    df = spark.createDataFrame([(i, t, 5, [1], 2) for i, t in rows], "doc_id bigint, text string, size int, prefix array<int>, node int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, jaccard_join.similar_components(df).collect()), key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    base = prose(120)
    rows = list(enumerate([None, "", " \n", "a", "A", "a b", "a b c d", "A b c d", "a b c d e", "a\x0bb\x0cc\rd\ne", base, base.upper(), base + " more", base.replace(base.split()[60], "x", 1), "É b c d e", "é b c d e", "ab " * 9_000, "ab " * 50, prose(30_000)]))
    rows += [(None, base), (None, "z z z"), (None, ""), (10, base), (10, base), (10, prose(9)), (-7, rows[-1][1])]
    same(spark, rows)
    assert jaccard_join.similar_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def families(rnd, n, copies):
    texts = []
    for _ in range(n):
        words = prose(rnd.randint(4, 200), rnd).split()
        for _ in range(copies):
            copy = list(words)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                copy += [rnd.choice(WORDS) for _ in range(rnd.randint(0, len(words) // 3))]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("few", "block", "piece"), [(12, 512, 4_096), (1, 8, 16), (3, 5, 1)])
def test_against_all_pairs(spark, monkeypatch, few, block, piece):
    """Whether pairs are joined or cells are compared in blocks, whose sets come whole or in pieces, the components are those of all pairs."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(shingle_sets, "PIECE", piece)
    rnd = random.Random(12)
    texts = families(rnd, 25, 5) + families(rnd, 2, 30)
    passage = prose(40, rnd)  # one that many share
    texts += [f"{passage} {prose(n, rnd)}" for n in (1, 2, 5, 9, 12, 30, 50) for _ in range(5)]
    same(spark, list(enumerate(texts)))


def test_at_the_threshold(spark):
    """Pairs with exactly 80 in 100, and with a shingle less."""
    new = lambda n: [f"w{RND.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in (4, 8, 40, 400):
        base = new(n + 4)
        rows += [" ".join(base), " ".join(base + new(n // 4)), " ".join(new(n // 4 + 1) + base)]
    same(spark, list(enumerate(rows)))


def test_dense_groups_hold_one_range(spark):
    """Very long texts of a dense cell are compared range by range: no piece is much longer than asked for."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120_000)]
    texts = []
    for n in range(20):
        copy = list(base)
        for at in range(0, len(copy), 27 if n % 4 == 0 else 60 if n % 2 == 0 else 4_000):
            copy[at] = f"x{n}"
        texts.append(" ".join(copy))
    rows = [(1, 0, 0, node, t, 120_000) for node, t in enumerate(texts)]
    dealt = spark.createDataFrame(rows, "cell bigint, i int, j int, node bigint, text string, most bigint")
    grams = shingle_sets.grams_of(texts[0], 5)
    bits = (-(-120_000 // shingle_sets.PIECE) - 1).bit_length()
    longest = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64)).max()
    assert longest < 1.2 * shingle_sets.PIECE
    found = shingle_sets.dense_links(dealt, 5, 80).collect()
    linked = {1}
    for _ in range(20):
        linked |= {x for r in found for x in (r.a, r.b) if r.a in linked or r.b in linked}
    sets = [set(shingle_sets.grams_of(t, 5).tolist()) for t in texts]
    want = {1}
    for _ in range(20):
        want |= {j for i in want for j in range(20) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked == want and len(want) == 15


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(jaccard_join.ORACLE)
    got = jaccard_join.similar_components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
