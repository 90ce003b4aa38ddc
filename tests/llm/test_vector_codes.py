"""Vector codes against plain whole numbers, and on odd rows."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np

from heatloom.llm import vector_codes as codes


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label); vectors of a length that 4 divides."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e15 else int(x) * 1024 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 4
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))  # noqa: B023, B905, E731
    for _ in range(rounds):
        hits = [defaultdict(list) for _ in range(4)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                hits[p][near(p, x)[1]].append(x)
        for p in range(4):
            for k, xs in hits[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    total = defaultdict(int)
    for _, parts, label in found:
        total[label] += sum(d for d, _ in parts)
    top = 2**63 - 1
    return [(i, "".join(f"{k:02x}" for _, k in parts), min(top, sum(d for d, _ in parts)), min(top, total[label]), digest) for i, parts, label in found]


def same(df, rows, **more):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, codes.code_digests(df).collect()), key=key) == sorted(brute(rows, **more), key=key)


SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, own int, parts string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.1) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(420)]
    rows += [(900 + i, [round(rnd.gauss(0, 0.01), 2) for _ in range(8)], 7) for i in range(60)]  # many ties
    rows += [(5, rows[3][1], 1), (None, rows[4][1], None), (None, rows[4][1], None), (7000, rows[9][1], 2), (7000, rows[9][1], 2)]
    rows += [(8000, None, 1), (8001, [None] * 8, 1), (8002, [float("nan")] + [0.0] * 7, 1), (8003, [float("-inf")] + [0.0] * 7, 1), (8004, [-0.0] * 8, 1), (8005, [1e-300, -1e-300] * 4, 1)]
    same(frame(spark, rows), rows)


def test_few_rows_and_none(spark):
    rows = [(3, [0.5, -0.5, 0.25, 1.0], None), (1, [0.5, -0.5, 0.25, 1.0], 2), (2, [9.0, 1.0, 1.0, 1.0], 2)]
    same(frame(spark, rows), rows)
    assert codes.code_digests(frame(spark, rows).limit(0)).count() == 0
    assert codes.code_digests(frame(spark, [(1, None, 1)])).count() == 0
    assert codes.code_digests(frame(spark, [(1, [], 1)])).count() == 0
    # another length goes; a length that 4 doesn't divide is cut as equally as can be
    assert codes.code_digests(frame(spark, [*rows, (9, [1.0] * 5, 1)])).count() == 3
    assert codes.code_digests(frame(spark, [(1, [1.0] * 6, 1), (2, [2.0] * 6, 1)])).select("error").collect()[1].error == 0


def test_huge_components(spark):
    """Whole numbers that 64 bits can't hold are exact all the same."""
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([1.0, -3.5, 2.0**31, 2.0**52 + 1, -(2.0**70), 1e300, 0.1]) for _ in range(4)], i % 2) for i in range(300)]
    same(frame(spark, rows), rows)
    rows = [(i, [rnd.choice([1.0, -3.5, 1e5, -7e5, 2.0**21]) for _ in range(4)], i % 2) for i in range(300)]
    same(frame(spark, rows), rows)


def test_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 0.1) for _ in range(12)], 1) for i in range(300)]
    monkeypatch.setattr(codes, "AT_ONCE", 7)
    blocks = [codes.unpacked(*codes.packed(codes.scaled([v for _, v, _ in rows[a : a + 90]], 1024))) for a in range(0, 300, 90)]
    whole = codes.scaled([v for _, v, _ in rows], 1024)
    entries = whole[:50, :3].tolist()
    got = np.concatenate([codes.nearest_entries(d[:3], c[:3], entries)[0] for d, c in blocks])
    want = ((whole[:, None, :3] - whole[None, :50, :3]) ** 2).sum(2).argmin(1)
    assert got.tolist() == want.tolist()
    same(frame(spark, rows).repartition(7), rows)


def test_digits():
    for x in (0, 1, -1, 2**32, -(2**32), 2**32 - 1, 12345678901234567890, -(10**60)):
        assert sum(d << codes.DIGIT * k for k, d in enumerate(codes.digits(x))) == x


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = codes.code_digests(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    want = con.sql(codes.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
