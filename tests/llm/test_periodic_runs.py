"""Runs against their definition, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from heatloom.llm import periodic_runs as runs


def brute_runs(ids, least_words=2, least_exponent=2):
    found = {}
    n = len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least_words, least_exponent * q))


def brute_lyndon(ids):
    out = []
    for i in range(len(ids)):
        j = i + 1
        while j < len(ids) and ids[j:] > ids[i:]:
            j += 1
        out.append(j - i)
    return out


def sequences():
    rnd = random.Random(3)
    for size in (2, 3, 5):
        for _ in range(150):
            yield [rnd.randrange(size) for _ in range(rnd.randint(1, 60))]
    for _ in range(100):
        part = [rnd.randrange(3) for _ in range(rnd.randint(1, 9))]
        more = part * rnd.randint(2, 9)
        yield [rnd.randrange(4) for _ in range(rnd.randint(0, 6))] + more[: rnd.randint(1, len(more))] + [rnd.randrange(4) for _ in range(rnd.randint(0, 6))]
    a, b = [0], [0, 1]
    for _ in range(8):
        a, b = b, b + a
        yield b


def test_lyndon_lengths():
    for ids in sequences():
        assert runs.lyndon_lengths(np.array(ids)).tolist() == brute_lyndon(ids)


@pytest.mark.parametrize("least", [(2, 2), (6, 4), (5, 3)])
def test_runs(least):
    for ids in sequences():
        want = brute_runs(ids, *least)
        assert runs.maximal_runs(np.array(ids), *least) == want
        assert runs.runs_of_words([str(x).encode() for x in ids], *least) == want


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(runs.Prefixes, "equal", lambda self, i, j, length: np.ones(len(i), bool))
    for ids in sequences():
        assert set(runs.maximal_runs(np.array(ids), 6, 4)) <= set(brute_runs(ids, 6, 4))


def test_long_text():
    words = [str(i % 7).encode() for i in range(300_000)] + [b"x"] + [b"y"] * 100_000
    assert runs.runs_of_words(words) == [(0, 300_000, 7), (300_001, 100_000, 1)]
    assert runs.kept_words(words, runs.runs_of_words(words)) == [b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"x", b"y"]


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 6, 4)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * longest[1] // longest[2] if found else None
    return (doc_id, len(found), *longest, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_query(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b c a b", "é é é é é é é 漢 漢", "a\x0ba\x0ca\ra\na\ta a", "ab\xa0ab ab\xa0ab ab\xa0ab ab\xa0ab ab\xa0ab ab\xa0ab"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90))) for _ in range(120)]
    rows = [(i, t, 1, [2], "x") for i, t in enumerate(texts)] + [(None, "a a a a a a a", 1, [2], "x"), (5, "a a a a a a", 1, [2], "x"), (5, "a a a a a a", 1, [2], "x"), (-3, texts[-1], 1, [2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, runs array<int>, collapsed string")
    got = runs.run_digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + tuple(r[-2:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    assert runs.run_digests(df.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    assert sorted(map(tuple, runs.run_digests(real).collect()), key=key) == sorted((brute_row(r.doc_id, r.text) for r in real.collect()), key=key)
