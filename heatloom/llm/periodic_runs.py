"""Runs of repeated word sequences in texts, by Lyndon roots from Baier's suffix grouping.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbouring word extends. Every run holds a
Lyndon root under an order of the words or under its reverse: the longest Lyndon word that starts at some place. The first phase of Baier's suffix sorter
finds these words directly: it takes groups of suffixes from the highest down, and each group lengthens the contexts of the
suffixes before it; the context with which a suffix is taken is its longest Lyndon prefix. Both orders' roots are then extended to both sides by the
longest common extensions of their two ends, found by binary search over prefix hashes, and compared word by word.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]  # start, length, period

PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_664_525_013)


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place; ranks give the order of the symbols.

    A group is a block of slots, named by its first slot, so that names grow with the order; suffixes that leave a group go to the end of its block.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ranks[order]) != 0)) if n else order
    after = np.append(first[1:], n)
    names = np.empty(n, np.int64)
    names[order] = np.repeat(first, after - first)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    group, slots, place = names.tolist(), order.tolist(), place_of.tolist()
    end, context = dict(zip(first.tolist(), after.tolist(), strict=True)), dict.fromkeys(first.tolist(), 1)
    before, lengths = [-1] * n, [1] * n
    high = n
    while high:
        low = group[slots[high - 1]]
        own = context[low]
        times: dict[int, int] = {}
        for i in sorted(slots[low:high]):
            lengths[i] = own
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moves = defaultdict(list)
        for j, k in times.items():
            moves[-k, group[j]].append(j)
        for less, g in sorted(moves):
            leaving = moves[less, g]
            last = end[g]
            s = last - len(leaving)
            longer = context[g] - less * own
            for slot, j in enumerate(leaving, s):
                other, free = slots[slot], place[j]
                slots[slot], slots[free] = j, other
                place[j], place[other] = slot, free
                group[j] = s
            end[g] = s
            end[s], context[s] = last, longer  # if the whole group leaves, its name stays
        high = low
    return np.array(lengths, np.int64)


class Prefixes:
    """Two hashes of each prefix of a sequence, for comparing stretches of it."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.hashes, self.powers = [], []
        for base in BASES:
            powers = np.ones(n + 1, np.uint64)
            done, step = 1, base
            while done <= n:
                powers[done : 2 * done] = powers[: min(done, n + 1 - done)] * np.uint64(step) % np.uint64(PRIME)
                done, step = 2 * done, step * step % PRIME
            terms = (ids.astype(np.uint64) + np.uint64(1)) % np.uint64(PRIME) * powers[:n] % np.uint64(PRIME)
            self.hashes.append((np.append(np.uint64(0), np.cumsum(terms)) % np.uint64(PRIME)).astype(np.int64))
            self.powers.append(powers.astype(np.int64))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of this length at i and at j >= i have equal hashes."""
        same = np.ones(len(i), bool)
        for h, powers in zip(self.hashes, self.powers, strict=True):
            same &= (h[i + length] - h[i]) % PRIME * powers[j - i] % PRIME == (h[j + length] - h[j]) % PRIME
        return same

    def extensions(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Length of the longest equal stretches that begin at i and j, or that end before them; at most `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def plain_run(ids: np.ndarray, at: int, period: int) -> Run:
    """The stretch of this period around a root, compared word by word."""
    differ = np.flatnonzero(ids[:-period] != ids[period:])
    k = int(np.searchsorted(differ, at))
    if k < len(differ) and differ[k] == at:
        stop = at
    else:
        stop = int(differ[k]) if k < len(differ) else len(ids) - period
    start = int(differ[k - 1]) + 1 if k else 0
    return start, stop - start + period, period


def maximal_runs(ids: np.ndarray, least_words: int = 2, least_exponent: int = 2) -> list[Run]:
    """(start, length, period) of the runs of a sequence of non-negative ids with at least so many words and periods, by start and period."""
    n = len(ids)
    if n < max(2, least_words):
        return []
    prefixes, found = Prefixes(ids), set()
    for ranks in (ids, ids.max() - ids):
        period = lyndon_lengths(ranks)
        i = np.flatnonzero(np.arange(n) + period < n)
        j = i + period[i]
        near = (ids[i] == ids[j]) | (ids[i - 1] == ids[j - 1]) & (i > 0)  # otherwise nothing extends the root
        i, j = i[near], j[near]
        ahead = prefixes.extensions(i, j, n - j, back=False)
        behind = prefixes.extensions(i, j, i.copy(), back=True)
        p = j - i
        length = ahead + behind + p
        whole = length >= np.maximum(least_words, least_exponent * p)
        found |= set(zip(i[whole].tolist(), (i - behind)[whole].tolist(), length[whole].tolist(), p[whole].tolist(), strict=True))
    runs = {}
    for at, start, length, period in found:
        runs.setdefault((start, length, period), at)
    exact = set()
    for (start, length, period), at in runs.items():
        if not np.array_equal(ids[start : start + length - period], ids[start + period : start + length]):  # two stretches with equal hashes
            start, length, period = plain_run(ids, at, period)
        if length >= max(least_words, least_exponent * period):
            exact.add((start, length, period))
    return sorted(exact, key=lambda r: (r[0], r[2]))


def gram_length(least_words: int, least_exponent: int) -> int:
    """The most consecutive words that every run surely has twice: any k words of a run of length L and period q stand in it q words later or earlier too, if L >= 2 * q + k - 1."""
    return min(max(least_words, least_exponent * q) - 2 * q + 1 for q in range(1, least_words + 2))


def runs_of_words(words: list[bytes], least_words: int = 6, least_exponent: int = 4) -> list[Run]:
    """The runs of a text's words. Words in no repeated gram of the text (see gram_length) lie in no run; the others, cut where there are gaps, are searched."""
    n, k = len(words), gram_length(least_words, least_exponent)
    if n < least_words or n < 2:
        return []
    # a hash takes part in no result: equal ones of different words only leave more to search
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    again = np.zeros(n + 1, np.int64)
    repeated = np.concatenate([order[1:][same], order[:-1][same]])
    repeated = np.unique(repeated)
    np.add.at(again, repeated, 1)
    np.add.at(again, repeated + k, -1)
    inside = np.cumsum(again[:n]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    pieces = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least_words]
    # one sequence of all pieces, with an id of its own between two of them, so that no run passes from one to the next
    known: dict[bytes, int] = {}
    ids, places = [], []
    for a, b in pieces:
        ids += [known.setdefault(w, len(known)) for w in words[a:b]]
        ids.append(known.setdefault(a, len(known)))  # a number is no word
        places += range(a, b + 1)
    return [(places[s], length, q) for s, length, q in maximal_runs(np.array(ids, np.int64), least_words, least_exponent)]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (the words outside repetitions, joined by one space) of every row of docs (doc_id, text).

    Words are what ASCII white space parts; texts are whole, and each is searched alone, so memory is that of the longest text. `rewrite` may change a row's words first.
    A null text is empty; texts without words have no runs and collapse to the empty text. Rows with null or repeated doc_id are rows like any other. Runs that tie in
    start differ in period. Other columns are ignored, so their names cannot clash; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            found, texts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or b"").split()
                words = rewrite(doc_id, words) if rewrite else words
                runs = runs_of_words(words, least_words, least_exponent)
                found.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]))
                texts.append(b" ".join(kept_words(words, runs)))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            columns = [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], kind), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    out = rows.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one text in ten, chosen by the checksum of its id, from a place on replaced by repeats of what stands there. A null id chooses none."""
    n = len(words)
    chosen, by = (zlib.crc32(str(doc_id).encode()) % 10 == 0, zlib.crc32(str(doc_id).encode()) // 10) if doc_id is not None else (False, 0)
    if not chosen or not n:
        return words
    a = by % n
    period = 1 + (n - a) // (3 + by % 8)
    block = words[a : a + period]
    return words[:a] + (block * (1 + (n - a) // len(block)))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls if there is none) and digests of the runs and of the collapsed text, of texts rewritten by with_repeats."""
    out = periodic_runs(docs, with_repeats)
    first = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"]).cast("int")).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    longest = out.withColumn("longest", F.get(first, F.lit(0)))
    best = {c: F.col("longest").getField(c) for c in ("start", "length", "period")}
    return longest.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[v.alias(c) for c, v in best.items()], F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
