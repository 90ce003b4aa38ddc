"""Sets of word shingles as sorted hashes, bounds on how far two sets are apart, and the comparison of many sets with one another in blocks of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments of hashes: about one for SHARE shingles, a power of two; sets of different sizes are compared by the lesser number.
SHARE, LEAST_SEGMENTS, MOST_SEGMENTS = 4, 64, 4_096
#: Hashes of one set that stand in one row when sets are compared in blocks.
PIECE = 4_096


def gram_set(words: list[bytes], k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles, in order; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = max(1, len(words) - k + 1)
    mixed = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(len(words), k)):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def grams_of(text: str | None, k: int) -> np.ndarray:
    return gram_set((text or "").encode().lower().split(), k)


def segment_counts(grams: np.ndarray) -> np.ndarray:
    """The number of shingles in each segment of the hashes (by their leading bits)."""
    bits = min(max(int(len(grams) // SHARE).bit_length(), LEAST_SEGMENTS.bit_length() - 1), MOST_SEGMENTS.bit_length() - 1)
    found = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(found, 65_535).astype("<u2")  # what is cut off makes distances smaller, so they stay a bound


def folded(counts: np.ndarray, segments: int) -> np.ndarray:
    """Counts of fewer, larger segments."""
    return counts.astype(np.int64).reshape(segments, -1).sum(1)


def may_be_similar(x: bytes, y: bytes, size_x: int, size_y: int, similarity: float) -> bool:
    """False if the Manhattan distance shows that two sets are further apart than `similarity` allows."""
    a, b = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
    n = min(len(a), len(b))
    return np.abs(folded(a, n) - folded(b, n)).sum() <= (size_x + size_y) * (1 - similarity) / (1 + similarity) + 1e-6


def near_somebody(counts: list[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """True for each set for which the Manhattan distance doesn't rule out a similar one in the list."""
    table = np.array([folded(np.frombuffer(c, "<u2"), LEAST_SEGMENTS) for c in counts], np.float32)
    near = np.zeros(len(counts), bool)
    for k in range(0, len(counts), 32):
        apart_by = np.abs(table[k : k + 32, None, :] - table[None, :, :]).sum(2)
        close = apart_by <= (sizes[k : k + 32, None] + sizes[None, :]) * (1 - similarity) / (1 + similarity) + 1e-3
        close[np.arange(len(close)), np.arange(k, k + len(close))] = False
        near[k : k + 32] = close.any(1)
    return near


def add_common(common: np.ndarray, owner: np.ndarray, grams: np.ndarray) -> None:
    """Adds to common[a, b] the shingles that a and b share; owner and grams: the sets' members, each once for an owner."""
    kinds, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    keep = times[column] > 1 if len(kinds) else np.zeros(0, bool)
    if not keep.any():
        return
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1, 4_096):
        low, high = np.searchsorted(column, [a, a + 4_096])
        part = np.zeros((len(common), 4_096), np.float32)
        part[owner[low:high], column[low:high] - a] = 1
        common += (part @ part.T).astype(common.dtype)


def forest(near: np.ndarray) -> np.ndarray:
    """Label of each node: the first one that it reaches over a symmetric table of links."""
    np.fill_diagonal(near, True)
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1, initial=n)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks_of(cells: DataFrame, member: str, block: int) -> DataFrame:
    """cells (cell, member, n: members of the cell) dealt to pairs (i, j) of blocks of about `block` members, chosen by hash: any two members of a cell meet in one."""
    many = cells.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = many.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "blocks", "own", "other")


def dense_links(dealt: DataFrame, k: int, percent: int, piece: int | None = None) -> DataFrame:
    """a, b: links that connect the similar ones (100 * common >= percent * union) among the nodes of each (cell, i, j) of dealt (cell, i, j, node, text, most: shingles of the cell's largest set, or words).

    Sets travel in pieces: all sets of a cell are cut at the same places of the hashes' range, so finely that a piece has about `piece` hashes. A task sorts
    its rows by group and range, reads them as a stream and keeps one range of one group, the numbers of common shingles and no text. A group returns a forest, not its pairs.
    """
    piece = piece or PIECE

    def cut(batches):
        for batch in batches:
            for cell, i, j, node, text, most in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "node", "text", "most")), strict=True):
                grams = grams_of(text, k)
                bits = max(0, -(-most // piece) - 1).bit_length()
                ends = np.searchsorted(grams, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                parts = np.split(grams, ends)
                n = len(parts)
                rows = [[cell] * n, [i] * n, [j] * n, list(range(n)), [node] * n, [len(grams)] * n]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(r, t) for r, t in zip(rows, kinds, strict=True)), pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())], ["cell", "i", "j", "range", "node", "size", "grams"])

    def link(batches):
        for key, ranges in groups(batches):
            nodes, sizes, common = [], np.zeros(0, np.int64), None
            for owners, own_sizes, parts in ranges:
                if common is None:  # every set has a piece of every range, so the first one names them all
                    nodes, sizes = owners, np.array(own_sizes, np.int64)
                    place = {node: at for at, node in enumerate(nodes)}
                    common = np.zeros((len(nodes), len(nodes)), np.int32)
                add_common(common, np.repeat([place[o] for o in owners], [len(p) // 8 for p in parts]), np.frombuffer(b"".join(parts), "<u8"))
            label = forest((100 + percent) * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :]))
            off, ids = label != np.arange(len(label)), np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[label[off]])], ["a", "b"])

    pieces = dealt.select("cell", "i", "j", "node", "text", "most").mapInArrow(cut, "cell bigint, i int, j int, range int, node bigint, size bigint, grams binary")
    sorted_pieces = pieces.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "range", "node")
    return sorted_pieces.mapInArrow(link, "a bigint, b bigint")


def groups(batches) -> Iterator[tuple[tuple, Iterator[tuple[list, list, list]]]]:
    """The (cell, i, j) of sorted rows, each with its ranges: nodes, sizes and pieces. A group's ranges are to be read before the next group."""
    names = ("cell", "i", "j", "range", "node", "size", "grams")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    row = next(rows, None)

    def ranges(key):
        nonlocal row
        while row is not None and row[:3] == key:
            at, nodes, sizes, parts = row[3], [], [], []
            while row is not None and row[:4] == (*key, at):
                nodes.append(row[4])
                sizes.append(row[5])
                parts.append(row[6])
                row = next(rows, None)
            yield nodes, sizes, parts

    while row is not None:
        key = row[:3]
        yield key, ranges(key)
