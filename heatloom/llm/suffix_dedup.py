"""Removal of repeated byte strings with suffix arrays, built one bucket at a time with difference-cover ranks.

A window is a string of `length` bytes inside a document. Its anchor is its smallest gram of GRAM bytes by hash, the leftmost of equal
ones; equal windows have the same gram at the same place, so the anchor's hash names a suffix bucket that all copies of a window
share. A context is a stretch of windows with one anchor, with the bytes they cover.

1. Contexts of all documents are listed (about one in 85 bytes); those whose anchor occurs once hold no repeat and leave.
2. Equal contexts meet in a count, before any text moves; a context with two copies is repeated as a whole.
3. Anchors with several different contexts are suffix-sorted: each context's text travels once, to the task of its anchor. A task takes a
   bounded block of buckets and ranks the suffixes at the places of a difference cover once: by PERIOD bytes, then by twice as many, from the
   ranks of two places a period apart. It sorts each bucket's suffixes by their few bytes up to the next place of the cover, the rank there, and the
   few bytes of the window that are left. Anchors lie on multiples of the cover's period, so a bucket's suffixes that can be equal have
   the same way to such a place. Neighbours in the order that agree in all of these are repeats. An anchor with more than `hot` different contexts is
   no bucket: blocks of its windows are hashed (128 bits) and counted, and only where they are equal in part fall into smaller blocks, down to
   single windows, so that no task holds them all.
4. The repeated windows return to the documents, where their union is removed.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import drop, stored, texts_of

LENGTH, GRAM = 200, 32
#: Window starts that are listed at a time, and suffixes that are sorted at a time.
PIECE, BLOCK = 1 << 22, 400_000
#: Different contexts of an anchor up to which they are sorted in one task.
HOT = 1_000
#: Windows in a block of those that have more, step by step; each at most LENGTH, the last 1.
WIDTHS = (16, 4, 1)
PLACE_BITS = 24
PERIOD = 64
CONTEXT = "h bigint, c bigint, n int, off int"
KEYS = ["h", "c", "n", "off"]


def difference_cover(period: int) -> list[int]:
    """Residues whose differences give every residue; grown greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & {d for c in cover for d in ((x - c) % period, (c - x) % period)})
        chosen = max(range(period), key=gain)
        cover.append(chosen)
        missing -= {d for c in cover for d in ((chosen - c) % period, (c - chosen) % period)}
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: Bytes from each residue to the cover's next place.
AHEAD = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 17) for b in range(256)], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    h, factor, size = BYTE_VALUES[data], 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & (2**64 - 1)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def contexts_of(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window start, number of windows, place of the anchor and its hash of each context. owner: the document of each byte."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    inside = owner[: len(least)] == owner[LENGTH - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
    new[1:] |= ~inside[:-1]
    begin = np.nonzero(new & inside)[0]
    # a context ends where the next one begins or where windows leave their document
    stops = np.nonzero(new | ~inside)[0]
    following = np.searchsorted(stops, begin, side="right")
    end = np.append(stops, len(least))[following]
    at = (least[begin] & low).astype(np.int64)
    return begin, end - begin, at, h[at]


def list_contexts(batches, piece: int = PIECE):
    """Rows of all contexts: k1, k2, start, h, c (hash of the context's bytes), n (windows), off (from start to the anchor)."""
    for batch in batches:
        k1, k2 = (batch.column(k).to_pylist() for k in ("k1", "k2"))
        pieces = []  # (row, offset of the piece, bytes)
        for row, text in enumerate(texts_of(batch)):
            raw = text.encode()
            pieces += [(row, a, raw[a : a + piece + LENGTH - 1]) for a in range(0, max(0, len(raw) - LENGTH + 1), piece)]
        while pieces:
            some, total = [], 0
            while pieces and (not some or total + len(pieces[-1][2]) <= piece):
                some.append(pieces.pop())
                total += len(some[-1][2])
            joined = b"".join(p for _, _, p in some)
            sizes = np.array([len(p) for _, _, p in some])
            owner = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            begin, n, at, h = contexts_of(np.frombuffer(joined, np.uint8), owner)
            if not len(begin):
                continue
            own = owner[begin]
            first = np.cumsum(sizes) - sizes
            start = begin - first[own] + np.array([a for _, a, _ in some])[own]
            view = memoryview(joined)
            c = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), (begin + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
            rows = np.array([r for r, _, _ in some])[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(k1)[rows]), pa.array(np.array(k2)[rows]), pa.array(start), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int32)), pa.array((at - begin).astype(np.int32))],
                ["k1", "k2", "start", *KEYS],
            )


def cut_contexts(batches):
    """The bytes of each context that a document is asked for."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in (*KEYS, "data")}
        for text, asked in zip(texts_of(batch), batch.column("asked").to_pylist(), strict=True):
            raw = text.encode()
            for x in asked:
                for k in KEYS:
                    out[k].append(x[k])
                out["data"].append(raw[x["start"] : x["start"] + x["n"] + LENGTH - 1])
        kinds = {"h": pa.int64(), "c": pa.int64(), "n": pa.int32(), "off": pa.int32(), "data": pa.binary()}
        for k in range(0, len(out["n"]), 5_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 5_000], kinds[x]) for x, v in out.items()], list(out))


def hash_blocks(batches, width: int):
    """Rows (context, a, b, known, core, w1, w2) of the blocks of the ranges asked of each context: its windows a to b - 1, which have `width` successive
    distances from the anchor in common with the blocks of other contexts. core: a hash of the bytes that all windows of such a block share, which
    every context with one of them has. w1, w2: a hash of all bytes of the block's windows."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in (*KEYS, "a", "b", "known", "core", "whole")}
        for h, c, n, off, data, ranges in zip(*(batch.column(k).to_pylist() for k in (*KEYS, "data", "ranges")), strict=True):
            for x in ranges:
                for block in range((x["a"] - off) // width, (x["b"] - 1 - off) // width + 1):
                    low = off + block * width
                    a, b = max(x["a"], low), min(x["b"], low + width)
                    out["core"].append(xxhash.xxh3_64_intdigest(struct.pack("<qi", h, block) + data[low + width - 1 : low + LENGTH]))
                    out["whole"].append(xxhash.xxh3_128_digest(struct.pack("<ii", a - off, b - off) + data[a : b + LENGTH - 1]))
                    for k, v in zip((*KEYS, "a", "b", "known"), (h, c, n, off, a, b, x["known"]), strict=True):
                        out[k].append(v)
        w = np.frombuffer(b"".join(out.pop("whole")), np.int64).reshape(-1, 2)
        core = pa.array(np.array(out.pop("core"), np.uint64).view(np.int64))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)), core, pa.array(w[:, 0]), pa.array(w[:, 1])], [*out, "core", "w1", "w2"])


def repeated_windows(bucket: np.ndarray, n: np.ndarray, off: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and place of each window that occurs in another context of its bucket. bucket: a number for each context."""
    sizes = np.array([len(t) for t in texts])
    # each context begins so that its anchor lies on a multiple of the period, and ends with room for ranks past its end
    room = sizes + off % PERIOD + 2 * PERIOD
    room += -room % PERIOD
    base = np.cumsum(room) - room
    base += (-off) % PERIOD
    data = np.zeros(int(room.sum()) + LENGTH + 2 * PERIOD, np.uint8)
    for b, t in zip(base.tolist(), texts, strict=True):
        data[b : b + len(t)] = np.frombuffer(t, np.uint8)
    which = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    suffix = base[which] + place
    ahead = AHEAD[suffix % PERIOD]
    # ranks of the cover's places that suffixes look at, by PERIOD bytes and then by two periods: a place and the next period's are both in the cover
    sample = np.unique(suffix + ahead)
    both = np.union1d(sample, sample + PERIOD)
    strings = np.lib.stride_tricks.sliding_window_view(data, PERIOD)
    _, short = np.unique(strings[both].view(f"S{PERIOD}")[:, 0], return_inverse=True)
    pair = short[np.searchsorted(both, sample)] * (len(both) + 1) + short[np.searchsorted(both, sample + PERIOD)]
    rank = np.unique(pair, return_inverse=True)[1][np.searchsorted(sample, suffix + ahead)]

    def bytes_at(at: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
        """The `size` bytes at each place, eight to a number."""
        words = []
        for k in range(0, most, 8):
            w = np.zeros(len(at), np.uint64)
            for j in range(8):
                w = (w << np.uint64(8)) | np.where(k + j < size, data[at + k + j], 0).astype(np.uint64)
            words.append(w)
        return words

    shift = place - off[which]  # suffixes of a bucket that can be equal lie as far from the anchor
    left = LENGTH - 2 * PERIOD - ahead
    keys = [bucket[which], shift, *bytes_at(suffix, ahead, int(AHEAD.max())), rank, *bytes_at(suffix + ahead + 2 * PERIOD, left, LENGTH - 2 * PERIOD)]
    order = np.lexsort(keys[::-1])
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)
    for x in keys:
        equal &= x[a] == x[b]
    hit = np.zeros(len(suffix), bool)
    hit[a[equal]] = True
    hit[b[equal]] = True
    return which[hit], place[hit]


def sort_buckets(batches, block: int = BLOCK):
    """Rows (context, data) in order of h: each context's repeated windows as ranges of places."""
    held: list[tuple] = []
    windows, last = 0, None

    def close():
        keys = [x[:4] for x in held]
        h, n, off = np.array([k[0] for k in keys]), np.array([k[2] for k in keys]), np.array([k[3] for k in keys])
        which, place = repeated_windows(np.unique(h, return_inverse=True)[1], n, off, [x[4] for x in held])
        at = which * (1 << 32) + place
        cut = np.nonzero(np.diff(at) != 1)[0] + 1
        begins, ends = np.concatenate([at[:1], at[cut]]), np.concatenate([at[cut - 1], at[-1:]]) + 1
        spans: dict[int, list] = {}
        for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
            spans.setdefault(x >> 32, []).append({"a": x & 0xFFFFFFFF, "b": y & 0xFFFFFFFF})
        chosen = list(spans)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([keys[i][k] for i in chosen], pa.int64() if k < 2 else pa.int32()) for k in range(4)), pa.array([spans[i] for i in chosen], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            [*KEYS, "spans"],
        )

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (*KEYS, "data")), strict=True):
            if row[:4] == last:  # rows equal in id and text bring their contexts twice
                continue
            if windows >= block and row[0] != last[0]:
                yield close()
                held, windows = [], 0
            held.append(row)
            windows += row[2]
            last = row[:4]
    if held:
        yield close()


def remove(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, found in zip(texts_of(batch), batch.column("found").to_pylist(), strict=True):
            raw = text.encode()
            edges = np.zeros(len(raw) + 1, np.int32)
            for x in found or []:
                for s in x["spans"]:
                    edges[x["start"] + s["a"]] += 1
                    edges[x["start"] + s["b"] - 1 + LENGTH] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if found else raw
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])


def repeated_ranges(contexts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """KEYS and spans, the ranges of repeated windows, of contexts (KEYS, data), and the tables that it reads.

    Blocks of WIDTHS[0] windows are compared first. A block that another context has in full is repeated; one whose core no other has holds no repeat.
    Only between these do blocks fall into smaller ones, each different block once (known: its own windows are already decided).
    """
    done, used = [], []
    asked = contexts.select("*", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(False).alias("known"))).alias("ranges"))
    for width in WIDTHS:
        blocks = stored(asked.mapInArrow(lambda batches, width=width: hash_blocks(batches, width), f"{CONTEXT}, a int, b int, known boolean, core bigint, w1 bigint, w2 bigint"), "hot-blocks")
        # Counts are tables of their own here too, so that joins can split a frequent core.
        one = F.min(F.struct(*KEYS, "a", "b", "known")).alias("one")
        different = stored(blocks.groupBy("core", "w1", "w2").agg(F.count("*").alias("times"), one), "hot-different")
        done.append(blocks.where("not known").join(different.where("times > 1"), ["w1", "w2"], "left_semi").select(*KEYS, "a", "b"))
        used += [blocks, different]
        if width > 1:
            torn = different.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
            ranges = F.collect_list(F.struct("one.a", "one.b", (F.col("one.known") | (F.col("times") > 1)).alias("known"))).alias("ranges")
            asked = contexts.join(different.join(torn, "core", "left_semi").groupBy(*[F.col(f"one.{k}").alias(k) for k in KEYS]).agg(ranges), KEYS)
    return reduce(DataFrame.union, done).groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("spans")), used


def suffix_dedup(docs: DataFrame, piece: int = PIECE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row of docs (doc_id, text).

    Every byte in a string of 200 bytes that starts elsewhere too, in this or another document, is removed; overlaps count, and strings are those of the
    input. A null text is the empty text; texts under 200 bytes lose nothing. Rows with a null or repeated doc_id are documents like others, so
    two equal rows of 200 bytes remove each other. What is left need not be valid UTF-8. Other columns are ignored, so their names cannot clash. An
    empty table gives an empty one. Long texts are read whole, in pieces of `piece` bytes. `block` suffixes, and at most the `hot` contexts of one more
    anchor, are sorted at a time; neither number changes a result.
    """
    keys = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", *keys)
    listed = stored(rows.select("k1", "k2", "text").mapInArrow(lambda batches: list_contexts(batches, piece), f"k1 bigint, k2 bigint, start bigint, {CONTEXT}"), "contexts")
    # Counts are tables of their own: a join can then split the rows of a frequent key over tasks.
    often = stored(listed.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "anchors-often")
    shared = stored(listed.join(often, "h"), "contexts-shared")
    kinds = stored(shared.groupBy(*KEYS).agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start")).alias("at")), "context-kinds")
    mixed = stored(kinds.groupBy("h").agg(F.count("*").alias("times"), F.min("copies").alias("least")).where("times > 1 and least = 1").select("h", "times"), "anchors-mixed")

    def asked_texts(anchors: DataFrame) -> DataFrame:
        asked = kinds.join(anchors.select("h"), "h").select("at.*", *KEYS).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", *KEYS)).alias("asked"))
        return rows.select("k1", "k2", "text").join(asked, ["k1", "k2"])

    cut = asked_texts(mixed.where(F.col("times") <= hot)).select("text", "asked").mapInArrow(cut_contexts, f"{CONTEXT}, data binary")
    ordered = cut.repartition("h").sortWithinPartitions(*KEYS)
    spans = "array<struct<a: int, b: int>>"
    sorted_ = stored(ordered.mapInArrow(lambda batches: sort_buckets(batches, block), f"{CONTEXT}, spans {spans}"), "context-repeats")
    drop(listed, often)
    many = asked_texts(mixed.where(F.col("times") > hot)).dropDuplicates(["k1", "k2"]).select("text", "asked")
    crowd = stored(many.mapInArrow(cut_contexts, f"{CONTEXT}, data binary"), "hot-contexts")
    places, used = repeated_ranges(crowd)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    verdict = kinds.join(sorted_.union(places), KEYS, "left").select(*KEYS, F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    verdict = stored(verdict, "context-verdicts")
    drop(kinds, mixed, sorted_, crowd, *used)
    found = shared.join(verdict, KEYS).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "found").mapInArrow(remove, schema)
