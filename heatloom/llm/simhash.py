"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments of two bits; the numbers of set bits of its segments are its point. The Manhattan distance of two points is at
most the number of differing bits. The segments form groups; if the distance is at most r, at most r groups differ, so two
points share a grid cell (the counts of all groups but r) for some choice of groups. Cells are joined, the Manhattan
distance is the first bound and the differing bits the exact test. More groups make finer grids, but more of them; the number of fingerprints decides.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import drop, keyed, stored, texts_of, unkeyed
from heatloom.llm.components import components
from heatloom.llm.jaccard_join import COUNTER_BITS, counters
from heatloom.llm.shingle_sets import blocks_of, dense_links, gram_set, grams_of, may_be_similar, near_somebody, segment_counts

ODD = 0x5555555555555555  # the lower bit of every segment


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False)]


def majority_bits(hashes: np.ndarray) -> bytes:
    """8 bytes: the bits that are set in over half of the hashes (big-endian unsigned 64-bit integers)."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16_384):
        total += np.unpackbits(hashes[k : k + 16_384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprint(text: str, k: int = 3) -> bytes:
    return fingerprint_of(text.encode().lower().split(), k)  # bytes: only A-Z are lower-cased, only ASCII white space splits


def fingerprint_of(words: list[bytes], k: int = 3, seed: int = 42) -> bytes:
    found = shingles(words, k)
    if not found:
        return bytes(8)
    return majority_bits(np.array(list(map(xxhash.xxh64_intdigest, found, repeat(seed))), ">u8"))


def fingerprint_table(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            raw = b"".join(fingerprint(t, k) for t in texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def counts_of(fp: Column) -> Column:
    """Set bits of each segment, in unary (00, 01, 11) in the segment's own two bits."""
    high, odd = F.shiftrightunsigned(fp, 1), F.lit(ODD)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def apart(x: Column, y: Column) -> Column:
    """Manhattan distance of two embeddings: in unary, the differing bits."""
    return F.bit_count(x.bitwiseXOR(y))


def grid_masks(radius: int, groups: int) -> list[int]:
    """Bit masks of all choices of groups - radius of the groups of segments."""
    members = [sum(3 << 2 * s for s in range(32) if s % groups == g) for g in range(groups)]
    return [signed(sum(chosen)) for chosen in combinations(members, groups - radius)]


def groups_for(n: int, radius: int) -> int:
    """The number of groups with the least work for n points: a row a grid and point, and the pairs that random points form (a count has 1.5 bits)."""
    cost = {g: comb(g, radius) * (n + n * n / 2 / 2 ** (1.5 * 32 * (g - radius) / g)) for g in range(radius + 1, 17)}
    return min(cost, key=cost.get)


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint: the smallest one it reaches over links inside the array."""
    bits = fps.view(np.uint64)  # of a negative number, numpy would count the bits of its absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        # a row's smallest label among its neighbours, then the label of that label
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fingerprint_links(nodes: DataFrame, radius: int = 3, groups: int | None = None, block: int = 512) -> DataFrame:
    """a, b: links that connect all of nodes (distinct fp) within `radius` differing bits, directly or through others.

    A cell of up to `block` points is joined with itself. A larger one is split into blocks by hash; each pair of blocks is a
    task's group of at most about twice `block` points, and returns a forest, not its pairs. No link is lost and no cell meets
    in one task. Neither `groups` nor `block` changes what is connected.
    """
    masks = grid_masks(radius, groups or groups_for(nodes.count(), radius))
    points = nodes.select("fp", counts_of(F.col("fp")).alias("c"))
    # a cell is named by a hash of its grid and counts: the test of the bits is exact, so cells that share a name only cost time
    cells = points.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(g), F.col("c").bitwiseAND(F.lit(m))) for g, m in enumerate(masks)])).alias("cell"))
    sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    full = stored(cells.join(sizes, "cell"), "simhash-cells")
    few = full.where(F.col("n") <= block).select("cell", "fp")
    x, y = F.col("x.fp"), F.col("y.fp")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (x < y) & (apart(counts_of(x), counts_of(y)) <= radius) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    found = pairs.select(x.alias("a"), y.alias("b"))
    dealt = blocks_of(full.where(F.col("n") > block), "fp", block)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fps = group.fp.to_numpy()
        label = forest(fps, radius)
        off = label != np.arange(len(fps))
        return pd.DataFrame({"a": fps[off], "b": fps[label[off]]})

    links = stored(found.union(dealt.groupBy("cell", "i", "j").applyInPandas(link, "a bigint, b bigint")), "simhash-links")
    drop(sizes, full)
    return links


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id, text).

    Texts are whole; a null text is empty and has the fingerprint zero, linked like any other. component_id is the
    smallest non-null doc_id of the component (null if it has none). Rows with a null or repeated doc_id are rows of their own.
    Equal fingerprints meet once, before the join. Other columns are ignored, so their names cannot clash. An empty table gives an
    empty one.
    """
    table = stored(fingerprint_table(docs, k), "fingerprints")
    nodes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    links = fingerprint_links(nodes.select("fp"), radius)
    roots = components(links)
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(labelled.join(least, "root").select("fp", "component_id"), "fingerprint-classes")
    drop(links, roots, nodes)
    return table.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by fingerprints, then by exact similarity: links of fingerprints are tested on the texts' whole shingle sets. Similar texts whose fingerprints are further
# apart follow. Candidates share a shingle of their prefixes; the numbers of shingles by segment of their hashes bound how far two sets can
# be apart (their Manhattan distance is at most the number of shingles that only one of them has); the whole sets decide.

#: Not read any more: the shingles of all texts are counted (see counters). An older test sets it.
SAMPLE = 1
#: A cell of up to this many nodes gives its pairs to a join; a larger one is compared in blocks of BLOCK nodes.
FEW, BLOCK = 12, 512


def gram_prefix(grams: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, rare ones before frequent ones, of which two sets of at least this Jaccard similarity have one in common."""
    times = counts[(grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    # similar sets share at least similarity * size shingles, so less than the prefix lies outside the common ones
    return grams[np.lexsort((grams, times))][: len(grams) - int(np.ceil(similarity * len(grams) - 1e-6)) + 1]


def prefix_table(docs: DataFrame, k: int, similarity: float, times: np.ndarray) -> DataFrame:
    """k1, k2, node (hash of the text's words), fp (fingerprint), size (distinct shingles), prefix, counts (of segments) of every row of docs (k1, k2, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(times)  # a table of fixed size

    def run(batches):
        for batch in batches:
            nodes, fps, sizes, prefixes, counts = [], [], [], [], []
            for text in texts_of(batch):
                words = text.encode().lower().split()
                grams = gram_set(words, k)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                fps.append(fingerprint_of(words))
                sizes.append(len(grams))
                prefixes.append(gram_prefix(grams, shared.value, similarity).view(np.int64))
                counts.append(segment_counts(grams).tobytes())
            numbers = [np.array(nodes, np.uint64).view(np.int64), np.frombuffer(b"".join(fps), ">i8").astype(np.int64)]
            arrays = [*map(pa.array, numbers), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *arrays], ["k1", "k2", "node", "fp", "size", "prefix", "counts"])

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, node bigint, fp bigint, size int, prefix array<bigint>, counts binary")


def fingerprint_pairs(nodes: DataFrame, radius: int, block: int = 512) -> DataFrame:
    """a, b: pairs that connect all of nodes (node, fp) whose fingerprints are equal or linked. Of equal ones, about `block` meet at one node, and these at the first."""
    sizes = nodes.groupBy("fp").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    own = stored(nodes.join(sizes, "fp").withColumn("own", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))).select("node", "fp", "own", "first"), "near-points")
    heads = stored(own.groupBy("fp", "own").agg(F.min("node").alias("head"), F.min("first").alias("first")), "near-heads")
    points = stored(heads.where("head = first").select("fp", "first"), "near-firsts")
    links = fingerprint_links(points.select("fp"), radius)
    first = lambda end: points.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}"))
    between = links.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = own.join(heads.drop("first"), ["fp", "own"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = between.union(equal).union(heads.select(F.col("first").alias("a"), F.col("head").alias("b"))).where("a <> b")
    pairs = stored(pairs, "near-fingerprints")
    drop(own, heads, points, links)
    return pairs


def similar_pairs(pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """a, b of the rows of pairs (a, b, x, y: texts) whose shingle sets are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in "xy"), strict=True):
                x, y = grams_of(x, k), grams_of(y, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def possible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the Manhattan distance of their segment counts doesn't rule out. nodes: node, size, counts."""
    both = pairs
    for end in "ab":
        both = both.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("counts").alias(f"counts_{end}")), end)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("counts_a", "counts_b", "size_a", "size_b")]
            keep = [may_be_similar(*row, similarity) for row in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "size_a", "size_b", "counts_a", "counts_b").mapInArrow(run, "a bigint, b bigint")


def texts_of_nodes(texts: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, text of the wanted nodes; texts (k1, k2, text), nodes (k1, k2, node, size)."""
    chosen = stored(wanted.distinct().join(nodes, "node").select("k1", "k2", "node", "size"), "near-nodes")
    # texts travel, not shingle sets: they are smaller
    near = stored(texts.join(chosen, ["k1", "k2"]).select("node", "size", "text").dropDuplicates(["node"]), "near-texts")
    drop(chosen)
    return near


def both_texts(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs (a, b) with their texts x and y."""
    x, y = near.select(F.col("node").alias("a"), F.col("text").alias("x")), near.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def first_of_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id (null first), by text where ids repeat.

    Texts with the same lower-cased words are one node. Nodes whose sets of k-word shingles (the whole text, if shorter) have a Jaccard similarity of at least
    `similarity` are linked, and groups are connected components.

    First come the links of near_duplicates: fingerprints that are equal or, by the grid join of their segments' bit counts, at most `radius` bits apart. Those whose
    texts are similar count (fingerprints of short texts may agree by chance) and form the first groups.
    What fingerprints can't tell follows: similar texts that are further apart. Candidates are nodes of different groups that share a shingle of their prefixes: with one order of all
    shingles, two similar sets always do, so no pair is lost. The order puts shingles last that are frequent in all texts (by counters, a table of fixed size), which keeps cells small. Cells with
    the same nodes count once, large ones with the same smallest node are one, and large ones within a first group are done. Pairs of small cells, and nodes of large ones, go on if the Manhattan
    distance of segment counts leaves them similar. Then their texts' shingle sets are made and compared. A large cell is split into blocks by hash; each pair
    of blocks compares all its nodes with one another and returns a forest, not its pairs, so that no cell meets in one task. Null and empty texts are one node.
    Columns of any name pass unchanged. An empty table gives an empty one; long texts are read whole.
    """
    rows = keyed(docs)
    texts = rows.select("k1", "k2", "text")
    table = prefix_table(texts, k, similarity, counters(texts, k))
    nodes = stored(table.groupBy("node").agg(F.min(F.struct("k1", "k2", "fp", "size", "prefix", "counts")).alias("first")).select("node", "first.*"), "prefix-nodes")
    alike = fingerprint_pairs(nodes.select("node", "fp"), radius)
    near = texts_of_nodes(texts, ends(alike), nodes)
    agreed = stored(similar_pairs(both_texts(alike, near), k, similarity), "near-agreed")
    drop(alike, near)
    early = components(agreed)
    cells = nodes.select("node", F.explode("prefix").alias("cell"))
    sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "prefix-sizes")
    met = stored(cells.join(sizes, "cell"), "prefix-cells")
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"members{i}") for i in (0, 1)]
    different = met.groupBy("cell", "n").agg(*members, F.min("node").alias("leader")).groupBy("n", "members0", "members1", "leader").agg(F.min("cell").alias("cell"))
    different = stored(different.select("cell", "leader"), "prefix-different")
    few = met.where(F.col("n") <= FEW).join(different.select("cell"), "cell").join(nodes.select("node", "size"), "node")
    few = stored(few.select("cell", "node", "size"), "prefix-few")
    x, y = few.alias("x"), few.alias("y")
    close = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6
    both = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node")) & close)
    pairs = both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    for end in "ab":
        pairs = pairs.join(early.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    pairs = stored(possible_pairs(pairs, nodes, similarity), "near-pairs")
    led = stored(met.where(F.col("n") > FEW).join(different, "cell").select(F.col("leader").alias("cell"), "node").distinct(), "prefix-led")
    drop(sizes, met, different, few)

    def possible(group: pd.DataFrame) -> pd.DataFrame:
        return group.loc[near_somebody(group.counts.to_list(), group["size"].to_numpy(), similarity), ["cell", "node"]]

    root = F.coalesce("root", "node")
    leaders = led.join(early, "node", "left").groupBy("cell").agg(F.count("*").alias("n"), F.min(root).alias("low"), F.max(root).alias("high"))
    leaders = stored(leaders.where("low <> high").select("cell", "n"), "prefix-leaders")
    counted = led.join(leaders, "cell").join(nodes.select("node", "size", "counts"), "node")
    many = blocks_of(counted, "node", BLOCK).groupBy("cell", "i", "j").applyInPandas(possible, "cell bigint, node bigint")
    many = stored(many.distinct(), "prefix-many")
    near = texts_of_nodes(texts, ends(pairs).union(many.select("node")), nodes)
    drop(led, leaders, early)
    left = stored(many.join(near.select("node", "size"), "node").groupBy("cell").agg(F.count("*").alias("n"), F.max("size").alias("most")), "prefix-left")
    dealt = blocks_of(many.join(left, "cell").join(near.select("node", "text"), "node"), "node", BLOCK)

    links = agreed.union(similar_pairs(both_texts(pairs, near), k, similarity)).union(dense_links(dealt, k, round(100 * similarity)))
    links = stored(links, "near-links")
    drop(agreed, pairs, many, left, near)
    roots = components(links)
    drop(links)
    grouped = nodes.select("node", F.struct("k1", "k2").alias("first")).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = stored(grouped.select("first.*"), "near-kept")
    drop(nodes, roots)
    return unkeyed(rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs.columns)
