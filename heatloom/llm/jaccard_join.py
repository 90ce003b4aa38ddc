"""Similarity join of texts on sets of word shingles, by prefix filtering.

Shingles have one order, rare ones first. A set of n shingles that shares at least `percent` of a union with another one shares at least percent * n / 100 shingles with it, so one of
its first n - ceil(percent * n / 100) + 1 shingles, its prefix, is in the other's prefix. Nodes (different sets) are joined on prefix
shingles. Then filters drop pairs that can't be similar: by length; by position (what stands before and after a common shingle bounds what two sets can
share); by suffix (fixed probes cut both lists into parts, and the differences of the parts' sizes add up to a bound on what isn't shared). The pairs
that are left are compared once each, by their whole sets. The order comes from counts over all documents: a table of counters
of fixed size, to which every shingle adds one; it decides how large cells get, not what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import drop, stored, texts_of
from heatloom.llm.components import components
from heatloom.llm.shingle_sets import LEAST_SEGMENTS, blocks_of, dense_links, folded, grams_of, near_somebody, segment_counts

#: Bits of a counter's number: counters are a million at any size of the input.
COUNTER_BITS = 20
#: Counters that travel in one row.
CHUNK = 4_096
#: A cell of up to FEW nodes gives its pairs to a join; a larger one is compared in blocks of BLOCK nodes.
FEW, BLOCK = 12, 512


def shared_least(size_a: Column, size_b: Column, percent: int) -> Column:
    """The least number of common shingles of two sets that are similar: 100 * common >= percent * (a + b - common)."""
    return F.ceil(percent * (size_a + size_b) / F.lit(100 + percent))


def counters(texts: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each counter occur in all texts; a shingle's counter is given by its leading bits.

    Every task sends its counters in chunks; each chunk is summed as a stream.
    """
    width = 1 << COUNTER_BITS

    def count(batches):
        total, waiting, held = np.zeros(width, np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                waiting.append(grams_of(text, k) >> np.uint64(64 - COUNTER_BITS))
                held += len(waiting[-1])
                if held > width:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=width)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=width)
        full = [c for c in range(0, width, CHUNK) if total[c : c + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([total[c : c + CHUNK].astype("<i8").tobytes() for c in full], pa.binary())], ["chunk", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["chunk", "counts"])

    sums = stored(texts.select("text").mapInArrow(count, "chunk bigint, counts binary").repartition("chunk").mapInArrow(add, "chunk bigint, counts binary"), "counters")
    out = np.zeros(width, np.int64)
    for r in sums.collect():
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.counts, "<i8")
    drop(sums)
    return out


def prefix_of(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order: by count, then by hash."""
    rarity = counts[(grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    n = len(grams)
    return grams[np.argsort(rarity, kind="stable")][: n - -(-percent * n // 100) + 1 if n else 0]


def prefix_table(rows: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """k1, k2, doc_id, node (hash of the set), size, and of the first row of a node in a task also prefix and segments."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # a table of fixed size

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, prefixes, segments = [], [], [], []
            for text in texts_of(batch):
                grams = grams_of(text, k)
                node = xxhash.xxh3_64_intdigest(grams.tobytes())
                first = node not in seen
                if len(seen) > 1_000_000:
                    seen = set()
                seen.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                prefixes.append(prefix_of(grams, shared.value, percent).view(np.int64) if first else None)
                segments.append(np.minimum(folded(segment_counts(grams), LEAST_SEGMENTS), 65_535).astype("<u2").tobytes() if first else None)
            arrays = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(segments, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "doc_id")), *arrays], ["k1", "k2", "doc_id", "node", "size", "prefix", "segments"])

    return rows.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, node bigint, size bigint, prefix array<bigint>, segments binary")


def place_and_size(at: str = "at") -> tuple[Column, Column]:
    """A shingle's position in a prefix and its set's size, which travel in one number."""
    return F.col(at).bitwiseAND(F.lit(2**32 - 1)).alias("pos"), F.shiftright(at, 32).alias("size")


def joined_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """a, b, size_a, size_b of nodes that share a cell (cell, node, at), once each, as far as lengths and positions leave them similar."""
    cells = cells.select("cell", "node", *place_and_size())
    x, y = cells.alias("x"), cells.alias("y")
    size_x, size_y = F.col("x.size"), F.col("y.size")
    # before a common shingle two sets share at most the lesser number of shingles there, after it likewise
    most = F.least("x.pos", "y.pos") + 1 + F.least(size_x - F.col("x.pos"), size_y - F.col("y.pos")) - 1
    close = (100 * F.least(size_x, size_y) >= percent * F.greatest(size_x, size_y)) & (most >= shared_least(size_x, size_y, percent))
    both = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node")) & close)
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), size_x.alias("size_a"), size_y.alias("size_b")).distinct()


def suffix_filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the differences of their parts' sizes don't rule out. nodes: node, segments."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("segments").alias(f"segments_{end}")), end)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"segments_{e}").to_pylist()), "<u2").reshape(batch.num_rows, -1).astype(np.int64) for e in "ab")
                sizes = sum(batch.column(f"size_{e}").to_numpy() for e in "ab")
                shared_most = (sizes - np.abs(x - y).sum(1)) // 2
                batch = batch.filter(pa.array((100 + percent) * shared_most >= percent * sizes))
            yield batch.select(["a", "b"])

    return pairs.select("a", "b", "size_a", "size_b", "segments_a", "segments_b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. texts: node, text."""
    for end in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)

    def run(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last:
                    last, own = a, grams_of(x, k)
                other = grams_of(y, k)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): texts whose sets of k-word shingles (of fewer words, the whole text) share at least `percent` of their union are linked.

    Words are what ASCII white space parts, A-Z in lower case; texts are whole. Rows with the same set are one node, a 64-bit hash. component_id is the smallest
    non-null doc_id that a row reaches over links (null if there is none). Null texts and texts without words have the empty set and are linked with nothing; theirs is
    their own. Rows with null or repeated doc_id are rows of their own. Cells with the same nodes count once. A cell of more than FEW nodes is split
    into blocks by hash; each pair of blocks compares its nodes and returns a forest, so that no cell meets in one task and no link between different sets is lost. Other columns are
    ignored, so their names cannot clash; an empty table gives an empty one.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = stored(prefix_table(rows, k, percent, counters(rows, k)), "jaccard-rows")
    full = table.where("prefix is not null and size > 0")
    nodes = stored(full.groupBy("node").agg(F.min(F.struct("k1", "k2", "size", "prefix", "segments")).alias("first")).select("node", "first.*"), "jaccard-nodes")
    cells = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "cell")).select("node", "cell", (F.shiftleft("size", 32) + F.col("pos")).alias("at"))
    sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-sizes")
    met = stored(cells.join(sizes, "cell"), "jaccard-cells")
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"members{i}") for i in (0, 1)]
    different = met.groupBy("cell", "n").agg(*members, F.min("node").alias("leader"), F.sum(place_and_size()[0]).alias("place"))
    different = stored(different.groupBy("n", "members0", "members1", "leader").agg(F.min_by("cell", F.struct("place", "cell")).alias("cell")), "jaccard-different")
    few = met.where(F.col("n") <= FEW).join(different.where(F.col("n") <= FEW).select("cell"), "cell").select("cell", "node", "at")
    few = stored(few, "jaccard-few")
    pairs = stored(suffix_filtered(joined_pairs(few, percent), nodes, percent), "jaccard-pairs")
    led = stored(met.where(F.col("n") > FEW).join(different.select("cell", "leader"), "cell").select(F.col("leader").alias("cell"), "node").distinct(), "jaccard-led")
    drop(sizes, met, different, few)

    def possible(group):
        return group.loc[near_somebody(group.segments.to_list(), group["size"].to_numpy(), percent / 100), ["cell", "node"]]

    leaders = stored(led.groupBy("cell").agg(F.count("*").alias("n")), "jaccard-leaders")
    counted = led.join(leaders, "cell").join(nodes.select("node", "size", "segments"), "node")
    many = stored(blocks_of(counted, "node", BLOCK).groupBy("cell", "i", "j").applyInPandas(possible, "cell bigint, node bigint").distinct(), "jaccard-many")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(many.select("node")).distinct()
    chosen = stored(wanted.join(nodes, "node").select("k1", "k2", "node", "size"), "jaccard-chosen")
    texts = stored(rows.select("k1", "k2", "text").join(chosen.hint("merge"), ["k1", "k2"]).select("node", "size", "text").dropDuplicates(["node"]), "jaccard-texts")
    left = stored(many.join(texts.select("node", "size"), "node").groupBy("cell").agg(F.count("*").alias("n"), F.max("size").alias("most")), "jaccard-left")
    dealt = blocks_of(many.join(left, "cell").join(texts.select("node", "text"), "node"), "node", BLOCK)
    links = stored(verified(pairs, texts, k, percent).union(dense_links(dealt, k, percent)), "jaccard-links")
    drop(pairs, led, leaders, many, chosen, texts, left)
    roots = components(links)
    named = table.groupBy("node", "size").agg(F.min("doc_id").alias("first")).where("size > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("node", "root", "first"), "jaccard-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(named.join(least, "root").select("node", "component_id"), "jaccard-classes")
    drop(nodes, links, roots, named)
    out = table.select("doc_id", "size", "node").join(classes, "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: DuckDB SQL: sets of shingles (g), the different ones (by h, a digest), pairs by common shingles, and what each one reaches.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
m AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM m GROUP BY doc_id),
c AS MATERIALIZED (SELECT h, min(doc_id) AS rep FROM s GROUP BY h),
o AS MATERIALIZED (SELECT rep, n, g FROM c JOIN s ON s.h = c.h AND s.doc_id = c.rep JOIN m ON m.doc_id = c.rep),
l AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b FROM o AS x JOIN o AS y ON x.g = y.g AND x.rep <> y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n IS NULL THEN w.doc_id ELSE least(c.rep, coalesce(k.least, c.rep)) END AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (h) LEFT JOIN k USING (rep)
"""
