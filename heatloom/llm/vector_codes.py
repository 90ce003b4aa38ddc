"""Short codes for vectors: a codebook for each part of the components, fitted over all rows in whole numbers.

Each task turns its rows into blocks once: of every dimension the sorted distinct integers (the dictionary), and the places of the rows' components in it (the codes). To find the
nearest entries, a block tabulates, for every dimension, the squared differences of each value of the dictionary to each entry; the distance of a row's
part to all entries is then a gather of table rows by code for each dimension, and their sum. Blocks are written once and read in every round; what
comes back from a round are sums and counts for each entry, added up by Spark, whose number doesn't depend on that of the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import drop, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a block, and rows whose distances are summed at a time.
BLOCK, AT_ONCE = 4_096, 1_024
#: Whole numbers of which sums are sent apart in digits of so many bits, so that no total overflows.
DIGIT = 32
MOST = 2**63 - 1

Codebook = list[list[list[int]]]  # part, entry, component


def scaled(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of finite vectors of one length; Python's whole numbers where 64 bits could overflow."""
    x = np.array(vectors, np.float64)
    if x.size == 0 or np.abs(x).max() < 2**20:
        return np.floor(scale * x).astype(np.int64)
    exact = [[(n * scale) // d for n, d in map(float.as_integer_ratio, v)] for v in x.tolist()]
    out = np.empty(x.shape, object)
    out[:] = exact
    return out


def bounds(dimensions: int, parts: int) -> list[tuple[int, int]]:
    """First and last dimension of each part; where they can't be equal, the first ones are one longer."""
    at = [0]
    for k in range(parts):
        at.append(at[-1] + dimensions // parts + (k < dimensions % parts))
    return list(zip(at, at[1:], strict=False))


def packed(rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A block's dictionaries (sizes; values) and codes."""
    sizes, values, codes = [], [], []
    for column in rows.T:
        own, code = np.unique(column, return_inverse=True)
        sizes.append(len(own))
        values += own.tolist()
        codes.append(code)
    return np.array(sizes, "<i4").tobytes(), ",".join(map(str, values)).encode(), np.array(codes, "<u2").tobytes()


def unpacked(sizes: bytes, values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionary of each dimension and the codes (dimensions x rows)."""
    sizes = np.frombuffer(sizes, "<i4")
    numbers = list(map(int, values.split(b","))) if len(values) else []
    small = all(abs(v) < 2**31 for v in numbers)
    ends = np.cumsum(sizes)
    dictionaries = [np.array(numbers[e - s : e], np.int64 if small else object) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return dictionaries, np.frombuffer(codes, "<u2").reshape(len(sizes), -1)


def nearest_entries(dictionaries: list[np.ndarray], codes: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of a block's part (ties: the first), and its squared distance."""
    widest = max((max(abs(int(d[0])), abs(int(d[-1]))) for d in dictionaries if len(d)), default=0) + max((abs(v) for e in entries for v in e), default=0)
    most = len(dictionaries) * widest**2
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    tables = []
    for k, own in enumerate(dictionaries):
        to = np.array([e[k] for e in entries], kind)
        tables.append((own.astype(kind)[:, None] - to[None, :]) ** 2)
    n = codes.shape[1]
    best, error = np.empty(n, np.int64), np.empty(n, kind)
    for a in range(0, n, AT_ONCE):
        part = codes[:, a : a + AT_ONCE]
        total = np.zeros((part.shape[1], len(entries)), kind)
        for table, code in zip(tables, part, strict=True):
            total += table[code]
        own = total.argmin(axis=1)
        best[a : a + AT_ONCE], error[a : a + AT_ONCE] = own, total[np.arange(len(own)), own]
    return best, error


def digits(value: int) -> list[int]:
    """A whole number in digits of DIGIT bits, lowest first; the last one has the sign."""
    out = []
    while not -(2**DIGIT) <= value < 2**DIGIT:
        out.append(value & (2**DIGIT - 1))
        value >>= DIGIT
    return [*out, value]


def blocks_of(rows: DataFrame, dimensions: int, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """sizes, dictionary, codes, vec_ids, labels of blocks of rows (vec_id, embedding, label) of one length."""

    def run(batches):
        for batch in batches:
            ids, vectors, labels = (batch.column(c).to_pylist() for c in ("vec_id", "embedding", "label"))
            for a in range(0, len(ids), size):
                sizes, values, codes = packed(scaled(vectors[a : a + size], scale).reshape(-1, dimensions))
                yield pa.RecordBatch.from_pylist([{"sizes": sizes, "dictionary": values, "codes": codes, "vec_ids": ids[a : a + size], "labels": labels[a : a + size]}], schema=schema)

    schema = pa.schema([("sizes", pa.binary()), ("dictionary", pa.binary()), ("codes", pa.binary()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])
    return rows.mapInArrow(run, "sizes binary, dictionary binary, codes binary, vec_ids array<bigint>, labels array<string>")


def refined(blocks: DataFrame, codebook: Codebook, cuts: list[tuple[int, int]]) -> Codebook:
    """The codebook after a round: each entry the floored mean of the parts nearest to it; entries without any stay."""
    tasks = blocks.sparkSession.sparkContext.broadcast(codebook)  # a fixed number of entries

    def run(batches):
        sums = [[[0] * (b - a) for _ in own] for (a, b), own in zip(cuts, tasks.value, strict=True)]
        counts = [np.zeros(len(own), np.int64) for own in tasks.value]
        for batch in batches:
            for sizes, values, codes in zip(*(batch.column(c).to_pylist() for c in ("sizes", "dictionary", "codes")), strict=True):
                dictionaries, places = unpacked(sizes, values, codes)
                for p, (a, b) in enumerate(cuts):
                    best, _ = nearest_entries(dictionaries[a:b], places[a:b], tasks.value[p])
                    order = np.argsort(best, kind="stable")
                    hit, first = np.unique(best[order], return_index=True)
                    counts[p] += np.bincount(best, minlength=len(counts[p]))
                    for k in range(a, b):
                        for e, s in zip(hit.tolist(), np.add.reduceat(dictionaries[k][places[k]][order], first).tolist(), strict=True):
                            sums[p][e][k - a] += s
        out = []
        for p, own in enumerate(counts):
            for e in np.flatnonzero(own).tolist():
                out.append((p, e, -1, 0, int(own[e])))
                out += [(p, e, k, place, d) for k, s in enumerate(sums[p][e]) for place, d in enumerate(digits(s))]
        names = ("part", "entry", "component", "place", "digit")
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})

    parts = blocks.select("sizes", "dictionary", "codes").mapInArrow(run, "part bigint, entry bigint, component bigint, place bigint, digit bigint")
    totals: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("part", "entry", "component", "place").agg(F.sum("digit").alias("digit")).collect():
        key = (r.part, r.entry, r.component)
        totals[key] = totals.get(key, 0) + (r.digit << DIGIT * r.place)
    tasks.unpersist()
    return [[[totals[p, e, k] // totals[p, e, -1] for k in range(len(entry))] if (p, e, -1) in totals else entry for e, entry in enumerate(own)] for p, own in enumerate(codebook)]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles), label (as text, null stays null) of the rows whose vector is neither null nor holds a null, NaN or infinite component."""
    v = F.col(f"`{column}`").cast("array<double>")
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding"), label.alias("label"))
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))


def codebook_digest(codebook: Codebook) -> str:
    return hashlib.sha256(",".join(str(x) for own in codebook for entry in own for x in entry).encode()).hexdigest()


def encoded(blocks: DataFrame, codebook: Codebook, cuts: list[tuple[int, int]]) -> DataFrame:
    """vec_id, label, parts (entry of each part), error of every row of blocks. An error over the largest long counts as that."""
    tasks = blocks.sparkSession.sparkContext.broadcast(codebook)

    def run(batches):
        for batch in batches:
            for sizes, values, codes, ids, labels in zip(*(batch.column(c).to_pylist() for c in ("sizes", "dictionary", "codes", "vec_ids", "labels")), strict=True):
                dictionaries, places = unpacked(sizes, values, codes)
                found = [nearest_entries(dictionaries[a:b], places[a:b], own) for (a, b), own in zip(cuts, tasks.value, strict=True)]
                parts = np.array([best for best, _ in found]).T.tolist()
                errors = [min(MOST, int(sum(map(int, e)))) for e in zip(*(error.tolist() for _, error in found), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(parts, pa.list_(pa.int32())), pa.array(errors, pa.int64())], ["vec_id", "label", "parts", "error"])

    return blocks.mapInArrow(run, "vec_id bigint, label string, parts array<int>, error bigint")


def vector_codes(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """(vec_id, label, parts, error of every usable row of vectors (vec_id, `column`, label), the codebook: part, entry, component).

    Components are floor(scale * x), exact at any size. A codebook starts from the parts of the `entries` smallest vec_ids (null ones last; where ids repeat, by vector), of fewer rows
    if there are no more, and takes `rounds` rounds; distances are squared Euclidean, ties go to the lower entry, means are floored, unused entries stay. Rows whose vector is null or
    holds null or non-finite components are dropped, and so are those that haven't the length of the first vector in that order. Parts are as equal as the length allows. Repeated rows
    are rows of their own and count as often. Other columns are ignored. A table without usable rows gives an empty one and an empty codebook.
    """
    rows = usable(vectors, column)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.orderBy(*order).limit(1).collect()
    dimensions = len(first[0].embedding) if first else 0
    rows = rows.where(F.size("embedding") == dimensions)
    start = scaled([r.embedding for r in rows.orderBy(*order).limit(entries).collect()], scale).reshape(-1, dimensions).tolist() if dimensions else []
    cuts = bounds(dimensions, parts)
    codebook = [[v[a:b] for v in start] for a, b in cuts]
    if not start:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, label string, parts array<int>, error bigint"), codebook
    blocks = stored(blocks_of(rows, dimensions, scale), "vector-blocks")
    for _ in range(rounds):
        codebook = refined(blocks, codebook, cuts)
    coded = stored(encoded(blocks, codebook, cuts), "vector-codes")
    drop(blocks)
    return coded, codebook


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of vectors (vec_id, embedding, label)."""
    coded, codebook = vector_codes(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    by_label = coded.groupBy(F.col("label").alias("own")).agg(total.alias("label_error"))
    code = F.array_join(F.transform("parts", lambda p: F.lpad(F.lower(F.hex(p)), 2, "0")), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))


#: DuckDB SQL: parts of whole numbers (x), then a codebook (e) and its nearest entries (a) in each round.
_ROUND = """
a{i} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.r, x.part, e.entry, list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN e{i} AS e USING (part)) GROUP BY r, part)"""
_MEANS = """
m{i} AS (SELECT part, entry, list(m ORDER BY k) AS v FROM (
  SELECT part, entry, k, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
    SELECT part, entry, k, sum(x.v[k]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, 17)) AS k FROM x JOIN a{i} USING (r, part)) AS x GROUP BY part, entry, k)) GROUP BY part, entry),
e{j} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m{i}.v, e.v) AS v FROM e{i} AS e LEFT JOIN m{i} USING (part, entry))"""
ORACLE = (
    """
WITH u AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, part, v[part * 16 + 1:part * 16 + 16] AS v FROM (SELECT r, v, unnest(range(0, 4)) AS part FROM u)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM x WHERE r <= 256),"""
    + ",".join(_ROUND.format(i=i) + "," + _MEANS.format(i=i, j=i + 1) for i in range(ROUNDS))
    + ","
    + _ROUND.format(i=ROUNDS)
    + f""",
c AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM e{ROUNDS}) AS codebooks_sha256
FROM u JOIN c USING (r)
"""
)
