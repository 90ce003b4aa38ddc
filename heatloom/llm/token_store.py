"""Token ids as binary shards with a minimal perfect hash index.

Shards hold raw little-endian unsigned 16-bit ids (32-bit where a vocabulary needs them) in ascending key order. Beside
each lies an index: a minimal perfect hash from document keys to slots (levels of bit sets; a key's slot is the rank of
its bit), and per slot a stored fingerprint, the first record and the number of records of that key. A reader finds a
key in constant time and checks the fingerprint, so a key that isn't stored is told apart.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.llm.common import fresh_path, shuffle_partitions, stored, texts_of
from heatloom.llm.pretokens import Bounded, pretokenizer

MAGIC = b"HLTOK001"
NULL_KEY = -(2**63)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of the keys for a level."""
    step = (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)
    x = keys.astype(np.uint64) + np.uint64(step)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about 3 bits a key, built and asked in whole arrays."""

    FINGERPRINT = 99

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.before = counts[:-1]
        self.size = int(counts[-1])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            n = max(8, int(gamma * len(left)))
            at = (mixed(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, PerfectHash.FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """keys: of the records in file order, equal ones together; offsets: where each record begins, in ids, and the end."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    prints, firsts, counts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8"), np.zeros(len(distinct), "<u8")
    prints[slot], firsts[slot], counts[slot] = fingerprints(distinct), first, count
    head = struct.pack("<8sIQQI", MAGIC, width, len(distinct), len(keys), len(table.levels)) + b"".join(struct.pack("<Q", len(b)) for b in table.levels)
    return head + b"".join(np.packbits(b).tobytes() for b in table.levels) + prints.tobytes() + firsts.tobytes() + counts.tobytes() + offsets.astype("<u8").tobytes()


class Shard:
    """Keyed access to one shard: `records(key)` reads only that key's ids."""

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path)
        with self.files.open_input_stream(self.path + ".idx") as f:
            raw = f.read()
        magic, self.width, n, m, k = struct.unpack_from("<8sIQQI", raw)
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token shard")
        at = struct.calcsize("<8sIQQI")
        sizes = struct.unpack_from(f"<{k}Q", raw, at)
        at += 8 * k
        levels = []
        for s in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (s + 7) // 8, at))[:s].astype(bool))
            at += (s + 7) // 8
        self.table = PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.first = np.frombuffer(raw, "<u8", n, at + 4 * n)
        self.count = np.frombuffer(raw, "<u8", n, at + 12 * n)
        self.offsets = np.frombuffer(raw, "<u8", m + 1, at + 20 * n).astype(np.int64)
        self.data = None

    def keys(self) -> np.ndarray:
        """Keys of the records in file order."""
        with self.files.open_input_stream(self.path + ".keys") as f:
            return np.frombuffer(f.read(), "<i8")

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; no records for a key that isn't stored."""
        slot = self.table.slots(keys)
        held = slot >= 0
        held[held] = self.prints[slot[held]] == fingerprints(keys[held])
        safe = np.where(held, slot, 0)
        return np.where(held, self.first[safe].astype(np.int64), 0), np.where(held, self.count[safe].astype(np.int64), 0)

    def blocks(self, most: int):
        """(first, last, ids) of neighbouring records, read together up to about `most` ids; a longer record is a block."""
        self.data = self.data or self.files.open_input_file(self.path)
        i, n = 0, len(self.offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1)
            begin, end = int(self.offsets[i]), int(self.offsets[j])
            yield i, j, np.frombuffer(self.data.read_at((end - begin) * self.width, begin * self.width), f"<u{self.width}")
            i = j

    def record(self, i: int) -> np.ndarray:
        self.data = self.data or self.files.open_input_file(self.path)
        begin, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.data.read_at((end - begin) * self.width, begin * self.width), f"<u{self.width}")

    def records(self, key: int) -> list[np.ndarray]:
        first, count = (x[0] for x in self.spans(np.array([key], np.int64)))
        return [self.record(i) for i in range(first, first + count)]


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, shard_ids: int = 32_000_000, shard_docs: int = 4_000_000, cached: int = 400_000) -> DataFrame:
    """Writes the shards and returns one row a shard: path, task, part, first_key, last_key, n_docs, n_ids.

    Ids are the library's without added special tokens, then end_id. The shards hold the documents in ascending doc_id
    order (nulls first, equal ids by a hash of the text). A shard closes after `shard_ids` ids or `shard_docs` documents, also between records of one id, and a
    range of ids is split by that hash, so a frequent id meets neither in a task nor in a file. A task writes each file under names of its own, so a
    repeated task disturbs no other, and only files that the returned table names count.
    """
    spark = docs.sparkSession

    def encode(batches):
        split = pretokenizer(vocabulary)
        width = 2 if max(split.library.get_vocab_size(with_added_tokens=True) - 1, end_id, *split.special.values()) < 65_536 else 4
        kind = f"<u{width}"
        coded = Bounded(lambda piece: np.array(split.ids(piece), kind).tobytes(), most=cached)
        look, end = coded.__getitem__, np.array([end_id], kind).tobytes()
        special = {s: np.array([i], kind).tobytes() for s, i in split.special.items()}
        files, root = fs.FileSystem.from_uri(path)
        from pyspark import TaskContext

        task, part, out = TaskContext.get().partitionId(), 0, None

        def close():
            out.close()
            name = posixpath.join(root, f"shard-{task:06d}-{part:04d}-{uuid.uuid4().hex[:8]}.ids")
            all_keys = np.array(keys, "<i8")
            for end_, data in ((".idx", index_bytes(all_keys, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]), width)), (".keys", all_keys.tobytes())):
                with files.open_output_stream(name + end_) as f:
                    f.write(data)
            files.move(temp, name)
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{posixpath.basename(name)}"], "task": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()), "first_key": pa.array([keys[0]], pa.int64()), "last_key": pa.array([keys[-1]], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([sum(sizes)], pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if split.plain(text):
                    body = b"".join(b"".join(map(look, split.pieces(p))) if k % 2 == 0 else special[p] for k, p in enumerate(split.parts(text)))
                else:
                    body = np.array(split.whole(text), kind).tobytes()
                key = NULL_KEY if key is None else key
                if out is not None and (sum_ids >= shard_ids or len(keys) >= shard_docs):
                    yield close()
                    part, out = part + 1, None
                if out is None:
                    temp = posixpath.join(root, f"_open-{uuid.uuid4().hex}")
                    out, keys, sizes, sum_ids = files.open_output_stream(temp), array("q"), array("q"), 0
                out.write(body + end)
                keys.append(key)
                sizes.append(len(body) // width + 1)
                sum_ids += sizes[-1]
        if out is not None:
            yield close()

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "k2").sortWithinPartitions("doc_id", "k2").drop("k2")
    shards = ordered.mapInArrow(encode, "path string, task int, part int, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint")
    return stored(shards, "token-shards")


def read_store(shards: DataFrame, block_ids: int = 4_000_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back from the shard files in blocks of about `block_ids` ids and cut by the index.

    start counts the ids of all records before it in the whole store.
    """
    order = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # one short row a shard
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                keys = shard.keys()
                distinct = np.unique(keys)
                firsts, counts = shard.spans(distinct)
                # what the index says of each key, held against the keys' file: each record is found under its key
                if not (np.repeat(distinct, counts) == keys[np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(len(keys))]).all():
                    raise ValueError(f"{path}: the index doesn't fit the records")
                for i, j, ids in shard.blocks(block_ids):
                    at = shard.offsets[i : j + 1]
                    for a in range(i, j, 20_000):
                        own = range(a, min(j, a + 20_000))
                        crcs = [zlib.crc32(ids[x - at[0] : y - at[0]].astype("<u4").tobytes()) for x, y in zip(shard.offsets[own.start : own.stop].tolist(), shard.offsets[own.start + 1 : own.stop + 1].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if x == NULL_KEY else x for x in keys[own.start : own.stop].tolist()], pa.int64()),
                                pa.array(base + shard.offsets[own.start : own.stop], pa.int64()),
                                pa.array(np.diff(shard.offsets[own.start : own.stop + 1]), pa.int64()),
                                pa.array(crcs, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = based.select("path", "base").repartition(shuffle_partitions(shards.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """key, ids for each distinct non-null key of keys (key bigint) and each record it has: a random read through the index.

    Each shard knows its smallest and largest key; keys meet shards in a range join. A key that isn't stored gives no row.
    """
    wanted = keys.where("key is not null").select(F.col("key").cast("bigint")).distinct()
    met = wanted.join(shards, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).groupBy("path").agg(F.collect_list("key").alias("keys"))

    def read(batches):
        for batch in batches:
            for path, ks in zip(batch.column("path").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                shard = Shard(path)
                found = [(k, ids.astype(np.int64).tolist()) for k in ks for ids in shard.records(k)]
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int64()))})

    return met.mapInArrow(read, "key bigint, ids array<bigint>")


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes docs (doc_id, text) to a new store in the shared folder and returns what `read_store` reads from it.

    A null or empty text has the end id alone. A null doc_id comes first and reads back as null (the smallest long is
    taken for it, so that id must not occur). Rows with the same doc_id are records of one key, next to each other, by
    a hash of the text. Other columns are ignored, so their names cannot clash. An empty table gives an empty one. Texts of any
    length are written whole.
    """
    return read_store(write_store(docs, vocabulary, fresh_path(docs.sparkSession, "token-store"), end_id))
