"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every k-word gram a 64-bit hash is taken; of each window of w neighbouring grams the smallest is a fingerprint. Any
stretch of k + w - 1 words that a text shares with a benchmark item then shares a fingerprint at the same place in it. Fingerprints of
documents meet those of the items in a join; around each hit the words themselves are compared, in all windows that
hold the gram, so hits are exact and extend as far as the texts agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import keyed, stored, unkeyed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a packed value: a gram's place in its text, as long as they last (the window tells which of the places it is); the other bits are its hash.
PLACE = (1 << 26) - 1


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of digits, ASCII letters and other characters from U+0080; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def grams_of(length: int, places: int) -> Column:
    """Grams for windows of `length` words, of the column h (hashes of words): hash and place in one number."""
    k = (length + 1) // 2
    w = length - k + 1
    # No filter on the number of words: it would split each text once more.
    upto = lambda last, least: F.when(last >= least, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]).bitwiseAND(~places)
    return F.transform(upto(F.size("h") - k, w - 1), lambda i: gram(i).bitwiseOR(i.cast("bigint").bitwiseAND(places)))


def least_grams(length: int, grams: str, places: int) -> Column:
    """The leftmost of the smallest grams of each window of `length` words, from the column `grams`."""
    k = (length + 1) // 2
    w = length - k + 1
    smallest = lambda xs: F.least(*xs) if w > 1 else xs[0]
    plain = lambda i: smallest([F.get(grams, i + j) for j in range(w)])

    def careful(i: Column) -> Column:
        # where places start again inside the window, the place in the window decides between equal hashes
        y = smallest([F.get(grams, i + j).bitwiseAND(~places).bitwiseOR(F.lit(j).cast("bigint")) for j in range(w)])
        wraps = (i.cast("bigint") % (places + 1)) + w > places + 1
        return F.when(wraps, y.bitwiseAND(~places).bitwiseOR((i + y).bitwiseAND(places))).otherwise(plain(i))

    begins = F.when(F.size(grams) >= w, F.sequence(F.lit(0), F.greatest(F.size(grams) - w, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(grams) <= places, F.transform(begins, plain)).otherwise(F.transform(begins, careful))


def fingerprints(rows: DataFrame, keys: list[str], lengths: list[int], places: int = PLACE) -> DataFrame:
    """keys, length, fp, place, around, at: a row for each winnowed gram of the column words, for windows of each of `lengths` words.

    around holds the words of all windows with the gram, at is the gram's index in it. A text is split and its words are hashed once for all lengths.
    """
    rows = rows.select(*keys, "words", F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.select(*keys, "words", *[grams_of(n, places).alias(f"g{n}") for n in lengths])
    rows = rows.select(*keys, "words", *[least_grams(n, f"g{n}", places).alias(f"m{n}") for n in lengths])

    def details(n: int) -> Column:
        m, w = F.col(f"m{n}"), n - (n + 1) // 2 + 1

        def detail(x: Column, place: Column) -> Column:
            begin = F.greatest(place - (w - 1), F.lit(0))
            return F.struct(F.lit(n).alias("length"), x.bitwiseAND(~places).alias("fp"), place.alias("place"), F.slice("words", begin + 1, place + n - begin).alias("around"), (place - begin).alias("at"))

        # neighbouring windows with the same gram give it once; in a long text a packed value may come again elsewhere
        new = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        few = F.transform(F.array_distinct(m), lambda x: detail(x, x.bitwiseAND(places).cast("int")))
        many = F.transform(new, lambda i: detail(F.get(m, i), i + (F.get(m, i) - i).bitwiseAND(places).cast("int")))
        return F.when(F.size("words") <= places, few).otherwise(many)

    found = F.concat(*[details(n) for n in lengths])
    return rows.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def windows_hit(docs: DataFrame, items: DataFrame, window: int, lengths: list[int], small: int, places: int) -> DataFrame:
    """doc keys, begin, length, ids: windows of items in docs. docs: k1, k2, words; items: item, words. An item of fewer than `window` words is one window."""
    own = [fingerprints(items.where(F.size("words") >= n if n == window else F.size("words") == n), ["item"], [n], places) for n in lengths]
    found = reduce(DataFrame.union, own).groupBy("length", "fp", "around", "at").agg(F.collect_set("item").alias("ids"))
    found = stored(found.withColumnsRenamed({"around": "i_around", "at": "i_at"}), "benchmark-fingerprints")
    # The measured size in memory decides (characters, and about 60 bytes for each word, id and row); beyond it the join shuffles.
    words = F.aggregate("i_around", F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x) + 60)
    size = found.agg(F.sum(words + F.aggregate("ids", F.lit(60).cast("bigint"), lambda acc, x: acc + F.octet_length(x) + 60))).first()[0]
    if (size or 0) <= small:
        found = F.broadcast(found)
    met = fingerprints(docs, ["k1", "k2"], lengths, places).join(found, ["length", "fp"])
    n = F.col("length")
    w = n - F.floor((n + 1) / 2).cast("int") + 1
    same = F.filter(
        F.sequence(F.lit(0), w - 1),
        lambda d: (d <= F.col("at"))
        & (d <= F.col("i_at"))
        & (F.size("around") >= F.col("at") - d + n)
        & (F.size("i_around") >= F.col("i_at") - d + n)
        & (F.slice("around", F.greatest(F.col("at") - d + 1, F.lit(1)), n) == F.slice("i_around", F.greatest(F.col("i_at") - d + 1, F.lit(1)), n)),
    )
    return met.select("k1", "k2", "ids", "place", "length", F.explode(same).alias("d")).select("k1", "k2", (F.col("place") - F.col("d")).alias("begin"), "length", "ids")


def keyed_words(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (a key of id and text), words."""
    k1 = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(F.col("doc_id").cast("bigint"), k1.alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), words_of(F.col("text")).alias("words"))


def benchmark_hits(keyed: DataFrame, benchmark: DataFrame, window: int, small: int, places: int) -> DataFrame:
    """k1, k2, begin, length, ids: all windows of benchmark items in keyed (k1, k2, words)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stored(items, "benchmark-words")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())  # at most `window` numbers
    return windows_hit(keyed, items, window, lengths or [window], small, places)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, small: int = 64_000_000, places: int = PLACE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text).

    benchmark has item_id, text. A window is `window` words of an item in a row, or a shorter item's whole words; words inside any occurrence of
    a window are hit. Null and empty texts have no words and no hits; items without words have no windows; an item with a null id counts under
    the id "". Rows with a null or repeated doc_id have results of their own. Other columns are ignored, so their names cannot clash. Empty tables
    give no rows, or no hits. Whole texts of any length are read (hits are kept for a document at a time). Windows of
    items are broadcast up to `small` bytes. `places` (a power of two less one, no smaller than the window) packs a word's place and changes no result.
    """
    keyed = keyed_words(docs)
    hits = benchmark_hits(keyed, benchmark, window, small, places)
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("begin", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        to = x["begin"] + x["length"]
        return F.struct(F.greatest(acc["end"], to).alias("end"), (acc["n"] + F.greatest(to - F.greatest(acc["end"], x["begin"]), F.lit(0))).alias("n"))

    scored = spans.select("k1", "k2", F.aggregate("spans", start, add)["n"].alias("n_hit"), F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    counted = keyed.select("doc_id", "k1", "k2", F.size("words").cast("bigint").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    return counted.join(scored, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, small: int = 64_000_000, places: int = PLACE) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of a benchmark item occurs; else as contamination."""
    hit = benchmark_hits(keyed_words(docs), benchmark, window, small, places).select("k1", "k2").distinct()
    return unkeyed(keyed(docs).join(hit, ["k1", "k2"], "left_anti"), docs.columns)


#: DuckDB SQL of op8; also a part of the pipeline's checks.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: list_slice(w, p, p + least(len(w), 10) - 1))) AS win FROM i WHERE len(w) > 0),
u AS (SELECT win, l, list(DISTINCT item_id) AS ids FROM iw GROUP BY win, l),
dw AS (SELECT doc_id, l, p, list_slice(w, p, p + l - 1) AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM u))),
h AS (SELECT doc_id, p, l, ids FROM dw JOIN u USING (win, l)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(unnest(ids) AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
