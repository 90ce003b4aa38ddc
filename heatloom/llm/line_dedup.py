"""Line dedup with DataFrame functions only: a suffix array over line-ID sequences by distributed prefix doubling.

Each document is a sequence of line IDs. A rank names the string of 2^k lines that starts at a place: the ranks of 2^k lines, 2^k apart, are
a pair, and the order of the distinct pairs that several places have is the rank of 2^(k+1) lines. Places with one rank are an interval of the suffix
array with a common prefix of 2^k lines. A place whose rank occurs once leaves; doubling goes on until no rank repeats.

Common-prefix intervals of the lengths between 2^k and 2^(k+1) follow from the ranks below: an interval is split by the ranks of 2^(k-1) lines after
its prefix, then of 2^(k-2) and so on. Places that agree go on with the longer prefix; the first of them also stays, for those
that agree with them on less. So every place learns the longest prefix that it shares with an earlier one: a maximal repeated run of lines. Later
copies are the runs with `min_words` words; their union is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.llm.common import drop, keyed, stored, unkeyed

PLACE = ["k1", "k2", "seq"]


def least_lines(words: Column, place: Column, min_words: int) -> Column:
    """Lines of the least stretch from a place on that has min_words words; null if the text ends before."""
    add = lambda acc, w: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["words"] + w).alias("words"), (acc["lines"] + 1).alias("lines")))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    # every line has a word, so min_words lines are always enough
    return F.aggregate(F.slice(words, place + 1, min_words), start, add, lambda acc: F.when(acc["words"] >= min_words, acc["lines"]))


def intervals(places: DataFrame, string: list[str], label: str) -> DataFrame:
    """number (its rank), first (place) of each string that occurs at several places. A range-partitioned sort gives the order of ranks, so no task holds more than its share.

    A table of its own: a join can then split the places of a frequent string over tasks.
    """
    place = F.struct(*PLACE)
    kinds = places.groupBy(*string).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return stored(kinds.orderBy(*string).select(*string, "first", F.monotonically_increasing_id().alias("number")), label)


def doubled(lines: DataFrame) -> list[DataFrame]:
    """Tables PLACE, least, rank, first of the places whose string of 1, 2, 4 ... lines occurs elsewhere too, as long as there are any. lines: PLACE, a, b, least."""
    now, string, size, levels = lines, ["a", "b"], 1, []
    while True:
        kinds = intervals(now, string, f"line-ranks-{size}")
        if kinds.isEmpty():
            drop(kinds)
            return levels
        level = now.join(kinds, string).select(*PLACE, "least", F.col("number").alias("rank"), "first")
        # rows equal in id and text are one document
        level = stored(level if levels else level.dropDuplicates(PLACE), f"line-places-{size}")
        drop(kinds)
        levels.append(level)
        after = level.select("k1", "k2", (F.col("seq") - size).alias("seq"), F.col("rank").alias("next"))
        now, string, size = level.drop("first").join(after, PLACE), ["rank", "next"], 2 * size


def copied_runs(lines: DataFrame) -> DataFrame:
    """PLACE, length: runs of lines that occur before, among them the longest one from each place on, where they have `least` lines."""
    levels = doubled(lines)
    is_later = F.struct(*PLACE) > F.col("first")
    state, found = None, []
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select(*PLACE, "least", F.lit(2**k).alias("length"), F.lit(k).alias("kind"), "rank", "first")
        if k + 1 < len(levels):
            # places that have no earlier copy of the next level's length, also those that are the first there: they stand for the others
            own = own.join(levels[k + 1].where(is_later).select(*PLACE), PLACE, "left_anti")
        if state is not None:
            after = levels[k].select("k1", "k2", F.col("seq").alias("at"), F.col("rank").alias("next"))
            tried = stored(state.withColumn("at", F.col("seq") + F.col("length")).join(after, ["k1", "k2", "at"], "left").drop("at"), f"line-tried-{2**k}")
            agreed = intervals(tried.where("next is not null"), ["kind", "rank", "next"], f"line-agreed-{2**k}")
            both = tried.join(agreed.withColumnsRenamed({"first": "first_longer", "number": "longer"}), ["kind", "rank", "next"], "left")
            short = F.struct("length", "kind", "rank", "first")
            long = F.struct((F.col("length") + 2**k).alias("length"), F.lit(-1 - k).alias("kind"), F.col("longer").alias("rank"), F.col("first_longer").alias("first"))
            leads = F.struct(*PLACE) == F.col("first_longer")
            states = F.when(F.col("longer").isNull(), F.array(short)).when(leads, F.array(short, long)).otherwise(F.array(long))
            split = stored(both.select(*PLACE, "least", F.explode(states).alias("x")).select(*PLACE, "least", "x.*"), f"line-states-{2**k}")
            drop(tried, agreed)
            own = split.unionByName(own)
        state = own
    if state is None:
        return lines.select(*PLACE, F.lit(0).alias("length")).where("false")
    return state.where(is_later & (F.col("length") >= F.col("least"))).select(*PLACE, "length")


def line_dedup(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """docs (doc_id, text, ...) with text without later copies, and n_lines, n_removed, n_runs after its own columns.

    A run of lines is a copy if it occurs before, in doc_id order and then in text order, and has min_words words in all. Lines
    without text are never part of a run, don't end one, and stay. A null text stays null and has no lines; an empty one has one. Rows equal in doc_id and
    text are one document, and come out alike; a null doc_id is the smallest. Columns named n_lines, n_removed or n_runs in docs are replaced. An
    empty table gives an empty one. Texts of any length are read whole; a document's lines are kept together, not a line's documents.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    rows = keyed(docs)
    lines = rows.select("k1", "k2", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "").alias("lines"))
    lines = lines.withColumn("words", F.transform("lines", lambda x: F.size(F.array_remove(F.split(x, " "), ""))))
    detail = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), least_lines(F.col("words"), i, min_words).alias("least")))
    places = lines.select("k1", "k2", F.posexplode(detail).alias("seq", "x")).select(*PLACE, "x.*")
    runs = copied_runs(places)
    # Runs overlap: of each, what reaches past those before it.
    before = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("seq", "end").rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.withColumn("end", F.col("seq") + F.col("length")).withColumn("begin", F.greatest("seq", before)).where("begin < end")
    spans = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    removed = spans.select("k1", "k2", F.array_sort(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1)))).alias("removed"))
    removed = removed.withColumn("n_runs", F.size(F.array_except("removed", F.transform("removed", lambda s: s + 1))).cast("bigint"))
    joined = rows.join(removed, ["k1", "k2"], "left")
    split = F.split("text", "\n", -1)
    # Line numbers of the lines with text, then of the removed ones.
    full = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.trim(F.get("all", i)) != "")
    gone = F.transform("removed", lambda s: F.get("full", s))
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")
    step = joined.withColumn("all", F.when(F.col("removed").isNotNull(), split)).withColumn("full", F.when(F.col("removed").isNotNull(), full))
    step = step.withColumn("gone", gone).withColumn("left", F.when(F.col("removed").isNotNull(), left))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("all", i)), "\n"))
    counts = [
        F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
    ]
    return unkeyed(step, own, kept, counts)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 of every row of docs."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB SQL: lines with i (from 1), and seq among the lines with text; st: the least stretches (l lines from p on) with 10 words, from each line on and up to each line. A run
#: with 10 words is a copy just if these are; gone: their lines.
ORACLE_LINES = """
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {table}),
x AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
nb AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words FROM x WHERE trim(line) <> ''),
t AS (SELECT doc_id, list(line ORDER BY seq) AS ls, list(words ORDER BY seq) AS ws FROM nb GROUP BY doc_id),
e AS (SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS p FROM t),
f AS (SELECT doc_id, ls, p,
  list_filter(range(1, 11), lambda l: p + l - 1 <= len(ls) AND list_sum(ws[p:p + l - 1]) >= 10)[1] AS forth,
  list_filter(range(1, 11), lambda l: l <= p AND list_sum(ws[p - l + 1:p]) >= 10)[1] AS back FROM e),
st AS (SELECT doc_id, p, forth AS l, ls[p:p + forth - 1] AS s FROM f WHERE forth IS NOT NULL UNION SELECT doc_id, p - back + 1, back, ls[p - back + 1:p] FROM f WHERE back IS NOT NULL),
later AS (SELECT doc_id, p, l FROM (SELECT doc_id, p, l, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM st) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + l)) AS seq FROM later),
cut AS (SELECT doc_id, i, seq FROM nb JOIN gone USING (doc_id, seq)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM x ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)"""
ORACLE = f"""
WITH {ORACLE_LINES.format(table="documents")},
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> seq - 1) AS n_runs FROM (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM cut) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
