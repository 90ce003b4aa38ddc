"""What the near copies' stage counts, and what it leaves on disk."""

import numpy as np
from pyspark.sql import functions as F

from heatloom.llm import simhash
from heatloom.llm.common import drop, keyed, stored
from heatloom.llm.shingle_sets import grams_of


def test_shingles_of_all_texts_are_counted(spark):
    """A passage of two texts comes last in their order, whatever else is frequent and whichever texts they are."""
    passage = " ".join(f"shared{i}" for i in range(24))
    texts = [f"{passage} " + " ".join(f"own{k // 2}x{k}x{i}" for i in range(60)) if k % 20 < 2 else " ".join(f"other{k}x{i}" for i in range(70)) for k in range(200)]
    rows = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("k1", "k2", "text")
    counts = simhash.counters(rows, 5)
    assert counts.sum() == sum(len(grams_of(t, 5)) for t in texts)
    common = set(grams_of(passage, 5).tolist())
    found = simhash.prefix_table(rows, 5, 0.8, counts).select("prefix").collect()
    prefixes = [np.array(r.prefix, np.int64).view(np.uint64) for r in found]
    assert len(prefixes) == 200 and all(len(p) > 10 and not common & set(p.tolist()) for p in prefixes)


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    rows = spark.range(10_000).withColumn("k", F.col("id") % 100)
    spark._jvm.System.gc()
    before = files()
    tables = [stored(rows.groupBy("k").agg(F.sum("id").alias("s")), "sums") for _ in range(3)]
    assert files() <= before
    assert [t.count() for t in tables] == [100] * 3
    drop(*tables)
