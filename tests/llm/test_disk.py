"""What a job of many steps leaves on disk."""

import os
import time

from pyspark.sql import functions as F

from arlens.llm import order_minhash as om
from arlens.llm.common import dispose, stored
from arlens.session import checkpoint_dir


def shuffles(spark) -> list[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")]


def settled(spark, most: int) -> bool:
    """Whether at most ``most`` shuffle files are left; they go a little after their job."""
    return any(len(shuffles(spark)) <= most or time.sleep(0.2) for _ in range(50))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 700).alias("k"))
    sums = rows.join(rows.groupBy("k").agg(F.sum("id").alias("s")), "k").repartition(5, "s")  # planned before it is stored
    before = len(shuffles(spark))
    table = stored(sums, "kept")
    assert settled(spark, before) and table.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sums.count() == 5000  # the frame itself still works


def test_disposed_tables_are_gone_and_others_stay(spark):
    one, two = stored(spark.range(5).toDF("a"), "one"), stored(spark.range(6).toDF("a"), "two")
    paths = [x._arlens_path.removeprefix("file:") for x in (one, two)]
    dispose(one, spark.range(3), two.filter("a > 1"))
    assert [os.path.exists(p) for p in paths] == [False, True] and two.count() == 6


def test_near_duplicates_keeps_only_what_its_result_reads(spark, prose):
    texts = [prose(i, 60) for i in range(30)]
    texts += [t + " more words here" for t in texts[:10]] + texts[:4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "arlens-llm")
    had = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = om.near_duplicates(docs)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - had}
    assert not left & {"signatures", "representatives", "members", "shared", "candidates", "centres", "texts", "crowded", "rare-runs", "shared-runs", "nodes"}
    assert {"signed", "classes"} <= left
    assert found.select("class_id").distinct().count() == 30


def test_members_are_the_shared_sketches_however_many_parts(spark):
    reps = spark.createDataFrame([(n, 9, [n % 4 - 2, 100 + n, -7 * (n // 2)]) for n in range(20)], "node long, n_words long, sketches array<long>")
    count = {}
    for n in range(20):
        for b in (n % 4 - 2, 100 + n, -7 * (n // 2)):
            count.setdefault(b, []).append(n)
    want = sorted((b, n) for b, nodes in count.items() if len(nodes) > 1 for n in nodes)
    for parts in (1, 3, om.PARTS):
        assert sorted((r["bucket"], r["node"]) for r in om.members(reps, parts).collect()) == want
