"""What the chain leaves on disk while it runs: a step shuffles its rows once, and tables and shuffle files go when they have been read."""

import os
import re
import time
import uuid

from pyspark.sql import functions as F

from pagewright.operators import clean, merge, store
from pagewright.plans import structure

from .test_structure import paragraphs, spans_of

SPANS = "doc_id long, page int, seq int, text string, font string, font_size double, x0 double, y0 double, x1 double, y1 double, page_height double, flags int"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def test_shuffle_files_go_and_tables_can_be_let_go(spark):
    before = shuffle_files(spark)
    table = store.kept(spark.range(20000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and table.count() == 100
    path = table.kept_at.removeprefix("file://")
    assert os.path.isdir(path)
    store.let_go(table, spark.range(1))
    assert not os.path.exists(path)


def test_the_chain_keeps_few_tables(spark, tmp_path, monkeypatch):
    spans = spark.createDataFrame([(d, p, s, f"word {d} {p} {s}.", "Times", 11.0, 72.0, 90.0 + 30 * s, 99.0, 99.0 + 30 * s, 800.0, 0) for d in range(3) for p in range(2) for s in range(3)], SPANS)
    tables = spark.createDataFrame([], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(store, "folder", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    found = structure.to_markdown(spans, tables)
    assert len(os.listdir(tmp_path)) == 2  # lines, and the headers and pipe lines among those before
    assert found.count() == 3


def test_paragraphs_are_shuffled_once(spark, tmp_path):
    paragraphs(spark, [(1, 0, 0, spans_of(["1 | a"]))]).write.parquet(f"{tmp_path}/p")
    rows = spark.read.parquet(f"{tmp_path}/p")
    heads = store.kept(spark.createDataFrame([(1, "a")], "doc_id long, header string"))
    for df in (clean.drop_running_headers(rows, heads), merge.join_pages(rows)):
        todo, dealt = [df._jdf.queryExecution().executedPlan().initialPlan()], set()
        while todo:  # reused exchanges are alike but for the numbers of their columns
            node = todo.pop()
            if node.nodeName().startswith("Exchange") and any(node.output().apply(i).name() == "spans" for i in range(node.output().size())):
                dealt.add(re.sub(r"plan_id=\d+", "", node.canonicalized().treeString()))
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert len(dealt) == 1
