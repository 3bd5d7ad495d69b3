"""The text_files source: what is read and written, and what failures leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.plans.compact import rewrite_rows
from palimpsest.sources import text_files


def tree(path):
    return {os.path.relpath(os.path.join(f, n), path): open(os.path.join(f, n), newline="").read() for f, _, names in os.walk(path) for n in names}


@pytest.fixture
def given(spark, tmp_path):
    text_files.register(spark)
    files = {f"a/{i}.txt": f"text {i}\r\n" * i for i in range(30)} | {"b.md": "é\n", "empty.txt": ""}
    for name, text in files.items():
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode())
    (tmp_path / "in" / ".hidden").write_text("no")
    return files


def test_round_trip(spark, tmp_path, given):
    held = spark.read.format("text_files").option("part_bytes", 300).load(str(tmp_path / "in"))
    assert {r.name: r.text for r in held.collect()} == given and held.rdd.getNumPartitions() > 5
    assert held.sparkSession.read.format("text_files").option("pattern", ".md").load(str(tmp_path / "in")).count() == 1
    out = str(tmp_path / "out")
    held.write.format("text_files").mode("append").save(out)
    assert tree(out) == given
    held.where("name = 'b.md'").withColumn("text", F.lit(None).cast("string")).write.format("text_files").mode("append").save(out)
    assert tree(out) == given | {"b.md": ""}
    held.where("name like 'a/%'").write.format("text_files").mode("overwrite").save(out)
    assert tree(out) == {k: v for k, v in given.items() if k.startswith("a/")}
    held.limit(0).write.format("text_files").mode("append").save(out)
    assert len(tree(out)) == 30


def test_failures_leave_nothing(spark, tmp_path, given):
    """A task that dies after it wrote, a name twice, and a name outside the folder."""
    held = spark.read.format("text_files").option("part_bytes", 300).load(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    held.where("name = 'b.md'").write.format("text_files").mode("append").save(out)
    dies = held.withColumn("text", F.when(F.col("name") == "a/29.txt", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    for bad in (dies, held.unionByName(held), held.withColumn("name", F.concat(F.lit("../"), "name")), held.withColumn("name", F.concat(F.lit("/"), "name"))):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception):  # noqa: B017
                bad.write.format("text_files").mode(mode).save(out)
            assert tree(out) == {"b.md": "é\n"} and sorted(os.listdir(out)) == ["b.md"]
    assert tree(tmp_path / "in") == given | {".hidden": "no"}


def test_rewritten_files(spark, tmp_path, given):
    (tmp_path / "in" / "log.txt").write_text("line with blanks   \n\n\n\n\n" * 200)
    held = spark.read.format("text_files").load(str(tmp_path / "in"))
    done = rewrite_rows(held, Config(stages=("whitespace",))).select("name", F.coalesce("compressed", "text").alias("text"))
    done.write.format("text_files").mode("append").save(str(tmp_path / "out"))
    got = tree(tmp_path / "out")
    assert got["log.txt"].count("\n\n\n") == 0 and len(got["log.txt"]) < 200 * 25 and got["b.md"] == "é\n"
