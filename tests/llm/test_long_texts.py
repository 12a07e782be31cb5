import os
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import ODD, plain_stats

from tessera.llm import decision_list

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_parts_add_up(spark, monkeypatch):
    """Texts counted in rows of parts have the same values as in one row, wherever they are cut."""
    rng = random.Random(8)
    some = ["a", "b", "c", "Der", "é😀", "#x!", "12", "w" * 50, " ", " z"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", " ", "\n", "\t", "\n\n", " \r\n", "\x0b", "\x0c" * 20]) for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += [*texts[:3], *ODD, " " * 100, "\n" * 100, "\n" + "y" * 100, "one two three four five six " * 9, "same line\n" * 30, "x" * 90 + " " + "x" * 90]
    docs = spark.createDataFrame([(k % 50, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, _key string")
    whole = decision_list.text_stats(docs).collect()
    assert {r.text: tuple(r[k] for k in decision_list.BASE) for r in whole} == {t: plain_stats(t) for t in texts}
    for long, part in ((-1, 16), (30, 1), (60, 64)):
        monkeypatch.setattr(decision_list, "LONG", long)
        monkeypatch.setattr(decision_list, "PART", part)
        cut = decision_list.text_stats(docs)
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole)), (long, part)


LONG_TEXTS = """
import sys
from pyspark.sql import SparkSession
from tessera.llm import decision_list
base = sys.argv[1]
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.files.maxPartitionBytes": "1m", "spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.warehouse.dir": f"{base}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
judged = decision_list.text_stats(spark.read.parquet(f"{base}/documents.parquet")).where(~decision_list.base_failed())
judged.select("doc_id", "text", *decision_list.BASE).write.parquet(f"{base}/out")
"""


def test_long_texts_fit(tmp_path):
    """Texts of 12 MB in a JVM of 1 GB, two at a time."""
    rng = random.Random(9)
    want = {}
    (tmp_path / "documents.parquet").mkdir()
    for k in range(2):
        words = [f"{rng.randrange(10**5):05d}" for _ in range(2_000_000)]
        text = " ".join(words[:1_000_000]) + "\n" + " ".join(words[1_000_000:])
        want[k] = (text, *plain_stats(text))
        pq.write_table(pa.table({"doc_id": [k], "text": [text]}), tmp_path / f"documents.parquet/{k}.parquet")
    env = os.environ | {"PYTHONPATH": REPO, "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    ran = subprocess.run([sys.executable, "-c", LONG_TEXTS, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    if ran.returncode:
        pytest.fail(ran.stderr[-2000:])
    assert {r["doc_id"]: tuple(r.values())[1:] for r in pq.read_table(tmp_path / "out").to_pylist()} == want
