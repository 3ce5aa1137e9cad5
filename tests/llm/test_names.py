"""Columns whose names clash with internal ones pass through the stages unchanged; workers need no repository."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from emberline.llm import decontaminate, mixing, pii, sharding, simhash, toxicity

CLASHING = ["_id", "_h", "_h1", "_h2", "row", "_row", "key", "root", "_unit", "_copies", "_copy", "_run", "_last", "_again", "_k", "_text_key", "unit", "copies", "item", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} and some other words number {i * 7} of a text that goes on {i}", "en", f"s{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.col("doc_id") * 100 + i for i, c in enumerate(CLASHING)}).cache()


def unchanged(found, docs, but=()):
    columns = [c for c in docs.columns if c not in but]
    have = {tuple(r) for r in docs.select(*[f"`{c}`" for c in columns]).collect()}
    rows = [tuple(r) for r in found.select(*[f"`{c}`" for c in columns]).collect()]
    return rows and set(rows) <= have


def test_stages_keep_clashing_columns(spark, docs):
    assert unchanged(mixing.apply_mix(docs), docs)
    kept = simhash.keep_one(docs, bits=4, shingles=(5, 4), similarity=0.8)
    assert unchanged(kept, docs) and kept.columns == docs.columns
    dealt = sharding.shard_docs(docs, shards=3)
    assert unchanged(dealt, docs) and dealt.columns == [*docs.columns, "shard", "slot"] and dealt.count() == 12
    assert unchanged(pii.pseudonymize(docs, "k"), docs, but=("text",))


def test_both_sizes_of_benchmark_keep_them(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, "and some other words number 21 of a text that goes on 3")], "item_id long, text string")
    small = decontaminate.scan(docs, benchmark)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    large = decontaminate.scan(docs, benchmark)
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert unchanged(large, docs)


def test_many_exceptions_keep_them(spark, docs, monkeypatch):
    monkeypatch.setattr(pii, "MAX_EXCEPTIONS", -1)
    assert unchanged(pii.pseudonymize(docs, "k"), docs, but=("text",))


BARE = """
    import sys, os, tempfile
    repo, data = sys.argv[1:3]
    sys.path.insert(0, repo)
    os.environ.pop("PYTHONPATH", None)
    from pyspark.sql import SparkSession
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
             .config("spark.checkpoint.dir", "file://" + shared).config("spark.sql.warehouse.dir", shared + "/w").getOrCreate())
    from emberline.llm.queries import QUERIES
    spark.range(1).mapInArrow(lambda batches: (b for b in batches), "id long").collect()
    def absent(batches):
        import importlib.util
        assert importlib.util.find_spec("emberline") is None, "the workers see the repository"
        yield from batches
    spark.range(1).mapInArrow(absent, "id long").collect()
    for name in sys.argv[3:]:
        print(name, QUERIES[name](spark, data).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_workers_need_no_repository(tmp_path):
    """Executors of another process, with neither the path nor the folder of the repository."""
    from emberline.llm.queries import QUERIES

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "run.py").write_text(textwrap.dedent(BARE))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")} | {"PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    home = tmp_path / "home"
    home.mkdir()
    import pyspark

    for p in os.listdir(os.path.dirname(pyspark.__file__)):
        os.symlink(os.path.join(os.path.dirname(pyspark.__file__), p), home / p)
    names = [n for n in QUERIES if n not in ("op4_toxicity",)]
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), repo, "/root/testdata/sf0.001", *names], cwd=tmp_path, env=env | {"SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()[-len(names) :]] == names


def test_toxicity_travels_by_value():
    """What op4 sends to workers unpickles without the module (its fit takes too long for the bare run)."""
    from pyspark import cloudpickle

    data = cloudpickle.dumps(toxicity.features)
    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); assert len(f('a bc')) == 2"
    assert subprocess.run([sys.executable, "-c", code], input=data, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
