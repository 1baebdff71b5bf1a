import ast
import pathlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from parleyframe.llm import queries
from tests.llm.test_decontaminate import brute
from tests.llm.test_packing import check

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages(spark, stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    counts = [stages[n].count() for n in names]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] <= counts[5]
    items = [(str(r["item_id"]), r["text"])
             for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(brute(t, items, 10)[0] for t in list(
        texts(stages["benchmark_decontamination"]).values())[::9])
    before, after = texts(stages["benchmark_decontamination"]), texts(stages["pii"])
    assert not any("@mail" in t for t in after.values())
    changed = {i for i in before if before[i] != after[i]}
    assert changed and all(any(c.isdigit() or c == "@" for c in before[i]) for i in changed)
    packed = stages["best_fit_packing"].collect()
    used = check(packed, list(after.items()), 4096)
    assert used <= -(-sum(r["length"] for r in packed) // 4096) + 1


def test_run_is_the_stages(spark, stages):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select(columns).collect())) == sorted(
        map(tuple, stages["best_fit_packing"].select(columns).collect()))


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_nothing_else_imports_the_folder():
    for path in (ROOT / "parleyframe").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [
                    node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in name for name in names)
