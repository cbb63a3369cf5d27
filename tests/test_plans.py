"""Plan shape guards: pruned scans, broadcast dimensions, no cross joins."""

import inspect
from types import SimpleNamespace

import pytest

from tessera.operators import dedup, label
from tessera.plans import catalog
from tessera.session import ensure_checkpoint_dir
from tessera.sinks import writers

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_dims_broadcast(spark):
    plan = _plan(label.corpus_raw(spark, SF_SMALL))
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line or "FileScan parquet" in line]
    assert schemas
    for col in ("lang", "n_chars", "label:int"):
        assert all(col not in s for s in schemas), col
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_windows_are_partitioned_and_shards_are_rebalanced(spark):
    """No window spans a table, and no bucket is written by one task."""
    for name in ("paraphrase_requests", "top_tags", "fill_to_target", "registry_upsert", "near_dup_first"):
        plan = _plan(catalog.REGISTRY[name](spark, SF_SMALL))
        assert "SinglePartition, ENSURE" not in plan, name
    source = inspect.getsource(writers.write_shards)
    assert "rebalance" in source and "repartition" not in source


def test_reports_read_the_written_corpus(spark):
    """A report reads one table, not the five sources."""
    for name in ("source_stats", "skip_funnel", "label_frequency", "bucket_sizes", "registry_upsert"):
        scans = [x for x in _plan(catalog.REGISTRY[name](spark, SF_SMALL)).split("\n") if "Scan parquet" in x]
        assert scans and all("testdata" not in x for x in scans), name


def test_bands_need_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert "Exchange" not in _plan(dedup.document_members(docs))


def test_a_cluster_needs_a_shared_folder(spark):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)


def test_no_cartesian_products(spark):
    for name in ("paraphrase_requests", "sampling_reduction", "adapter_flatten", "coverage_audit"):
        plan = _plan(catalog.REGISTRY[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
