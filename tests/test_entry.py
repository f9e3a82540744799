import importlib
import sys

import pytest


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    importlib.import_module("nearfield")
    for name in [m for m in sys.modules if m.startswith("nearfield.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("nearfield.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr(sys.modules["nearfield"], "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "knn_angular" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry_without_a_library(monkeypatch):
    """A library that the subpackage lacks is told, not taken for its removal."""
    entry = importlib.import_module("__spark_entry__")

    def missing(module):
        raise ModuleNotFoundError("tiktoken", name="tiktoken")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("nearfield.llm.registry")


@pytest.mark.parametrize("name", ["pareto", "knn_jaccard_documents", "report_level_curves_hnsw", "all_metrics"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    key = lambda p: sorted(map(str, p[cols].round(4).astype(str).itertuples(index=False)))
    assert sorted(want.columns) == cols and len(want) == len(got)
    assert key(want.astype(got.dtypes.to_dict())) == key(got)


def test_garbage_of_written_tables_is_collected(spark):
    """Long queries write many tables; the driver's heap doesn't grow with them."""
    from nearfield import storage

    def full() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return max(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName() and "Scavenge" not in b.getName() and b.getName() != "Copy")

    before = full()
    for i in range(12):
        storage.materialise(spark.range(10), f"tidy-{i}")
    assert full() - before >= 3
