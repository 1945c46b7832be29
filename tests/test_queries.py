import math
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["cliff_per_patient", "dl_meta", "bootstrap_dl", "mwu_u", "kruskal_h", "spearman", "stratified_minima", "even_with_topup", "log_cpm", "hvg_topk", "panel_zscore_argmax", "quintile_bins", "dual_label_mal", "coverage_table", "knn_graph", "forman_edges", "contact_topk", "graph_clustering", "connected_components", "average_precision", "arm_moving_average"]


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(repr(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert shown(ours) == shown(theirs)


@pytest.mark.parametrize("name", ["dispersion_seurat", "dispersion_cell_ranger"])
def test_dispersions_are_given_for_any_number_of_genes(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    assert "Limit" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == tables.execute(f"select count(*) from ({entry.oracle_sql()[name]})").fetchone()[0]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [["corpus_pipeline.py"], []])
def test_the_rest_imports_without_the_llm_folders(tmp_path, also):
    """Without corpus_pipeline.py as well, and with that file left behind."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", *also, "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


def test_analyses_run_over_all_rows(spark, tables, monkeypatch):
    from orrery.operators import meta

    n = tables.execute("select count(*) from embeddings").fetchone()[0]
    assert entry.queries()["pseudotime"](spark, DATA).count() == n
    assert sum(r.n for r in entry.queries()["bakry_emery"](spark, DATA).collect()) == n
    seen, whole = [], meta.bootstrap_cliff

    def watched(df, *args, **kwargs):
        seen.append(df.count())
        return whole(df, *args, **kwargs)

    monkeypatch.setattr(meta, "bootstrap_cliff", watched)
    entry.queries()["bootstrap_cliff"](spark, DATA)
    assert seen == [tables.execute("select count(*) from events where event_type in ('purchase', 'view')").fetchone()[0]]
