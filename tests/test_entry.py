import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT

DATA = "/root/testdata/sf0.001"


def test_entry_works_without_the_deletable_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "arcwright")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"arcwright\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["match_partial_fallback", "bfs_d2", "rank_topk_seeds", "fed_nodes", "diff_sig_changed", "merge_edges", "sample_nodes", "facts_edges"])
def test_queries_equal_their_sql(spark, name):
    from arcwright.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 51
