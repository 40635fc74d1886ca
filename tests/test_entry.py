"""The driver's contract, also in a checkout without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["oakmill/llm"], ["oakmill/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
            (path / "__pycache__").mkdir(parents=True)  # as a deletion of tracked files leaves it
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(k.startswith('op1_') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql, pipeline, ops = done.stdout.split()[-4:]
    assert int(queries) >= int(sql) > 50 and pipeline == "False"
    if "oakmill/llm" in gone:
        assert ops == "False"


def test_every_sql_has_its_query():
    sys.path.insert(0, REPO)
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
