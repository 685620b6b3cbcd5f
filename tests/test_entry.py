"""The entry with and without the optional subpackage."""

import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from quern.plans import queries as plans

ROOT = Path(__file__).resolve().parent.parent


def test_every_plan_is_registered():
    assert plans.queries().keys() <= __spark_entry__.queries().keys()
    assert set(plans.oracle_sql().items()) <= set(__spark_entry__.oracle_sql().items())
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.plans.queries()), e.oracle_sql() == e.plans.oracle_sql())"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
        assert done.stdout.strip() == "True True", done.stderr


def test_a_missing_library_leaves_the_rest():
    code = (
        "import sys, warnings; sys.modules['ahocorasick'] = sys.modules['xxhash'] = None\n"
        "import __spark_entry__ as e\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    found = e.queries()\n"
        "print(sorted(found) == sorted(e.plans.queries()), e.oracle_sql() == e.plans.oracle_sql(), any('left out' in str(w.message) for w in said))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    said = importlib.util.find_spec("quern.llm") is not None
    assert done.stdout.strip() == f"True True {said}", done.stderr


def test_absent_modules_and_errors_inside_present_ones(tmp_path, monkeypatch):
    assert importlib.util.find_spec("quern.llm") is None or __spark_entry__._optional("quern.llm.queries") is not None
    assert __spark_entry__._optional("quern.absent") is None and __spark_entry__._optional("absent_package.module") is None
    (tmp_path / "faulty_module.py").write_text("1 / 0")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        __spark_entry__._optional("faulty_module")
