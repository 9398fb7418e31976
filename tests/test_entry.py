"""The entry module of a copy from which the training-data folders were removed, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

from twinweave.plans.oracles import ORACLE_SQL
from twinweave.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0, said.stderr
    lines = {x.split()[0]: x.split()[1:] for x in said.stdout.splitlines() if x.startswith(("NAMES", "SQL"))}
    return lines["NAMES"], lines["SQL"]


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, held: {x for x in held if x in (".git", "llm", "__pycache__") or x == "corpus_pipeline.py" and not pipeline})
    assert not (copy / "twinweave" / "llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    held, sql = names(copy)
    assert held == sorted(QUERIES) and sql == sorted(ORACLE_SQL)


@pytest.mark.skipif(not os.path.exists(os.path.join(ROOT, "twinweave", "llm")), reason="the folders are removed here")
def test_errors_of_the_subpackage_are_raised(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    assert set(QUERIES) < {*names(copy)[0]}
    (copy / "twinweave" / "llm" / "common.py").write_text("import a_module_that_is_not_there\n")
    with pytest.raises(AssertionError, match="a_module_that_is_not_there"):
        names(copy)
