"""The entry module works whatever of the training-data part is missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import sys, warnings; warnings.simplefilter('ignore'); {hide}; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def _counts(hide: str) -> list[int]:
    done = subprocess.run([sys.executable, "-c", SAY.format(hide=hide)], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return [int(n) for n in done.stdout.split()]


def test_a_missing_library_or_folder_costs_only_its_own_queries():
    alone = _counts("sys.modules['pagemill.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert alone[0] == alone[1] > 90
    assert _counts("sys.modules['xxhash'] = None") == alone
    assert _counts("pass")[0] >= alone[0]
