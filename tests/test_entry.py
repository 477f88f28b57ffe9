"""The driver's entry, with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_corpus_operators():
    code = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 150 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert e.oracle_sql().keys() <= names.keys()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    other = code.replace('name == "corpus_pipeline" or name.startswith("tidemark.llm")', 'name == "xxhash"')
    failed = subprocess.run([sys.executable, "-c", other], cwd=ROOT, capture_output=True, text=True)
    assert failed.returncode and "xxhash" in failed.stderr  # a missing wheel isn't taken for the operators' absence
