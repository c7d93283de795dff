"""The driver contract, with and without the corpus part."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

from terrane import catalog

CODE = "import re, __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), sum(bool(re.match(r'op\\d+_|pipeline', k)) for k in q))"


def _counts(folder):
    run = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert not run.returncode, run.stderr
    return tuple(map(int, run.stdout.split()[-3:]))


def test_queries_without_the_corpus_folders(tmp_path):
    """The pipeline's file alone may stay or go with the folders."""
    for n, gone in enumerate((["terrane/llm", "tests/llm"], ["terrane/llm", "tests/llm", "corpus_pipeline.py"])):
        to = tmp_path / str(n)
        shutil.copytree(ROOT, to, ignore=lambda d, names: [x for x in names if os.path.relpath(os.path.join(d, x), ROOT) in gone or x in (".git", "__pycache__", ".pytest_cache")])
        assert _counts(to) == (len(catalog.QUERIES), len(catalog.ORACLE), 0)


def test_queries_with_the_corpus_folders():
    if os.path.isdir(os.path.join(ROOT, "terrane", "llm")):
        queries, _, corpus = _counts(ROOT)
        assert corpus == 13 + os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) and queries == len(catalog.QUERIES) + corpus
