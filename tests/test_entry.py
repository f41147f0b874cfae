"""The entry file works with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_imports_without_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/wiretrace", tmp_path / "wiretrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_sources' in q and 'pipeline' not in q and not any(k[:2] == 'op' for k in q if '_' in k and k[2:3].isdigit())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
