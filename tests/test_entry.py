"""The library without the parts that may be left out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LEFT_OUT = [["tessera/llm", "tests/llm"], ["tessera/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]]


@pytest.mark.parametrize("gone", LEFT_OUT)
def test_the_rest_imports(tmp_path, gone):
    for part in ("tessera", "tests"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
    for part in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    for part in gone:
        if (tmp_path / part).is_dir():
            shutil.rmtree(tmp_path / part)
        else:
            (tmp_path / part).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e, bench; print(*e.queries()); e.oracle_sql()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "mips_exact_topk" in names and "pipeline" not in names
    assert any(n.startswith("op") for n in names) == ("tessera/llm" not in gone and (ROOT / "tessera/llm").exists())
