"""Tasks need no copy of the package: a driver that found it on its own path runs from a folder without it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from martlet.session import build_session
spark = build_session("abroad", "local[2]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": {folder!r}}})
from martlet.llm.queries import QUERIES
assert not spark.range(1).mapInPandas(lambda b: (__import__("pandas").DataFrame({{"x": [bool(__import__("importlib").util.find_spec("martlet"))]}}) for _ in b), "x boolean").first().x
sf = "/root/testdata/sf0.001"
for name in ("op3_ftrl_quality", "op6_byte_cnn", "op9_decontaminate", "op12_ranked_search", "op13_vector_codes"):
    print(name, QUERIES[name](spark, sf).count())
"""


def test_tasks_run_without_the_package(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = [p for p in sys.path if p.startswith("/opt/tokenizers")]
    if tokenizers:
        env["PYTHONPATH"] = os.pathsep.join(tokenizers)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, folder=str(tmp_path / "w"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == ["op3_ftrl_quality", "op6_byte_cnn", "op9_decontaminate", "op12_ranked_search", "op13_vector_codes"]
