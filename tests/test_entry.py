import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def names(where):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, check=True)
    return [eval(line) for line in out.stdout.splitlines()]


def copied(path, without_pipeline):
    shutil.copytree(ROOT / "crowdnet", path / "crowdnet", ignore=lambda d, _: ["llm", "__pycache__"])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and not (without_pipeline and name == "corpus_pipeline.py"):
            shutil.copy(ROOT / name, path / name)
    return path


def test_entry_without_the_corpus_folders(tmp_path):
    whole, oracles = names(ROOT)
    for without_pipeline in (True, False):
        queries, sql = names(copied(tmp_path / str(without_pipeline), without_pipeline))
        core = [q for q in whole if not q.startswith("op") and q != "pipeline"]
        assert queries == core and "consensus_top10" in queries
        assert sql == [q for q in oracles if not q.startswith("op") and q != "pipeline"]
