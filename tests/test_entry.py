import subprocess
import sys
import textwrap


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(re.match('op[0-9]', n) for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_names_and_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "rank"
