"""The driver contract, with and without the optional subpackage."""

import ast
import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.count() == 18 and "auroc" in df.columns


def test_every_plan_has_sql():
    from claimlens import plans

    assert plans.QUERIES.keys() == plans.ORACLE_SQL.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_library_doesnt_import_the_optional_subpackage():
    for path in (ROOT / "claimlens").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_works_without_it():
    code = "import sys; sys.modules['claimlens.llm'] = None; import __spark_entry__ as e; assert 'arm_metrics' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
