import __spark_entry__
from runloom.plans.queries import QUERIES, SQL


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["block", "k", "edges"] and rows.count() == 200


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_parts():
    import ast
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for p in (root / "runloom").rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
