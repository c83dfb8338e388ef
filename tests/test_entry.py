"""The driver contract."""

import re

import __spark_entry__


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "confidence", "hits", "label"] and df.count() > 0


def test_registry_is_consistent():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 60 and set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_nothing_outside_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in (root / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
