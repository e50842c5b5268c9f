"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    se = _entry_module()
    df = se.entry(spark)
    assert df.columns == ["date", "topic", "Negative", "Positive", "Neutral", "total_volume", "negative_rate"]
    assert df.count() > 0
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in o.values())
