import __spark_entry__ as E


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["item_id", "rank", "doc_id", "chunk_no", "distance", "score"]


def test_entry_without_a_library_of_the_corpus_operators():
    """Their queries are left out; all others are there."""
    import subprocess
    import sys
    from pathlib import Path

    ask = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as E; q = E.queries(); print(len(q) >= 60, any(k.startswith('op') and k[2].isdigit() for k in q))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", ask], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == ["True", "False"], out.stderr
