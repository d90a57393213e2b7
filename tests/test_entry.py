import __spark_entry__ as entry


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60 and all(callable(f) for f in q.values())


def test_without_the_text_operators():
    assert not any("loreline.llm" in open(f).read() for f in __import__("glob").glob("loreline/**/*.py", recursive=True) if "/llm/" not in f)
