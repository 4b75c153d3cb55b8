from oracles import compare

from tidewater import registry

SF = "/root/testdata/sf0.01"


def test_whole_index_after_changes(spark):
    """All postings of the changed index, as registered."""
    sql = registry.oracle_sql()["fts_index_after_changes"]
    assert "term >=" not in sql
    assert compare(spark, SF, registry.queries()["fts_index_after_changes"], sql) > 100_000
