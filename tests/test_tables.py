"""Table functions in SQL."""

import pytest

from tessella.functions import tables


def test_table_functions(spark):
    assert tables.register(spark) == ["path_nodes", "pair_glyphs"]
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT * FROM path_nodes(' a -> b ->  -> c')") == [(0, "a"), (1, "b"), (2, "c")]
    assert rows("SELECT * FROM path_nodes('a|b', separator => '|')") == [(0, "a"), (1, "b")]
    assert rows("SELECT * FROM path_nodes(NULL)") == rows("SELECT * FROM path_nodes('')") == []
    assert rows("SELECT i, p.* FROM VALUES (0), (7), (8), (9), (-1), (NULL) t(i), LATERAL pair_glyphs(i, 3) p") == [(0, 0, 0), (7, 2, 1), (8, 2, 2)]
    for bad in ("SELECT * FROM path_nodes(1)", "SELECT * FROM pair_glyphs('a', 3)"):
        with pytest.raises(Exception, match="has to be|have to be"):
            spark.sql(bad)
