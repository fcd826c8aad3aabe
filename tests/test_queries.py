"""Every query of the library against its SQL, and the entry."""

import os

import duckdb
import pandas as pd
import pytest

from glyphward.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_subpackage():
    from pathlib import Path

    import glyphward

    root = Path(glyphward.__file__).parent
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert "llm" not in path.read_text()


def test_deobfuscate_equals_its_sql_on_odd_texts(spark, tmp_path):
    """Nulls, texts without a character, compatibility forms, decomposed letters."""
    texts = ["busanui jarang", None, "", "ﬁrst ½ ① ｆｕｌｌ …", "café é", "ᚨŋ 0L K ſ", "ㄱㅏ", "x\ny\r\n", " ", "가", "𝒳 İ"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES["q_deobfuscate"](spark, str(tmp_path)).toPandas()) == rows(c.execute(ORACLE_SQL["q_deobfuscate"]).df())
