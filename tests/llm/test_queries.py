import pytest

import __spark_entry__ as entry
import compare
from wardspark.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    if name in ORACLE_SQL:
        line, same = compare.compare(spark, compare.connect(FOLDER), FOLDER, name)
        assert same, line
        return
    found = entry.queries()[name](spark, FOLDER)
    rows = found.count()
    table = "pages" if "page_id" in found.columns else "documents"
    whole = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name.startswith(("op2_", "op3_", "op5_", "op6_", "op7_", "op8_", "op10_")):
        assert rows == whole
    else:
        assert rows > 0
