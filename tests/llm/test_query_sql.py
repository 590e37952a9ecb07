import duckdb
import pytest

from skein.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_ngram_join", "op8_embed_dedup", "op12_variants", "op13_hard_negatives"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = cur.fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
