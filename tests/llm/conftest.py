import duckdb
import pytest

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.fixture(scope="session")
def compare(spark):
    """Rows of a query over small tables against those of its SQL, or of brute force, over the same ones."""

    def rows(found):
        names = sorted(found.columns)
        return sorted((tuple(repr(v.tolist() if hasattr(v, "tolist") else v) for v in r) for r in found[names].astype(object).where(found[names].notna(), None).itertuples(index=False)))

    def run(query, tables: dict, tmp_path, sql=None):
        con = duckdb.connect()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        found = query(spark, str(tmp_path)).toPandas()
        if sql:
            want = con.sql(sql).df()
            assert sorted(found.columns) == sorted(want.columns)
            assert rows(found) == rows(want)
        return found

    return run


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        full = [(i, t, None, "s", None if t is None else len(t)) if not isinstance(i, tuple) else i for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)

    return make
