import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
CLASHING = ("key", "fp", "least", "of", "n", "root", "host", "path", "rule", "verdict", "size", "shard", "slot", "block",
            "words", "numbers", "hits", "spans", "score", "rejected_by", "masked_text", "TEXT_HASH_A", "a.b")


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like table from (doc_id, text) pairs, with extra columns whose
    names the operators use inside."""
    def build(rows, clash=True):
        names = [f"`{c}` string" for c in (CLASHING if clash else ())]
        schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *names])
        full = [(i, t, "en", "s", None if t is None else len(t), *[f"x-{c}" for c in (CLASHING if clash else ())])
                for i, t in rows]
        return spark.createDataFrame(full, schema)
    return build


@pytest.fixture(scope="session")
def duck():
    """DuckDB result of a statement over given pandas tables, as sorted rows."""
    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        return rows_of(con.execute(sql).df())
    return run


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = [tuple(None if v != v or v is None else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: [(v is None, str(type(v).__name__ in ("str",)), v if v is not None else 0)
                                      for v in r])
