"""What holds on tables of many files, many rows or long texts."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import chunking
from graphloom.providers import generate


def test_ends_of_equal_place_are_the_first_of_the_files(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, n, status in (("a", 1, "O"), ("b", 500, "F"), ("c", 20, "P")):  # Spark reads the largest first
        rows = f"SELECT (i // 5)::BIGINT AS l_orderkey, 1::INT AS l_linenumber, ['A', 'N', 'R'][1 + i % 3] AS l_returnflag, '{status}' || (i % 7) AS l_linestatus FROM range({5 * n}) t(i)"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    con.execute(f"COPY (SELECT range::BIGINT AS o_orderkey FROM range(500)) TO '{tmp_path}/orders.parquet'")
    for t, path in (("lineitem", "lineitem.parquet/*.parquet"), ("orders", "orders.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{path}'")
    got = catalog.queries()["endpoint_resolution"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["endpoint_resolution"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


class Batch:
    """Says how many rows, and characters, came in the batch that a prompt is of."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"{len(prompts)} {sum(map(len, prompts))}"] * len(prompts)


def test_texts_go_to_python_in_small_batches(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = {k: spark.conf.get(k) for k in (rows, size)}
    sizes: list[tuple[str, int, int]] = []
    try:
        for chars, n, make in ((10, 3000, "generate"), (100_000, 300, "generate"), (10, 3000, "semantic"), (10, 3000, "scored")):
            spark.conf.set(rows, "10000")
            spark.conf.set(size, "64m")
            docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), chars).alias("text"))
            if make == "generate":
                got = generate(docs, "text", "answer", Batch(), batch=10**6).select("answer").collect()
                assert len(got) == n
                sizes += [(make, *map(int, r[0].split())) for r in got]
            else:
                chunks = chunking.semantic_chunks(docs, 5) if make == "semantic" else chunking.scored_chunks(docs, 5, lambda a, b: 0.0)
                assert chunks.count() == n and int(spark.conf.get(rows)) <= 256
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(r for _, r, _ in sizes) <= 256
    assert max(c for *_, c in sizes) <= 2 * 4 * 2**20


def test_text_files_keep_rows_that_share_an_id(spark, tmp_path):
    con = duckdb.connect()
    texts = [(1, "a\nb"), (1, "second"), (2, None), (3, ""), (-4, "\nx\x1d"), (5, "\r\n\r"), (6, "ü 漢 \U0001f600\n"), (7, "\x1d")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["text_files"](spark, str(tmp_path)).select("doc_id", "hash").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()["text_files"]).fetchall())
