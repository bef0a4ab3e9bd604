"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from graphloom.llm.common import NULL_ID
from graphloom.llm.oracles import line_ctes, mix_ctes
from tests.llm.test_operators import DOCS, brute_fingerprint, components, hugging, make_docs

SF = "/root/testdata/sf0.001"


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        given = rows_of(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            check(name, given, rows_of(docs))
    want = Counter()
    tok = hugging()
    for i, t, _, _ in given:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in docs.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def kept_share(folder: str, given: set, left: set, caught: float) -> None:
    """Nearly all clean documents stay, and at least a share of the toxic ones goes."""
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    clean, toxic = ([i for i, y in labels if y == k and i in given] for k in (0, 1))
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    assert sum(i not in left for i in toxic) >= caught * len(toxic)


def test_toxic_documents_go(spark):
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.toxic_out(spark, docs, folder)
    kept_share(folder, {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in kept.select("doc_id").collect()}, 0.5)


def check(name: str, given: list[tuple], kept: list[tuple]) -> None:
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s in given])
    if name == "toxicity":
        assert set(kept) <= set(given)
        kept_share(SF, {r[0] for r in given}, {r[0] for r in kept}, 0.0)
    elif name == "line_dedup":
        want = con.sql(f"WITH {line_ctes('documents')} SELECT doc_id, kept FROM line_rows").fetchall()
        assert Counter(r[:2] for r in kept) == Counter(want)
    elif name == "simhash_near_dedup":
        assert Counter(kept) == Counter(first_of_groups(given))
    else:
        want = con.sql(f"WITH {mix_ctes('documents')} SELECT doc_id, text FROM mix_rows, range(copies)").fetchall()
        assert Counter(r[:2] for r in kept) == Counter(want)


def first_of_groups(given: list[tuple]) -> list[tuple]:
    """By brute force: of each group of near copies the first row by id, fingerprint as a signed long, text and other columns, nulls first."""
    fps = [brute_fingerprint(r[1]) for r in given]
    groups = defaultdict(list)
    for r, fp, root in zip(given, fps, components(fps, list(range(len(given)))), strict=True):
        signed = fp - 2**64 if fp >= 2**63 else fp
        groups[root].append(((NULL_ID if r[0] is None else r[0], signed, *[("" if x is None else x, x is not None) for x in r[1:]]), r))
    return [min(own, key=lambda k: k[0])[1] for own in groups.values()]


def test_every_group_keeps_one_text(spark):
    """Random rows with many null and shared ids, copies and repeated rows: what stays is what brute force keeps, text by text."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(50)] + [None, "", " "]
    rows = []
    for _ in range(160):
        t = rng.choice(texts)
        rows.append((rng.choice([None, None, 1, 2, 3, rng.randint(4, 50)]), t if t is None or rng.random() < 0.7 else t.upper().replace(" ", "  "), rng.choice(["en", None]), rng.choice(["a", "b", None])))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for given in (docs, docs.orderBy("source", "text").repartition(5)):
        assert Counter(rows_of(pipeline.near_copies_out(spark, given, SF))) == Counter(first_of_groups(rows))


def test_stages_on_awkward_rows(spark):
    docs = spark.createDataFrame(make_docs(), DOCS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b c d", "z"), (None, "other words in here", "n"), (3, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = pipeline.near_copies_out(spark, docs, SF).collect()
    assert Counter(NULL_ID if r["doc_id"] is None else r["doc_id"] for r in kept) == Counter([1, NULL_ID, 3])


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    one, two, three = "alpha beta gamma delta", "river stone window garden paper", "little morning summer walking under"
    rows = [(None, one, "b"), (None, two, "c"), (None, three, "d"), (5, one, "e"), (2, two, "f"), (7, "silver letter house the", "g"), (7, "quite other words than those", "h"), (7, "Silver  letter house the", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for given in (docs, docs.orderBy("key"), docs.orderBy(F.desc("key")).repartition(3)):
        kept = sorted(r["key"] for r in pipeline.near_copies_out(spark, given, SF).collect())
        assert kept == ["b", "c", "d", "h", "i"]



def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and all(0 < r["length"] <= 2048 for r in rows)
    ends = {}
    for r in rows:
        ends[r["sequence_id"]] = max(ends.get(r["sequence_id"], 0), r["offset"] + r["length"])
    assert np.mean([n == 2048 or n & (n - 1) == 0 for n in ends.values()]) > 0.5
