import hashlib

import duckdb
import pytest

from tests.llm.conftest import odd
from tidemark.llm.exact import digests, exact_groups, winners, without_copies
from tidemark.llm.queries import SQL, op10_exact_dedup
from tidemark.llm.rows import written

WHITE = {ord(c): None for c in " \t\n\r\x0b\x0c"}


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["text"] or "").translate(WHITE), []).append(r)
    out = []
    for text, members in groups.items():
        order = sorted(
            members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        )
        digest = hashlib.sha256(text.encode()).digest()
        for i, r in enumerate(order):
            out.append((r["doc_id"], order[0]["doc_id"], len(members), i == 0, digest))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "keep_id", "group_size", "kept", "digest")
    rows = [tuple(bytes(r[n]) if n == "digest" else r[n] for n in names) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("settings", [{}, {"fan_in": 2, "range_rows": 2, "run_rows": 2}])
def test_groups_equal_those_of_brute_force(odd_docs, settings):
    assert got(exact_groups(odd_docs, **settings)) == brute(odd_docs.collect())


def test_an_empty_table_gives_an_empty_result(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert without_copies(no_docs, ["doc_id", "text"]).count() == 0


def test_the_kept_rows_keep_their_columns(odd_docs):
    kept = without_copies(odd_docs, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    assert len(kept) == len({(r["text"] or "").translate(WHITE) for r in odd_docs.collect()})
    base = next(r for r in kept if r["doc_id"] == 2)
    assert base["text"].endswith("  ")


def test_one_text_of_very_many_copies_is_merged_in_every_round(spark):
    df = spark.range(20_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('t', id) END AS text"
    ).repartition(16)
    rows = written(digests(df), "t")
    best = winners(rows, fan_in=4, range_rows=1_000, run_rows=500).collect()
    assert len(best) == len({b["digest"] for b in best}) == 1 + 20_000 - 6_667
    hot = max(best, key=lambda b: b["copies"])
    assert (hot["copies"], hot["doc_id"]) == (6_667, 0)


def test_the_query_gives_the_rows_of_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = op10_exact_dedup(spark, folder)
    want = con.execute(SQL["op10_exact_dedup"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


def test_extra_rows_of_one_id(spark):
    df = spark.createDataFrame([odd(1, "a b"), odd(1, "ab"), odd(1, "c")], "doc_id long, text string,"
        "lang string, source string, n_chars long, key_a long, row_id string, size int, part string,"
        "score double, label int")
    assert sorted(r["kept"] for r in exact_groups(df).collect()) == [False, True, True]
