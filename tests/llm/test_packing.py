import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd, prose
from tidemark.llm.encoding import Encoder, public_vocabulary
from tidemark.llm.lengths import at_limits, length_quantiles, length_table
from tidemark.llm.packing import packed

PATH = public_vocabulary("word_bpe_49k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key_a long, "
          "row_id string, size int, part string, score double, label int")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def check(encoder, docs, window):
    rows = packed(docs, PATH, window, with_ids=True).collect()
    stream = sorted((r["sequence_id"], r["offset"], r) for r in rows)
    at, pieces = 0, {}
    for sequence, offset, r in stream:
        assert sequence * window + offset == at
        assert 0 < r["length"] and offset + r["length"] <= window
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"], at - r["start"] - r["length"]), []).append(
            (r["start"], ids.tolist())
        )
    got = []
    for (doc, tokens, _), cuts in pieces.items():
        cuts.sort()
        ids, expect = [], 0
        for start, part in cuts:
            assert start == expect
            expect += len(part)
            ids += part
        assert len(ids) == tokens
        got.append((doc, tuple(ids)))
    want = [(r["doc_id"], (*encoder.ids(r["text"] or ""), 1)) for r in docs.collect()]
    assert Counter(got) == Counter(want)
    return at


@pytest.mark.parametrize("window", [7, 64, 2048])
def test_pieces_are_the_stream_cut_at_windows(spark, encoder, window):
    docs = spark.createDataFrame([odd(i, prose(i, i % 40)) for i in range(60)], SCHEMA).repartition(5)
    check(encoder, docs, window)


def test_odd_rows(odd_docs, no_docs, encoder):
    check(encoder, odd_docs, 2048)
    assert packed(no_docs, PATH).count() == 0
    assert "ids" not in packed(no_docs, PATH).columns


def test_given_documents_are_packed_without_padding(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    total = check(encoder, docs, 2048)
    rows = packed(docs, PATH).collect()
    assert max(r["sequence_id"] for r in rows) == (total - 1) // 2048


def brute_lengths(encoder, docs):
    return [len(encoder.ids(r["text"] or "")) for r in docs.collect()]


def test_the_length_table_answers_every_limit(odd_docs, spark, encoder, monkeypatch):
    monkeypatch.setattr("tidemark.llm.lengths.RANGE", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for table in (docs, odd_docs):
        lengths = brute_lengths(encoder, table)
        rows = length_table(table, PATH).collect()
        assert {r["length"]: r["docs"] for r in rows} == Counter(lengths)
        for r in rows:
            n = r["length"]
            assert r["docs_from"] == sum(x >= n for x in lengths)
            assert r["tokens_from"] == sum(x for x in lengths if x >= n)
            assert r["docs_up_to"] == sum(x <= n for x in lengths)
            assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
            assert r["quantile"] == r["docs_up_to"] / len(lengths)
            assert r["all_tokens"] == sum(lengths)
        found = at_limits(length_table(table, PATH), [0, 1, 100, 10**6]).collect()
        for r in found:
            n = r["context_limit"]
            assert r["kept_tokens"] == sum(min(x, n) for x in lengths)
            assert r["docs_over"] == sum(x > n for x in lengths)
            assert r["lost_tokens"] == sum(max(0, x - n) for x in lengths)
        quantiles = length_quantiles(length_table(table, PATH), [0.5, 0.9, 1.0]).collect()
        for r in quantiles:
            want = sorted(lengths)[max(0, int(np.ceil(r["share"] * len(lengths))) - 1)]
            assert r["length"] == want


def test_no_lengths(no_docs):
    assert length_table(no_docs, PATH).count() == 0
