from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import bag, similarity
from tests.llm.test_mixing import brute_targets
from tidemark.llm.encoding import public_vocabulary
from tidemark.llm.mixing import mixed_blocks, mixed_documents
from tidemark.llm.queries import VOCABULARY

FOLDER = "/root/testdata/sf0.01"
WHITE = {ord(c): None for c in " \t\n\r\x0b\x0c"}


def plain(text):
    return (text or "").translate(WHITE)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that every stage reads and gives."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def test_stages_keep_the_columns(stages):
    for table in stages[1:-1]:
        assert table.columns == corpus_pipeline.COLUMNS
        assert [f.dataType for f in table.schema] == [
            f.dataType for f in stages[0].select(*table.columns).schema]


def test_quality_rejects_bad_and_keeps_good_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before = Counter(labels.get(r["doc_id"]) for r in stages[0].collect())
    after = Counter(labels.get(r["doc_id"]) for r in stages[1].collect())
    # Some 250 labelled rows to learn from here.
    assert after[1] >= 0.95 * before[1] and after[0] <= 0.25 * before[0]
    assert set(stages[1].collect()) <= set(stages[0].collect())


def test_exact_dedup_keeps_one_of_each_text(stages):
    before, after = stages[1].collect(), stages[2].collect()
    assert set(after) <= set(before)
    assert Counter(plain(r["text"]) for r in after) == Counter({plain(r["text"]) for r in before})


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after = stages[2].collect(), stages[3].collect()
    assert set(after) <= set(before)
    bags = {r["doc_id"]: bag(r["text"]) for r in before}
    kept = [r["doc_id"] for r in after]
    gone = set(bags) - set(kept)
    assert gone
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert similarity(bags[a], bags[b]) < 0.8
    # A dropped document is joined to a kept one by links of copies.
    linked = set(kept)
    while more := {g for g in gone - linked if any(similarity(bags[g], bags[k]) >= 0.8 for k in linked)}:
        linked |= more
    assert gone <= linked


def test_the_mix_meets_its_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size, taken, each = Counter(), Counter(), Counter()
    of = {}
    for r in before:
        size[r["source"]] += len(r["text"].encode().split())
        of[r["doc_id"]] = r
    for r in after:
        n = len(r["text"].encode().split())
        taken[r["source"]] += n
        each[r["doc_id"]] += n
        assert r["text"] in of[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"])
    want = brute_targets(size)
    for source in size:
        assert abs(taken[source] - want[source]) <= 1
    for doc, n in each.items():
        assert n <= 2 * len(of[doc]["text"].encode().split())


def test_packing_covers_the_mix(spark, stages):
    pieces = stages[5]
    assert pieces.filter("start = 0").count() == stages[4].count()
    ends = pieces.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] != 2048 for r in ends) <= 1
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_an_empty_table_passes_every_stage(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_the_mix_lies_in_the_order_of_its_decision(spark, stages):
    names = corpus_pipeline.COLUMNS
    want = mixed_documents(stages[3], mixed_blocks(stages[3]), names).orderBy("shard", "place")
    got = [tuple(r) for r in corpus_pipeline.mix(spark, stages[3], FOLDER).collect()]
    assert got == [tuple(r[n] for n in names) for r in want.collect()]
    draws = Counter(r[0] for r in got)
    twice = sum(n > 1 for n in draws.values())
    near = sum(a[0] == b[0] for a, b in zip(got, got[1:]))
    assert twice > 100 > 20 * near


def test_every_sequence_can_be_rebuilt_from_the_packed_ids(stages):
    vocabulary = Tokenizer.from_file(public_vocabulary(VOCABULARY))
    pieces = sorted(stages[5].collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    found, now, place = Counter(), [], (0, 0)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        sequence, offset = place
        assert (p["sequence_id"], p["offset"]) in (place, (sequence + 1, 0))
        assert len(ids) == p["length"]
        now = ids if p["start"] == 0 else now + ids
        if len(now) == p["doc_tokens"]:
            found[tuple(now)] += 1
        place = (p["sequence_id"], p["offset"] + p["length"])
    texts = [r["text"] for r in stages[4].select("text").collect()]
    encoded = vocabulary.encode_batch(texts, add_special_tokens=False)
    assert found == Counter((*e.ids, 1) for e in encoded)
