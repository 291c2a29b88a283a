import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd, prose
from tidemark.llm import suffix_tree
from tidemark.llm.rows import texts, written
from tidemark.llm.words import mix, unmix
from tidemark.session import scratch_path
from tidemark.llm.suffix_tree import END, Settings, grown, scored, tokens

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key_a long, "
          "row_id string, size int, part string, score double, label int")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = Settings(depth=2, symbol_share=2e-3, state_share=2e-3, pair_share=1e-4, common_share=1e-3)


def tokens_of(text):
    return [*(text or "").translate(LOWER).encode().split(), None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def brute(rows):
    counts = Counter(t for r in rows if not held(r["doc_id"]) for t in tokens_of(r["text"]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        found = tokens_of(r["text"])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        known = sum(counts[t] > 0 for t in found)
        out.append((r["doc_id"], held(r["doc_id"]), len(found), known, n, round(base, 6)))
    return sorted(out, key=repr)


def shown(rows):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    return sorted(((*(r[n] for n in names), round(r["base_score"], 6)) for r in rows), key=repr)


@pytest.mark.parametrize("settings", [SMALL, Settings()])
def test_counts_and_base_scores_equal_brute_force(odd_docs, settings):
    assert shown(scored(odd_docs, settings=settings).collect()) == brute(odd_docs.collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert shown(scored(docs).collect()) == brute(docs.collect())


def test_no_documents_and_no_training_rows(spark, no_docs):
    assert scored(no_docs).count() == 0
    lonely = spark.createDataFrame([odd(None, "a b")], SCHEMA)
    row = scored(lonely).first()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["score"] == pytest.approx(0) and row["base_score"] == pytest.approx(0)


@pytest.fixture(scope="module")
def sayings(spark):
    """Texts in which the next word follows from the last one or two."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        words = []
        for _ in range(30):
            words += [["Red", "car", "stops"], ["red", "bus", "goes"], ["old", "bus", "stops"],
                      [f"w{rng.integers(300)}"]][rng.integers(4)]
        rows.append(odd(i, " ".join(words)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_contexts_that_foretell_the_next_word_are_kept_and_help(sayings):
    rows = scored(sayings, settings=SMALL).collect()
    out = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out)
    one = scored(sayings, settings=Settings(1, 2e-3, 2e-3, 1e-4, 1e-3)).collect()
    out_one = [r for r in one if r["held_out"]]
    gain_one = sum(r["score"] - r["base_score"] for r in out_one) / sum(r["n_tokens"] for r in out_one)
    assert gain > gain_one > 0.2


def test_probabilities_of_every_state_sum_to_one(spark, sayings):
    training = sayings.select("text")
    counts = written(
        suffix_tree._counts(training, lambda c: tokens(c)[1].view(np.int64)), "counts")
    total = sum(r["n"] for r in counts.collect())
    tree = grown(training, counts, total, counts.count(), SMALL)
    assert [len(level.keys) > 0 for level in tree.levels] == [True, True]
    assert tree.base.sum() == pytest.approx(1)
    symbols = np.arange(tree.width)
    for depth, level in enumerate(tree.levels, 1):
        for key in level.keys[:50]:
            contexts = [np.full(tree.width, key % tree.width**d) for d in range(1, depth + 1)]
            p = tree.base * suffix_tree._ratios(tree, contexts, symbols)
            assert p.min() > 0 and p.sum() == pytest.approx(1)


def test_what_reaches_the_driver_is_bounded_by_shares(spark, sayings):
    training = sayings.select("text")
    counts = written(
        suffix_tree._counts(training, lambda c: tokens(c)[1].view(np.int64)), "counts")
    total = sum(r["n"] for r in counts.collect())
    tree = grown(training, counts, total, counts.count(), SMALL)
    assert len(tree.symbols) <= 1 / SMALL.symbol_share
    for level in tree.levels:
        assert len(level.keys) <= 1 / SMALL.state_share
        assert len(level.pairs) <= 1 / SMALL.pair_share


def test_random_words_leave_few_states(spark):
    rows = [odd(i, prose(i, 200, 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    gained = [r["score"] - r["base_score"] for r in scored(docs, settings=SMALL).collect()
              if r["held_out"]]
    assert abs(np.mean(gained)) < 1


def test_tokens_end_every_text():
    text, word = tokens(texts(pa.array(["A b", "", None, "c"], pa.string())))
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert [w == END for w in word] == [False, False, True, True, True, False, True]


def test_the_tables_score_as_the_tree_in_memory(spark, sayings):
    """A tree in memory that has every word, with thresholds equal to the tables' minima."""
    training = sayings.filter("NOT pmod(crc32(cast(cast(doc_id AS string) AS binary)), 10) = 0")
    counts = written(
        suffix_tree._counts(training, lambda c: tokens(c)[1].view(np.int64)), "counts")
    total, kinds = sum(r["n"] for r in counts.collect()), counts.count()
    tree = grown(training, counts, total, kinds,
                 Settings(2, 1e-9, 4.5 / total, 1.5 / total, least_gain=2.0))
    assert len(tree.symbols) == kinds
    rows = scored(sayings, settings=Settings(2, common_share=1e-3, pair_share=1e-3)).collect()
    given = {r["doc_id"]: r["text"] for r in sayings.collect()}
    for r in rows[:100]:
        text, word = tokens(texts(pa.array([given[r["doc_id"]]])))
        symbol = suffix_tree.find(tree.symbols, word) + 1
        contexts = [suffix_tree.context_keys(text, symbol, d, tree.width) for d in (1, 2)]
        want = np.log10(suffix_tree._ratios(tree, contexts, symbol)).sum()
        if r["n_known"] == r["n_tokens"]:
            assert r["score"] - r["base_score"] == pytest.approx(want, abs=1e-6)


def test_the_tree_grows_with_the_input(spark):
    """Contexts of ten uses are states, however many other tokens there are."""
    docs = [odd(i, " ".join(f"a{j}x b{j}x c{j}x" for j in range(i % 30, 3000, 30)))
            for i in range(330)]
    docs += [odd(1000 + i, prose(i, 1000, 50)) for i in range(300)]
    rows = scored(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    gained = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows
              if r["held_out"] and r["doc_id"] < 1000]
    # Of ten thousand words, those two in three that follow from the last are nearly certain.
    assert min(gained) > 2


def test_jobs_leave_no_table_of_sequences_and_no_setting(spark, sayings):
    """What has served is deleted before texts meet values, which takes the most disk."""
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",
             "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(name) for name in names]
    scored(sayings).collect()
    base = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert not list(base.glob("sequences-*")) and list(base.glob("scored-rows-*"))
    assert not list(base.glob("next-*")) and list(base.glob("values-*"))
    assert [spark.conf.get(name) for name in names] == before


def test_numbers_mix_back():
    x = np.random.default_rng(2).integers(0, 1 << 64, 10_000, np.uint64, endpoint=False)
    assert (unmix(mix(x)) == x).all()


def test_flushes_and_parts_change_no_row(spark, sayings, monkeypatch):
    """Tasks that send what they have after every slice, and parts that hold a key or two."""
    def run():
        rows = scored(sayings, settings=Settings(2, common_share=1e-3)).collect()
        return sorted((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in rows)

    want = run()
    monkeypatch.setattr(suffix_tree, "_PARTS", 3)
    monkeypatch.setattr(suffix_tree, "_ROWS", 2)
    assert run() == want


def test_blocks_keep_keys_and_columns():
    key = np.sort(mix(np.arange(1, 5001, dtype=np.uint64)))
    n = np.arange(5000)
    found = []
    for block in suffix_tree._dealt({"key": key, "n": n}, origin=7):
        cells = suffix_tree._cells(block, "high", "low", "n")
        for begin, end in suffix_tree._runs(block, "part", "origin"):
            keys = suffix_tree._key(cells, begin, end)
            assert (keys >> np.uint64(64 - suffix_tree._PARTS) == block["part"][begin].as_py()).all()
            found += zip(keys.tolist(), suffix_tree._cut(cells["n"], begin, end, np.int64).tolist(),
                         strict=True)
    assert found == list(zip(key.tolist(), n.tolist(), strict=True))
    assert not list(suffix_tree._dealt({"key": key[:0], "n": n[:0]}))


def test_sums_of_equal_rows_stay_apart(spark, sayings):
    """Rows that repeat are summed apart, whichever blocks their sums are in."""
    rows = scored(sayings.union(sayings), settings=Settings(2, common_share=1e-3)).collect()
    once = {r["doc_id"]: r["n_known"] for r in scored(sayings).collect()}
    assert len(rows) == 2 * len(once) and all(r["n_known"] == once[r["doc_id"]] for r in rows)
