import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encoding import Encoder, public_vocabulary
from tidemark.llm.rows import layout, slices, texts
from tidemark.llm.words import PUNCTUATION, SPACE, shingles, words

TEXT = st.text(alphabet=st.sampled_from("ab A'.é \t\n\r\x0b\x0c\x1c\xa0"), max_size=30)


def column(values):
    return texts(pa.array(values, pa.string()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_a_byte_split(values):
    text, word = words(column(values), SPACE)
    want = [(i, w) for i, v in enumerate(values) for w in (v or "").encode().split()]
    assert text.tolist() == [i for i, _ in want]
    by_word = {}
    for (_, w), h in zip(want, word.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_lower_case_and_punctuation():
    one = words(column(["The, IDIOT! x-y"]), PUNCTUATION, lower=True)[1]
    two = words(column(["the idiot x y"]), SPACE)[1]
    assert one.tolist() == two.tolist()


def test_a_sliced_column_is_read_from_its_own_rows():
    whole = column(["ab", "cd e", "", "f"])
    part = whole.slice(1, 3)
    values, offsets = layout(part)
    assert values.tobytes() == b"cd ef" and offsets.tolist() == [0, 4, 4, 5]
    assert words(part)[1].tolist() == words(whole)[1].tolist()[1:]


def test_shingles_of_short_and_long_texts():
    text, word = words(column(["a b c d e f", "", "a b", "a b c d e"]))
    owner, value = shingles(text, word, 5)
    assert owner.tolist() == [0, 0, 2, 3]
    assert value[0] == value[3] and len(set(value.tolist())) == 3


def test_slices_cover_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (3, 0, 9 << 20, 1, 5 << 20)]})
    parts = list(slices(iter([batch]), "text"))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch["text"].to_pylist()
    assert len(parts) > 1


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_vocabulary("word_bpe_49k.json"))


ODD = [
    "Ａ̸ b", "x<|endoftext|>y", "<|ENDOFTEXT|>", "á ́b", "it's I'LL 'S ' s", "İstanbul ΣΑΣ ß ÉÀ µm",
    "", " ", "\x1c\x1d x", "a\x00b", "\U0001f642 ½", "é̸≠", "word...!! foo_bar a'b $$$ ÇA, ôÖ;", "K Å ſ ẞ",
    "a b　c", "42 4x2",
]


def test_ids_are_the_tokenizers_own(encoder):
    assert encoder.by_words
    for _ in range(2):
        ids, counts = encoder.encode(column(ODD))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [encoder.ids(t) for t in ODD]
    for text in ODD:
        assert encoder.encode(column([text]))[0].tolist() == encoder.ids(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=4))
def test_ids_of_any_text(values):
    own = Encoder(public_vocabulary("word_bpe_49k.json")) if not _KEPT else _KEPT[0]
    _KEPT[:] = [own]
    ids, counts = own.encode(column(values))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [own.ids(t) for t in values]


_KEPT = []


def test_other_tokenizers_are_used_text_by_text():
    own = Encoder(public_vocabulary("byte_bpe_50k.json"))
    assert not own.by_words
    ids, counts = own.encode(column(["a  b", "", "c"]))
    assert ids.tolist() == own.ids("a  b") + own.ids("c") and counts.tolist()[1] == 0


def test_a_full_memory_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr("tidemark.llm.encoding.KEPT_WORDS", 3)
    for text in ("alpha beta gamma delta epsilon", "zeta eta alpha"):
        assert encoder.encode(column([text]))[0].tolist() == encoder.ids(text)


def test_words_that_collide_in_a_polynomial_have_different_hashes():
    """A Thue-Morse word and its complement, at lengths where a polynomial cannot tell them apart."""
    import pyarrow as pa

    from tidemark.llm.words import words

    for bits in (10, 11, 12):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        other = word.translate(str.maketrans("ab", "ba"))
        column = pa.array([f"{word} {other} {word.upper()}".encode()], pa.large_binary())
        one, two, three = words(column)[1].tolist()
        assert len({one, two, three}) == 3
        lower = words(column, lower=True)[1].tolist()
        assert lower[0] == lower[2] != lower[1]
