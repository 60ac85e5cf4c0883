import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm.ngram_join import link_documents
from shelfspark.llm.substring_dedup import remove_repeats
from shelfspark.llm.text_hash import again, hash_spans, row_chunks, words


def thue_morse(n):
    """The word of n letters and its complement: equal under polynomial hashes modulo a power of two."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 512, 1024, 2048, 4096, 8192])
def test_words_of_like_structure_differ(n):
    (_, _, data, offs), = row_chunks(pa.array(list(thue_morse(n))))
    assert len(set(words(data, offs).hash.tolist())) == 2


def test_hash_depends_on_every_byte_and_on_length():
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 16, 17, 64, 1024, 1025, 3000):
        word = rnd.integers(97, 123, n).astype(np.uint8)
        forms = [word] + [np.r_[word[:k], [65], word[k + 1:]].astype(np.uint8) for k in {0, n // 2, n - 1}] + [np.r_[word, [0]].astype(np.uint8), np.r_[word, word]]
        data, ends = np.concatenate(forms), np.cumsum([len(f) for f in forms])
        assert len(set(hash_spans(data, ends - [len(f) for f in forms], ends).tolist())) == len(forms)


def test_long_words_neither_link_nor_count_as_repeats(docs):
    a, b = thue_morse(1024)
    line = " ".join(f"w{i}" for i in range(19))
    df = docs([(1, f"{line} {a}"), (2, f"{line} {b}"), (3, a), (4, b)])
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    got = {r.doc_id: r.component_id for r in link_documents(df, n=3, percent=95).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_ids_may_be_strings(docs):
    from pyspark.sql import functions as F
    text = " ".join(f"w{i}" for i in range(30))
    df = docs([(1, text), (2, text)]).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert sorted(r.n_removed for r in remove_repeats(df).collect()) == [0, 30]


def test_again_counts_by_row():
    row, key = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 5, 5, 5, 6, 7], np.uint64) << np.uint64(40)
    assert again(row, key, 4).tolist() == [2, 0, 0, 0]
