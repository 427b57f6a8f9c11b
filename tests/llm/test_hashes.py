"""Texts built to collide under polynomial hashes modulo 2**64: Thue-Morse strings and their complements."""

import hashlib

import numpy as np
import pytest

from pitspark.llm import bpe, ngram_join, packing, quality, repeats, tokens, training_order
from pitspark.llm import textarrays as ta

SIZES = (512, 1024, 2048, 4096)


def twins(size, letters="ab"):
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("size", SIZES)
def test_pieces_of_one_block_differ(size):
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in twins(size))
    data = np.concatenate([one, two])
    at = np.array([0, size]), np.array([size, 2 * size])
    for salt in (0, 1):
        a, b = ta.PrefixHash(data, salt).pieces(*at)
        assert a != b
    same = np.concatenate([one, one])
    assert len(set(ta.PrefixHash(same).pieces(*at))) == 1


def test_encoder_keeps_the_words_apart(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = [t for size in SIZES for t in twins(size)] + [" ".join(twins(1024, "xy"))]
    rows = {r.doc_id: r for r in tokens.digests(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_documents_are_not_linked(spark):
    found = ngram_join.groups(frame(spark, list(twins(1024)) + list(twins(2048))), size=4, percent=85).collect()
    assert {r.component_id for r in found} == {0, 1, 2, 3}


def test_texts_are_not_taken_for_copies(spark):
    pair = twins(2048)
    rows = {r.doc_id: r for r in repeats.removed_digests(frame(spark, [pair[0], pair[1], "x" + pair[0]])).collect()}
    assert rows[1].n_bytes == 2048 and rows[1].kept_sha256 != rows[0].kept_sha256 or rows[1].n_removed == 2048
    assert all(r.n_left == r.n_bytes - r.n_removed for r in rows.values())


def test_lines_and_words_are_not_repeats():
    one, two = twins(1024)
    text = "\n".join([one, two] * 1).encode()
    found = quality.measures(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert found["n_dup_lines"].tolist() == [0] and found["n_repeat_words"].tolist() == [0]


def test_pieces_and_sequences_hold_the_right_ids(spark):
    import zlib

    import tokenizers

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = list(twins(2048))
    want = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for r in packing.packed_documents(frame(spark, texts)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert training_order.ordered_sequences(frame(spark, texts)).count() > 0
