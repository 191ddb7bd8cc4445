import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pieces

PATH = pieces.vocabulary()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return pieces.Pieces(f.read())


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.text(alphabet="aeioustrnlhq .,'-▁é1234\n\t日語зж🙂́\x00", max_size=40), max_size=4))
def test_ids_equal_the_library(own, texts):
    got = own.encode(texts)
    assert [g.tolist() for g in got] == LIBRARY.encode(texts)
    for text, ids in zip(texts, got):
        assert own.decode(ids) == LIBRARY.decode(ids.tolist()) == text.replace("▁", " ")


def test_documents_round_trip(spark, documents):
    rows = pieces.encode(documents, PATH).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["pieces"] == LIBRARY.encode(r["text"] or "") and r["pieces_exact"]
    back = pieces.decode(pieces.encode(documents, PATH), PATH)
    assert back.where("decoded != coalesce(text, '')").count() == 0


def test_wrong_bytes_decode_like_the_library(own):
    rnd = np.random.default_rng(3)
    for _ in range(300):
        ids = rnd.integers(3, 400, 12).astype(np.int32)
        assert own.decode(ids) == LIBRARY.decode(ids.tolist())


def test_a_small_memory_changes_nothing(monkeypatch, own):
    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 5)
    texts = ["the quick brown fox", "jumps over the lazy dog", "internationalisation " * 3]
    for t in texts:
        assert own.encode([t])[0].tolist() == LIBRARY.encode(t)


def test_the_mark_itself_is_not_exact(spark, empty):
    row = pieces.encode(spark.createDataFrame([(1, "a▁b")], "doc_id bigint, text string"), PATH).first()
    assert not row["pieces_exact"]
    assert pieces.encode(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(empty.withColumnRenamed("lang", "pieces"), PATH)


def fields(data):
    return list(pieces._fields(data))


def changed(data, part, number, value):
    """The file with one field of its trainer (2) or normaliser (3) settings set."""
    out = bytearray()
    for n, v in fields(data):
        if n == part:
            v = message([(k, x) for k, x in fields(v) if k != number] + [(number, value)])
        out += wrapped(n, v)
    return bytes(out)


def wrapped(n, v):
    size, key = len(v), bytearray()
    while size > 127:
        key.append(size & 127 | 128)
        size >>= 7
    return bytes([n << 3 | 2]) + bytes(key) + bytes([size]) + v


def message(parts):
    out = bytearray()
    for number, value in parts:
        if isinstance(value, int):
            out += head(number, 0) + head_int(value)
        elif len(value) == 4 and number in (10, 15):  # floats of the trainer
            out += head(number, 5) + value
        else:
            out += head(number, 2) + head_int(len(value)) + value
    return bytes(out)


def head(number, kind):
    return head_int(number << 3 | kind)


def head_int(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


@pytest.fixture(scope="module")
def unigram():
    """The same pieces, read as a unigram model: the library then takes the best sum of scores.

    Scores of -1e9 become -4e4, as sums of single precision are too coarse beside them.
    """
    with open(PATH, "rb") as f:
        data = changed(f.read(), 2, 3, pieces.UNIGRAM)
    far, near = struct.pack("<f", -1e9), struct.pack("<f", -4e4)
    data = b"".join(wrapped(n, v.replace(b"\x15" + far, b"\x15" + near) if n == 1 else v) for n, v in fields(data))
    return data, pieces.Unigram(data), sentencepiece.SentencePieceProcessor(model_proto=data)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="aeioustrnlhq .,'-é12\n\t日語зж🙂\x00", max_size=30), max_size=4))
def test_unigram_ids_equal_the_library(unigram, texts):
    _, own, library = unigram
    assert [g.tolist() for g in own.encode(texts)] == library.encode(texts)


def test_unigram_shares_prefixes_and_runs_in_spark(spark, unigram, documents, tmp_path):
    data, own, library = unigram
    words = ["▁" + w for w in ("inter", "international", "internationally", "interval", "into", "")]
    assert own.solve(words) == {w: own.solve([w])[w] for w in words}
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(data)
    rows = pieces.encode(documents.where("length(text) < 2000"), path).collect()
    assert rows and all(r["pieces"] == library.encode(r["text"]) and r["pieces_exact"] for r in rows)


def test_files_that_ask_for_more_are_refused(empty, tmp_path):
    with open(PATH, "rb") as f:
        data = f.read()
    assert pieces.model_kind(data) == pieces.BYTE_PAIR
    for part, number, value in ((2, 3, 3), (2, 24, 1), (3, 2, b"x"), (3, 3, 0), (3, 4, 1), (3, 5, 0)):
        path = f"{tmp_path}/{part}{number}.model"
        with open(path, "wb") as f:
            f.write(changed(data, part, number, value))
        with pytest.raises(ValueError):
            pieces.encode(empty, path)
    with pytest.raises(ValueError):
        pieces.decode(pieces.encode(empty, PATH), PATH, out="text")
