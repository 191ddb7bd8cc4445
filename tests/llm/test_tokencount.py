import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def encode():
    with open(PATH, "rb") as f:
        return tokencount.load(f.read(), "word_bpe_49k.json")


def test_counts_of_documents(spark, documents):
    rows = tokencount.count_tokens(documents, PATH).join(documents, "doc_id").select("n_tokens", "n_bytes", "text").collect()
    assert rows
    for r in rows:
        assert (r["n_tokens"], r["n_bytes"]) == (plain(r["text"] or ""), len((r["text"] or "").encode()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aB1é'’sS ,.\n\t\r\x0b\x1c\x85\xa0 ́Σßİ日🙂-_", "<|startoftext|>", "<|endoftext|>", "'ll"]), max_size=30))
def test_white_space_is_a_safe_boundary(encode, parts):
    text = "".join(parts)
    assert tokencount.Counter(encode).counts([text]) == [plain(text)]


def test_a_small_memory_changes_nothing(encode, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    monkeypatch.setattr(tokencount, "BATCH_BYTES", 10)
    own = tokencount.Counter(encode)
    texts = ["a b c d e", "f g", "a b", "", "zz " * 50]
    assert [own.counts(t) for t in tokencount.groups(texts)] and [n for g in tokencount.groups(texts) for n in own.counts(g)] == [plain(t) for t in texts]


def test_other_vocabularies_and_edges(spark, empty, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = tokencount.count_tokens(documents, path, between_spaces=False).join(documents, "doc_id").select("n_tokens", "text").collect()
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "")) for r in rows)
    assert tokencount.count_tokens(empty, PATH).count() == 0


def test_boundaries_are_read_from_the_file(empty, tmp_path):
    import json

    with open(PATH, "rb") as f:
        data = f.read()
    assert tokencount.safe_spaces(data, "word_bpe_49k.json")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            assert not tokencount.safe_spaces(f.read(), name)
    own = json.loads(data)
    own["added_tokens"][0]["lstrip"] = True
    assert not tokencount.safe_spaces(json.dumps(own).encode(), "x.json")
    with pytest.raises(ValueError):
        tokencount.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"), between_spaces=True)


def test_whole_texts_where_spaces_count(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = tokencount.count_tokens(documents, path).join(documents, "doc_id").select("n_tokens", "text").collect()
    assert rows and all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)


def test_batches_are_balanced_by_bytes(monkeypatch):
    monkeypatch.setattr(tokencount, "BATCH_BYTES", 8)
    assert list(tokencount.groups(["日本", "日", "aaaa", "bbbb", "x" * 20, "c"])) == [["日本"], ["日", "aaaa"], ["bbbb"], ["x" * 20], ["c"]]
