"""SentencePiece encoding and decoding by a shared-prefix Viterbi over a trie of marked words.

Distinct words, sorted, are the leaves of a trie in depth-first order, and the forward states
along a common prefix are computed once. For a unigram file (Unigram) the state is the best
score of the prefix and the piece that ends there.

In a byte-pair file (Pieces) the pieces of a word are set by the order of merges, and not by a
sum of scores. The forward state of a prefix is therefore its last piece. Merging has one
such piece for every prefix: the piece whose pair with the last piece of what stands before
it is left alone by the merges. So a prefix is solved once, from shorter prefixes, whatever
follows, and words that share it share its states.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

MARK = "▁"
codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))  # the library replaces each wrong byte
#: Characters of text whose distinct words make one trie (a longer text goes alone).
TRIE_CHARS = 2 << 20
#: Words and pairs that a worker remembers; beyond that it starts anew.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 100_000, 300_000
#: Largest vocabulary file that is sent to the workers.
FILE_BYTES = 64 << 20


#: Numbers of the file format: kinds of models and of pieces.
UNIGRAM, BYTE_PAIR, USER_DEFINED, UNUSED = 1, 2, 4, 5
#: What the library takes off the least score for a character that no piece has.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message of the file: integers, and bytes of the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def model_kind(data: bytes) -> int:
    """UNIGRAM or BYTE_PAIR; a file whose texts or pieces are treated in a way that isn't built here is an error."""
    parts = list(_fields(data))
    trainer = dict(_fields(next((v for n, v in parts if n == 2), b"")))
    normal = dict(_fields(next((v for n, v in parts if n == 3), b"")))
    kinds = {dict(_fields(v)).get(3, 1) for n, v in parts if n == 1}
    reasons = [
        (trainer.get(3, UNIGRAM) not in (UNIGRAM, BYTE_PAIR), "a model of words or characters"),
        (trainer.get(24, 0), "white space as a suffix"),
        (normal.get(2, b""), "a normaliser"),
        (not normal.get(3, 1), "no mark before the text"),
        (normal.get(4, 1), "white space taken out"),
        (not normal.get(5, 1), "white space that is not marked"),
        (kinds & {USER_DEFINED, UNUSED}, "pieces defined by users, or unused"),
    ]
    if found := [why for test, why in reasons if test]:
        raise ValueError(f"the vocabulary file has {', '.join(found)}")
    return trainer.get(3, UNIGRAM)


class Pieces:
    """Encoder and decoder for one byte-pair vocabulary."""

    def __init__(self, data: bytes):
        model_kind(data)
        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(own.get_piece_size())
        self.names = [own.id_to_piece(i) for i in ids]
        special = {i for i in ids if own.is_control(i) or own.is_unknown(i) or own.is_byte(i)}
        self.silent = {i for i in ids if own.is_control(i)}
        self.byte = {int(self.names[i][3:5], 16): i for i in ids if own.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unknown = own.unk_id()
        self.rank = {self.names[i]: (-own.get_score(i), i) for i in ids if i not in special}
        self.least = min(own.get_score(i) for i in ids if i not in special)
        if any(MARK in name.lstrip(MARK) for name in self.rank):
            raise ValueError("a piece reaches from one word into the next")
        self.longest = max(map(len, self.rank))
        self.cut = self._cuts()
        self.single = {name for name in self.rank if len(name) == 1}
        self.automaton = ahocorasick.Automaton()
        for name in self.rank:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        self.shown = ["" if i in self.silent else chr(self.of_byte[i]) if i in self.of_byte else n.replace(MARK, " ") for i, n in enumerate(self.names)]
        self.high = np.array([self.of_byte.get(i, 0) > 127 for i in ids])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def _cuts(self) -> re.Pattern:
        """Units of a marked text. No piece holds the two characters on the sides of a cut, so that no merge crosses it."""
        inside = {name[i : i + 2] for name in self.rank for i in range(len(name) - 1)}
        letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
        ends = [p for p in ".,;:!?|&%*$#\n" if not any(c + p in inside for c in letters)]
        ends = "".join(map(re.escape, ends)) or MARK
        word = "".join(letters)
        lone = r"\n|" if not any("\n" in x for x in inside) else ""
        stop = r"\n" if lone else ""
        return re.compile(rf"{lone}{MARK}*[{word}]+(?=[{ends}])|{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-ranked neighbours first, the leftmost of equals."""
        own = list(text)
        while True:
            best = min(((self.rank[x], i) for i in range(len(own) - 1) if (x := own[i] + own[i + 1]) in self.rank), default=None)
            if best is None:
                return own
            own[best[1] : best[1] + 2] = [own[best[1]] + own[best[1] + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces as they are, side by side (left may be empty)."""
        known = self.pairs.get(key := (left, right))
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()  # in place: solve() holds it
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def solve(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word: the words, sorted, are the trie's leaves in depth-first order."""
        pairs = self.pairs
        solved, before, last = {}, "", [""]  # last[i]: last piece of the first i characters
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            last += [""] * (len(word) - shared)
            found = self.automaton.iter(word, max(0, shared + 1 - self.longest))
            if self.single.issuperset(word):
                for end, piece in found:
                    end += 1
                    if end > shared and not last[end]:
                        previous = last[end - len(piece)]
                        if previous or end == len(piece):
                            apart = pairs.get((previous, piece))
                            if self.apart(previous, piece) if apart is None else apart:
                                last[end] = piece
            else:
                self._with_lone(word, last, shared, found)
            own, end = [], len(word)
            while end:
                own.append(last[end])
                end -= len(last[end])
            solved[word] = own[::-1]
            before = word
        return solved

    def _with_lone(self, word: str, last: list[str], shared: int, found: Iterator[tuple[int, str]]) -> None:
        """The same where a character that is no piece stands alone if no piece holds it."""
        done = shared
        for end, piece in found:
            end += 1
            if end <= shared:
                continue
            for lone in range(done + 1, end):
                last[lone] = last[lone] or word[lone - 1]
            done = end - 1
            previous = last[end - len(piece)]
            if not last[end] and (previous or end == len(piece)) and self.apart(previous, piece):
                last[end] = piece
        for lone in range(done + 1, len(word) + 1):
            last[lone] = last[lone] or word[lone - 1]

    def ids(self, piece: str) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece][1]]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them; none for an empty text."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {}
        words, rank = self.words, self.rank
        for word, own in self.solve([w for w in set().union(*cut) if w not in words]).items():
            try:
                words[word] = array("i", [rank[p][1] for p in own]).tobytes()
            except KeyError:
                words[word] = array("i", [i for p in own for i in self.ids(p)]).tobytes()
        return [np.frombuffer(b"".join(map(words.__getitem__, c)), np.int32) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: bytes are put together (wrong ones give U+FFFD), marks are spaces, the first is dropped."""
        if not self.high[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        else:
            out, raw = [], bytearray()
            for i in [*ids.tolist(), -1]:
                if i in self.of_byte:
                    raw.append(self.of_byte[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "each-byte"))
                    raw.clear()
                out.append(self.shown[i] if i >= 0 else "")
            text = "".join(out)
        return text[1:] if text.startswith(" ") else text


class Unigram(Pieces):
    """Encoder and decoder for one unigram vocabulary: the path of the best sum of scores."""

    def solve(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word by Viterbi; of equal sums the one whose last piece starts first, as in the library.

        best[i] and back[i] are the score of the first i characters and where the last piece of
        the best path to i starts. Both hold for every word with that prefix, so a word only
        pays for what it doesn't share with the one before. A character that no piece has
        costs the least score and a penalty more; unknown characters in a row are one piece
        where the file has no bytes for them.
        """
        solved, before, best, back = {}, "", [0.0], [0]
        lone = self.least - UNKNOWN_PENALTY
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            ends: dict[int, list[str]] = {}
            for end, piece in self.automaton.iter(word, max(0, shared + 1 - self.longest)):
                if end >= shared:
                    ends.setdefault(end + 1, []).append(piece)
            for end in range(shared + 1, len(word) + 1):
                found = sorted(ends.get(end, []), key=len, reverse=True)  # the earliest start first
                options = [(best[end - len(p)] - self.rank[p][0], end - len(p)) for p in found]
                if word[end - 1] not in self.single:
                    options.append((best[end - 1] + lone, end - 1))
                score, start = max(options, key=lambda x: x[0])
                best.append(score)
                back.append(start)
            own, end = [], len(word)
            while end:
                own.append(word[back[end] : end])
                end = back[end]
            solved[word] = self._joined(own[::-1])
            before = word
        return solved

    def _joined(self, own: list[str]) -> list[str]:
        if self.byte or all(p in self.rank for p in own):
            return own
        out: list[str] = []
        for p in own:
            if out and p not in self.rank and out[-1] not in self.rank:
                out[-1] += p
            else:
                out.append(p)
        return out

    def _cuts(self) -> re.Pattern:
        """Units of a marked text: a word with the marks before it, as no piece reaches into the next."""
        return re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


_OWN: dict[int, Pieces] = {}


def _pieces(data: bytes) -> Pieces:
    """One encoder to a worker: tries and pairs outlive a task."""
    key = hash(data)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = (Unigram if model_kind(data) == UNIGRAM else Pieces)(data)
    return _OWN[key]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > TRIE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _sent(spark: SparkSession, path: str):
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    with open(path, "rb") as f:
        data = f.read()
    model_kind(data)
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """docs with two more columns: ``out`` (array of int) and ``out``_exact (boolean).

    The ids are those of the library for the file; a file that asks for what isn't built here
    is an error (see model_kind()). ``exact`` says that decode() gives the text back; it
    doesn't where a text holds the mark U+2581 itself, which reads as a space, or a character
    that neither the pieces nor bytes have.
    Null and empty texts have no pieces and are exact. All columns and rows stay, repeated
    ones too; texts are read whole. Columns that have the new names are an error.
    """
    if {out, f"{out}_exact"} & set(docs.columns):
        raise ValueError(f"docs already has {out} or {out}_exact")
    sent, at = _sent(docs.sparkSession, path), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in _groups(texts):
                ids = own.encode(texts[a:b])
                exact = [own.decode(i) == t for i, t in zip(ids, texts[a:b])]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(exact)], names=[*batch.schema.names, out, f"{out}_exact"])

    shape = docs.limit(0).withColumns({out: F.array().cast("array<int>"), f"{out}_exact": F.lit(True)}).schema
    return in_arrow(docs, run, shape)


def decode(rows: DataFrame, path: str, ids_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """rows with the text of the ids in a column ``out``; a null or empty list is an empty text.

    Ids are those of the file; repeated rows and other columns stay; a column that has the new
    name is an error; an empty table gives no rows.
    """
    if out in rows.columns:
        raise ValueError(f"rows already has {out}")
    sent, at = _sent(rows.sparkSession, path), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(sent.value)
        for batch in batches:
            texts = [own.decode(np.array(i or [], np.int32)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return in_arrow(rows, run, rows.limit(0).withColumn(out, F.lit("")).schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip of each row of documents; a null text has no pieces and is exact."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path or vocabulary())
    return coded.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", F.col("pieces_exact").alias("round_trip"))
