"""Language identification by blended-spectrum n-gram presence kernels.

The kernel of two texts is the number of n-grams (1 to N characters) that both have, over
the geometric mean of how many each has. Nyström landmarks stand for the training texts;
one-versus-rest kernel ridge regression in their space gives a weight matrix, so that a
batch of texts is scored by two matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, table

#: Longest n-gram.
SPECTRUM = 3
#: Bounds of the training sample: texts of each language, and characters of all languages together. Each
#: language has an equal part of the characters, and one text at least.
SAMPLE_PER_LANG, SAMPLE_CHARS = 300, 8_000_000
#: Bounds of the landmarks, likewise.
LANDMARKS_PER_LANG, LANDMARK_CHARS = 24, 400_000
RIDGE = 1e-3
#: Texts that are scored by one matrix product, and the most cells of its presence matrix.
ROWS_AT_ONCE, CELLS = 256, 1 << 24
UNKNOWN = "und"
#: Least score of a text that the stage takes for one of the learned languages.
LEAST_SCORE = 0.1

_LETTER = re.compile(r"[^\W\d_]")
_CODES = 0x110000


def has_letter(text: str) -> bool:
    """Whether a text has a letter (Unicode category L); numbers like ² or Ⅷ are none."""
    found = _LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # of each code point: 0 for what is no letter, then a number for each letter of the sample, then one for others
    size: int  # codes
    grams: np.ndarray  # sorted n-gram numbers that a landmark has
    weights: np.ndarray  # n-grams x langs: the landmarks' kernel columns times the ridge weights of the landmarks


def _codes(text: str, code: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = code[points].astype(np.int64)
    own = own[(own > 0) | np.concatenate(([True], own[:-1] > 0))[: len(own)]]  # a run of other characters counts once
    return np.concatenate(([0], own, [0]))


def grams(text: str, code: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the distinct n-grams of the whole text, sorted."""
    own, found, number, offset = _codes(text, code), [], None, 0
    for n in range(1, SPECTRUM + 1):
        if len(own) < n:
            break
        number = own if n == 1 else number[:-1] * size + own[n - 1 :]
        found.append(np.unique(number) + offset)
        offset += size**n
    return np.concatenate(found)


def _rows(own: list[np.ndarray], known: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Presence of the known n-grams in texts (n-gram numbers of each), over the root of how many each has, times columns."""
    out = np.zeros((len(own), columns.shape[1]))
    step = max(1, min(ROWS_AT_ONCE, CELLS // max(1, len(known))))
    for a in range(0, len(own), step):
        part = own[a : a + step]
        presence, norms = np.zeros((len(part), len(known)), np.float32), np.ones(len(part))
        for i, g in enumerate(part):
            at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
            presence[i, at[known[at] == g]] = 1
            norms[i] = max(1, len(g))
        out[a : a + step] = (presence @ columns) / np.sqrt(norms)[:, None]
    return out


def alphabet(texts: list[str]) -> tuple[np.ndarray, int]:
    """Code of each code point, and how many codes there are: every letter of the texts has its own."""
    letters = sorted({c for t in texts for c in set(t.lower()) if c.isalpha()})
    code = np.zeros(_CODES, np.int32)
    other = len(letters) + 1
    code[[i for i in range(_CODES) if chr(i).isalpha()]] = other
    code[[ord(c) for c in letters]] = np.arange(1, other)
    return code, other + 1


def chosen_landmarks(rows: list[tuple[str, str]], langs: list[str]) -> list[int]:
    """Evenly over the sorted rows of each language, as many as LANDMARKS_PER_LANG and its part of LANDMARK_CHARS allow, one at least."""
    chosen, part = [], LANDMARK_CHARS // len(langs)
    by_lang: dict[str, list[int]] = {g: [] for g in langs}
    for i, (_, g) in enumerate(rows):
        by_lang[g].append(i)
    for of in by_lang.values():
        picked = [of[int(k)] for k in np.unique(np.linspace(0, len(of) - 1, min(LANDMARKS_PER_LANG, len(of))).astype(int))]
        picked.sort(key=lambda i: (len(rows[i][0]) > part, i))  # a text beyond the part counts only where all are
        chars = np.cumsum([len(rows[i][0]) for i in picked])
        chosen += [i for k, i in enumerate(picked) if k == 0 or chars[k] <= part]
    return sorted(chosen)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """(text, lang) pairs -> model; None without any text that has a letter. The order of the pairs doesn't matter.

    The kernel of a text with a landmark is presence @ landmark / roots, and a score is that
    times the ridge weights. The landmarks' columns are multiplied by the weights once, here,
    so that the model has a column for each language and not for each landmark.
    """
    rows = sorted({(t, g) for t, g in rows if has_letter(t)}, key=lambda r: (r[1], r[0]))
    if not rows:
        return None
    langs = sorted({g for _, g in rows})
    code, size = alphabet([t for t, _ in rows])
    own = [grams(t, code, size) for t, _ in rows]
    chosen = chosen_landmarks(rows, langs)
    known = np.unique(np.concatenate([own[i] for i in chosen]))
    kernel = np.zeros((len(rows), len(chosen)))
    block = max(1, CELLS // len(known))
    for a in range(0, len(chosen), block):  # some landmarks at a time, as their dense columns take room
        kernel[:, a : a + block] = _rows(own, known, _columns([own[i] for i in chosen[a : a + block]], known))
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors[:, good := values > 1e-6 * values.max()] / np.sqrt(values[good])
    features = kernel @ root  # Nyström: inner products of features are kernel values
    target = np.array([[1.0 if g == r[1] else 0.0 for g in langs] for r in rows])
    weight = 1 / target.sum(0)[[langs.index(r[1]) for r in rows]]  # every language weighs the same
    scaled = features * weight[:, None]
    solved = root @ np.linalg.solve(features.T @ scaled + RIDGE * np.eye(features.shape[1]), scaled.T @ target)
    weights = np.zeros((len(known), len(langs)))
    for a in range(0, len(chosen), block):
        weights += _columns([own[i] for i in chosen[a : a + block]], known) @ solved[a : a + block]
    return Model(langs, code, size, known, weights.astype(np.float32))


def _columns(own: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """n-grams x landmarks, each column over the root of its landmark's n-grams."""
    columns = np.zeros((len(known), len(own)), np.float32)
    for k, g in enumerate(own):
        columns[np.searchsorted(known, g), k] = 1 / np.sqrt(len(g))
    return columns


def predict(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text; ``und`` and 0 where there is no letter, or no model."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if model and has_letter(t)]
    for a in range(0, len(use), ROWS_AT_ONCE):
        part = use[a : a + ROWS_AT_ONCE]
        found = _rows([grams(texts[i], model.code, model.size) for i in part], model.grams, model.weights)
        best = found.argmax(1)
        for i, k, s in zip(part, best.tolist(), np.clip(found.max(1), 0, 1).tolist()):
            langs[i], scores[i] = model.langs[k], s
    return langs, scores


def held_out(doc_id: str = "doc_id"):
    """Documents that training never sees; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Labelled texts of every language, at most SAMPLE_PER_LANG of each and SAMPLE_CHARS together, by a hash of the id.

    Each language has an equal part of the characters: its texts are taken in the order of
    their marks while their lengths add up to no more. A text longer than the part comes
    last, and only the first text of a language may be longer, so that no language is lost.
    The cut is made in Spark; only the sample reaches the driver.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    mark = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return []
    part = SAMPLE_CHARS // len(counts)
    # A little more than is needed by the rate, then exactly the bound by the order of the marks.
    rates = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.3 * SAMPLE_PER_LANG / r["count"] + 20 / r["count"]) * (1 << 30))) for r in counts], "_lang string, _rate long")
    near = labelled.withColumn("_mark", mark).join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where("_mark < _rate")
    order = Window.partitionBy("lang").orderBy(F.length("text") > part, "_mark", "text")
    ranked = near.withColumns({"_n": F.row_number().over(order), "_chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    kept = ranked.where((F.col("_n") == 1) | ((F.col("_n") <= SAMPLE_PER_LANG) & (F.col("_chars") <= part)))
    return [(r["text"], r["lang"]) for r in kept.select("text", "lang").collect()]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, lang_pred, score), one row for each row of docs.

    Texts are read whole. Null and empty texts, and texts without a letter, are ``und`` with
    score 0. Language, source and id take no part. Other columns are not read.
    """
    sent, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                own = predict([t or "" for t in batch.column(1).slice(a, ROWS_AT_ONCE).to_pylist()], sent.value)
                langs += own[0]
                scores.append(own[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(texts, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def trained(docs: DataFrame) -> Model | None:
    return fit(sample(docs))


def known_language(docs: DataFrame, model: Model | None, langs: tuple[str, ...] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the documents that the classifier rejects; all columns stay, whatever their names.

    A document stays if its text has a letter, the model gives it one of ``langs`` (None: any
    learned one) and a score of ``least`` or more. Texts of scripts and languages that are
    unlike every learned one score next to nothing. Every row is judged by its own text, in
    place: no text is shuffled. Null and empty texts go. Without a model nothing tells
    languages apart, and every text with a letter stays. An empty table gives no rows.
    """
    lettered = docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    if model is None:
        return lettered
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            found, scores = predict([t or "" for t in batch.column(at).to_pylist()], sent.value)
            wanted = [g != UNKNOWN and s >= least and (langs is None or g in langs) for g, s in zip(found, scores.tolist())]
            yield batch.filter(pa.array(wanted, pa.bool_()))

    return in_arrow(lettered, run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents; null and letterless texts are ``und`` with score 0."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
