"""Word n-gram TF-IDF: vocabulary fit, document vectors and their long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from textprep.functions.text import WORD
from textprep.operators.identity import quoted
from textprep.sources.scratch import batches_of, materialize

MAX_FEATURES = 5000
NGRAM_RANGE = (1, 3)


#: A fitted vocabulary is collected, broadcast and kept in the model, so it may not be larger.
MAX_VOCABULARY = 1_000_000
#: A task's summary of its words holds this many times ``max_features`` of them.
SUMMARY = 8
#: Texts whose words are sent to Python at once.
TEXTS_A_BATCH = 200
#: Different n-grams that a batch of texts adds up in a task until they are passed on.
WINDOWS_HELD = 1_000_000
#: Bytes of text whose n-grams a task counts by document.
TEXT_PER_TASK = 4 << 20


class Term(NamedTuple):
    """A vocabulary entry: an n-gram, its length in words and its corpus count."""

    term: str
    n: int
    total: int


def token_pattern(min_chars: int = 2, keep_marks: bool = False) -> str:
    """Token regex. Without ``keep_marks`` Indic words split at vowel signs, as in Python's \\w."""
    return f"[{WORD}{chr(92) + 'p{M}' if keep_marks else ''}]{{{min_chars},}}"


def word_tokens(c: Column | str, min_chars: int = 2, keep_marks: bool = False) -> Column:
    """Lower-cased word tokens in text order."""
    pattern = token_pattern(min_chars, keep_marks)
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def ngrams_sql(tokens: str, ngram_range: tuple[int, int] = NGRAM_RANGE) -> str:
    """SQL expression for all n-grams of an array column, shorter ones first."""
    parts = []
    for n in range(ngram_range[0], ngram_range[1] + 1):
        words = "".join(f", ' ', {tokens}[i + {k}]" for k in range(1, n))
        firsts = f"slice({tokens}, 1, size({tokens}) - {n - 1})"
        window = f"transform({firsts}, (word, i) -> concat(word{words}))"
        none = "cast(array() AS array<string>)"
        parts.append(tokens if n == 1 else f"if(size({tokens}) < {n}, {none}, {window})")
    return f"concat({', '.join(parts)})"


def ngrams(tokens: str, ngram_range: tuple[int, int] = NGRAM_RANGE) -> Column:
    """All n-grams of an array column with n in ``ngram_range``, joined by a space."""
    return F.expr(ngrams_sql(tokens, ngram_range))


def _explode(df: DataFrame, terms: str, *keep: str) -> DataFrame:
    """One row per array element.

    ``explode`` would make the optimizer add ``size(terms) > 0`` below, which runs the tokenizer a
    second time; ``explode_outer`` does not, and the rows of empty arrays are dropped here.
    """
    exploded = df.select(*keep, F.explode_outer(terms).alias("term"))
    return exploded.where(F.col("term").isNotNull())


def placed_by_id(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and ``text``, placed by id in parts of about ``TEXT_PER_TASK`` bytes of text.

    Documents' n-grams take many times the room of their texts, so the number of parts grows with the
    texts and a task's table of n-grams does not.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.select(doc_id, text).repartition(size // TEXT_PER_TASK + 1, doc_id)


def term_counts(
    df: DataFrame, doc_id: str, text: str = "text", ngram_range: tuple[int, int] = NGRAM_RANGE
) -> DataFrame:
    """(document, term, tf) over every n-gram of every document.

    Texts are placed by id before they are cut into terms, so the exchange carries the texts and
    not the much longer list of their n-grams.
    """
    placed = placed_by_id(df, doc_id, text)
    tokens = placed.select(doc_id, word_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    terms = tokens.select(doc_id, ngrams("tokens", ngram_range).alias("grams"))
    return _explode(terms, "grams", doc_id).groupBy(doc_id, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def _top(counts: DataFrame, size: int) -> list[Term]:
    """Most frequent terms; ties go to the shorter n-gram, then to the lower term."""
    best = counts.orderBy(F.desc("total"), "n", "term").limit(size)
    return [Term(*row) for row in best.select("term", "n", "total").collect()]


def checked_size(size: int) -> int:
    if not 0 < size <= MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has 1 to {MAX_VOCABULARY} terms, not {size}")
    return size


def word_summaries(df: DataFrame, tokens: str, capacity: int) -> DataFrame:
    """``term, n``: each task's most frequent words, ``capacity`` at most, with their counts there.

    A row without a term tells how often, at most, the task holds any word that it left out. Summed
    over the tasks, counts are lower bounds, off by the sum of those rows at most.
    """

    def most_frequent(parts: list[pa.Table]) -> tuple[pa.Table, int]:
        counts = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        counts = counts.rename_columns(["term", "n"])
        if counts.num_rows <= capacity:
            return counts, 0
        last = pc.select_k_unstable(counts, capacity + 1, [("n", "descending")])[-1].as_py()
        bound = counts["n"][last].as_py()
        return counts.filter(pc.greater(counts["n"], bound)), bound

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, missed = [schema.empty_table()], 0, 0
        for batch in batches:
            counted = pc.value_counts(split(batch.column(0))[0])
            held.append(pa.table([counted.field(0), counted.field(1)], schema=schema))
            size += len(counted)
            if size > 4 * capacity:  # so a task's memory does not grow with its words
                kept, bound = most_frequent(held)
                held, size, missed = [kept], kept.num_rows, missed + bound
        kept, bound = most_frequent(held)
        yield from kept.cast(schema).to_batches()
        yield pa.RecordBatch.from_pylist([{"term": None, "n": missed + bound}], schema)

    schema, split = pa.schema([("term", pa.string()), ("n", pa.int64())]), word_splitter()
    return df.select(tokens).mapInArrow(rows, "term string, n long")


def frequent_words(df: DataFrame, tokens: str, size: int) -> DataFrame | None:
    """``term``: words among which the ``size`` most frequent are; ``None`` if summaries cannot tell.

    Whatever is missing from a summary is no more frequent there than the task says. A word whose
    lower bound and all that may be missing stay below the lower bound in place ``size`` is out.
    """
    summary = word_summaries(df, tokens, SUMMARY * size).groupBy("term").agg(F.sum("n").alias("n"))
    with batches_of(df.sparkSession, TEXTS_A_BATCH):
        summary = materialize(summary, "summary")
    missed = summary.where("term IS NULL").select("n").first()
    known = summary.where("term IS NOT NULL")
    place = known.orderBy(F.desc("n")).select("n").limit(size).agg(F.min("n"), F.count(F.lit(1))).first()
    missed, floor = (missed[0] if missed else 0), (place[0] or 0) if place[1] == size else 0
    # Without a full list, or if a word that no summary holds could be in it, all words count.
    if missed and missed >= floor:
        return None
    return known.where(F.col("n") + missed >= floor).select("term")


class Coded(NamedTuple):
    """Texts as lists of places in ``words``, -1 for other words, in the column ``codes`` of ``table``."""

    words: list[str]
    table: DataFrame


def coded_words(df: DataFrame, tokens: str, words: list[str]) -> Coded:
    """Stored for the passes over n-grams, which then need no strings."""

    def codes(column: pa.Array) -> pa.Array:
        flat, size = split(column)
        found = pc.index_in(flat, value_set=known).fill_null(-1)
        return pa.ListArray.from_arrays(pa.array(np.append([0], np.cumsum(size)), pa.int32()), found)

    known, split = pa.array(words, pa.string()), word_splitter()
    coded = df.select(F.arrow_udf(codes, "array<int>")(tokens).alias("codes"))
    with batches_of(df.sparkSession, TEXTS_A_BATCH):
        return Coded(words, materialize(coded, "codes"))


def count_words(df: DataFrame, tokens: str, size: int) -> tuple[DataFrame, Coded | None]:
    """``term, total``, exact, of words among which the ``size`` most frequent are; texts in their codes.

    ``None`` if the tasks' summaries leave too many words.
    """
    survivors = frequent_words(df, tokens, size)
    if survivors is not None and survivors.count() <= MAX_VOCABULARY:
        coded = coded_words(df, tokens, survivors.toArrow()["term"].to_pylist())
        return code_counts(coded), coded
    if isinstance(df.schema[tokens].dataType, StringType):
        df = df.select(F.filter(F.split(tokens, " "), lambda word: word != "").alias(tokens))
    words = _explode(df, tokens)
    if survivors is not None:
        words = words.join(survivors, "term", "left_semi")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("total")), None


def code_counts(coded: Coded) -> DataFrame:
    """``term, total`` of the words that have codes; a task sends one row per word at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy()
            total += np.bincount(codes[codes >= 0], minlength=size)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], ["place", "total"])

    size = len(coded.words)
    counts = coded.table.mapInArrow(rows, "place int, total long")
    counts = counts.groupBy("place").agg(F.sum("total").alias("total"))
    names = pa.table({"place": pa.array(range(size), pa.int32()), "term": pa.array(coded.words, pa.string())})
    names = F.broadcast(coded.table.sparkSession.createDataFrame(names))
    return counts.join(names, "place").select("term", "total")


def fit_vocabulary(
    df: DataFrame,
    tokens: str = "tokens",
    max_features: int = MAX_FEATURES,
    max_n: int = NGRAM_RANGE[1],
) -> list[Term]:
    """The ``max_features`` most frequent 1..max_n-grams, best first.

    ``tokens`` are arrays, or strings of words with a space between. Counting all n-grams would
    shuffle nearly every trigram of the corpus, as most are unique. An n-gram is never more frequent
    than the two (n-1)-grams it consists of, so each pass counts only n-grams whose parts beat the
    current last place. Fewer than ``max_features`` parts can do so, which bounds the broadcast, and
    the result is exact. At most ``max_features`` rows reach the driver per pass. Words are counted
    exactly only if the tasks' summaries leave them a place; those have codes, on which all passes work.
    """
    return fit_coded_vocabulary(df, tokens, max_features, max_n)[0]


def fit_coded_vocabulary(
    df: DataFrame, tokens: str, max_features: int, max_n: int
) -> tuple[list[Term], Coded]:
    """The vocabulary of :func:`fit_vocabulary` and the texts in codes of all its words at least."""
    spark = df.sparkSession
    df = df.select(tokens)
    counts, coded = count_words(df, tokens, checked_size(max_features))
    top = _top(counts.withColumn("n", F.lit(1)), max_features)
    coded = coded or coded_words(df, tokens, [t.term for t in top])
    # Of the (n-1)-grams that may be parts: the last word and the places of their own two parts.
    parts = {t.term: (t.term, None, None) for t in top}
    tables, size = [], 0
    for n in range(2, max_n + 1):
        floor = top[-1].total if len(top) == max_features else 0
        terms = [t.term for t in top if t.n == n - 1 and t.total > floor]
        if not terms:
            break
        if n == 2:
            place = {term: i for i, term in enumerate(terms)}
            first = np.array([place.get(word, -1) for word in coded.words], np.int64)
        else:
            terms.sort(key=lambda term: parts[term][1:])
            tables.append((size, np.array([parts[t][1] * size + parts[t][2] for t in terms], np.int64)))
        size = len(terms)
        names = pa.table({"place": pa.array(range(size), pa.int32()), "term": terms, "last": [parts[t][0] for t in terms]})
        names = F.broadcast(spark.createDataFrame(names))
        heads = names.select(F.col("place").alias("head"), F.col("term").alias("head_term"))
        tails = names.select(F.col("place").alias("tail"), "last")
        counts = window_counts(coded.table, first, size, tables).join(heads, "head").join(tails, "tail")
        counts = counts.withColumns({"term": F.concat_ws(" ", "head_term", "last"), "n": F.lit(n)})
        best = counts.orderBy(F.desc("total"), "term").limit(max_features).collect()
        parts = {r.term: (r.last, r.head, r.tail) for r in best}
        merged = top + [Term(r.term, r.n, r.total) for r in best]
        merged.sort(key=lambda t: (-t.total, t.n, t.term.encode()))
        top = merged[:max_features]
    return top, coded


def word_splitter():
    """Function: the words of an Arrow column of arrays or of spaced strings, and how many each row has.

    Made anew for each use: what is defined in here is sent to Python workers by value.
    """

    def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not pa.types.is_list(column.type):
            column = pc.if_else(pc.equal(column, ""), pa.scalar(None, column.type), column)
            column = pc.split_pattern(column, " ")
        size = pc.list_value_length(column).fill_null(0)
        return column.flatten(), size.to_numpy(zero_copy_only=False)

    return split


def window_counts(
    coded: DataFrame, first: np.ndarray, size: int, tables: list[tuple[int, np.ndarray]]
) -> DataFrame:
    """``head, tail, total``: how often the n-grams occur of which both (n-1)-grams may be parts.

    ``first`` has the places of codes among the words that may be parts, or -1. From the words upwards
    ``tables`` tell which m-grams may: those of the pairs ``head * words + tail`` of places of their two
    (m-1)-grams, of which there are so many. The last ones are ``size``; ``head`` and ``tail`` are places.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [schema.empty_table()]

        def counted() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by("pair").aggregate([("total", "sum")])
            pair = whole["pair"].to_numpy()
            head, tail = pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32))
            yield from pa.table([head, tail, whole["total_sum"]], ["head", "tail", "total"]).to_batches()

        for batch in batches:
            codes = batch.column(0)
            ends = np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))
            place = np.insert(by_code[codes.flatten().to_numpy()], ends, -1)  # -1 parts the texts
            for words, pairs in tables:
                pair = np.where((place[:-1] >= 0) & (place[1:] >= 0), place[:-1] * words + place[1:], -1)
                place = pc.index_in(pa.array(pair), value_set=pa.array(pairs)).fill_null(-1)
                place = place.to_numpy().astype(np.int64)
            at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
            found = pc.value_counts(pa.array(place[at] * size + place[at + 1]))
            held.append(pa.table([found.field(0), found.field(1)], schema=schema))
            if sum(part.num_rows for part in held) > most:
                yield from counted()
                held = [schema.empty_table()]
        yield from counted()

    schema, most = pa.schema([("pair", pa.int64()), ("total", pa.int64())]), WINDOWS_HELD
    by_code = np.append(first, -1)  # the code -1 counts from the end
    counts = coded.mapInArrow(rows, "head int, tail int, total long")
    return counts.groupBy("head", "tail").agg(F.sum("total").alias("total"))


def vocabulary_table(spark: SparkSession, vocabulary: list[Term]) -> DataFrame:
    """``idx, term, n, total`` for joins; as long as the vocabulary, so it may be broadcast."""
    columns = list(zip(*vocabulary)) or [(), (), ()]
    return spark.createDataFrame(
        pa.table(
            {
                "idx": pa.array(range(len(vocabulary)), pa.int32()),
                "term": pa.array(columns[0], pa.string()),
                "n": pa.array(columns[1], pa.int32()),
                "total": pa.array(columns[2], pa.int64()),
            }
        )
    )


def _gram_tables(terms: list[str]) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """The words of ``terms``, and by length the beginnings of terms: ``(size, keys, term)``.

    A beginning's place is that of its key ``place * words + word`` among the sorted ``keys``, from the
    place of the same without its last word; a first word stands by itself. ``term`` is the place of the
    term it is, or -1.
    """
    split = [t.split(" ") for t in terms]
    words = sorted({w for t in split for w in t})
    place, tables = {w: i for i, w in enumerate(words)}, []
    state = [0] * len(terms)
    for n in range(1, max(map(len, split), default=0) + 1):
        keys = {i: state[i] * len(words) + place[t[n - 1]] for i, t in enumerate(split) if len(t) >= n}
        ordered = np.unique(np.fromiter(keys.values(), np.int64))
        at = np.searchsorted(ordered, np.fromiter(keys.values(), np.int64)).tolist()
        term = np.full(len(ordered), -1, np.int32)
        for i, j in zip(keys, at):
            state[i] = j
            if len(split[i]) == n:
                term[j] = i
        tables.append((ordered, term))
    return words, tables


class VocabularyGrams(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """The n-grams of an array column that are in a vocabulary, within each row and as often as there.

    What a vocabulary does not hold needs no string. Terms are words with a space between them.
    """

    terms = Param(Params._dummy(), "terms", "the vocabulary", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, terms=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        grams = vocabulary_grams(self.getOrDefault("terms"))
        return dataset.withColumn(self.getOutputCol(), grams(quoted(self.getInputCol())))


def term_finder(terms: list[str]):
    """The words of ``terms`` and a function: of texts in codes of these words, with the number of words
    of each, the rows and the places of the terms that occur, as often as they do, in no order.
    """

    def find(word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
        at, state = np.arange(len(word)), np.zeros(len(word), np.int64)
        rows, found = [row[:0]], [np.empty(0, np.int32)]
        for n, (keys, term) in enumerate(tables):
            inside = at + n < ends[row[at]]
            at, state = at[inside], state[inside]
            key = np.where(word[at + n] >= 0, state * known + word[at + n], -1)
            state = pc.index_in(pa.array(key), value_set=keys).fill_null(-1).to_numpy()
            at, state = at[state >= 0], state[state >= 0].astype(np.int64)
            is_term = term[state] >= 0
            rows.append(row[at[is_term]])
            found.append(term[state[is_term]])
        return np.concatenate(rows), np.concatenate(found)

    words, tables = _gram_tables(terms)
    tables, known = [(pa.array(keys), term) for keys, term in tables], len(words)
    return words, find


def vocabulary_grams(terms: list[str]):
    """Arrow function of an array column: its n-grams among ``terms``, in no order."""

    def grams(tokens: pa.Array) -> pa.Array:
        parts = [of_few(tokens.slice(i, few)) for i in range(0, len(tokens), few)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    def of_few(tokens: pa.Array) -> pa.Array:
        flat, size = split(tokens)
        word = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
        rows, found = find(word, size)
        order = np.argsort(rows, kind="stable")
        offsets = np.append([0], np.cumsum(np.bincount(rows, minlength=len(size))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(found[order])))

    words, find = term_finder(terms)
    names, known, few = pa.array(terms, pa.string()), pa.array(words, pa.string()), TEXTS_A_BATCH
    split = word_splitter()
    return F.arrow_udf(grams, "array<string>")


def documents_of_terms(coded: Coded, vocabulary: list[Term]) -> DataFrame:
    """``idx, df``: the documents that hold each term; a task sends one row per term at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, few):
                codes = batch.column(0).slice(start, few)
                size = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
                row, term = find(by_code[codes.flatten().to_numpy()], size)
                pairs = pc.unique(pa.array(row * terms + term)).to_numpy()
                df += np.bincount(pairs % terms, minlength=terms)
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(df[idx])], ["idx", "df"])

    words, find = term_finder([t.term for t in vocabulary])
    place = {word: i for i, word in enumerate(words)}
    by_code = np.array([*(place.get(word, -1) for word in coded.words), -1], np.int64)
    terms, few = len(vocabulary), TEXTS_A_BATCH
    counts = coded.table.mapInArrow(rows, "idx int, df long")
    return counts.groupBy("idx").agg(F.sum("df").alias("df"))


def idf_of_terms(coded: Coded, vocabulary: list[Term]) -> list[float]:
    """Smoothed idf by term index, as :func:`fit_idf` has it from vectors."""
    n, df = coded.table.count(), dict(documents_of_terms(coded, vocabulary).collect())
    return [math.log((n + 1.0) / (df.get(i, 0) + 1.0)) + 1.0 for i in range(len(vocabulary))]


def count_vectorizer(vocabulary: list[Term], grams: str = "grams") -> CountVectorizerModel:
    """Term counts by index as a sparse vector, within each row: no shuffle."""
    terms = [t.term for t in vocabulary]
    return CountVectorizerModel.from_vocabulary(terms, inputCol=grams, outputCol="tf")


def vector_entries(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """One row per stored entry of a sparse vector: ``idx, value``."""
    v = F.unwrap_udt(vector)
    zipped = F.arrays_zip(v["indices"].alias("idx"), v["values"].alias("value"))
    entries = df.select(*keep, F.inline_outer(zipped).alias("idx", "value"))
    return entries.where(F.col("idx").isNotNull())


def document_frequency(df: DataFrame, vector: str = "tf") -> DataFrame:
    """Documents per term index; a map task sends at most one row per vocabulary entry."""
    return vector_entries(df, vector).groupBy("idx").agg(F.count(F.lit(1)).alias("df"))


def fit_idf(df: DataFrame, vector: str = "tf") -> list[float]:
    """Smoothed idf by term index, ``ln((1 + n) / (1 + df)) + 1``, in one pass."""
    model = IDF(inputCol=vector, outputCol="_idf").fit(df)
    return [value + 1.0 for value in model.idf.toArray().tolist()]


def idf_stages(idf: list[float]) -> list:
    """tf vector -> ``features``: tf * idf, each row divided by its L2 norm."""
    return [
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf"),
        Normalizer(p=2.0, inputCol="tfidf", outputCol="features"),
    ]
