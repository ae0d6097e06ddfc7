"""Language ID: word-first backoff.

A word that was seen in training counts by its log frequency in each language.
A word that was not falls back to its character n-grams: the longest length of
which it has known n-grams decides, down to single characters.

Training takes about ``train_docs`` labelled documents (``TRAIN_DOCS`` unless
told otherwise), chosen by the hash of their ids, and keeps all their words and
n-grams.  Words are counted in the texts; n-grams follow from the distinct words
and their counts.  Prediction reads every text whole: a text is a list of row
numbers in the table of words, and one gather and sum gives its log likelihoods.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: The bound of the training sample, and the longest n-gram.
TRAIN_DOCS, LONGEST = 20_000, 4
#: Entries of a task's counts before they are given out and begun anew; characters of words that a worker keeps the rows of.
HELD, HELD_CHARS = 50_000, 8_000_000
#: From this many words on, more words don't make the score more certain.
SURE_WORDS = 20
#: The pipeline rejects what scores less.
KEEP = 0.5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Lower-cased runs of letters (and of number signs that aren't digits), in order."""
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Its n-grams; a space marks either end."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def keys_of(tokens: list[str]) -> np.ndarray:
    """64-bit hashes that stand for tokens in a model."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), dtype=np.uint64, count=len(tokens))


class Model:
    """Log frequencies by language of words (length 0) and n-grams.

    The tables are sorted arrays of the tokens' hashes and of their log frequencies, some 8
    bytes and 8 for each language a token; a word that training didn't see is taken for
    one that it saw with a probability of its words over 2^64.  A worker keeps the rows
    of the words that it met lately.  A word's row has its log frequencies, then its
    share of known n-grams at the length that decides (1 for a known word), then 1 if it
    has a letter.
    """

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables
        self.places: dict[int, dict[int, int]] = {}
        self.forget()

    @classmethod
    def fitted(cls, languages: list[str], counts: dict[int, tuple[list[str], np.ndarray]]) -> Model:
        """``counts``: for each length, the tokens and their counts, a row a token and a column a language."""
        tables = {}
        for n, (tokens, c) in counts.items():
            if len(c):
                keys = keys_of(tokens)
                order = np.argsort(keys)
                tables[n] = keys[order], np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(c)))[order]
        return cls(languages, tables)

    def parts(self) -> tuple:
        """What a model is made of again."""
        return self.languages, self.tables

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table, self.held = np.zeros((1024, len(self.languages) + 2)), 0

    @property
    def added(self) -> list[str]:
        """The words that the worker's table has rows of now."""
        return list(self.index)

    def known(self, n: int, grams: list[str]) -> np.ndarray:
        """The log frequencies of those of the n-grams that training saw, a row for each."""
        if n not in self.tables:
            return np.zeros((0, len(self.languages)))
        keys, logs = self.tables[n]
        if n not in self.places:
            # n-grams are few beside the words, and asked for one word at a time.
            self.places[n] = dict(zip(keys.tolist(), range(len(keys))))
        places = self.places[n]
        return logs[[i for g in grams if (i := places.get(xxhash.xxh3_64_intdigest(g))) is not None]]

    def unseen(self, word: str) -> np.ndarray:
        """The row of a word that training didn't see: from its longest known n-grams, all 0 without any."""
        row = np.zeros(len(self.languages) + 2)
        row[-1] = any(map(str.isalpha, word))
        for n in range(LONGEST, 0, -1) if row[-1] else ():
            grams = grams_of(word, n)
            found = self.known(n, grams)
            if len(found):
                row[:-2], row[-2] = found.mean(axis=0), len(found) / len(grams)
                break
        return row

    def add(self, words: list[str]) -> None:
        """Puts words that aren't there yet into the table."""
        words, before = list(dict.fromkeys(words)), len(self.index)
        self.index.update(zip(words, range(before, before + len(words))))
        self.held += sum(map(len, words)) + 50 * len(words)
        if len(self.index) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(len(self.table), len(words)), self.table.shape[1]))))
        place = np.arange(before, before + len(words))
        if 0 in self.tables:
            keys, logs = self.tables[0]
            wanted = keys_of(words)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            seen = keys[at] == wanted
            self.table[place[seen], :-2], self.table[place[seen], -2:] = logs[at[seen]], 1
            place = place[~seen]
        for i in place.tolist():
            self.table[i] = self.unseen(words[i - before])

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_in(text or "")
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if self.held > HELD_CHARS:
            self.forget()
        rows = list(map(self.index.get, words))
        if None in rows:
            self.add([w for i, w in zip(rows, words) if i is None])
            rows = list(map(self.index.__getitem__, words))
        total = self.table[rows].sum(axis=0)
        n, explained, logs = total[-1], total[-2], total[:-2]
        if n == 0:
            return UNKNOWN, 0.0
        if n > SURE_WORDS:
            logs = logs * (SURE_WORDS / n)
        p = np.exp(logs - logs.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum() * explained / n)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_COUNTS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("k", T.LongType())])


def _counted(df: DataFrame, add) -> DataFrame:
    """Counts of what ``add`` puts from each batch into a Counter by (n, token, lang)."""
    arrow = common.to_arrow(_COUNTS)
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.start_anew()
        counts: Counter = Counter()

        def made() -> pa.RecordBatch:
            columns = zip(*((*key, k) for key, k in counts.items())) if counts else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in common.pieces(batches):
            for _ in add(batch, counts):
                if len(counts) >= HELD:
                    yield made()
                    counts.clear()
        yield made()

    return df.mapInArrow(run, _COUNTS).groupBy("n", "token", "lang").agg(F.sum("k").alias("k"))


def _words(batch: pa.RecordBatch, counts: Counter):
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        for w, k in Counter(words_in(text)).items():
            if w.isalpha() or any(map(str.isalpha, w)):
                counts[0, w, lang] += k
        yield


def _grams(batch: pa.RecordBatch, counts: Counter):
    for w, lang, k in zip(*(batch.column(c).to_pylist() for c in ("token", "lang", "k"))):
        for n in range(1, LONGEST + 1):
            for g in grams_of(w, n):
                counts[n, g, lang] += k
        yield


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """n (0: a word), token, lang and count over the training documents; rows without id, text or label are not used."""
    id_, text, lang = docs[id_col], docs[text_col], docs[lang_col]
    ready = id_.isNotNull() & text.isNotNull() & lang.isNotNull() & ~held_out(id_)
    labelled = docs.where(ready).select(id_.alias("id"), lang.cast("string").alias("lang"), text.cast("string").alias("text"))
    n = labelled.select("lang").count()
    if n > train_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / n))
    common.shared_dir(docs.sparkSession)
    words = _counted(labelled.select("lang", "text"), _words).checkpoint()
    return words.unionByName(_counted(words.select("token", "lang", "k"), _grams))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents that are not held out; the driver gets the counts of that bounded sample."""
    rows = token_counts(docs, id_col, text_col, lang_col, train_docs).toArrow()
    lang = pc.dictionary_encode(rows.column("lang")).combine_chunks()
    names = lang.dictionary.to_pylist()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], dtype=np.int64)
    at = place[lang.indices.to_numpy()] if names else np.empty(0, np.int64)
    lengths, k = rows.column("n").to_numpy(), rows.column("k").to_numpy()
    counts = {}
    for n in range(LONGEST + 1):
        own = np.flatnonzero(lengths == n)
        token = pc.dictionary_encode(rows.column("token").take(pa.array(own))).combine_chunks()
        made = np.zeros((len(token.dictionary), len(languages)))
        np.add.at(made, (token.indices.to_numpy(), at[own]), k[own])
        counts[n] = (token.dictionary.to_pylist(), made)
    return Model.fitted(languages, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred and score.

    The score is the language's share of the likelihood, less for texts whose
    words the training explains less: a known word counts whole, an unseen one
    by the share of its n-grams that are known.  Texts that are null, empty or
    without a letter are ``und`` with score 0, as is everything if nothing was
    learned; a text of unknown letters only scores 0.  The prediction sees the
    text alone; ties between languages go to the first by name.  Repeated rows
    are each judged.  A null id is not held out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.parts())
    schema = T.StructType([common.id_field(docs, id_col), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> dict:
        own = common.built(sent, lambda parts: Model(*parts))
        got = [own.predict(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    df = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return common.map_arrow(df, run, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more, with all their columns."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.parts())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = common.built(sent, lambda parts: Model(*parts))
        got = [own.predict(t) for t in batch.column(text_col).to_pylist()]
        return batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], type=pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
