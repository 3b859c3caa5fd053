"""Language identification by words first, then shorter and shorter character n-grams.

A known word adds each language's log frequency of that word. An unseen word is covered by
character n-grams instead: at each position the longest known one is taken, down to single
letters. The language with the largest sum wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import aside, by_value, slices, split_words

by_value(__name__)

#: Documents of each language the model is expected to learn from at most, and the size of its tables.
SAMPLE_DOCS, WORDS, GRAMS, LONGEST = 1500, 20000, 8000, 4
#: Bytes of text that are looked at together.
PART = 2 << 20
UNKNOWN = "und"
NOT_LETTERS = r"\P{L}+"


def letters(text: Column) -> Column:
    """Lower-case words of letters alone."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), " ")


class Model:
    """Log frequencies of words and n-grams, one column for each language."""

    def __init__(self, langs: list[str], words: dict, grams: dict):
        self.langs, self.words, self.grams = langs, words, grams
        self.floor = np.full(len(langs), -12.0)

    def unseen(self, word: str) -> np.ndarray:
        """Sum over the word's positions of the longest known n-gram that starts there."""
        total, i = np.zeros(len(self.langs)), 0
        word = f"_{word}_"
        while i < len(word):
            for n in range(min(LONGEST, len(word) - i), 0, -1):
                row = self.grams.get(word[i:i + n])
                if row is not None:
                    total += row
                    break
            else:
                n = 1
                total += self.floor
            i += n
        return total

    def rows(self, words: list[str]) -> np.ndarray:
        get, unseen = self.words.get, self.unseen
        found = [get(w) for w in words]
        return np.array([unseen(w) if r is None else r for w, r in zip(words, found)], float).reshape(-1, len(self.langs))

    def predict(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        """Language and confidence of each text: ``und`` and 0 where it has no letter. Works on a few
        megabytes of text at a time."""
        names, sure = [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", PART):
            more, share = self._predict(part.column("text"))
            names += more
            sure.append(share)
        return names, np.concatenate(sure) if sure else np.empty(0)

    def _predict(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        clean = pc.replace_substring_regex(pc.utf8_lower(pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])), NOT_LETTERS, " ")
        sizes, at, words = split_words(clean, lower=False)
        names, sure = [UNKNOWN] * len(sizes), np.zeros(len(sizes))
        if not self.langs or not len(at):
            return names, sure
        sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.rows(words)[at], axis=0)))
        ends = np.cumsum(sizes)
        mean = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)[:, None]
        best = mean.argmax(1)  # ties: the first language in alphabetical order
        share = np.exp(mean - mean.max(1, keepdims=True))
        share = share.max(1) / share.sum(1)
        for i in np.flatnonzero(sizes):
            names[i], sure[i] = self.langs[best[i]], share[i]
        return names, sure


def _tables(counts: pd.DataFrame, langs: list[str], kinds: int) -> dict:
    """Log frequency of each key in each language, with half a count added everywhere."""
    rows, at = {}, {lang: i for i, lang in enumerate(langs)}
    totals = np.zeros(len(langs))
    for key, lang, n in counts.itertuples(index=False):
        rows.setdefault(key, np.zeros(len(langs)))[at[lang]] += n
        totals[at[lang]] += n
    return {k: np.log((v + 0.5) / (totals + 0.5 * (kinds + 1))) for k, v in rows.items()}


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learns from ``docs`` (doc_id, text, lang); null languages teach nothing.

    About ``sample_docs`` documents of each language are taken by a hash of the id, and the most
    frequent ``words`` words and ``grams`` n-grams of each length and language are kept: these are
    the model's documented bounds, so it stays small however large the corpus is."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the model has a column for each
    if not sizes:
        return Model([], {}, {})
    rate = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample_docs / n))])[F.col("lang")]
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    tokens = drawn.select("lang", F.explode(letters(F.col("text"))).alias("key")).filter("key <> ''").groupBy("lang", "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    rows = tokens.withColumn("place", place).filter(F.col("place") <= words).select("lang", "key", "n").toPandas()
    langs = sorted(rows["lang"].unique())
    top = rows.sort_values(["lang", "n", "key"], ascending=[True, False, True])
    pieces: dict = {}
    for lang, key, n in top.itertuples(index=False):
        word = f"_{key}_"
        for size in range(1, LONGEST + 1):
            for i in range(len(word) - size + 1):
                at = (size, lang, word[i:i + size])
                pieces[at] = pieces.get(at, 0) + n
    cut = pd.DataFrame([(s, lang, g, n) for (s, lang, g), n in pieces.items()], columns=["size", "lang", "key", "n"])
    table: dict = {}
    for _, part in cut.sort_values(["size", "lang", "n", "key"], ascending=[True, True, False, True]).groupby("size"):
        part = part.groupby("lang").head(grams)
        table |= _tables(part[["key", "lang", "n"]], langs, part["key"].nunique())
    return Model(langs, _tables(top[["key", "lang", "n"]], langs, top["key"].nunique()), table)


def predictor(model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, sure = model.predict(pa.Array.from_pandas(texts, type=pa.large_string()))
        return pd.DataFrame({"lang_pred": names, "score": sure})

    return predict


def identify(docs: DataFrame, teach: Column | None = None, **bounds) -> DataFrame:
    """``docs`` with lang_pred and score (the winner's share, 0 to 1) from the whole text alone.

    Learns from the rows where ``teach`` holds and lang is not null. Texts that are null or have
    no letter get ``und`` and 0, and so does every text when nothing could be learned. Columns of
    ``docs`` called lang_pred or score come back as lang_pred_ and score_."""
    model = train(docs if teach is None else docs.filter(teach), **bounds)
    free = aside(docs, ["lang_pred", "score"])
    said = free.select(F.struct(*free.columns).alias("row"), predictor(model)("text").alias("said"))
    return said.select("row.*", "said.lang_pred", "said.score")
