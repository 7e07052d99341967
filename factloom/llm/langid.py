"""Language identification: known words first, then ever shorter character n-grams.

A word known from training scores its log frequency in each language. An unseen word is read as
character n-grams, marked at its ends: at each place the longest known n-gram, from four
characters down to one, scores its log frequency, and the word scores the mean of its places. A
text's score in a language is the sum over its words; the best language is predicted, with the
softmax of the sums as its score.

Training reads about `per_language` documents of each language, chosen by a hash of the id; that
bound is a parameter. Of these documents it reads whole texts and keeps every word and n-gram, so
the model's size is set by that bound. Prediction reads every whole text.

Defined results: a text that is null or has no letters is `und` with score 0; ties go to the
smallest name; with no training rows everything is `und`; repeated rows are predicted each; very long texts are
read whole; no rows give no rows; other columns are left out.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.pretokens import LATIN

SIZES = (4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    if LATIN.fullmatch(text):
        return LETTERS.findall(text.lower())
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies over languages: a row of `rows` for each word and n-gram, and for an unknown character.

    What it has worked out for words is remembered in a worker and not sent along.
    """

    def __init__(self, langs: list[str], counts: list[tuple[int, str, str, int]], totals: dict[tuple[int, str], int]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        total = np.array([[totals.get((k, x), 0) for x in langs] for k in range(5)], float)
        found: list[dict[str, np.ndarray]] = [{} for _ in range(5)]
        for kind, item, lang, n in counts:
            found[kind].setdefault(item, np.zeros(len(langs)))[at[lang]] = n
        rows = [np.log(0.5 / (total[1] + 0.5 * (len(found[1]) + 1)))]
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        for k, items in enumerate(found):
            for item, n in items.items():
                (self.grams if k else self.words)[item] = len(rows)
                rows.append(np.log((n + 0.5) / (total[k] + 0.5 * (len(items) + 1))))
        self.rows = np.array(rows)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def places(self, w: str) -> list[int]:
        """Rows whose mean is the word's score: its own, or the longest known n-gram at each place."""
        known = self.words.get(w)
        if known is not None:
            return [known]
        marked, get, out = f"^{w}$", self.grams.get, []
        for i in range(1, len(marked) - 1):
            for n in SIZES:
                row = get(marked[i : i + n])
                if row is not None:
                    out.append(row)
                    break
            else:
                out.append(0)
        return out

    def learn(self, new: list[str]) -> None:
        """Remembers the scores of new words."""
        parts = [self.places(w) for w in new]
        sizes = np.array([len(p) for p in parts])
        flat = np.fromiter((r for p in parts for r in p), np.int64, sizes.sum())
        means = np.add.reduceat(self.rows[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        while len(self.seen) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[len(self.seen) : len(self.seen) + len(new)] = means
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))

    def totals(self, texts: list[list[str]], most: int) -> list[np.ndarray]:
        """The sums over each text's words (one at least)."""
        if len(self.seen) > most:
            self.forget()
        new = list(set().union(*texts).difference(self.seen))
        if new:
            self.learn(new)
        return [self.table[np.fromiter(map(self.seen.__getitem__, ws), np.int64, len(ws))].sum(axis=0) for ws in texts]


def train(docs: DataFrame, *, per_language: int = 1000, seed: int = 11) -> Model | None:
    """A model from doc_id, text and lang; rows without lang or text take no part."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    many = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not many:
        return None
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in sorted(many.items()):
        wanted = wanted | ((F.col("lang") == lang) & (place < int((1 << 30) * min(1.0, per_language / n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py()))
        for lang, words in seen.items():
            kinds: list[Counter] = [words, *(Counter() for _ in SIZES)]
            for w, n in words.items():
                for size in SIZES:
                    for g in grams_of(w, size):
                        kinds[size][g] += n
            for k, c in enumerate(kinds):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array([lang] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                    names=["kind", "item", "lang", "n"],
                )

    counted = (
        labelled.where(wanted)
        .mapInArrow(count, "kind int, item string, lang string, n long")
        .groupBy("kind", "item", "lang")
        .agg(F.sum("n").alias("n"))
    )
    # What is collected is bounded by the documents of the sample, not by the input.
    rows = [(r["kind"], r["item"], r["lang"], r["n"]) for r in counted.collect()]
    totals: dict[tuple[int, str], int] = {}
    for kind, _, lang, n in rows:
        totals[kind, lang] = totals.get((kind, lang), 0) + n
    return Model(sorted(many), sorted(rows), totals)


def predict(docs: DataFrame, model: Model | None, *, most: int = 600_000) -> DataFrame:
    """doc_id, lang_pred and score for each of docs (doc_id, text); a worker remembers about `most` words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [words_of(t) if m else [] for t in batch.column("text").to_pylist()]
                sums = iter(m.totals([ws for ws in texts if ws], most) if m else [])
                langs, scores = [], []
                for ws in texts:
                    total = next(sums) if ws else None
                    best = None if total is None else int(total.argmax())
                    langs.append("und" if best is None else m.langs[best])
                    scores.append(0.0 if best is None else float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
