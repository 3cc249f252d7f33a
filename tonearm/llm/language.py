"""Language ID with hyperdimensional profiles.

Every letter has a random +-1 vector. A 3-gram binds its letters' vectors, each shifted by its place, by multiplying
them; a text bundles (adds) its 3-grams; a language's prototype bundles the texts of that language; a text gets the
language whose prototype has the largest cosine with it.

Null texts and texts without a letter (of Unicode category L) get ``und`` with score 0, as do all where nothing could be learned. Equal
cosines go to the first language by name. Rows with a null id or language are predicted but do not teach. Whole texts
count, in bounded slices; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import map_columns

DIMENSIONS = 512
SEED = 20_260
#: Symbols of the alphabet: 0 is any run of other than letters, 1-26 are a-z, other letters share the rest by code point.
SYMBOLS = 64


def _symbol_table() -> np.ndarray:
    """Code point (up to U+FFFF, others fold into it) -> symbol, by lower case."""
    table = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """(place, symbol, dimension): a random vector for each symbol, rolled once for each place in a 3-gram."""
    first = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
    return np.stack([np.roll(first, p, axis=1) for p in (2, 1, 0)])


def _grams(text: str, table: np.ndarray) -> np.ndarray:
    """3-grams of symbols as numbers, with one edge symbol before and after the text; runs of non-letters are one."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[cps & 0xFFFF]
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def _count_grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3-grams of some texts, and how often each text has each."""
    parts = [_grams(t, table) for t in texts]
    joined = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    here = np.flatnonzero(np.bincount(joined, minlength=1))
    place = np.zeros(SYMBOLS**3, np.int64)
    place[here] = np.arange(len(here))
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    counts = np.bincount(owner * max(1, len(here)) + place[joined], minlength=len(parts) * len(here))
    return here, counts.reshape(len(parts), len(here)).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _bind(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return letters[0][grams // SYMBOLS**2] * letters[1][grams // SYMBOLS % SYMBOLS] * letters[2][grams % SYMBOLS]


def _bundle(counts: np.ndarray, grams: np.ndarray, letters: np.ndarray, most: int = 8192) -> np.ndarray:
    """Sums of the bound vectors of 3-grams, each times its count; ``most`` of them are bound at once."""
    out = np.zeros((*counts.shape[:-1], letters.shape[2]), np.float64)
    for i in range(0, len(grams), most):
        out += counts[..., i : i + most] @ _bind(grams[i : i + most], letters)
    return out


def _slices(texts: list[str], most: int = 64):
    """Runs of texts whose count tables stay small."""
    for i in range(0, len(texts), most):
        yield texts[i : i + most]


def prototypes(docs: DataFrame, id_col: str, text_col: str, lang_col: str, teaches: Column) -> dict[str, np.ndarray]:
    """A vector for each language: tasks bundle what they read, Spark adds up one row a language and task."""
    table, letters = _symbol_table(), letter_vectors()

    def run(batches):
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                for texts in _slices(part["text"].tolist()):
                    grams, counts = _count_grams([t for t in texts if has_letter(t)], table)
                    if len(grams):
                        sums[lang] = sums.get(lang, 0) + _bundle(counts.sum(axis=0, dtype=np.float64), grams, letters)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "d": np.arange(len(v)), "x": np.asarray(v, np.float64)})

    taught = docs.where(teaches).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = (
        taught.where("lang is not null and text is not null")
        .mapInPandas(run, "lang string, d int, x double")
        .groupBy("lang", "d")
        .agg(F.sum("x").alias("x"))
    )
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():  # languages x DIMENSIONS numbers
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["x"]
    return {lang: v / max(np.linalg.norm(v), 1e-12) for lang, v in sorted(found.items())}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None) -> DataFrame:
    """Learn from the rows that are not held out, then label every row. Two passes, one tiny shuffle."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True)) if held_out is None else held_out
    learned = prototypes(docs, id_col, text_col, lang_col, ~held)
    names = list(learned)
    matrix = np.array([learned[n] for n in names]).reshape(-1, DIMENSIONS)
    table, letters = _symbol_table(), letter_vectors()

    def run(ids, held, texts):
        langs, scores = [], []
        for part in _slices([t or "" for t in texts]):
            grams, counts = _count_grams(part, table)
            v = _bundle(counts, grams, letters)
            cosine = v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            for t, c in zip(part, cosine, strict=True):
                sure = bool(names) and has_letter(t)
                langs.append(names[int(np.argmax(c))] if sure else "und")
                scores.append(float(min(1.0, max(0.0, c.max()))) if sure else 0.0)
        return [ids, held, langs, scores]

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return map_columns(plain, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
