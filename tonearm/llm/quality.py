"""Quality rules: a threshold table compiled into one Spark projection.

Null, empty and blank texts have no words, so they fail the base rule ``n_words < 50`` and are not kept. Rows are
judged one by one: repeated rows and ties get equal verdicts, an empty table gives an empty result, and columns
besides the id and the text are neither read nor able to clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import SPACE, unused, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by at from or an have not you which "
    "der die und das den von zu mit sich des auf ist ein eine dem nicht als auch es "
    "le la les et des en un une du est que qui dans pour pas sur au il elle "
    "el los las y de una por con para se no su al lo como"
).split()

WRITTEN = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})

#: (rule, metric, comparison, bound): a document breaks a rule where metric, comparison and bound hold together.
THRESHOLDS = (
    ("few_words", "n_words", "<", 50.0),
    ("repeated_words", "repeat_ratio", ">", 0.5),
    ("symbol_ratio", "symbol_ratio", ">", 0.1),
    ("short_words", "mean_word_length", "<", 2.0),
    ("long_words", "mean_word_length", ">", 16.0),
    ("stop_words", "stop_ratio", "<", 0.01),
    ("duplicate_lines", "dup_line_ratio", ">", 0.3),
    ("marked_words", "bang_ratio", ">", 0.3),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the same text.

    Windows are sorted by their 64-bit hash together with their place, so equal neighbours are repeats: n log n work.
    """
    n = F.size(words)
    hashed = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return hashed


def _covered(hashed: Column) -> Column:
    order = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                    | ((j > 0) & F.coalesce(F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
                    x["i"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("e")),
            lambda a, p: F.struct(
                (a["t"] + p + 3 - F.greatest(p, a["e"])).cast("long").alias("t"), (p + 3).alias("e")
            ),
            lambda a: a["t"],
        )

    # one-element transform binds the sorted array once
    return F.get(F.transform(F.array(order), places), F.lit(0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Metrics, broken rules and verdict of every document: one projection, no shuffle, no user function."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = base.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )
    d = d.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("hashed"),
        F.size(F.filter("words", lambda w: w.isin(WRITTEN))).cast("long").alias("n_stop_words"),
    ).drop("words", "lines")
    d = d.select(
        "*",
        F.when(F.size(F.array_distinct("hashed")) == F.size("hashed"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("hashed")))
        .alias("n_repeat_words"),
    ).drop("hashed")
    n = F.greatest(F.col("n_words"), F.lit(1))
    d = d.select(
        "*",
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_bangs") / n).alias("bang_ratio"),
        (F.col("n_stop_words") / n).alias("stop_ratio"),
        (F.col("word_chars") / n).alias("mean_word_length"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    broken = F.array_compact(
        F.array(
            *(
                F.when(F.col(metric) < bound if op == "<" else F.col(metric) > bound, F.lit(name))
                for name, metric, op, bound in thresholds
            )
        )
    )
    d = d.select("*", broken.alias("broken_rules"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"),
        "broken_rules", "repeat_ratio", "symbol_ratio", "bang_ratio", "stop_ratio", "mean_word_length", "dup_line_ratio",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in the same pass over the data."""
    mark = unused(docs, "quality_row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col(text_col).alias("text"))
    verdict = quality(whole).select(F.col("doc_id").alias(mark), "kept", F.monotonically_increasing_id().alias("place"))
    # the row's place keeps the filter above the projection: below it, the whole rule would be evaluated again for
    # each part of it, and the words for every word
    return verdict.where("kept and place >= 0").select(f"{mark}.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BREAKS = " or ".join(f"{metric} {op} {bound}" for _, metric, op, bound in THRESHOLDS)
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select doc_id, unnest(generate_series(1, len(ws) - 2)) as i, unnest(list_transform(generate_series(1, len(ws) - 2), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) as x from w),
h as (select doc_id, i, count(*) over (partition by doc_id, x) as n from g),
r as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from h where n > 1) group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) as bigint) as n_symbols, length(t) - length(replace(t, '!', '')) as bangs,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
        len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in WRITTEN)}], x))) as stops from w left join r on r.doc_id = w.doc_id),
k as (select *, n_repeat_words::double / greatest(n_words, 1) as repeat_ratio, n_symbols::double / greatest(n_words, 1) as symbol_ratio, bangs::double / greatest(n_words, 1) as bang_ratio,
        stops::double / greatest(n_words, 1) as stop_ratio, word_chars::double / greatest(n_words, 1) as mean_word_length, n_dup_lines::double / greatest(n_lines, 1) as dup_line_ratio,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({_BREAKS}) as kept from k
"""
