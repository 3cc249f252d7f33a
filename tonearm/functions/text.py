"""Words, tags and keyword scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no tags, and the signs that separate words.
STOPWORDS = (
    "the a an of in on is it at to for and with by from or as but be was are this that not no has had will can all "
    "his her its who one two been more some any my your our their new just than if so up out when what which how do "
    "does did i you he she we they me him us them also only very then now into over after before between about other "
    "each these those"
).split()
DELIMITERS = r"""[_\-\s.,;:!?()\[\]{}"'/\\|&]+"""
# Weights of a query word among tags, album title, creator and track title.
TAG, ALBUM, CREATOR, TRACK = 0.40, 0.35, 0.15, 0.10
# Error texts worth another try.
TRANSIENT = ("stream:", "rate limit:", "clap:", "timeout", "connection refused", "connection reset", "i/o timeout",
             "no such host", "eof", "503", "429", "502", "500", "504")


def _useful(w: Column) -> Column:
    """Over two bytes long and no stop word."""
    return (F.octet_length(w) > 2) & ~w.isin(STOPWORDS)


def extract_words(text: Column) -> Column:
    """Lower-cased words of a text; those that recur stay."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), DELIMITERS), _useful)


def generate_tags(*texts: Column) -> Column:
    """The distinct words of all texts in order, joined by ``", "``."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(extract_words(t) for t in texts)))), ", ")


def split_keywords(keywords: Column) -> Column:
    """A comma list as trimmed lower-case words."""
    parts = F.transform(F.split(F.lower(F.coalesce(keywords, F.lit(""))), ","), lambda k: F.trim(k))
    return F.filter(parts, lambda k: k != "")


def tag_words(tags: Column) -> Column:
    """Whole tags of a ``", "`` list; a tag of several words stays one."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(tags, F.lit(""))), ", "), lambda k: F.trim(k)), _useful)


def pill_score(query: Column, title: Column, tags: Column, album: Column, creator: Column) -> Column:
    """Mean over the query's words of the weights of the fields that hold each; 0 without words."""
    weights = {"tags": TAG, "album": ALBUM, "creator": CREATOR, "title": TRACK}
    bound = F.struct(
        extract_words(query).alias("words"), tag_words(tags).alias("tags"), extract_words(album).alias("album"),
        extract_words(creator).alias("creator"), extract_words(title).alias("title"),
    )

    def score(b: Column) -> Column:
        def weigh(total, word):
            for field, weight in weights.items():
                total = total + F.when(F.array_contains(b[field], word), F.lit(weight)).otherwise(F.lit(0.0))
            return total

        return F.when(F.size(b["words"]) == 0, F.lit(0.0)).otherwise(F.aggregate(b["words"], F.lit(0.0), weigh) / F.size(b["words"]))

    return F.get(F.transform(F.array(bound), score), F.lit(0))  # words are taken once a row


def is_transient_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    hit = F.lit(False)
    for p in TRANSIENT:
        hit = hit | F.contains(low, F.lit(p))
    return ~F.contains(low, F.lit("401")) & ~F.contains(low, F.lit("403")) & hit
