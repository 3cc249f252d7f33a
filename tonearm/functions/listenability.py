"""Listenability of tracks and albums as column expressions: components, reasons, tier, stream, decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "listenability-v2"
SHORT, TARGET, PREFERRED, LONGFORM = 60, 90, 1800, 2700
INCLUDE, HARD_EXCLUDE = 0.50, 0.25
WEIGHTS = {"duration": 0.30, "album_shape": 0.25, "content_type": 0.25, "technical_quality": 0.15, "metadata_hygiene": 0.05}
# Terms looked for in titles and metadata.
CHANNELS = ("ch 1", "ch 2", "ch 3", "ch 4", "ch 5", "channel 1", "channel 2", "track 1", "track 2")
NON_MUSIC = ("audiobook", "spoken word", "language instruction", "sound effects", "sound effect", "sfx", "test tones",
             "test tone", "silence", "noise")
SEMI_NON_MUSIC = ("field recording", "environmental sound", "applause", "crowd noise")
STORY = ("story", "stories", "tale", "tales", "fable", "fables")
POSITIVE_PROMPTS = ("a complete music track", "a full song with melody and rhythm", "an instrumental music performance",
                    "a recorded musical performance")
NEGATIVE_PROMPTS = ("a short sound effect", "spoken word audiobook narration", "language lesson speech sound",
                    "applause and crowd noise", "silence or test tone", "isolated drum hit sound",
                    "multitrack channel stem")


def _text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def _any(text: Column, terms) -> Column:
    """One search for any of the terms, which hold no special signs."""
    return text.rlike("|".join(terms))


def round4(x: Column) -> Column:
    return F.round(x * 10000, 0) / 10000


def duration_score(s: Column) -> Column:
    return (
        F.when(s < SHORT, 0.0)
        .when(s < TARGET, 0.65 + (s - SHORT) / (TARGET - SHORT) * 0.25)
        .when(s <= PREFERRED, 1.0)
        .when(s <= LONGFORM, 0.75 - (s - PREFERRED) / (LONGFORM - PREFERRED) * 0.75)
        .otherwise(0.0)
    )


def album_avg_duration_score(a: Column) -> Column:
    return (
        F.when(a <= 0, 0.0)
        .when(a < 30, 0.1)
        .when(a < 60, 0.1 + (a - 30) / 30 * 0.2)
        .when(a <= TARGET, 0.3 + (a - 60) / (TARGET - 60) * 0.4)
        .when(a <= PREFERRED, 0.7 + (a - TARGET) / (PREFERRED - TARGET) * 0.3)
        .otherwise(1.0)
    )


def album_shape_score(n: Column, avg: Column, short60: Column) -> Column:
    return F.when(n > 0, F.greatest(F.lit(0.0), album_avg_duration_score(avg) * (1 - short60))).otherwise(0.0)


def title_patterns(title: Column, filename: Column) -> Column:
    def found(t: Column) -> Column:
        has = lambda w: F.contains(t, F.lit(w))
        return F.array_compact(
            F.array(
                F.when(_any(t, CHANNELS), "channel_dump_title_pattern"),
                F.when(has("test tone") | has("testtone"), "test_tone_pattern"),
                F.when(has("sine") & has("hz"), "sine_wave_pattern"),
                F.when(has("silence"), "silence_pattern"),
                F.when(has("noise") & ~has("noisy"), "noise_pattern"),
            )
        )

    return F.get(F.transform(F.array(_text(title, filename)), found), F.lit(0))  # the text is made once


def non_music(title: Column, creator: Column, subjects: Column, genres: Column) -> Column:
    return _any(_text(title, creator, subjects, genres), NON_MUSIC)


def semi_non_music(title: Column, creator: Column, subjects: Column, genres: Column) -> Column:
    return _any(_text(title, creator, subjects, genres), SEMI_NON_MUSIC)


def story(title: Column, creator: Column, subjects: Column, genres: Column) -> Column:
    """Two of the terms at least; one that holds another counts with it."""
    t = _text(title, creator, subjects, genres)
    many = sum((F.contains(t, F.lit(w)).cast("int") for w in STORY), F.lit(0)) >= 2
    return F.when(_any(t, STORY), many).otherwise(False)


def metadata_hygiene(title: Column, filename: Column, tags: Column, bitrate: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    cost = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    total = (
        F.lit(1.0) - cost(empty(title), 0.15) - cost(empty(filename), 0.1) - cost(empty(tags), 0.05)
        - cost((bitrate > 0) & (bitrate < 64), 0.1) - cost((bitrate > 0) & (bitrate < 32), 0.15)
        - cost(F.contains(F.lower(title), F.lit("untitled")), 0.1)
    )
    return F.greatest(F.lit(0.0), total)


def content_score(positive: Column, negative: Column, margin: Column, bad: Column, semi: Column, patterns: Column) -> Column:
    """From the prompt margin; where both similarities are zero or absent, from the metadata."""
    plain = 0.5 - F.when(bad, F.lit(0.3)).otherwise(0.0) - F.when(semi, F.lit(0.15)).otherwise(0.0) - 0.2 * F.size(patterns)
    prompt = F.when(margin > 0, 0.5 + F.least(F.lit(0.5), margin * 1.5)).otherwise(0.5 - F.least(F.lit(0.5), -margin * 1.5))
    absent = (F.coalesce(positive, F.lit(0.0)) == 0) & (F.coalesce(negative, F.lit(0.0)) == 0)
    return F.when(absent, F.greatest(F.lit(0.0), plain)).otherwise(prompt)


def tier(score: Column) -> Column:
    return (
        F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score >= 0.50, "borderline")
        .when(score >= 0.25, "poor").otherwise("unusable")
    )


def quality_tier(q: Column) -> Column:
    return F.when(q > 0.7, "high_fidelity").when(q >= 0.3, "historical_vintage").otherwise("unusable")


def composite_quality(snr: Column, centroid: Column, crest: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    mix = 0.5 * unit(snr / 40) + 0.3 * unit(centroid / 8000) + 0.2 * unit((crest - 1) / 9)
    return F.when(snr < 10, 0.0).otherwise(unit(mix))


def stream_and_decision(stream: Column, decision: Column) -> Column:
    return F.struct(stream.alias("stream"), decision.alias("decision"))


def by_score(score: Column) -> Column:
    """The stream and decision that a score alone gives."""
    verdict = lambda s, d: stream_and_decision(F.lit(s), F.lit(d))
    return (
        F.when(score >= INCLUDE, verdict("default", "include"))
        .when(score >= HARD_EXCLUDE, verdict("default", "demote"))
        .otherwise(verdict("excluded", "exclude"))
    )


def track_verdict(seconds: Column, score: Column, bad: Column, tells: Column) -> Column:
    out, demoted = (stream_and_decision(F.lit(s), F.lit(d)) for s, d in (("excluded", "exclude"), ("longform_candidate", "demote")))
    return (
        F.when((seconds < SHORT) | (seconds > LONGFORM), out)
        .when((seconds > PREFERRED) & (score >= HARD_EXCLUDE), demoted)
        .when((seconds > PREFERRED) | bad | tells, out)
        .otherwise(by_score(score))
    )
