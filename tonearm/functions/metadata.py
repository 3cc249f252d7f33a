"""Rules on item metadata and files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CC = r"^https?://creativecommons\.org"
#: Longest audio file that is taken, in seconds.
MAX_SECONDS = 1920
COMMERCIAL = ("pd", "cc0", "cc-by", "cc-by-sa")
# Subjects and titles of what is no music.
NON_MUSIC_SUBJECTS = ("non-music", "audiobook", "spoken word")
NON_MUSIC_TITLES = ("language course", "learn spanish", "learn french", "learn german", "learn mandarin", "learn italian",
                    "learn russian", "learn japanese", "language instruction", "listen & learn")
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def classify_license(url: Column) -> Column:
    """License class of a URL; hosts other than the bare one fall to ``other``."""
    u = F.lower(F.coalesce(url, F.lit("")))
    known = u.rlike(rf"{_CC}/licenses/(by|by-sa|by-nc|by-nd|by-nc-sa|by-nc-nd)/")
    kind = F.when(u == "", "unknown")
    kind = kind.when(u.rlike(rf"{_CC}/publicdomain/(zero|mark)/"), "pd")
    kind = kind.when(u.rlike(rf"{_CC}/licenses/zero/") | F.contains(u, F.lit("/cc0/")) | F.endswith(u, F.lit("/cc0")), "cc0")
    kind = kind.when(u.rlike("publicdomain|public_domain|pdmark|cc-pdm"), "pd")
    for part in ("by-nc-nd", "by-nc-sa", "by-nd", "by-nc", "by-sa", "by"):
        kind = kind.when(known & F.contains(u, F.lit(f"/{part}/")), f"cc-{part}")
    return kind.otherwise("other")


def commercially_usable(url: Column) -> Column:
    return classify_license(url).isin(*COMMERCIAL)


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double")


def parse_duration(text: Column) -> Column:
    """Seconds of ``s``, ``m:s`` or ``h:m:s``; 0 where unreadable."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.split(t, ":")
    n = F.transform(parts, leading_number)
    total = (
        F.when(F.size(parts) == 2, n[0] * 60 + n[1])
        .when(F.size(parts) == 3, n[0] * 3600 + n[1] * 60 + F.get(n, F.lit(2)))
        .otherwise(leading_number(t))
    )
    return F.coalesce(total, F.lit(0.0))


def parse_bitrate(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def parse_track_number(text: Column) -> Column:
    """The number before a slash, without leading zeros; 0 where it is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    head = F.when(F.instr(t, "/") > 1, F.substring_index(t, "/", 1)).otherwise(t)
    bare = F.ltrim(head, F.lit("0"))
    return F.when(bare.rlike(r"^[+-]?\d+$"), F.coalesce(bare.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def derive_title(filename: Column) -> Column:
    """A title from a file name: no extension, no leading number, words apart and capitalised."""
    stem = F.regexp_replace(filename, r"\.[^./]*$", "")
    name = F.regexp_replace(stem, r"^(?:\d{1,3}[\s._\-]+(?:-\s*)?|[Tt]rack\s*\d+[\s._\-]+)", "")
    name = F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))
    return F.initcap(F.when(name == "", stem).otherwise(name))


def is_acceptable_mp3(format_: Column, bitrate: Column) -> Column:
    rate = parse_bitrate(bitrate)
    return (
        F.when(format_.isin("64Kbps MP3", "128Kbps MP3"), False)
        .when(format_ == "VBR MP3", True)
        .otherwise(F.contains(F.coalesce(format_, F.lit("")), F.lit("MP3")) & ((rate <= 0) | (rate >= 192)))
    )


def path_escaped(name: Column) -> Column:
    """Percent-encoding of one path segment, which leaves ``$&+=:@~`` as they are."""
    out = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    for code, sign in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def download_url(identifier: Column, filename: Column) -> Column:
    return F.concat(F.lit("https://archive.org/download/"), identifier, F.lit("/"), path_escaped(filename))


def art_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://archive.org/services/img/"), identifier)


def flex_to_array(item: Column, path: str) -> Column:
    """A field of a VARIANT that is a string or an array of strings, as an array."""
    many = F.try_variant_get(item, path, "array<string>")
    return F.array_compact(F.coalesce(many, F.array(F.try_variant_get(item, path, "string"))))


def flex_to_string(item: Column, path: str) -> Column:
    return F.array_join(flex_to_array(item, path), ", ")


def flex_bool(item: Column, path: str) -> Column:
    """A field that is ``true`` or the string of it."""
    return F.coalesce(F.try_variant_get(item, path, "string") == "true", F.lit(False))


def music_reason(subjects: Column, genres: Column, mediatype: Column, title: Column, description: Column, creator: Column) -> Column:
    """Why an item is no music: the first reason in a fixed order, or null."""

    def first(values: Column, what: str) -> Column:
        hit = F.get(F.filter(values, lambda s: F.lower(s).rlike("|".join(NON_MUSIC_SUBJECTS))), F.lit(0))
        return F.when(hit.isNotNull(), F.concat(F.lit(f'non-music {what}: "'), hit, F.lit('"')))

    def pattern(text: Column, what: str):
        return [F.when(F.contains(F.lower(text), F.lit(p)), F.lit(f'non-music {what} pattern: "{p}"')) for p in NON_MUSIC_TITLES]

    return F.coalesce(
        first(subjects, "subject"), first(genres, "genre"),
        F.when(mediatype.isin("texts", "movies", "data"), F.concat(F.lit("non-audio mediatype: "), mediatype)),
        *pattern(title, "title"), *pattern(description, "description"),
        F.when(F.contains(F.lower(creator), F.lit("librivox")), F.lit("librivox creator")),
    )
