"""Language, keyword and theme expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlops.functions.text import col, let, strip

# Words that point to a language, in order of preference on ties.
LANGUAGE_WORDS = {
    "fr": ["le", "la", "les", "et", "ou", "avec", "dans", "pour"],
    "en": ["the", "and", "or", "with", "in", "for", "this", "that"],
    "es": ["el", "la", "los", "las", "y", "o", "con", "en"],
    "de": ["der", "die", "das", "und", "oder", "mit", "in", "für"],
}
# Markers used when no configuration is given.
DEFAULT_MARKERS = {
    "fr": ["le ", "la ", "les ", "et ", "ou ", "avec ", "dans ", "pour ", "sur ", "par "],
    "en": ["the ", "and ", "or ", "with ", "in ", "for ", "on ", "at ", "by ", "this "],
    "es": ["el ", "la ", "los ", "las ", "y ", "o ", "con ", "en ", "para ", "por "],
    "de": ["der ", "die ", "das ", "und ", "oder ", "mit ", "in ", "für ", "von ", "zu "],
    "it": ["il ", "la ", "lo ", "gli ", "le ", "e ", "o ", "con ", "in ", "per "],
}
# Theme weights.
SPECIALISATION_WEIGHT = 1.5
QUALITY_BONUS = 1.2
EXCLUSION_PENALTY = -2.0


def _first_best(scores: dict[str, Column]) -> Column:
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best <= 0, F.lit(None).cast("string"))
    for lang, score in scores.items():
        out = out.when(score == best, lang)
    return out


def lang_spider(text: Column | str) -> Column:
    """Language with the most indicator words present between spaces."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    return _first_best(
        {
            lang: sum((lower.contains(f" {w} ").cast("int") for w in words), F.lit(0))
            for lang, words in LANGUAGE_WORDS.items()
        }
    )


def marker_count(lower: Column, marker: str) -> Column:
    """Occurrences of the marker that do not overlap; a text without it is not copied."""
    gone = F.octet_length(lower) - F.octet_length(F.replace(lower, F.lit(marker), F.lit("")))
    return F.when(lower.contains(marker), (gone / len(marker.encode())).cast("int")).otherwise(0)


def lang_markers(text: Column | str, markers: dict[str, list[str]] | None = None) -> Column:
    """Language whose configured markers occur most often."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    return _first_best(
        {
            lang: sum((marker_count(lower, m.lower()) for m in words), F.lit(0))
            for lang, words in (markers or DEFAULT_MARKERS).items()
        }
    )


def lang_supported(c: Column | str, markers: dict[str, list[str]] | None = None) -> Column:
    return F.coalesce(col(c).isin(*(markers or DEFAULT_MARKERS)), F.lit(False))


def keywords(c: Column | str) -> Column:
    """Keywords of a JSON array or a separated list: trimmed, folded, two characters or more."""
    c = col(c)
    as_json = F.from_json(c, "array<variant>")
    texts = F.transform(
        F.filter(as_json, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")
    )
    parts = F.when(c.startswith("["), texts).otherwise(F.split(strip(c), "[,;\n]+"))
    folded = F.transform(parts, lambda w: F.lower(strip(w)))
    return F.coalesce(F.filter(folded, lambda w: F.length(w) > 1), F.array().cast("array<string>"))


def keywords_form(c: Column | str) -> Column:
    """Separated list as typed into the job form: trimmed, empty parts dropped."""
    parts = F.transform(F.split(strip(c), "[,;\n]+"), strip)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def found_words(text: Column | str, words: Column | str) -> Column:
    """The words, in small letters, that a text contains."""
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: F.filter(col(words), lambda w: F.contains(t, w)))


def keyword_match(text: Column | str, words: Column | str, mode: Column | str, least: Column | str) -> Column:
    """Struct (found_keywords, match_count, matches) for the modes any, multiple and all."""
    return keyword_gate(found_words(text, words), words, mode, least)


def keyword_gate(found: Column, words: Column | str, mode: Column | str, least: Column | str) -> Column:
    """``keyword_match`` from the words that were found."""
    words, mode, least = col(words), col(mode), col(least)

    def decide(hits: Column) -> Column:
        n = F.size(hits)
        ok = (
            F.when(mode == "any", n >= 1)
            .when(mode == "multiple", n >= least)
            .when(mode == "all", n == F.size(words))
            .otherwise(False)
        )
        return F.struct(
            hits.alias("found_keywords"), n.alias("match_count"), (F.coalesce(ok, F.lit(False)) & (F.size(words) > 0)).alias("matches")
        )

    return let(found, decide)


def theme_hits(text: Column | str, themes: dict[str, dict[str, list[str]]]) -> Column:
    """Array of (lang, theme, hits) over the configured theme words."""
    groups = F.array(
        *[
            F.struct(
                F.lit(lang).alias("lang"), F.lit(theme).alias("theme"),
                F.array(*[F.lit(w.lower()) for w in words]).alias("words"),
            )
            for lang, by_theme in themes.items()
            for theme, words in by_theme.items()
        ]
    )
    return let(
        F.lower(F.coalesce(col(text), F.lit(""))),
        lambda t: F.transform(
            groups,
            lambda g: F.struct(
                g.lang.alias("lang"), g.theme.alias("theme"),
                F.size(F.filter(g.words, lambda w: F.contains(t, w))).alias("hits"),
            ),
        ),
    )


def weighted_score(text: Column | str, special: list[str], quality: list[str], excluded: list[str]) -> Column:
    """Weighted number of specialisation, quality and exclusion words present."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))

    def present(words: list[str]) -> Column:
        return sum((lower.contains(w.lower()).cast("int") for w in words), F.lit(0))

    return (
        present(special) * F.lit(SPECIALISATION_WEIGHT)
        + present(quality) * F.lit(QUALITY_BONUS)
        + present(excluded) * F.lit(EXCLUSION_PENALTY)
    )
