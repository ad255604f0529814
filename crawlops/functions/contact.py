"""Expressions that find and judge contact data in text."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlops.functions.text import col, let, strip

# Patterns for addresses, numbers, names and organisations.
EMAIL_VALID = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_SUSPICIOUS = r"noreply|no-reply|donotreply|test|example|admin@admin|user@user|contact@localhost"
EMAIL_IN_PAGE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_ANYWHERE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_IN_PAGE = r"\+?[\d\s().-]{8,20}"
PHONE_INTERNATIONAL = r"\+\d[\d\s().-]{5,}"
NAME_PATTERNS = [
    r"(?i)(?:M\.|Mme|Mr\.|Mrs\.|Dr\.|Prof\.)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?i)([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s*[-,]\s*(?:avocat|lawyer|doctor|consultant))",
    r"(?i)Contact:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
]
ORG_PATTERNS = [
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z&][a-z]*)*\s+(?:Cabinet|Law Firm|Clinic|Consulting))",
    r"(?i)((?:[A-Z][a-z]+\s*){1,3}(?:SARL|SAS|SA|LLC|Inc\.|Ltd\.))",
]
# Words that never belong to a name.
STOP_WORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "among", "le", "la", "les", "et", "ou", "mais", "dans", "sur", "avec", "par", "pour", "de", "du", "des",
]
NAME_IN_TEXT = r"\b([A-Z][a-z]{2,})\s+([A-Z][a-z]{2,})\b"


def unicode(pattern: str) -> str:
    """Word boundaries, spaces and digits of all scripts."""
    return "(?U)" + pattern


def email_valid(c: Column | str) -> Column:
    """Well-formed address that is not one of the usual placeholders."""
    c = col(c)
    return F.coalesce(strip(c).rlike(EMAIL_VALID) & ~F.lower(c).rlike(EMAIL_SUSPICIOUS), F.lit(False))


def email_domain(c: Column | str) -> Column:
    return F.lower(F.split_part(col(c), F.lit("@"), F.lit(2)))


def name_from_email(c: Column | str) -> Column:
    """Words of the part before the @, at least two, without digits and one-letter words."""
    c = col(c)
    words = F.regexp_replace(F.split_part(c, F.lit("@"), F.lit(1)), "[._+-]+", " ")
    words = F.trim(F.regexp_replace(words, "[0-9]+", ""))
    letters = F.replace(words, F.lit(" "), F.lit(""))
    name = F.array_join(
        F.transform(F.filter(F.split(words, " +"), lambda w: F.length(w) > 1), lambda w: F.initcap(w)), " "
    )
    ok = c.contains("@") & (F.length(words) >= 2) & letters.rlike("^\\p{L}+$") & (F.length(name) >= 3) & name.contains(" ")
    return F.when(ok, name)


def _addresses(c: Column, pattern: str) -> Column:
    """Distinct matches in order; most texts have no @ and are not searched."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.when(c.contains("@"), found).when(c.isNotNull(), F.array().cast("array<string>"))


def emails(c: Column | str) -> Column:
    """Distinct addresses of a page, in page order."""
    return _addresses(col(c), unicode(EMAIL_IN_PAGE))


def emails_util(c: Column | str) -> Column:
    return _addresses(F.coalesce(col(c), F.lit("")), EMAIL_ANYWHERE)


def phones(c: Column | str) -> Column:
    """Distinct phone-like runs with 8 to 15 digits, in page order."""
    runs = F.transform(F.regexp_extract_all(col(c), F.lit(unicode(PHONE_IN_PAGE)), F.lit(0)), strip)
    return F.array_distinct(
        F.filter(runs, lambda p: F.length(F.regexp_replace(p, "[^\\p{Nd}]", "")).between(8, 15))
    )


def phones_util(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(unicode(PHONE_INTERNATIONAL)), F.lit(0)))


def name_guess(c: Column | str) -> Column:
    """First two capitalised words in a row."""
    c = col(c)
    first, second = F.regexp_extract(c, unicode(NAME_IN_TEXT), 1), F.regexp_extract(c, unicode(NAME_IN_TEXT), 2)
    return F.when(first != "", F.concat_ws(" ", first, second))


def name_valid(c: Column | str) -> Column:
    """At least three characters, no stop word, no digit."""
    c = col(c)
    words = F.split(F.lower(c), "(?U)\\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.coalesce((F.length(c) >= 3) & ~F.arrays_overlap(words, stop) & ~c.rlike("(?U)\\d"), F.lit(False))


def around(needle: Column, text: Column, text_lower: Column, radius: int) -> Column:
    """Text within ``radius`` characters of the first place of the needle; NULL when it is absent."""
    place = F.instr(text_lower, needle)
    return let(
        place,
        lambda p: F.when(
            p > 0,
            F.substr(text, F.greatest(p - radius, F.lit(1)), p + radius - F.greatest(p - radius, F.lit(1))),
        ),
    )


def _first_match(context: Column, patterns: list[str], accept) -> Column:
    found = [strip(F.regexp_extract(context, unicode(p), 1)) for p in patterns]
    return F.coalesce(*[let(f, lambda m: F.when(accept(m), m)) for f in found])


def name_in(context: Column) -> Column:
    return _first_match(context, NAME_PATTERNS, name_valid)


def org_in(context: Column) -> Column:
    return _first_match(context, ORG_PATTERNS, lambda f: F.length(f) > 3)


def name_org_near(email: Column | str, text: Column | str) -> Column:
    """Struct (name, org) found within 200 characters of the address."""
    email, text = col(email), col(text)
    context = around(F.lower(email), text, F.lower(text), 200)
    return let(context, lambda c: F.struct(name_in(c).alias("name"), org_in(c).alias("org")))


def phone_near(email: Column | str, text: Column | str, found: Column | str) -> Column:
    """First of the page's phones that lies within 300 characters of the address."""
    email, text = col(email), col(text)
    context = around(F.lower(email), text, F.lower(text), 300)
    return phone_in(context, col(found))


def phone_in(context: Column, found: Column) -> Column:
    return let(context, lambda c: F.get(F.filter(found, lambda p: F.contains(c, p)), F.lit(0)))


def confidence(found: Column, keywords: Column, email: Column, seed_netloc: Column) -> Column:
    """0.5, plus the keyword share times 0.3, plus 0.2 when mail and seed domain contain one another."""
    domain = F.lower(F.element_at(F.split(email, "@"), -1))
    seed = F.lower(seed_netloc)
    related = F.contains(seed, domain) | F.contains(domain, seed)
    score = F.lit(0.5) + found / F.greatest(keywords, F.lit(1)) * F.lit(0.3)
    score = score + F.when(related, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def contact_hash(email: Column | str, name: Column | str, org: Column | str) -> Column:
    """Identity of a contact: folded e-mail, name and organisation."""
    parts = [F.coalesce(F.lower(strip(c)), F.lit("")) for c in (email, name, org)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


# Words that mark each page type.
CONTACT_WORDS = ["contact", "nous contacter", "contact us", "get in touch", "contactez-nous", "coordonnées"]
TEAM_WORDS = ["équipe", "team", "staff", "notre équipe", "our team", "collaborateurs", "membres"]
ABOUT_WORDS = ["à propos", "about", "about us", "qui sommes nous", "présentation", "notre société"]
PROFESSION_WORDS = [
    "avocat", "lawyer", "médecin", "doctor", "consultant", "expert", "professionnel", "professional", "cabinet", "clinic",
]


def contact_context(c: Column | str) -> Column:
    """Struct of page-type flags with their number and an overall flag."""
    text = F.lower(F.coalesce(col(c), F.lit("")))

    def has(words: list[str]) -> Column:
        return functools.reduce(operator.or_, [text.contains(w) for w in words])

    flags = {
        "contact_page": has(CONTACT_WORDS), "team_page": has(TEAM_WORDS),
        "about_page": has(ABOUT_WORDS), "professional_context": has(PROFESSION_WORDS),
    }
    score = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return F.struct(
        *[f.alias(n) for n, f in flags.items()], score.alias("context_score"), (score > 0).alias("has_contact_context")
    )
