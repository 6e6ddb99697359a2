"""Text recipes as Column expressions. None is a UDF."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def code(c: Column | str) -> Column:
    """Upper-case code; blank is null."""
    return F.upper(blank_to_null(c))


def _spaced(c: Column) -> Column:
    """Letters and digits alone, single spaces between."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]", " "), " +", " "))


def norm(c: Column | str) -> Column:
    return _spaced(F.lower(_empty(c)))


def norm_title(c: Column | str) -> Column:
    """As norm, without what stands in parentheses."""
    return _spaced(F.regexp_replace(F.lower(_empty(c)), r"\([^)]*\)", " "))


def canonical_key(company: Column | str, title: Column | str, country: Column | str) -> Column:
    """Key of one role at one company in one country, whatever source tells of it. Nulls are empty, so they do meet."""
    return F.md5(F.concat_ws("|", norm(company), norm_title(title), F.lower(_empty(country))))


#: What the second key drops from titles.
TITLE_NOISE = r"m/?w/?d|m/?f/?d|h/?m/?x|f/?m|all genders|remote|hybrid|fulltime|full[- ]time|part[- ]time|contract|freelance"


def canonical_key_stripped(company: Column | str, title: Column | str, country: Column | str) -> Column:
    """The key that also drops boilerplate from titles; SHA-256, and not comparable with ``canonical_key``."""
    bare = F.regexp_replace(F.lower(_empty(title)), r"\([^)]*\)", " ")
    bare = F.regexp_replace(bare, rf"(?U)\b({TITLE_NOISE})\b", " ")
    return F.sha2(F.concat_ws("\x1f", norm(company), _spaced(bare), F.lower(_empty(country))), 256)


def _unaccent_map() -> tuple[str, str]:
    """Every single character whose canonical decomposition is one base character and marks; marks themselves go."""
    source, target, gone = [], [], []
    for point in range(0xC0, 0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        if unicodedata.category(c).startswith("M"):
            gone.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source + gone), "".join(target)


_ACCENTED, _PLAIN = _unaccent_map()
#: Legal forms and words that say nothing about which company it is.
LEGAL_FORMS = ("[bn][^a-z0-9]*v", "v[^a-z0-9]*o[^a-z0-9]*f", "c[^a-z0-9]*v", "u[^a-z0-9]*a", "b[^a-z0-9]*a", "s[^a-z0-9]*a", "s[^a-z0-9]*r[^a-z0-9]*l")
NOISE_WORDS = (
    "holding", "holdings", "group", "groep", "international", "nederland", "netherlands", "the", "and", "inc", "ltd", "llc", "gmbh", "sa",
    "company", "co", "corp", "corporation", "europe", "global", "bv", "nv", "vof", "cv", "ua", "ba",
)
#: An edge between an ASCII word character and anything else; Java's own edge knows all of Unicode.
_EDGE = "(?:(?<![a-z0-9_])(?=[a-z0-9_])|(?<=[a-z0-9_])(?![a-z0-9_]))"


def unaccent(c: Column | str) -> Column:
    return F.translate(_col(c), _ACCENTED, _PLAIN)


def normalize_company(c: Column | str) -> Column:
    """Company names without accents, legal forms, punctuation and noise words."""
    bare = F.regexp_replace(unaccent(F.lower(_empty(c))), f"{_EDGE}({'|'.join(LEGAL_FORMS)}){_EDGE}", " ")
    words = F.regexp_replace(bare, "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, f"{_EDGE}({'|'.join(NOISE_WORDS)}){_EDGE}", " "), " +", " "))


def content_hash(source: Column | str, *fields: Column | str) -> Column:
    """Fingerprint of a content version: the source as it is, then the fields, lower-cased and with single spaces."""
    clean = [F.lower(F.trim(F.regexp_replace(_empty(f), r"(?U)\s+", " "))) for f in fields]
    return F.sha2(F.concat_ws("\x1f", _empty(source), *clean), 256)


def surrogate_key(*columns: Column | str) -> Column:
    """md5 of the columns' texts, joined by hyphens; null has a mark of its own."""
    return F.md5(F.concat_ws("-", *(F.coalesce(_col(c).cast("string"), F.lit("_dbt_utils_surrogate_key_null_")) for c in columns)))


ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))


def strip_html(c: Column | str) -> Column:
    """Tags become spaces, six entities are resolved in turn, white space is collapsed. Null stays null."""
    text = F.regexp_replace(_col(c), "<[^>]+>", " ")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def truncate(c: Column | str, most: int = 6000, suffix: str = " …[truncated]") -> Column:
    return F.when(F.length(_col(c)) > most, F.concat(F.substring(_col(c), 1, most), F.lit(suffix))).otherwise(_col(c))


def redact(c: Column | str, names: tuple[str, ...] = ("key", "api_key", "apikey", "token", "access_token", "app_key")) -> Column:
    """Values of secret query-string parameters are hidden."""
    return F.regexp_replace(_col(c), rf"(?i)([?&](?:{'|'.join(names)})=)[^&\s'\"]+", "$1***")


def extract_json(c: Column | str) -> Column:
    """From the first brace to the last, whatever stands around them; null where there are none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))


def parse_instant(c: Column | str) -> Column:
    """ISO-like text to a timestamp in UTC: a time without a zone is UTC, else its first ten characters as a date; garbage is null."""
    text = F.trim(_col(c))
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), day))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector is null, empty, of another length or without size."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot / size).otherwise(0.0)


def age_label(ts: Column | str, now: Column | None = None) -> tuple[Column, Column]:
    """(age in words, tone): good under 36 hours, warn up to three days, bad beyond or unknown."""
    hours = (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(_col(ts))) / 3600
    days = F.floor(hours / 24)
    label = F.when(hours.isNull(), "unknown").when(hours < 1, "just now").when(hours < 36, F.concat(F.floor(hours).cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    return label, F.when(hours.isNull(), "bad").when(hours < 36, "good").when(days <= 3, "warn").otherwise("bad")


def prompt_text(title: Column | str, company: Column | str, location: Column | str, country: Column | str, language: Column | str, salary: Column | str, description: Column | str) -> Column:
    """A posting as lines of labelled text for a classifier; what is missing or empty says so."""
    # Labels, and what stands for a missing value.
    line = lambda label, c, missing: F.concat(F.lit(f"{label}: "), _or(c, missing))
    return F.concat_ws(
        "\n", line("Title", title, "(none)"), line("Company", company, "(unknown)"), line("Location", location, "(unknown)"), line("Country", country, "(unknown)"),
        line("Detected language", language, "(unknown)"), line("Salary (raw)", salary, "(none)"), F.lit(""), F.lit("Job description:"), _or(truncate(description), "(no description provided)"),
    )


def _or(c: Column | str, missing: str) -> Column:
    return F.coalesce(F.nullif(_col(c).cast("string"), F.lit("")), F.lit(missing))


#: Short words by language (ISO 639-1) that are frequent in it.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "für", "ist", "ein", "eine", "nicht", "auf", "wir"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "are", "you", "was", "by", "it"),
    "es": ("el", "la", "los", "las", "que", "y", "en", "por", "con", "para", "una", "un", "del", "se", "es"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "un", "dans", "pour", "avec", "sur", "du", "que", "par"),
    "nl": ("de", "het", "een", "en", "van", "voor", "met", "op", "zijn", "niet", "wij", "aan", "bij", "naar", "ook"),
}


def _count(words: Column, own: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*own)))


def detect_language(c: Column | str, min_chars: int = 20) -> Column:
    """The language whose function words a text has most of, the first by code of equal ones; null for short texts and those without any."""
    words = F.split(F.lower(_col(c)), r"[^\p{L}]+")
    hits = [F.struct(_count(words, own).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, own) in enumerate(sorted(FUNCTION_WORDS.items()))]
    best = F.array_max(F.array(*hits))
    return F.when((F.length(F.trim(_col(c))) >= min_chars) & (best["n"] > 0), best["code"])
