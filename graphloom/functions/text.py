"""Text normalisers and string predicates as Column expressions.

Every metric names its own normaliser; they are not interchangeable. All of them stay in the JVM except
the Unicode normal forms, which Spark has no builtin for and which run as an Arrow-batched function.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Words that must equal the assessed method's lists for the same results.
PRONOUNS = (
    "he she it they him her them his hers its their theirs we us our ours i you your yours "
    "this that these those who which"
).split()
RELATION_STOP_WORDS = (
    "in of is by the a an to at for on with as and or s was were be been has have had"
).split()
TYPE_NOUNS = (
    "county city state province district region territory town village borough municipality area "
    "river lake island mountain sea ocean bay valley peninsula desert forest "
    "university college school academy institute hospital airport station stadium arena museum "
    "library church temple mosque prison park bridge tower castle palace "
    "company corporation firm agency organization organisation association federation union party "
    "band group orchestra choir ensemble team club league franchise squad "
    "film movie album song single track series season episode novel book magazine newspaper journal "
    "comic game show programme program tour "
    "actor actress singer songwriter comedian musician composer producer director writer author poet "
    "novelist painter artist politician president governor senator mayor player coach manager engineer "
    "scientist lawyer doctor physician professor journalist economist philosopher soldier general"
).split()
MONTH_NAMES = (
    "january february march april may june july august september october november december"
).split()


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Every character that counts as white space at the ends of a string.
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim any white space on both ends (``trim`` only removes blanks)."""
    return F.btrim(c, F.lit(BLANKS))


def strip_quotes(c: Column) -> Column:
    """Trim, then drop surrounding double quotes, then surrounding single quotes."""
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _word_key(c: Column) -> Column:
    """White space and commas to ``_``, other symbols dropped, runs and ends of ``_`` removed."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)[\s,]+", "_"), r"\W+", "")
    return F.btrim(F.regexp_replace(c, "__+", "_"), F.lit("_"))


def norm_entity(c: Column) -> Column:
    """Entity surface key: underscore separated, ASCII word characters only, lower case."""
    return F.lower(_word_key(c))


def norm_relation(c: Column) -> Column:
    """Relation name as lower-case words (camel case, ``_``, ``-`` and ``/`` split)."""
    return F.lower(F.trim(F.regexp_replace(split_camel(c), r"(?U)[\s_/-]+", " ")))


def norm_open(c: Column) -> Column:
    """Surface text for open-triple comparison: quotes off, camel case and ``_``/``-`` split."""
    return F.lower(F.trim(F.regexp_replace(split_camel(strip_quotes(c)), r"(?U)[\s_-]+", " ")))


def norm_token(c: Column) -> Column:
    """Span-scorer token: symbols removed, underscores kept, case kept."""
    s = strip(c)
    quoted = s.rlike(r'(?s)^".*"$') | s.rlike(r"(?s)^'.*'$")
    s = F.when(quoted & (F.length(s) >= 2), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(
        F.when(quoted, F.lit("")).otherwise(s))
    s = F.replace(F.replace(s, F.lit("&"), F.lit("and")), F.lit("."), F.lit(""))
    return _word_key(s)


def token_words(c: Column) -> Column:
    """Span-scorer words: :func:`norm_token`, camel case and underscores split, lower case."""
    return F.lower(squeeze(F.replace(split_camel(norm_token(c)), F.lit("_"), F.lit(" "))))


def norm_schema_relation(c: Column) -> Column:
    return F.translate(F.lower(c), "_ ", "")


def fold(c: Column) -> Column:
    """Instance key: case folded, punctuation and ``_`` to blanks, collapsed."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[\W_]", " "))


def fold_tokens(c: Column) -> Column:
    """Distinct words of :func:`fold`; empty array for an empty fold."""
    return F.array_distinct(F.filter(F.split(fold(c), " "), lambda t: t != ""))


def norm_definition_key(c: Column) -> Column:
    """Definition-stage key: trimmed, lower case, ``_`` equals blank."""
    return F.regexp_replace(F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")


def norm_intrinsic(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "_")


def norm_annotation(c: Column) -> Column:
    c = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)(?:\s|[_-])+", " ")
    return strip(F.regexp_replace(c, r"(?U)(?! )\W", ""))


def clean_text(c: Column) -> Column:
    """One-line text: every whitespace run becomes one blank."""
    return squeeze(c)


def norm_corpus(c: Column) -> Column:
    """Leak-guard key of a text: lower case, one blank between words."""
    return F.lower(squeeze(c))


def strip_numbered_key(c: Column) -> Column:
    """``"1. location"`` -> ``location``."""
    return strip(F.when(c.contains("."), F.regexp_replace(c, r"(?s)^[^.]*\.", "")).otherwise(c))


@F.arrow_udf(T.StringType())
def nfc(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in v.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfd(v: pa.Array) -> pa.Array:
    return pc.utf8_normalize(v, form="NFD")


def deaccent(c: Column) -> Column:
    """Canonical decomposition without combining marks; pure ASCII text skips the Python worker's work."""
    return F.regexp_replace(nfd(F.coalesce(c, F.lit(""))), r"\p{Mn}", "")


# Letters that decompose into no ASCII base letter, with their usual transliteration.
LETTER_MAP = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i",
    "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...",
}


def to_ascii(c: Column) -> Column:
    """Transliterate to ASCII: accents off, special letters mapped, anything else dropped."""
    c = deaccent(c)
    for src, dst in LETTER_MAP.items():
        c = F.replace(c, F.lit(src), F.lit(dst))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def norm_benchmark_entity(c: Column, is_object: bool = False) -> Column:
    """Benchmark-file form: camel case split, ``_`` to blank, ASCII, lower; object loses a final ``(…)``."""
    c = split_camel(c)
    if is_object:
        c = F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")
    return F.lower(squeeze(F.replace(to_ascii(c), F.lit("_"), F.lit(" "))))


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(deaccent(c)), r"[\W_]+", "")


def label_tokens(c: Column) -> Column:
    """Lower-case morphemes of a camel-case or snake-case label."""
    c = F.regexp_replace(deaccent(c), r"[_\-/]+", " ")
    c = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(squeeze(c)), " "), lambda t: t != ""))


def text_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def entity_tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, "_"), lambda t: t != ""))


def entity_in_text(norm: Column, tokens: Column, threshold: float) -> Column:
    """At least ``threshold`` of the entity's tokens occur in the text; empty entities count as realised."""
    own = entity_tokens(norm)
    return (F.size(own) == 0) | (F.size(F.array_intersect(own, tokens)) / F.size(own) >= F.lit(threshold))


def has_pronoun(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, _words(PRONOUNS))


def relation_tokens(c: Column) -> Column:
    toks = F.regexp_extract_all(F.lower(split_camel(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(F.array_except(toks, _words(RELATION_STOP_WORDS)), lambda t: F.length(t) > 1)


def relation_grounded(c: Column, tokens: Column) -> Column:
    own = relation_tokens(c)
    return (F.size(own) == 0) | F.arrays_overlap(own, tokens)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_temporal(c: Column) -> Column:
    """Year, decade, month or century surface; such surfaces merge only when fold-equal."""
    toks = fold_tokens(c)
    return (fold(c).rlike(r"\b\d{3,4}s?\b") | F.arrays_overlap(toks, _words(MONTH_NAMES))
            | F.array_contains(toks, "century"))


def type_noun_tokens(tokens: Column) -> Column:
    return F.array_intersect(tokens, _words(TYPE_NOUNS))


def is_value_literal(c: Column) -> Column:
    """Empty, quoted, or a number with an optional unit in parentheses: has no knowledge-base type."""
    s = strip(c)
    return ((s == "") | s.rlike('(?s)^["“]') | s.rlike('(?s)["”]$') | s.rlike(r"^[-+−]?[0-9.,]+(\s*\(.*\))?$"))


def tokens_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
