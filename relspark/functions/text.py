"""Text expressions: cleaning, personal data, tokens, fingerprints, and rules by pattern."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on, in Java's syntax.
HTML = r"<[^>]+>"
EMAIL = r"(?<![\w.-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
URL = r"(?i)\b(?:https?://|www\.)\S+"
PHONE = r"(?<!\w)(?:\+?\d[\d ()-]{7,}\d)(?!\w)"
HANDLE = r"(?<!\w)@[A-Za-z0-9_]{2,32}\b"
TOKEN = r"([\p{L}\p{N}_']+)"
CRISIS = r"(?i)\b(?:suicid(?:e|al)|kill myself|end my life|hurt myself|self[- ]?harm|hurt someone|kill someone)\b"
DIAGNOSIS = r"(?i)\b(?:you (?:have|are suffering from)|diagnos(?:e|ed|is)|mental disorder)\b"
CLAIM = r"(?i)\b(?:you (?:have|definitely have|are suffering from)|diagnos(?:e|ed|is)|mental disorder)\b"  # the verifier's own
MEDICATION = r"(?i)\b(?:start|stop|increase|decrease|take)\s+(?:your\s+)?(?:dose|medication|antidepressant|ssri)\b"
REFUSAL = r"(?i)\b(?:i\s+)?(?:cannot|can't|won't|do not|am not able to)\s+(?:diagnos\w*|recommend\s+medication|prescribe\w*)\b"
MEDICAL_REQUEST = r"(?i)\b(?:diagnos(?:e|is)|what disorder|what medication|which medicine|change my dose|stop taking|clinical treatment plan)\b"
INJECTION = r"(?i)(?:ignore (?:all |the )?(?:previous|system) instructions|reveal (?:the )?system prompt|developer message|bypass (?:safety|policy))"
CERTAINTY = r"(?i)\b(?:definitely|certainly|proves?|guaranteed|without doubt)\b"
SPECIFIC_ADVICE = r"(?i)\b(?:treatment plan|therapy protocol|clinical recommendation|medication|dosage)\b"
EMPATHY = r"(?i)\b(?:thank you for sharing|that sounds|it makes sense|i hear|you are not alone|what you feel)\b"
STOP_WORDS = ["the", "a", "an", "and", "or", "to", "of", "in", "is", "you", "your", "i", "it", "that", "this"]
CONSENT = {
    "yes": ["yes", "y", "sure", "ok", "okay", "confirm", "proceed"],
    "no": ["no", "n", "nope", "no thanks", "do not proceed"],
    "cancel": ["cancel", "stop", "never mind", "nevermind"],
    "refine": ["refine", "change it", "modify", "edit"],
}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def squash(t: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def unescape(t: Column) -> Column:
    """The common character references only; the ampersand comes last so that nothing is unescaped twice."""
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    return t


@lru_cache
def _python() -> tuple:
    """Functions that no built-in gives, made when a session is there: composed characters without references, full case folding."""
    over = lambda f: F.pandas_udf(lambda t: t.map(lambda x: x if x is None else f(x)), "string")
    return over(lambda x: unicodedata.normalize("NFC", html.unescape(x))), over(str.casefold)


def normal_form(t: Column) -> Column:
    """Character references resolved and characters composed; texts that need neither are not sent to Python."""
    pattern = r"&|[^\x00-\x7f]"
    return F.coalesce(_python()[0](F.when(F.regexp_like(t, F.lit(pattern)), t)), t)


def casefold(t: Column) -> Column:
    """Lower case for comparisons, by full case folding where a text has other letters than ASCII ones."""
    pattern = r"[^\x00-\x7f]"
    return F.coalesce(_python()[1](F.when(F.regexp_like(t, F.lit(pattern)), t)), F.lower(t))


def strip_html(t: Column, by: str = " ") -> Column:
    return F.regexp_replace(t, HTML, by)


def pii_counts(t: Column) -> dict[str, Column]:
    """Counts in the raw text; null counts as empty."""
    t = F.coalesce(t, F.lit(""))
    return {n: F.regexp_count(t, F.lit(p)) for n, p in (("email", EMAIL), ("url", URL), ("phone", PHONE), ("handle", HANDLE))}


def redact(t: Column) -> Column:
    """Text without markup, with personal data named by kind. The order matters: an e-mail holds what looks like a handle."""
    t = strip_html(normal_form(F.coalesce(t, F.lit(""))))
    for pattern, name in ((EMAIL, "[EMAIL]"), (URL, "[URL]"), (PHONE, "[PHONE]"), (HANDLE, "[HANDLE]")):
        t = F.regexp_replace(t, pattern, name.replace("[", r"\[").replace("]", r"\]"))
    return squash(t)


def tokens(t: Column) -> Column:
    """Lower-case words of letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN), 1)


def normalized(t: Column) -> Column:
    return F.array_join(F.regexp_extract_all(casefold(redact(t)), F.lit(TOKEN), 1), " ")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the normalised parts, a line each."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of words; all words if there are fewer, none without words.

    The words are bound once, by an outer lambda: named in the inner one they would be computed again for each run.
    """

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def terms(t: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of at least two characters that aren't stop words, and their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    stop = F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words))
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w))
    both = lambda ws: F.concat(ws, F.transform(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.concat(F.get(ws, i), F.lit(" "), w)))
    return F.get(F.transform(F.array(kept), both), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def has(t: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(t, F.lit(pattern)), F.lit(False))


def unsafe_claim(t: Column) -> Column:
    """A diagnosis or an instruction on medication that isn't part of a refusal."""
    t = F.regexp_replace(t, REFUSAL, "")
    return has(t, DIAGNOSIS) | has(t, MEDICATION)


def consent(t: Column) -> Column:
    """yes, no, cancel, refine or null."""
    t = F.regexp_replace(squash(F.lower(t)), r"[.!?]+$", "")
    out = F.lit(None).cast("string")
    for kind, words in CONSENT.items():
        out = F.when(t.isin(words), kind).otherwise(out)
    return out


def word_count(t: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(t, F.lit("")), r"\s+"), ""))


def slug(t: Column, longest: int = 50) -> Column:
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.substring(t, 1, longest), r"^-+|-+$", "")
