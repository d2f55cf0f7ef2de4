"""Text functions: Column to Column, all within code generation or array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the English term extractor.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its",
    "of", "on", "or", "that", "the", "their", "these", "this", "to", "was", "were", "with", "we", "our", "they", "which",
    "can", "may", "might", "using", "use", "used", "based", "method", "methods", "result", "results", "study", "studies",
    "analysis", "data", "model", "models",
)

# The stop words of the Russian term extractor.
RUSSIAN_STOP_WORDS = (
    "и", "а", "но", "что", "это", "как", "в", "во", "на", "по", "к", "у", "о", "об", "от", "до", "для", "из", "при", "без",
    "с", "со", "же", "ли", "бы", "не", "нет", "мы", "вы", "они", "он", "она", "оно", "их", "наш", "ваш",
)

#: Letters, digits, underscore and hyphen, three or more.
TOKEN = r"[\p{L}\p{N}_\-]{3,}"
WORD = r"[\p{L}\p{N}_\-]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def norm(x: Column | str) -> Column:
    """Lower case, one space for each run of blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(x)), r"\s+", " "))


def title_key(x: Column | str) -> Column:
    """Lower case without punctuation, blanks collapsed: equal titles get equal keys."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(x)), r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))


def tokens(x: Column | str) -> Column:
    """Tokens of three letters or more that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(_col(x)), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def sentences(x: Column | str, least: int = 20) -> Column:
    """Lower-case parts between dots of at least ``least`` letters; the whole text if there is none."""
    whole = norm(x)
    parts = F.filter(F.transform(F.split(whole, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(whole), lambda s: s != ""))


def chunks(x: Column | str, size: int = 1200) -> Column:
    """Consecutive chunks of ``size`` letters, trimmed, blank ones dropped."""
    text = _col(x)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return F.filter(F.transform(starts, lambda i: strip(text.substr(i * size + 1, F.lit(size)))), lambda c: F.length(c) > 0)


def truncate(x: Column | str, size: int) -> Column:
    """At most ``size`` letters, the last an ellipsis if something was cut."""
    text = _col(x)
    return F.when(F.length(text) > size, F.concat(F.regexp_replace(F.substring(text, 1, size - 1), r"\s+$", ""), F.lit("…"))).otherwise(text)


def slug(x: Column | str) -> Column:
    """Runs of anything but a-z and 0-9 become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def stop_words(language: str = "en") -> tuple[str, ...]:
    return RUSSIAN_STOP_WORDS if language.lower().startswith("ru") else STOP_WORDS


def phrases(x: Column | str, longest: int = 4, least: int = 3, language: str = "en") -> Column:
    """Runs of words between stop words and words shorter than ``least``, cut to ``longest`` words each."""
    words = F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD), F.lit(0))
    marked = F.transform(words, lambda w: F.when(w.isin(*stop_words(language)) | (F.length(w) < least), F.lit("|")).otherwise(w))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r))
    return F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.slice(F.split(r, " "), 1, longest))


def modality(x: Column | str) -> Column:
    """table, figure, formula or text by the words of a caption; the first that holds."""
    text = F.lower(_col(x))
    return F.when(text.rlike(r"\btab(le|\.)"), "table").when(text.rlike(r"\bfig(ure|\.)"), "figure").when(text.rlike(r"\b(eq(uation|\.)|formula)"), "formula").otherwise("text")


def verdict(x: Column | str) -> Column:
    """accept, reject, revise or unknown from the words of a review."""
    text = norm(x)
    return (
        F.when(text.isin("accept", "accepted", "correct", "yes", "valid", "approve", "approved"), "accept")
        .when(text.isin("reject", "rejected", "incorrect", "no", "invalid", "wrong"), "reject")
        .when(text.rlike(r"\b(not|never|in)\s*(correct|valid|accepted)"), "reject")
        .when(text.rlike(r"needs? (fix|work|time)|revise|edit"), "revise")
        .when(text.rlike(r"accept|correct"), "accept")
        .otherwise("unknown")
    )
