"""Rule-based triplets: relation patterns, entity cleaning, canonical predicates and the choice of the best.

All of it is column expressions: Java's regular expressions have the lazy groups
that the rules need, so no row goes through Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Words that carry no meaning in an entity.
STOP_WORDS = (
    "the", "a", "an", "this", "that", "these", "those", "we", "our", "their", "his", "her", "its", "and", "or", "but", "with", "for", "from", "into",
    "onto", "than", "then", "using", "use", "used", "show", "shows", "showed", "shown", "observe", "observed", "result", "results", "study", "paper",
    "method", "methods", "approach", "approaches", "data", "dataset", "datasets", "experiment", "experiments", "analysis", "model", "models", "in",
    "on", "at", "to", "of", "by", "as", "is", "are", "was", "were", "be", "being", "been", "can", "may", "might", "could", "should", "would", "will",
    "during", "under", "across", "between", "among", "via", "through",
)
# Parts of an entity that make it junk.
JUNK = ("copyright", "all rights reserved", "supplementary", "figure", "table", "equation", "section", "appendix", "references")
# What relation verbs are called.
ALIASES = {
    "associated with": "associated_with", "associated_with": "associated_with", "correlated with": "associated_with",
    "linked to": "associated_with", "related to": "associated_with",
    "depends on": "depends_on",
    "results in": "results_in", "result in": "results_in", "resulting in": "results_in",
    "leads to": "leads_to", "lead to": "leads_to", "gives rise to": "leads_to",
    "causes": "causes", "caused": "causes", "cause": "causes",
    "induces": "induces", "induce": "induces", "induced": "induces",
    "triggers": "triggers", "trigger": "triggers", "triggered": "triggers",
    "drives": "drives", "drive": "drives", "driven": "drives",
    "promotes": "promotes", "promote": "promotes", "promoted": "promotes",
    "enhances": "improves", "boosts": "improves", "improves": "improves", "improve": "improves", "improved": "improves",
    "increases": "increases", "increase": "increases", "increased": "increases",
    "reduces": "reduces", "reduce": "reduces", "reduced": "reduces", "decreases": "reduces",
    "suppresses": "suppresses", "inhibits": "inhibits", "prevents": "prevents", "mitigates": "mitigates",
    "predicts": "predicts", "predict": "predicts", "predicted": "predicts",
    "precedes": "precedes", "before": "precedes", "occurs before": "precedes", "is followed by": "precedes", "followed by": "precedes",
    "follows": "follows", "after": "follows", "occurs after": "follows",
}
# Predicates that say nothing, and strengths by which triplets are chosen; others count 0.3.
WEAK = ("show", "shows", "state", "states", "describes", "describe", "mentions", "section", "displays", "defined_as")
STRENGTH = {
    1.0: ("causes", "induces", "triggers", "drives", "promotes", "leads_to", "results_in"),
    0.9: ("prevents", "inhibits", "suppresses", "mitigates", "improves", "increases", "reduces", "predicts"),
    0.85: ("precedes", "follows"),
    0.45: ("associated_with",),
    0.25: ("relates_to",),
}
OTHER_STRENGTH = 0.3
STRONG = tuple(p for s in (1.0, 0.9, 0.85) for p in STRENGTH[s])
# Relations as (adverbs or lead-in, verbs, polarity, confidence).
OFTEN = r"(?:directly\s+|strongly\s+|significantly\s+|consistently\s+)?"
HAPPENS = r"(?:occurs?\s+|happens?\s+|appears?\s+)?"
RELATIONS = (
    (OFTEN, "causes?|induces?|triggers?|drives?|promotes?", "supports", 0.9),
    (r"(?:directly\s+|significantly\s+|consistently\s+)?", "leads to|results in|gives rise to|depends on|predicts?", "supports", 0.87),
    (r"(?:directly\s+|significantly\s+|strongly\s+)?", "improves?|enhances?|boosts?|increases?", "supports", 0.82),
    (r"(?:significantly\s+|consistently\s+)?", "reduces?|decreases?|suppresses?|inhibits?|prevents?|mitigates?", "supports", 0.84),
    (HAPPENS, "before|precedes?", "supports", 0.83),
    (HAPPENS, "after|follows?", "supports", 0.83),
    ("", "is followed by|followed by", "supports", 0.8),
    (r"(?:is|was|are|were)\s+", "associated with|correlated with|linked to|related to", "unknown", 0.56),
    ("", "contradicts?|fails to improve|does not improve|does not increase|does not reduce|worsens?", "contradicts", 0.74),
)
SIDE = r"([A-Za-z][A-Za-z0-9_\-()/,%+ ]{2,90}?)"
CUE = r"(?i)\b(improv(?:e|es|ed)|increase(?:s|d)?|reduce(?:s|d)?|decrease(?:s|d)?|lead(?:s)? to|result(?:s)? in|cause(?:s|d)?|prevent(?:s|ed)?|before|after|follow(?:s|ed)?|predict(?:s|ed)?)\b"
DATE = r"(19\d{2}|20\d{2}|2100)(?:-(\d{2})(?:-(\d{2}))?)?"
PHRASE = r"[A-Za-z][A-Za-z0-9_\-]{2,}(?:\s+[A-Za-z0-9_\-]{2,}){0,4}"
#: Triplets of a chunk at most; entities, sentences and pairs that the fallback looks at.
KEPT, ENTITIES, ENTITY_SENTENCES, PAIR_SENTENCES, PAIRS = 10, 8, 5, 3, 8
MARKS = " ,;:-"


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def cleaned(text: Column) -> Column:
    """An entity without marks, article, references to figures, brackets and stop words, of at most ten words; stop words stay if there are no others."""
    own = F.btrim(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(MARKS))
    own = F.regexp_replace(own, r"(?i)^(?:the|a|an)\s+", "")
    own = F.regexp_replace(own, r"(?i)\([^)]*\b(?:fig|figure|table|eq|equation)\.?\s*\d+[^)]*\)", "")
    own = F.trim(F.regexp_replace(F.regexp_replace(own, r"\[[^\]]+\]", ""), r"\s+", " "))
    words = F.split(own, " ")

    def told(all_words: Column) -> Column:
        return _let(F.filter(all_words, lambda w: ~F.lower(w).isin(*STOP_WORDS)), lambda kept: F.btrim(F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(all_words), 1, 10), " "), F.lit(MARKS)))

    return _let(words, told)


def informative(entity: Column) -> Column:
    """Whether a cleaned entity says something: three letters or more, no junk, one to twelve words that begin with a letter."""
    low = F.lower(entity)
    words = F.regexp_extract_all(low, F.lit(r"[A-Za-z][A-Za-z0-9_\-]*"), F.lit(0))
    clean = reduce(lambda a, b: a & b, (~F.contains(low, F.lit(j)) for j in JUNK))

    def counted(all_words: Column) -> Column:
        n = F.size(F.filter(all_words, lambda w: ~w.isin(*STOP_WORDS)))
        return F.when(n > 0, n).otherwise(F.size(all_words)).between(1, 12)

    return (F.length(low) >= 3) & clean & _let(words, counted)


def canonical(predicate: Column) -> Column:
    """The canonical name of a relation verb, else its words joined by underscores."""
    own = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(predicate, F.lit(""))), r"\s+", " ")), "-", " ")
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, own), F.regexp_replace(own, " ", "_"))


def strength(predicate: Column) -> Column:
    out = F.lit(OTHER_STRENGTH)
    for value, names in STRENGTH.items():
        out = F.when(predicate.isin(*names), value).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """Trimmed parts that end with a full stop, question or exclamation mark and a blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def time_of(sentence: Column, year: Column) -> Column:
    """The first date of a sentence as year, month or day, else the paper's year."""
    return F.coalesce(F.nullif(F.regexp_extract(sentence, DATE, 0), F.lit("")), year.cast("string"))


def _matches(sentence: Column) -> Column:
    """(subject, verb, object, polarity, confidence) of every relation of a sentence, by rule, then place.

    A sentence is searched for a relation only if it has one of its verbs, and
    the parts are taken from what was found.
    """
    found = []
    for lead, verbs, polarity, confidence in RELATIONS:
        pattern = rf"(?i){SIDE}\s+{lead}({verbs})\s+{SIDE}(?:[.,;:]|$)"
        whole = F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
        found.append(F.when(sentence.rlike(rf"(?i)\s(?:{verbs})\s"), _parts(whole, pattern, polarity, confidence)).otherwise(F.expr(f"CAST(array() AS array<{MATCH}>)")))
    return F.concat(*found)


MATCH = "struct<subject:string,verb:string,object:string,polarity:string,confidence:double>"


def _parts(whole: Column, pattern: str, polarity: str, confidence: float) -> Column:
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    return F.transform(whole, lambda m: F.struct(part(m, 1).alias("subject"), part(m, 2).alias("verb"), part(m, 3).alias("object"), F.lit(polarity).alias("polarity"), F.lit(confidence).alias("confidence")))


def chosen(found: DataFrame, key: str, most: int = KEPT) -> DataFrame:
    """The ``most`` best triplets of each key: strong predicates first, then by strength, confidence and length of the quote; equal ones once.

    ``found``: key, pos, subject, predicate, object, confidence, polarity, time,
    quote, in which entities are cleaned.  Self-loops, entities that say
    nothing and weak predicates go.
    """
    own = found.withColumn("predicate", canonical(F.col("predicate")))
    own = own.where(informative(F.col("subject")) & informative(F.col("object")) & (F.lower("subject") != F.lower("object")) & (F.col("predicate") != "") & ~F.col("predicate").isin(*WEAK))
    others = [c for c in own.columns if c != key]
    once = own.groupBy(key, F.lower("subject").alias("__s"), F.col("predicate").alias("__p"), F.lower("object").alias("__o"), F.coalesce("time", F.lit("")).alias("__t")).agg(F.min_by(F.struct(*others), "pos").alias("r")).select(key, "r.*")
    order = [F.desc(F.col("predicate").isin(*STRONG)), F.desc(strength(F.col("predicate"))), F.desc("confidence"), F.desc(F.length("quote")), "pos"]
    return once.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def _fallback(chunks: DataFrame, key: str) -> DataFrame:
    """Pairs of entities of a sentence, joined by its cue verb or else by association, for chunks in which no rule holds."""
    entities = F.flatten(F.transform(F.slice("lines", 1, ENTITY_SENTENCES), lambda s: F.transform(F.regexp_extract_all(s, F.lit(PHRASE), F.lit(0)), lambda p: cleaned(p))))
    good = chunks.withColumn("entities", F.filter(entities, lambda e: informative(e)))
    same = F.transform("entities", lambda e: F.lower(e))
    firsts = F.slice(F.filter("entities", lambda e, i: F.array_position(same, F.lower(e)) == i + 1), 1, ENTITIES)
    lines = good.select(key, "year", firsts.alias("entities"), F.posexplode(F.slice("lines", 1, PAIR_SENTENCES)).alias("line", "sentence"))
    lines = lines.withColumn("inside", F.filter("entities", lambda e: F.contains(F.lower("sentence"), F.lower(e))))
    pairs = F.flatten(F.transform("inside", lambda a, i: F.transform(F.slice("inside", i + 2, F.size("inside")), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    cue = F.nullif(F.regexp_extract("sentence", CUE, 1), F.lit(""))
    rows = lines.where(F.size("inside") > 1).select(key, "year", "sentence", "line", cue.alias("cue"), F.posexplode(pairs).alias("at", "p"))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("line", "at"))).where(F.col("pos") <= PAIRS)
    return rows.select(key, "pos", "p.subject", F.coalesce("cue", F.lit("associated_with")).alias("predicate"), "p.object", F.when(F.col("cue").isNotNull(), 0.62).otherwise(0.46).alias("confidence"), F.when(F.col("cue").isNotNull(), "supports").otherwise("unknown").alias("polarity"), time_of(F.col("sentence"), F.col("year")).alias("time"), F.substring("sentence", 1, 200).alias("quote"), "year")


def extract(rows: DataFrame, key: str, text: str, year: str | None = None) -> DataFrame:
    """(key, place, subject, predicate, object, confidence, polarity, time, time_source, quote): the triplets that the rules find in each text.

    Relations within a sentence; where a text has none, pairs of its entities.
    ``key`` tells the texts apart.  Null and empty texts give nothing.
    """
    own = rows.select(key, sentences(F.col(text)).alias("lines"), (F.col(year).cast("int") if year else F.lit(None).cast("int")).alias("year"))
    lines = own.select(key, "year", F.posexplode("lines").alias("line", "sentence"))
    found = lines.select(key, "year", "line", "sentence", F.posexplode(_matches(F.col("sentence"))).alias("at", "m"))
    found = found.select(key, F.struct("line", "at").alias("pos"), cleaned(F.col("m.subject")).alias("subject"), F.col("m.verb").alias("predicate"), cleaned(F.col("m.object")).alias("object"), "m.confidence", "m.polarity", time_of(F.col("sentence"), F.col("year")).alias("time"), F.substring("sentence", 1, 200).alias("quote"), "year")
    ruled = chosen(found, key).drop("pos")
    rest = own.join(ruled.select(key).distinct(), key, "left_anti")
    paired = chosen(_fallback(rest, key), key).drop("pos")
    source = F.when(F.col("time").isNotNull() & (F.col("time") != F.coalesce(F.col("year").cast("string"), F.lit(""))), "extracted").otherwise("paper_year_fallback")
    return ruled.unionByName(paired).select(key, "place", "subject", "predicate", "object", "confidence", "polarity", "time", source.alias("time_source"), "quote")
