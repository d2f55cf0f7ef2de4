"""Personal data by exact patterns and bootstrapped contextual extraction.

Every step is a DataFrame or SQL expression.  Four exact patterns give the
base spans.  They, hexadecimal strings and access key ids are the seed entities
of a bootstrapping loop: what stands before an identifier, in its word if there
are letters and else in the words before, is its lexical pattern; patterns and identifiers form a graph; a pattern is as good as the share of
known identifiers among all that it precedes; those of high confidence make
the unknown identifiers after them known, and the loop goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged

#: Kinds in the order of the span strings; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Rounds of the loop.
ROUNDS = 3
#: A pattern counts if it precedes so many known identifiers of a kind ...
SUPPORT = 3
#: ... and if they are this share of all that it precedes.
CONFIDENCE = 0.6
#: Words before an identifier that make its pattern.
CONTEXT = 2

# Possessive forms of the fixed patterns: they match the same spans without backtracking over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP_OK = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
#: A word with a digit.
NUMBERED = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: The part with a digit of such a word, with marks around it that are trimmed.
CORE = r"(?<![0-9A-Za-z_./+:@-])[A-Za-z_./+:@-]*+[0-9][0-9A-Za-z_./+:@-]*+"
MARKS = "_./+:@-"
#: Seeds of the kind `secret`: hexadecimal strings with digits and letters, and ids of access keys.
SECRET = r"^(?:(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{16})$"

#: Matches whose positions are summed up together.
STEP = 256

SPAN = "struct<start:int,end:int,value:string>"
FOUND = "struct<start:int,end:int,value:string,before:string>"


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _words_before(found: Column, x: Column, k: Column) -> Column:
    """The last :data:`CONTEXT` words before the k-th match, each with a blank after it.

    Matches are words themselves, so they lie in the text since the match
    ``CONTEXT`` before, however long that is.
    """
    parts = [x["piece"]]
    for back in range(1, CONTEXT + 1):
        earlier = F.get(found, k - back)
        parts = [earlier["value"], *parts] if back == CONTEXT else [earlier["piece"], earlier["value"], *parts]
    words = F.rtrim(F.regexp_replace(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), r"\s+", " "))
    return F.lower(F.when(words == "", "").otherwise(F.concat(F.ltrim(F.substring_index(words, " ", -CONTEXT)), F.lit(" "))))


def places(text: Column, pattern: str, context: bool = False) -> Column:
    """All leftmost matches that do not overlap, with their code point spans (and the words before each, for patterns of whole words).

    A span starts where the lengths before it add up to.  The sums run within
    parts of :data:`STEP` matches and over the parts, so that a text of very
    many matches costs little more than its length.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda piece, value: F.struct(piece.alias("piece"), value.alias("value")))
    if context:
        pairs = _let(pairs, lambda found: F.transform(found, lambda x, k: F.struct(x["piece"].alias("piece"), x["value"].alias("value"), _words_before(found, x, k).alias("before"))))
    kind = FOUND if context else SPAN

    def length(x: Column) -> Column:
        return F.length(x["piece"]) + F.length(x["value"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        fields = [start.alias("start"), end.alias("end"), x["value"].alias("value")]
        if context:
            fields.append(x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(*fields))).alias("out"))

    def spans(part: Column, at: Column) -> Column:
        empty = F.struct(at.alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out"))
        return F.aggregate(part, empty, step, lambda state: state["out"])

    def starts(parts: Column) -> Column:
        """Where each part starts, and where the last one ends."""
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + length(x)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

    def joined(parts: Column) -> Column:
        return _let(starts(parts), lambda at: F.flatten(F.transform(parts, lambda part, k: spans(part, at[k]))))

    def cut(all_pairs: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_pairs) - 1) / STEP).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_pairs, k * STEP + 1, F.lit(STEP)))

    return _let(pairs, lambda all_pairs: _let(cut(all_pairs), joined))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, at: Column) -> Column:
        digit = digits.substr(F.length(digits) + 1 - at, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 0, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind; texts that cannot have one are passed over by a cheap test."""
    n = lambda x: F.length(_digits(x["value"]))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    found = {
        "email": (text.contains("@"), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["value"].rlike(IP_OK)),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, lambda x: n(x).between(12, 19) & luhn(_digits(x["value"]))),
        "phone": (text.contains("+"), PHONE, lambda x: n(x).between(9, 15)),
    }
    return {kind: F.when(may, F.filter(places(text, rx), ok) if ok else places(text, rx)).otherwise(none) for kind, (may, rx, ok) in found.items()}


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def span_string(spans: Column) -> Column:
    """kind:start:end of (start, kind, end) structs, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _occurrences(docs: DataFrame) -> DataFrame:
    """Per row: its key, the base spans, and every identifier-like word with its pattern and, if known, kind.

    A word in which a base span begins stands for that whole span; further
    words of the span are none of their own.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumns(base_spans(F.col("text")))
    out = out.withColumn("hits", F.concat(*(_labelled(F.col(k), k) for k in KINDS[:-1])))
    words = F.when(F.col("text").rlike("[0-9]"), places(F.col("text"), NUMBERED, context=True)).otherwise(F.expr(f"CAST(array() AS array<{FOUND}>)"))

    def entity(x: Column) -> Column:
        own = F.filter(F.col("hits"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return _let(own, lambda hits: F.when(F.size(hits) == 0, free(x)).when(hits[0]["start"] >= x["start"], seed(x, hits[0])))

    def pattern(x: Column, lead: Column) -> Column:
        return F.when(lead.rlike(r"\p{L}"), F.lower(lead)).otherwise(F.concat(x["before"], lead))

    def free(x: Column) -> Column:
        core = F.btrim(F.regexp_extract(x["value"], CORE, 0), F.lit(MARKS))
        lead = F.call_function("substring_index", x["value"], core, F.lit(1))
        start = x["start"] + F.length(lead)
        kind = F.when(core.rlike(SECRET), F.lit(KINDS.index("secret")))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), pattern(x, lead).alias("pattern"), kind.alias("kind"))

    def seed(x: Column, hit: Column) -> Column:
        lead = F.substring(x["value"], F.lit(1), hit["start"] - x["start"])
        return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), hit["value"].alias("value"), pattern(x, lead).alias("pattern"), hit["kind"].alias("kind"))

    entities = F.filter(F.transform(words, entity), lambda x: x.isNotNull())
    counts = {f"n_{k}": F.size(k).cast("long") for k in KINDS[:-1]}
    base = F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return out.select("doc_id", F.xxhash64("text").alias("text_hash"), *(c.alias(k) for k, c in counts.items()), base.alias("base"), entities.alias("entities"))


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence): the patterns that the loop trusts in the end.

    ``seen``: pattern, value and kind (null if unknown) of every occurrence.
    A pattern scores the share of known identifiers of its commonest kind among
    those it precedes; an identifier scores the mean confidence of all patterns
    that precede it, those not trusted counting zero, so that a number that
    stands anywhere is not learned from one of its places.

    Patterns and values are only ever grouped with map-side sums; the graph and
    what it is joined with are written tables, so that a value or a pattern of
    very many links may be split.
    """
    graph = staged(seen.where("pattern <> ''").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-graph")
    seeds = graph.where("kind IS NOT NULL").select("value", F.struct(F.lit(1).alias("seed"), "kind").alias("at"))
    known = staged(seeds.groupBy("value").agg(F.max("at.kind").alias("kind")), "pii-known")

    def by_kind(amount: Column) -> Column:
        """The kind of the largest sum, the first of equal ones."""
        sums = (F.sum(F.when(F.col("kind") == k, amount).otherwise(F.lit(0.0))) for k in range(len(KINDS)))
        return F.array_max(F.array(*(F.struct(s.alias("sum"), F.lit(-k).alias("kind")) for k, s in enumerate(sums))))

    trusted = None
    for turn in range(rounds):
        marked = graph.select("pattern", "value").join(known, "value", "left")
        scores = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), by_kind(F.lit(1.0)).alias("best"))
        scores = scores.select("pattern", (-F.col("best.kind")).alias("kind"), (F.col("best.sum") / F.col("n")).alias("confidence"), F.col("best.sum").alias("hits"))
        trusted = staged(scores.where((F.col("hits") >= support) & (F.col("confidence") >= confidence)).drop("hits"), "pii-patterns")
        if turn + 1 < rounds:
            found = graph.select("pattern", "value").join(trusted, "pattern", "left")
            sure = found.groupBy("value").agg(F.count(F.lit(1)).alias("n"), by_kind(F.col("confidence")).alias("best"))
            new = sure.where(F.col("best.sum") / F.col("n") >= confidence).select("value", F.struct(F.lit(0).alias("seed"), (-F.col("best.kind")).alias("kind")).alias("at"))
            known = staged(seeds.unionByName(new).groupBy("value").agg(F.max("at").alias("at")).select("value", "at.kind"), "pii-known")
    return trusted


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and found: one row per row of ``docs``.

    base and found are arrays of (start, kind, end), kind an index of
    :data:`KINDS`; found are the spans that the method adds: the seeds
    of kind secret, and identifiers after a trusted pattern, where no base span lies.
    Added spans are parts of different words and do not overlap; base spans of
    different kinds may.  Null texts are empty and have no spans; rows repeated
    get equal results, and extra columns are passed over.
    """
    rows = staged(_occurrences(docs), "pii")
    seen = rows.select("doc_id", "text_hash", F.explode("entities").alias("e")).select("doc_id", "text_hash", "e.*")
    patterns = bootstrap(seen.select("pattern", "value", "kind"), rounds, support, confidence)
    secret = KINDS.index("secret")
    free = seen.where(F.col("kind").isNull() | (F.col("kind") == secret))
    named = free.join(patterns.select("pattern", F.col("kind").alias("learned")), "pattern", "left").where("learned IS NOT NULL OR kind IS NOT NULL")
    added = named.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", F.coalesce("kind", "learned").alias("kind"), "end")).alias("found"))
    added = added.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found")
    out = rows.drop("entities").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:-1]), "base", F.coalesce("found", empty).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`."""
    counts = [f"n_{k}" for k in KINDS[:-1]]
    return found.select("doc_id", *counts, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_added"))
