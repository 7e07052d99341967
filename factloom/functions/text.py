"""Text forms: stripping, collapsing, grounding and anchoring forms, token estimates.

White space is Unicode's, so no-break spaces count, as in most text sources.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

#: What a rough token is, and how many of them a chunk carries over.
CHARS_PER_TOKEN, CARRY_TOKENS = 4, 175
#: Characters that grounding reads as others, and those it drops.
GROUNDING_FROM = "‘’‚‛“”–—−  "
GROUNDING_TO = "''''\"\"---  "
GROUNDING_DROPPED = "​‌‍﻿"
#: The fewer ones that anchoring reads as others.
ANCHORING_FROM, ANCHORING_TO = "‘’“”–—", "''\"\"--"
#: Fixed value: Unicode's white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # Single spaces, which are most runs, need no replacing.
    return F.trim(F.regexp_replace(text, r"(?U)\s\s+|[^\S ]", " "))


def norm(text: Column) -> Column:
    """Collapsed and lower-cased; null is empty."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def grounding_form(text: Column) -> Column:
    """Hyphenation at line ends undone, typographic characters made plain, collapsed, lower-cased."""
    joined = F.regexp_replace(text, "-[ \\t]*\\n[ \\t]*", "")
    odd = F.lit(f"[{GROUNDING_FROM.replace(' ', '')}{GROUNDING_DROPPED}]")
    plain = lambda t: F.translate(F.translate(t, GROUNDING_FROM, GROUNDING_TO), GROUNDING_DROPPED, "")
    # Characters are looked up one by one only in texts that have such.
    return let(joined, lambda t: F.lower(collapse(F.when(F.rlike(t, odd), plain(t)).otherwise(t))))


def anchoring_form(text: Column) -> Column:
    """Six typographic characters made plain, collapsed, lower-cased."""
    return F.lower(collapse(F.translate(text, ANCHORING_FROM, ANCHORING_TO)))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def tail(text: Column, tokens: int = CARRY_TOKENS) -> Column:
    """The last tokens of a text, from a word's beginning on where it is cut."""
    n = tokens * CHARS_PER_TOKEN
    last = F.right(text, F.lit(n))
    at = F.instr(last, F.lit(" "))
    return F.when(F.length(text) <= n, strip(text)).otherwise(strip(F.when(at > 0, last.substr(at + 1, F.length(last))).otherwise(last)))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def grounding(evidence: Column, source: Column) -> Column:
    """passed and reason for an evidence text against the source it is said to be from.

    Fixed limits: four letters or digits at least; a part under 24 characters may occur four times at most.
    """
    reason = lambda e, s: (
        F.when(~F.rlike(e, F.lit(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){4}")), "too short")
        .when(~F.contains(s, e), "not in source")
        .when((F.length(e) < 24) & (occurrences(s, e) > 4), "too generic")
    )
    judged = lambda r: F.struct(r.isNull().alias("passed"), r.alias("reason"))
    forms = F.struct(grounding_form(F.coalesce(evidence, F.lit(""))).alias("e"), grounding_form(F.coalesce(source, F.lit(""))).alias("s"))
    # Bound, as the forms would otherwise be made anew for each rule.
    return let(let(forms, lambda f: reason(f["e"], f["s"])), judged)


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else."""
    read = F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT"))
    return F.coalesce(read & F.endswith(strip(text), F.lit("}")), F.lit(False))  # what follows an object is not read
