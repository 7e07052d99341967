"""Repairs of extracted facts: comparators that the text around a figure states, and corrections of a verifier."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_figure
from factloom.functions.values import plain_number

#: Cues in the order in which they are tried.
CUES = (
    ("lte", r"\bno more than\b"), ("lte", r"\bup to\b"), ("gte", r"\bat least\b"), ("lte", r"\bat most\b"), ("gt", r"\bmore than\b"), ("gt", r"\bgreater than\b"),
    ("lt", r"\bless than\b"), ("lt", r"\bfewer than\b"), ("gt", r"\bover\b"), ("lt", r"\bunder\b"), ("gt", r"\bexceed(?:s|ed|ing)?\b"),
    ("approx", r"\b(?:approximately|approx\.?|about|around|roughly|nearly|circa)\b"), ("approx", r"~\s*\d"),
)
#: How far a clause reaches from its figure, and where it ends before.
LEFT, RIGHT, ENDS = 24, 16, ";:.()[]{}–—,"
#: Comparators by name, and words for them in the order in which they are tried.
NAMES = ("eq", "approx", "gt", "gte", "lt", "lte", "range")
WORDS = (
    ("greater than", "gt"), ("more than", "gt"), ("over", "gt"), ("at least", "gte"), ("less than", "lt"), ("under", "lt"), ("at most", "lte"),
    ("up to", "lte"), ("about", "approx"), ("approximately", "approx"), ("around", "approx"), ("exact", "eq"), ("exactly", "eq"),
)
#: Fields that may be corrected, with the longest text.
CORRECTABLE = {
    "value.number": None, "value.number_high": None, "value.unit": 40, "value.comparator": None, "value.state": None, "value.text": None,
    "entity": 120, "attribute": 120, "period": 60, "period.raw_label": 60,
}


def written_forms(number: Column) -> Column:
    """How a figure may be written, the longest first: plain, with grouped thousands, with two places."""
    n = F.abs(number)
    grouped = F.concat(F.format_number(F.floor(n), 0), F.regexp_extract(plain_number(n), r"\.\d+$", 0))
    places = F.format_number(n, 2)
    forms = F.when(n == F.floor(n), F.array(plain_number(n), grouped)).otherwise(F.array(plain_number(n), grouped, F.replace(places, F.lit(","), F.lit("")), places))
    ordered = F.sort_array(F.transform(F.array_distinct(forms), lambda f: F.struct((-F.length(f)).alias("size"), f.alias("form"))))
    return F.when(n < float("inf"), F.transform(ordered, lambda x: x["form"]))


def clause_around(evidence: Column, number: Column) -> Column:
    """What stands around the first place of the longest form that is found, up to the ends of its clause; else null.

    A figure at the very end, or with a digit, point or comma behind it, counts as not found; so does one with a
    digit before it.
    """
    ends = "".join("\\" + c for c in ENDS)
    # Only forms that are there are looked for, as a pattern is made for each; what is before and behind is cut by fixed patterns.
    place = lambda form: F.regexp_instr(evidence, F.concat(F.lit("(?<!\\p{Nd})\\Q"), form, F.lit("\\E(?=[^\\p{Nd}.,])")))
    places = F.transform(written_forms(number), lambda form: F.when(F.contains(evidence, form), F.struct(form.alias("form"), place(form).alias("at"))))
    first = F.filter(places, lambda p: p["at"] > 0)

    def cut(p: Column) -> Column:
        left = evidence.substr(F.greatest(p["at"] - LEFT, F.lit(1)), F.least(p["at"] - 1, F.lit(LEFT)))
        right = evidence.substr(p["at"] + F.length(p["form"]), F.lit(RIGHT))
        return F.concat(F.regexp_replace(left, f"(?s)^.*[{ends}]", ""), p["form"], F.regexp_replace(right, f"(?s)[{ends}].*", ""))

    return F.get(F.transform(F.slice(first, 1, 1), cut), 0)


def cue(text: Column) -> Column:
    """The comparator that a clause states, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CUES):
        out = F.when(F.rlike(text, F.lit("(?i)" + pattern)), name).otherwise(out)
    return out


def repair_comparators(facts: DataFrame) -> DataFrame:
    """facts with comparators that their evidence states in place of eq or none, and `repaired`.

    Only figures without a comparator or with eq are looked at, and of these only those whose
    evidence holds a cue at all. The rows are read once, and each clause is cut once, however many cues are tried on it.
    """
    value = F.col("value")
    open_ = (F.col("fact_kind") == "quantitative") & (value["comparator"].isNull() | (value["comparator"] == "eq"))
    hinted = open_ & F.rlike("evidence_text", F.lit("(?i)" + "|".join(pattern for _, pattern in CUES)))
    clause = F.coalesce(clause_around(F.col("evidence_text"), F.col("value.number").cast("double")), F.col("evidence_text"))
    # Cues are tried on a column: an expression would be worked out anew for each.
    found = facts.withColumn("_clause", F.when(hinted, clause)).withColumn("_cue", cue(F.col("_clause")))
    new = F.coalesce(F.col("_cue"), value["comparator"], F.when(F.col("fact_kind") == "quantitative", "eq"))
    return found.withColumn("value", value.withField("comparator", new)).withColumn("repaired", F.col("_cue").isNotNull()).drop("_clause", "_cue")


def read_comparator(text: Column) -> Column:
    """A comparator by its name, or by the first word for one that a text holds."""
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for word, name in reversed(WORDS):
        out = F.when(F.contains(low, F.lit(word)), name).otherwise(out)
    return F.when(low.isin(*NAMES), low).otherwise(out)


def safe_correction(issues: Column) -> Column:
    """The first of a verifier's issues (field, problem, suggested_correction) that can be applied, or null: field, text, number."""
    made = F.transform(
        issues, lambda i: F.struct(F.lower(F.trim(i["field"])).alias("field"), F.trim(F.coalesce(i["suggested_correction"], F.lit(""))).alias("text"))
    )

    def fits(i: Column) -> Column:
        ok = F.lit(False)
        for field, longest in CORRECTABLE.items():
            good = i["text"] != ""
            if longest:
                good = good & (F.length(i["text"]) <= longest)
            if field.startswith("value.number"):
                good = good & parse_figure(i["text"]).isNotNull()
            if field == "value.comparator":
                good = good & read_comparator(i["text"]).isNotNull()
            ok = ok | ((i["field"] == field) & good)
        return ok

    first = F.get(F.filter(made, fits), 0)
    return F.when(first.isNotNull(), F.struct(first["field"].alias("field"), first["text"].alias("text"), parse_figure(first["text"]).alias("number")))


def apply_correction(facts: DataFrame, correction: str = "correction") -> DataFrame:
    """facts with the one field changed that the correction names."""
    c, v = F.col(correction), F.col("value")
    pick = lambda field, new, old: F.when(c["field"] == field, new).otherwise(old)
    value = v
    for name, new in (("number", c["number"]), ("number_high", c["number"]), ("unit", c["text"]), ("comparator", read_comparator(c["text"])), ("state", c["text"]), ("text", c["text"])):
        value = value.withField(name, pick(f"value.{name}", new, v[name]))
    label = F.when(c["field"].isin("period", "period.raw_label"), c["text"]).otherwise(F.col("period.raw_label"))
    return facts.withColumns({"value": value, "entity": pick("entity", c["text"], F.col("entity")), "attribute": pick("attribute", c["text"], F.col("attribute")), "period": F.col("period").withField("raw_label", label)})
