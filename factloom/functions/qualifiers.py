"""Qualifiers that change what a value means, and assumptions that a fact rests on."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.text import strip

#: Significant qualifiers and the keys that state them, in order.
SIGNIFICANT = {
    "basis": ("basis", "measurement_basis", "accounting_basis"),
    "currency": ("currency", "reporting_currency"),
    "audited": ("audited", "audit_status", "auditing_status"),
    "consolidation": ("consolidation", "consolidated", "consolidated_vs_standalone", "standalone_vs_consolidated", "consolidation_basis"),
    "forecast_vs_actual": ("forecast_vs_actual", "actual_vs_forecast", "actual_or_forecast", "estimate_vs_actual", "projection_vs_actual"),
    "asserting_party": ("asserting_party", "source", "reported_by", "publisher"),
    "scope": ("scope", "segment", "geography", "region"),
}
#: Values that mean the same.
SYNONYMS = {
    "consolidated": "consolidated", "consol": "consolidated", "standalone": "standalone", "unconsolidated": "standalone",
    "audited": "audited", "unaudited": "unaudited", "reviewed": "unaudited", "actual": "actual", "actuals": "actual",
    "forecast": "forecast", "forecasted": "forecast", "projected": "forecast", "projection": "forecast", "estimate": "forecast",
    "estimated": "forecast", "guidance": "forecast", "yes": "true", "no": "false", "true": "true", "false": "false",
}
#: What an assumption costs, and the least confidence.
PENALTY, FLOOR = 0.10, 0.05
FY_KINDS = ("fiscal_year", "quarter", "half", "multi_year")


def significant(qualifiers: Column) -> Column:
    """A map from significant qualifiers to their values; a null value reads `none`, a blank one is unstated."""
    entries = F.transform(
        F.coalesce(F.map_entries(qualifiers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.lower(strip(e["key"])).alias("key"), F.lower(strip(F.coalesce(e["value"], F.lit("None")))).alias("value")),
    )
    synonyms = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SYNONYMS.items()))

    def read(e: Column) -> Column:
        def of(key: str) -> Column:
            found = F.filter(e, lambda x: x["key"] == key)
            return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(found, lambda x: F.when(x["value"] != "", x["value"]))), -1)  # of keys that differ in case the last counts

        def stated(keys: tuple[str, ...]) -> Column:
            return let(F.coalesce(*map(of, keys)), lambda first: F.coalesce(F.try_element_at(synonyms, first), first))

        pairs = F.array(*[F.struct(F.lit(name).alias("key"), stated(keys).alias("value")) for name, keys in SIGNIFICANT.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    return let(entries, read)


def differing(a: Column, b: Column) -> Column:
    """Names, in order, of significant qualifiers that both state and that differ; a and b are what significant gives."""
    names = F.array(*[F.lit(n) for n in sorted(SIGNIFICANT)])
    return F.filter(names, lambda n: F.coalesce(F.try_element_at(a, n) != F.try_element_at(b, n), F.lit(False)))


def assumptions(fact_kind: Column, entity_resolved: Column, comparator: Column, p: Column) -> Column:
    """Flags of a fact, in a fixed order; p is what `period` gives of its label."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(entity_resolved, F.lit(False)), "entity_inferred"),
            F.when((fact_kind == "quantitative") & (F.coalesce(comparator, F.lit("")) == ""), "comparator_unspecified"),
            F.when(p["convention_assumed"] & p["kind"].isin(*FY_KINDS), "fy_convention_assumed"),
        )
    )


def penalised(confidence: Column, flags: Column) -> Column:
    return F.when(F.size(flags) == 0, confidence).otherwise(F.greatest(F.lit(FLOOR), confidence - PENALTY * F.size(flags)))
