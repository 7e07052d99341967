"""The precheck: a rule table that decides about a pair of facts without a model.

Facts are normalised once each, before pairs are made; the rules then only compare columns.

Most pairs of a block do not meet in time. `open_pairs` never makes them: periods are laid over slots of time, facts meet in
the first slot that both are in, and what cannot be compared is left out by the join itself. `outcome_counts` makes no pair of
facts of a large block at all: facts that the rules cannot tell apart but for their interval are one class with a number, classes
meet by slots, and pairs of intervals that lie apart are counted by running totals over their ends.

Both do so for large blocks only. Facts of a block of up to SMALL meet directly, in one shuffle in which each fact is one row:
slots would copy it several times for a few pairs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.comparators import overlaps
from factloom.functions.periods import relation
from factloom.functions.qualifiers import differing, significant
from factloom.functions.text import norm
from factloom.operators.normalise import by_dictionary, with_period, with_value
from factloom.operators.running import running
from factloom.sources.shared import durable

#: Facts of a block that meet in one part, about; and up to how many large blocks their sizes are broadcast.
BLOCK, MOST_BROADCAST = 2000, 100_000
#: Facts of a block that meet without slots or classes.
SMALL = 200
#: Days of a slot of time; a period is in each slot that it touches.
SLOT = 120
BLOCKED = ["project_id", "kind", "e", "t"]
CONCRETE = ("currency", "percent", "mass", "length", "area", "duration", "ratio")


def _name(facts: DataFrame, c: str) -> Column:
    return norm(F.coalesce(F.col(f"canonical_{c}"), F.col(c)) if f"canonical_{c}" in facts.columns else F.col(c))


def comparable(facts: DataFrame) -> DataFrame:
    """facts with `cmp`, all that the rules need of a fact.

    Columns read: fact_kind, entity, attribute, value, period, qualifiers, entity_resolved and, if
    they are there, canonical_entity, canonical_attribute and written (as in value_interval).
    """
    label = F.col("period.raw_label")
    staged = with_value(with_period(facts, label, "_period"), F.col("fact_kind"), "value", "_value", F.col("written") if "written" in facts.columns else None)
    stated = F.array_sort(F.map_entries("qualifiers"))
    staged = by_dictionary(staged, stated, lambda e: significant(F.map_from_entries(e)), "_stated")
    return staged.withColumn(
        "cmp",
        F.struct(
            F.col("fact_kind").alias("kind"),
            _name(facts, "entity").alias("entity"),
            _name(facts, "attribute").alias("attribute"),
            F.col("_period").alias("period"),
            norm(label).alias("label"),
            F.col("_stated").alias("qualifiers"),
            F.col("_value").alias("value"),
            F.coalesce(F.col("entity_resolved"), F.lit(True)).alias("resolved"),
        ),
    ).drop("_period", "_value", "_stated")


def decide(a: Column, b: Column) -> Column:
    """A struct: outcome, reason, differing; a and b are what `comparable` gives. The first rule that holds decides."""
    va, vb = a["value"], b["value"]
    lies = relation(a["period"], b["period"])
    differ = differing(a["qualifiers"], b["qualifiers"])
    none = F.array().cast("array<string>")

    def out(outcome: str, reason, names: Column = none) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), names.alias("differing"))

    def agree(reason: str) -> Column:
        return F.when(a["resolved"] & b["resolved"], out("corroborates", reason)).otherwise(out("needs_adjudication", "an entity was inferred, not stated"))

    da, db = va["dimension"], vb["dimension"]
    open_a, open_b = da == "unknown", db == "unknown"
    other = F.when(open_a, db).otherwise(da)
    return (
        F.when(a["kind"] != b["kind"], out("not_comparable", "different kinds"))
        .when(a["entity"] != b["entity"], out("not_comparable", "different entities"))
        .when(a["attribute"] != b["attribute"], out("not_comparable", "different attributes"))
        .when(lies == "disjoint", out("not_comparable", "periods do not meet"))
        .when(lies.isin("a_contains_b", "b_contains_a", "overlap"), out("needs_adjudication", "periods meet but differ"))
        .when((lies == "unknown") & (a["label"] != b["label"]), out("needs_adjudication", "period labels differ and are not resolved"))
        .when(F.size(differ) > 0, out("needs_adjudication", F.concat(F.lit("significant qualifiers differ: "), F.array_join(differ, ", ")), differ))
        .when((a["kind"] == "status") & (va["state"] != "") & (va["state"] == vb["state"]), agree("same status"))
        .when(a["kind"] == "status", out("needs_adjudication", "status values differ"))
        .when(a["kind"] == "qualitative", out("needs_adjudication", "qualitative claims"))
        .when(~(va["comparable"] & vb["comparable"]), out("needs_adjudication", "a value is no interval"))
        .when((da != db) & (open_a | open_b) & other.isin(*CONCRETE), out("not_comparable", "one unit is unknown, the other is concrete"))
        .when((da != db) & (open_a | open_b), out("needs_adjudication", "one unit is unknown"))
        .when(da != db, out("not_comparable", "different dimensions"))
        .when(open_a, out("needs_adjudication", "both units are unknown"))
        .when((da == "currency") & (va["currency"] != vb["currency"]), out("needs_adjudication", "different currencies"))
        .when(overlaps(va["interval"], vb["interval"]), agree("intervals overlap"))
        .otherwise(out("needs_adjudication", "intervals do not overlap"))
    )


def detail(a: Column, b: Column) -> Column:
    """What the deciding rule of `decide` looked at, by name; empty where nothing but the reason is to be told."""
    va, vb = a["value"], b["value"]
    lies = relation(a["period"], b["period"])
    differ = differing(a["qualifiers"], b["qualifiers"])
    both = lambda name, x, y: (F.lit(f"{name}_a"), x.cast("string"), F.lit(f"{name}_b"), y.cast("string"))
    # The map has a name for each value that is there.
    told = lambda *parts: F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull())
    stated = lambda q, side: F.transform(differ, lambda n: F.struct(F.concat(n, F.lit(side)).alias("key"), q[n].alias("value")))
    ends = lambda i, side: (F.lit(f"low_{side}"), i["low"].cast("string"), F.lit(f"high_{side}"), i["high"].cast("string"))
    return (
        F.when(a["kind"] != b["kind"], told(*both("kind", a["kind"], b["kind"])))
        .when(a["entity"] != b["entity"], told(*both("entity", a["entity"], b["entity"])))
        .when(a["attribute"] != b["attribute"], told(*both("attribute", a["attribute"], b["attribute"])))
        .when((lies == "disjoint") | lies.isin("a_contains_b", "b_contains_a", "overlap") | ((lies == "unknown") & (a["label"] != b["label"])), told(F.lit("relation"), lies, *both("period", a["label"], b["label"])))
        .when(F.size(differ) > 0, F.map_from_entries(F.concat(stated(a["qualifiers"], "_a"), stated(b["qualifiers"], "_b"))))
        .when(a["kind"] == "status", told(*both("state", va["state"], vb["state"])))
        .when(a["kind"] == "qualitative", told(*both("text", va["text"], vb["text"])))
        .when(va["dimension"] != vb["dimension"], told(*both("dimension", va["dimension"], vb["dimension"])))
        .when((va["dimension"] == "currency") & (va["currency"] != vb["currency"]), told(*both("currency", va["currency"], vb["currency"])))
        .otherwise(told(*ends(va["interval"], "a"), *ends(vb["interval"], "b"), *both("entity_resolved", a["resolved"], b["resolved"])))
    )


def _ready(facts: DataFrame, key: str) -> DataFrame:
    """id, cmp and the block of each fact, normalised."""
    return comparable(facts).select(F.col(key).alias("id"), "cmp", "project_id", F.col("cmp.kind").alias("kind"), F.col("cmp.entity").alias("e"), F.col("cmp.attribute").alias("t"))


def _by_size(facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of facts id_a < id_b of small blocks, with project_id, cmp_a and cmp_b; what _ready gives of large ones, kept, or None)."""
    ready = _ready(facts, key).withColumn("block", F.xxhash64(*BLOCKED))
    # Counted by a hash, so that few bytes are shuffled; blocks that share one count as one, and are small or large together.
    blocks = facts.select(F.xxhash64("project_id", "fact_kind", _name(facts, "entity"), _name(facts, "attribute")).alias("block"))
    large = durable(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select("block"))
    many = large.count()
    known = F.broadcast(large) if many <= MOST_BROADCAST else large
    rows = (ready.join(known, "block", "left_anti") if many else ready).select("block", "project_id", "id", "cmp")
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in ("project_id", "cmp.kind", "cmp.entity", "cmp.attribute"))
    # Both sides are one frame under two names, so that it is shuffled once.
    met = rows.alias("a").join(rows.alias("b").hint("merge"), F.expr(f"a.block = b.block AND a.id < b.id AND {same}"))
    pairs = met.select("a.project_id", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("id", "cmp")])
    return pairs, durable(ready.join(known, "block", "left_semi").drop("block")) if many else None


def _met(left: DataFrame, right: DataFrame, block: list[str], sides: tuple[str, str]) -> DataFrame:
    """Rows of left and right that share a block; a block of many rows is cut into parts, and each pair of parts meets apart."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def parted(rows: DataFrame, own: str, named: str, side: str) -> DataFrame:
        hot = durable(rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(named)).where(F.col(named) > 1))
        many = hot.count()
        cut = rows.join(F.broadcast(hot) if many <= MOST_BROADCAST else hot, block, "left").na.fill(1, [named]) if many else rows.withColumn(named, F.lit(1))
        kept = [F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in block]
        return cut.select(*block, *kept, F.pmod(F.xxhash64("id"), F.col(named)).cast("int").alias(own), named), hot if many else None

    a, hot_a = parted(left, "row", "rows", sides[0])
    b, hot_b = parted(right, "col", "cols", sides[1])
    if hot_b is not None:
        a = a.join(hot_b, block, "left").na.fill(1, ["cols"])
    if hot_a is not None:
        b = b.join(hot_a, block, "left").na.fill(1, ["rows"])
    cols, rows = (every("cols") if hot_b is not None else F.lit(0)), (every("rows") if hot_a is not None else F.lit(0))
    return a.withColumn("col", cols).drop("rows", "cols").join(b.withColumn("row", rows).drop("rows", "cols"), [*block, "row", "col"]).drop("row", "col")


def pairs_in_blocks(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """Pairs a < b of facts with the same kind, entity, attribute and project, decided, those that are not comparable too.

    Other pairs are not comparable by the first three rules, so no outcome but that is lost.
    """
    ready = durable(_ready(facts, key))
    # The conditions are computed once, so that the rules read columns.
    joined = _met(ready, ready, BLOCKED, ("a", "b")).where("id_a < id_b")
    return joined.withColumn("check", decide(F.col("cmp_a"), F.col("cmp_b"))).select("project_id", F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b"), "check.*")


def _slots(rows: DataFrame) -> DataFrame:
    """rows once for each slot of time that their period touches; first is the first of them."""
    at = lambda c: F.floor(F.datediff(F.col(f"cmp.period.{c}"), F.lit("1970-01-01").cast("date")) / SLOT)
    return rows.withColumn("first", at("start_date")).withColumn("slot", F.explode(F.sequence(F.col("first"), F.greatest("first", at("end_date")))))


def _dated() -> Column:
    return F.col("cmp.period.start_date").isNotNull() & F.col("cmp.period.end_date").isNotNull()


def _not_apart(a: str, b: str) -> Column:
    """In the first slot that both are in: their periods meet."""
    day = lambda s, c: F.col(f"cmp_{s}.period.{c}")
    return (F.col("slot") == F.greatest(f"first_{a}", f"first_{b}")) & (day(a, "start_date") <= day(b, "end_date")) & (day(b, "start_date") <= day(a, "end_date"))


def open_pairs(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """The pairs of pairs_in_blocks that corroborate or need adjudication; no other pair becomes a row."""
    pairs, ready = _by_size(facts, key)
    both = pairs.where(_may_meet())
    if ready is not None:
        both = both.unionByName(_large_pairs(ready))
    checked = both.withColumn("check", decide(F.col("cmp_a"), F.col("cmp_b"))).where("check.outcome <> 'not_comparable'")
    return checked.select("project_id", F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b"), "check.*")


def _may_meet() -> Column:
    """Not both known and apart."""
    day = lambda s, c: F.col(f"cmp_{s}.period.{c}_date")
    apart = lambda a, b: (day(a, "end") < day(b, "start")) & day(a, "start").isNotNull() & day(b, "end").isNotNull()
    return ~F.coalesce(apart("a", "b") | apart("b", "a"), F.lit(False))


def _large_pairs(ready: DataFrame) -> DataFrame:
    """project_id, id_a, cmp_a, id_b, cmp_b of facts of large blocks that are not apart in time."""
    slots = _slots(ready.where(_dated()))
    dated = _met(slots, slots, [*BLOCKED, "slot"], ("a", "b")).where((F.col("id_a") < F.col("id_b")) & _not_apart("a", "b")).select("project_id", "id_a", "cmp_a", "id_b", "cmp_b")
    # A period that is not known meets every other.
    undated = _met(ready.where(~_dated()), ready, BLOCKED, ("u", "x"))
    u, x = F.struct(F.col("id_u").alias("id"), F.col("cmp_u").alias("cmp")), F.struct(F.col("id_x").alias("id"), F.col("cmp_x").alias("cmp"))
    known = F.col("cmp_x.period.start_date").isNotNull() & F.col("cmp_x.period.end_date").isNotNull()
    up = F.col("id_u") < F.col("id_x")
    told = undated.where(up | (known & (F.col("id_x") < F.col("id_u")))).select("project_id", F.when(up, u).otherwise(x).alias("p"), F.when(up, x).otherwise(u).alias("q"))
    return dated.unionByName(told.select("project_id", F.col("p.id").alias("id_a"), F.col("p.cmp").alias("cmp_a"), F.col("q.id").alias("id_b"), F.col("q.cmp").alias("cmp_b")))


def _intervals_apart(ready: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, apart: how many pairs of facts of the two classes of each pair have intervals without a common value.

    Of two such intervals one ends before the other begins, so these are, for each begin, the ends before it. At one
    value an open end comes before a closed begin, that before a closed end, and that before an open begin.
    """
    ends = ready.where("cmp.value.comparable").join(classes.select(*_CLASS_KEYS, "c"), _CLASS_KEYS).select("c", F.col("cmp.value.interval").alias("i"))
    place = F.explode(
        F.array(
            F.struct(F.col("i.low").alias("at"), F.when(F.col("i.low_closed"), 1).otherwise(3).alias("turn"), F.lit(0).alias("ends"), F.lit(1).alias("begins")),
            F.struct(F.col("i.high").alias("at"), F.when(F.col("i.high_closed"), 2).otherwise(0).alias("turn"), F.lit(1).alias("ends"), F.lit(0).alias("begins")),
        )
    )
    counted = ends.select("c", place.alias("p")).groupBy("c", "p.at", "p.turn").agg(F.sum("p.ends").alias("ends"), F.sum("p.begins").alias("begins"))
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("c_a", "c_b"))).alias("c"), "c_a", "c_b")
    side = lambda c, s: F.when(F.col("c") == F.col(f"c_{s}"), F.col(c)).otherwise(0)
    events = counted.join(sides, "c").groupBy("pair", "at", "turn").agg(
        F.sum(side("ends", "a")).alias("ends_a"), F.sum(side("begins", "a")).alias("begins_a"), F.sum(side("ends", "b")).alias("ends_b"), F.sum(side("begins", "b")).alias("begins_b"),
        F.first(F.col("c_a") == F.col("c_b")).alias("same"),
    )
    passed = running(events, ["pair"], ["at", "turn"], {"passed_a": "ends_a", "passed_b": "ends_b"})
    return passed.groupBy("pair").agg(F.sum(F.col("begins_b") * F.col("passed_a") + F.when(F.col("same"), 0).otherwise(F.col("begins_a") * F.col("passed_b"))).alias("apart"))


#: What tells facts of a block apart for the rules, but for the interval.
_CLASS = {
    "start": "cmp.period.start_date", "end": "cmp.period.end_date", "label": "cmp.label", "dimension": "cmp.value.dimension", "currency": "cmp.value.currency",
    "state": "cmp.value.state", "comparable": "cmp.value.comparable", "resolved": "cmp.resolved",
}
_CLASS_KEYS = [*BLOCKED, "class"]


def outcome_counts(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """project_id, outcome, reason, n: the pairs of pairs_in_blocks, counted; those of large blocks without a row for any of them."""
    pairs, ready = _by_size(facts, key)
    checked = pairs.withColumn("check", decide(F.col("cmp_a"), F.col("cmp_b")))
    small = checked.groupBy("project_id", "check.outcome", "check.reason").agg(F.count(F.lit(1)).alias("n"))
    if ready is None:
        return small
    return small.unionByName(_large_counts(ready)).groupBy("project_id", "outcome", "reason").agg(F.sum("n").alias("n"))


def _large_counts(ready: DataFrame) -> DataFrame:
    """What outcome_counts gives, of facts of large blocks.

    Rows that share a key are no pair. A key names one fact, so there are few of them, and these are made and taken off.
    """
    stated = F.array_sort(F.map_entries("cmp.qualifiers"))
    named = F.struct(*[F.col(c).alias(n) for n, c in _CLASS.items()], stated.alias("qualifiers"))
    # A string, so that classes with nulls are equal too.
    ready = durable(ready.withColumn("at", F.monotonically_increasing_id()).withColumn("class", F.sha2(F.to_json(F.struct(named.alias("k"))), 256)))
    # Any interval will do for the rules up to the last one, which is counted apart.
    point = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(True).alias("low_closed"), F.lit(True).alias("high_closed"))
    one = F.any_value("cmp").alias("cmp")
    classes = ready.groupBy(*_CLASS_KEYS).agg(F.count(F.lit(1)).alias("n"), one)
    classes = durable(classes.withColumn("cmp", F.col("cmp").withField("value.interval", point)).withColumn("c", F.monotonically_increasing_id()).withColumn("id", F.col("c")))
    slots = _slots(classes.where(_dated()))
    columns = [*BLOCKED, *(f"{c}_{s}" for s in "ab" for c in ("c", "n", "cmp"))]
    dated = _met(slots, slots, [*BLOCKED, "slot"], ("a", "b")).where((F.col("c_a") < F.col("c_b")) & _not_apart("a", "b")).select(*columns)
    undated = _met(classes.where(~_dated()), classes, BLOCKED, ("a", "b"))
    known = F.col("cmp_b.period.start_date").isNotNull() & F.col("cmp_b.period.end_date").isNotNull()
    undated = undated.where((F.col("c_a") < F.col("c_b")) | (known & (F.col("c_a") != F.col("c_b")))).select(*columns)
    inside = classes.where("n > 1").select(*BLOCKED, *[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("c", "n", "cmp")])
    weight = F.when(F.col("c_a") == F.col("c_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    met = dated.unionByName(undated).unionByName(inside).withColumn("check", decide(F.col("cmp_a"), F.col("cmp_b")))
    by_value = (F.col("kind") == "quantitative") & F.col("check.reason").isin("intervals overlap", "an entity was inferred, not stated")
    met = durable(met.select("project_id", "c_a", "c_b", weight.alias("n"), "check.outcome", "check.reason", by_value.alias("by_value")).withColumn("pair", F.monotonically_increasing_id()))
    apart = _intervals_apart(ready, classes, met.where("by_value")).withColumnRenamed("apart", "_apart")
    split = met.where("by_value").join(apart, "pair", "left").withColumn("_apart", F.coalesce("_apart", F.lit(0)))
    parts = [
        met.where("NOT by_value").select("project_id", "outcome", "reason", "n"),
        split.select("project_id", "outcome", "reason", (F.col("n") - F.col("_apart")).alias("n")),
        split.select("project_id", F.lit("needs_adjudication").alias("outcome"), F.lit("intervals do not overlap").alias("reason"), F.col("_apart").alias("n")),
        # All pairs, less those that meet: the rest is apart in time.
        classes.groupBy(*BLOCKED).agg(F.sum("n").alias("n")).select("project_id", F.lit("not_comparable").alias("outcome"), F.lit("periods do not meet").alias("reason"), F.expr("n * (n - 1) div 2").alias("n")),
        met.select("project_id", F.lit("not_comparable").alias("outcome"), F.lit("periods do not meet").alias("reason"), (-F.col("n")).alias("n")),
    ]
    own = [*BLOCKED, "id"]
    again = ready.join(ready.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*own), own)
    side = lambda s: again.select(*own, F.col("cmp").alias(f"cmp_{s}"), F.col("at").alias(f"at_{s}"))
    same = side("a").join(side("b"), own).where("at_a < at_b").withColumn("check", decide(F.col("cmp_a"), F.col("cmp_b")))
    parts.append(same.select("project_id", "check.outcome", "check.reason", F.lit(-1).cast("long").alias("n")))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("project_id", "outcome", "reason").agg(F.sum("n").alias("n")).where("n > 0")
