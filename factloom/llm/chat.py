"""Chat formatting: typed content parts, ordered placeholders, a reversible template and its loss mask.

A message holds parts of a kind: text, image, audio or document. One pass visits them in order.
Text parts that stand side by side are one text, which is joined before it is escaped, so that no
control string comes about where they meet. Every other part gives a placeholder that carries its
ordinal in the conversation, and an attachment record with the tokens it will expand to.

Inside texts a backslash is doubled and `<|` becomes `<\\|`, so no text can hold a control
string, and reading back undoes it exactly. A new line in a role becomes `<\\n>`.

Defined results: a null text is empty, a null role is empty, null parts are no parts; messages
with the same turn come in the order of role, then parts; a null turn comes first; a null
conversation id is a conversation; repeated rows are repeated messages. Other columns are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.binding import let

START, END = "<|im_start|>", "<|im_end|>"
#: A part: units is what its size is counted in (pixels by pixels, seconds, pages).
PARTS = "array<struct<kind:string,text:string,ref:string,width:double,height:double,units:double>>"
#: Tokens that an attachment expands to: per 28 x 28 pixel patch, per second, per page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 768
#: Code points of the blocks that a text is cut into to find places in it.
BLOCK = 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def as_parts(text: Column) -> Column:
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            null.cast("string").alias("ref"),
            null.cast("double").alias("width"),
            null.cast("double").alias("height"),
            null.cast("double").alias("units"),
        )
    ).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment stands for; 0 for a text, 1 at least for an attachment of unknown size."""
    size = (
        F.when(part["kind"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["kind"] == "audio", F.ceil(part["units"] * PER_SECOND))
        .when(part["kind"] == "document", F.ceil(part["units"] * PER_PAGE))
    )
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", F.lit(0).cast("long")).otherwise(
        F.greatest(F.coalesce(size.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    )


def _bodies(parts: Column, before: Column) -> Column:
    """The text of a message: neighbouring text parts joined and then escaped, and a placeholder for each other part.

    before is the number of attachments of the turns before. Each part is looked at once, however many there are.
    """
    others = F.filter(F.transform(parts, lambda p, i: F.when(~_is_text(p), i)), lambda i: i.isNotNull())

    def joined(at: Column) -> Column:
        # from: the place after the attachment before; to: the place of the next one, or the end
        start = lambda j: F.coalesce(F.get(at, j - 1) + 1, F.lit(0))
        end = lambda j: F.coalesce(F.get(at, j), F.size(parts))
        texts = lambda j: F.transform(F.slice(parts, start(j) + 1, end(j) - start(j)), lambda p: F.coalesce(p["text"], F.lit("")))
        mark = lambda j: F.coalesce(
            F.concat(F.lit("<|"), escape_role(F.get(parts, F.get(at, j))["kind"]), F.lit(":"), (before + j).cast("string"), F.lit("|>")), F.lit("")
        )
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), lambda j: F.concat(escape(F.array_join(texts(j), "")), mark(j))), "")

    return let(others, joined)


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def format_conversations(
    messages: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """One row per conversation: key, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans are start (from 0) and end of each assistant text in code points of formatted.
    attachments are ordinal (from 0), turn_index (from 0), kind, ref and tokens, in order.

    Turns, attachments and offsets are counted by running sums over a conversation's rows, so the
    work grows with its length; all of it moves by the key once.
    """
    kept = messages.select(
        F.col(key).alias("k"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts"),
    )
    in_order = W.partitionBy("k").orderBy("turn", "role", "parts")
    found = F.transform(F.filter("parts", lambda p: ~_is_text(p)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    counted = kept.withColumn("found", found).select(
        "k",
        "role",
        "parts",
        "found",
        (F.row_number().over(in_order) - 1).alias("at"),
        F.coalesce(F.sum(F.size("found")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("before"),
    )
    tail = END + "\n"
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    written = counted.select(
        "k",
        "at",
        head.alias("head"),
        _bodies(F.col("parts"), F.col("before")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
        F.transform(
            "found", lambda a, i: F.struct((F.col("before") + i).alias("ordinal"), F.col("at").alias("turn_index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ).alias("attachments"),
    )
    long = lambda c: F.length(c).cast("long")
    so_far = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(long("head") + long("body") + len(tail)).over(so_far), F.lit(0)) + long("head")
    placed = written.withColumn("start", start).select(
        "k",
        F.struct(
            "at",
            F.concat("head", "body", F.lit(tail)).alias("piece"),
            F.when(F.col("loss"), F.struct("start", (F.col("start") + long("body")).alias("end"))).alias("span"),
            "attachments",
        ).alias("m"),
    )
    whole = placed.groupBy("k").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return whole.select(
        F.col("k").alias(key),
        F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"),
        F.filter(F.transform("ms", lambda m: m["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m: m["attachments"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ms", lambda m: m["attachments"])), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: role and unescaped text, in order."""
    heads = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))
    return F.transform(
        heads,
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(
                s.substr(
                    F.length(F.substring_index(s, "\n", 1)) + 2,
                    F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(END + "\n"),
                )
            ).alias("text"),
        ),
    )


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    The text is cut into blocks first, as a place in a long one is only found by counting from its start.
    """
    pattern = F.lit("(?s).{1,%d}" % BLOCK)

    def cut(blocks: Column) -> Column:
        def of(s: Column) -> Column:
            first = F.floor(s["start"] / BLOCK).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, (F.floor(s["end"] / BLOCK) - first + 1).cast("int")), "")
            return unescape(some.substr((s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

        return F.transform(spans, of)

    return let(F.regexp_extract_all(formatted, pattern, F.lit(0)), cut)
