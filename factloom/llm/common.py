"""Small helpers that the operators of this subpackage share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import durable  # noqa: F401

#: Characters that part words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Ordinary words and parts of words that default samples of identifiers and hosts are built from.
WORDS = (
    "account address amount archive author balance batch buffer cache channel client column config counter "
    "customer default delete description document element entry error event factory field filter format "
    "gateway handler header history identifier image index input instance language length library listener "
    "location manager message method module network number object option order output package parameter "
    "password position process product profile project property protocol provider public query reader record "
    "reference register relation request resource response result schedule schema search section secret "
    "sequence server service session setting source station status storage stream string structure subject "
    "summary switch system table target template thread timeout token transaction translation update user "
    "validation value variable vector version visitor warning window worker writer the and that with from "
    "this which nation tion ther ing und der die nicht sich schen keit ung les des que pour dans ment eau "
    "elle los las ción para como mente ado osa"
).split()
LOWER = (("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("abcdefghijklmnopqrstuvwxyz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col) -> Column:
    """The text; null reads as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a non-null text, in order; none gives an empty array."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, *LOWER)


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns in the one column `row`, so that working columns of any name clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The packed columns, those of the names that are added replaced."""
    new = {c.lower() for c in added}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in new], *[v.alias(k) for k, v in added.items()])
