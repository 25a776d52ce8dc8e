"""Price sheets (Markdown tables) to price tables.

A sheet is taken whole or not at all: any fault in a used table rejects it and
the newest sound sheet stays current. Section, tier and unit lines apply to
everything below them, which is a carry-forward over the lines of a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.fixed_values import (
    LONG_COLUMNS,
    PLAIN_COLUMNS,
    PRICED_SECTIONS,
    SHORT_COLUMNS,
    THRESHOLD_COMPACT,
    THRESHOLD_START,
    TIER_HEADING_SUFFIX,
    TIER_HEADINGS,
    UNIT_LINE,
    UNPRICED_CATEGORIES,
    UNPRICED_SECTIONS,
)
from tallyspark.operators.pricing import PRICES
from tallyspark.session import settle

SNAPSHOT_VERSION = 1
SHEET_TIERS = ("standard", "fast", "ultrafast")
RATE_NAMES = ("input", "cached_input", "output")


def read_sheets(spark: SparkSession, root: str) -> DataFrame:
    """Sheet files below ``root``: ``sheet_id, effective_at, text``."""
    return (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.md")
        .text(root)
        .select(
            F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("sheet_id"),
            F.col("_metadata.file_modification_time").alias("effective_at"),
            F.col("value").alias("text"),
        )
    )


def _lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def _marked_lines(sheets: DataFrame) -> DataFrame:
    lines = sheets.select("sheet_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "_raw")).select(
        "sheet_id", "n", F.trim("_raw").alias("line")
    )
    heading = F.trim(F.regexp_replace("line", "^#+", ""))
    sections = {**PRICED_SECTIONS, **{name: "other" for name in UNPRICED_SECTIONS}}
    tiers = {**TIER_HEADINGS, **{k + TIER_HEADING_SUFFIX: v for k, v in TIER_HEADINGS.items()}}
    marked = lines.select(
        "sheet_id", "n", "line", _lookup(heading, sections).alias("_section"), _lookup(heading, tiers).alias("_tier")
    )
    # A new section clears the tier; the cyber section has only one.
    tier_event = F.when(F.col("_tier").isNotNull(), F.struct(F.nullif("_tier", F.lit("")).alias("t"))).when(
        F.col("_section").isNotNull(),
        F.struct(F.when(F.col("_section") == "cyber", "standard").alias("t")),
    )
    down = Window.partitionBy("sheet_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(down)

    is_row = F.col("line").startswith("|")
    return marked.select(
        "sheet_id",
        "n",
        "line",
        is_row.alias("is_row"),
        F.coalesce(latest(F.col("_section")), F.lit("other")).alias("section"),
        latest(tier_event).getField("t").alias("tier"),
        (
            latest(F.when(F.col("line") == UNIT_LINE, F.col("n")))
            > F.coalesce(latest(F.when(F.col("_section").isNotNull(), F.col("n"))), F.lit(-1))
        ).alias("has_unit"),
        latest(F.when(~is_row, F.col("n"))).alias("_above"),
    ).withColumn("table", F.coalesce("_above", F.lit(-1)))


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|"), lambda cell: F.trim(cell))


def _price(cell: Column) -> tuple[Column, Column]:
    """Value of a price cell and whether the cell is sound."""
    plain = F.regexp_replace(cell, ",", "")
    shaped = plain.rlike(r"^\$\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(shaped, F.substr(plain, F.lit(2)).try_cast("double"))
    good = (cell == "-") | (value.isNotNull() & (value < F.lit(float("inf"))))
    return F.when(cell != "-", value), F.coalesce(good, F.lit(False))


def _column(names: Column, header: str) -> Column:
    return F.array_position(names, header).cast("int")


def _table_rows(lines: DataFrame) -> DataFrame:
    """Rows of used tables with their header, place and cells."""
    block = Window.partitionBy("sheet_id", "table").orderBy("n")
    rows = lines.where(F.col("is_row") & (F.col("section") != "other") & F.col("tier").isNotNull())
    rows = rows.withColumn("cells", _cells(F.col("line")))
    return rows.withColumn("header", F.first("cells").over(block)).withColumn("at", F.row_number().over(block))


def parse_price_sheets(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns ``(prices with sheet_id, faults)``; a sheet with any fault has
    no prices. ``faults`` lists ``sheet_id, fault`` and is the reject table."""
    # Every check below reads the table rows; the sheets are taken apart and scanned once.
    rows = settle(_table_rows(_marked_lines(sheets)))
    special = F.col("section") == "specialized"
    header, cells = F.col("header"), F.col("cells")

    def missing(names) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(x) for x in names]), header)) > 0

    ragged = F.size(cells) != F.size(header)
    heads = rows.where("at = 1").select(
        "sheet_id",
        F.when(~F.coalesce("has_unit", F.lit(False)), "no unit line")
        .when(F.size(F.array_distinct(header)) != F.size(header), "repeated column")
        .when(special & missing(("Model", "Category", *PLAIN_COLUMNS)), "missing column")
        .when(~special & missing(("Model", *SHORT_COLUMNS, *LONG_COLUMNS)), "missing column")
        .alias("fault"),
    )
    separator = ragged | ~F.forall(cells, lambda c: c.rlike("^[-: ]*-[-: ]*$"))
    second = rows.groupBy("sheet_id", "table").agg(
        F.coalesce(F.bool_or(F.when(F.col("at") == 2, separator)), F.lit(True)).alias("_bad")
    )
    body = rows.where("at > 2").withColumn("ragged", ragged)
    entries = settle(_entries(body))
    conflicts = (
        entries.where("fault is null")
        .groupBy("sheet_id", "model", "tier")
        .agg(F.count_distinct(F.struct("is_split", F.coalesce(F.to_json("short"), F.lit("")), F.coalesce(F.to_json("long"), F.lit("")))).alias("_n"))
    )
    priced = F.coalesce(*[F.col(f"short.{r}") for r in RATE_NAMES]).isNotNull()
    core = sheets.select("sheet_id").join(
        entries.where((F.col("section") == "flagship") & priced)
        .groupBy("sheet_id")
        .agg(F.count_distinct("tier").alias("_tiers")),
        "sheet_id",
        "left",
    )
    # Of the sheets themselves: a line that states the threshold needs nothing carried to it.
    text = sheets.select("sheet_id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("sheet_id", F.trim("line").alias("line"))
    compact = F.regexp_replace("line", r"\s", "")
    stated = sheets.select("sheet_id").join(
        text.where(F.col("line").startswith(THRESHOLD_START)).groupBy("sheet_id").agg(F.bool_and(compact == THRESHOLD_COMPACT).alias("_ok")), "sheet_id", "left"
    )
    faults = (
        heads.where("fault is not null")
        .union(second.where("_bad").select("sheet_id", F.lit("broken separator")))
        .union(body.where("ragged").select("sheet_id", F.lit("ragged row")))
        .union(entries.where("fault is not null").select("sheet_id", "fault"))
        .union(conflicts.where("_n > 1").select("sheet_id", F.lit("conflicting price")))
        .union(core.where(F.coalesce("_tiers", F.lit(0)) < len(SHEET_TIERS)).select("sheet_id", F.lit("missing main table")))
        .union(stated.where(~F.coalesce("_ok", F.lit(False))).select("sheet_id", F.lit("context threshold")))
        .distinct()
    )
    sound = entries.where("fault is null").join(faults, "sheet_id", "left_anti")
    return sound.select("sheet_id", *PRICES.fieldNames()).dropDuplicates(["sheet_id", "model", "tier"]), faults


def _entries(body: DataFrame) -> DataFrame:
    header, cells = F.col("header"), F.col("cells")
    special = F.col("section") == "specialized"

    def cell(plain: str, usual: str) -> Column:
        name = F.when(special, F.lit(plain)).otherwise(F.lit(usual))
        spot = F.array_position(header, name).cast("int")
        return F.when(spot > 0, F.try_element_at(cells, spot))

    category = F.when(special, F.try_element_at(cells, F.greatest(_column(header, "Category"), F.lit(1))))
    kept = body.where(~F.col("ragged") & ~F.coalesce(category.isin(*UNPRICED_CATEGORIES), F.lit(False)))
    whole = F.try_element_at(cells, F.greatest(_column(header, "Model"), F.lit(1)))
    cut = F.instr(whole, " (")
    name = F.when(cut > 0, F.substring_index(whole, " (", 1)).otherwise(whole)
    note = F.when(cut > 0, F.expr("substring(_whole, instr(_whole, ' (') + 2)")).otherwise(F.lit(""))
    model = F.regexp_replace(name, "^`+|`+$", "")
    short = [_price(cell(p, s)) for p, s in zip(PLAIN_COLUMNS, SHORT_COLUMNS, strict=True)]
    long = [_price(cell("", name_)) for name_ in LONG_COLUMNS]
    long_good = F.lit(True)
    for _, good in long:
        long_good = long_good & good
    short_good = F.lit(True)
    for _, good in short:
        short_good = short_good & good

    def rates(parts) -> Column:
        return F.struct(*[value.alias(n) for (value, _), n in zip(parts, RATE_NAMES, strict=True)])

    has_long = ~special & F.coalesce(*[value for value, _ in long]).isNotNull()
    limited = F.contains(note, F.lit("272K")) & F.contains(note, F.lit("context length"))
    return kept.withColumn("_whole", whole).select(
        "sheet_id",
        "section",
        "tier",
        model.alias("model"),
        (has_long | limited).alias("is_split"),
        rates(short).alias("short"),
        F.when(has_long, rates(long)).alias("long"),
        F.when(~F.coalesce(model.rlike("^[A-Za-z0-9._-]+$"), F.lit(False)), "model name")
        .when(~short_good | (~special & ~long_good), "price cell")
        .alias("fault"),
    )


def save_prices(prices: DataFrame, effective: DataFrame, target: str) -> None:
    """Add sound sheets to the snapshot store, one folder per sheet. A sheet
    already stored is replaced as a whole; other sheets stay as they are."""
    (
        prices.join(effective.select("sheet_id", "effective_at"), "sheet_id")
        .withColumn("schema_version", F.lit(SNAPSHOT_VERSION))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sheet_id")
        .parquet(target)
    )


def load_current_prices(spark: SparkSession, target: str) -> DataFrame:
    """The newest stored sheet that is sound: right version, all prices finite
    and not negative. Without any stored sheet there are no prices."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], PRICES)
    stored = spark.read.parquet(target)
    bad = F.lit(False)
    for side in ("short", "long"):
        for rate in RATE_NAMES:
            value = F.col(f"{side}.{rate}")
            bad = bad | F.coalesce((value < 0) | F.isnan(value) | (value == float("inf")), F.lit(False))
    per_sheet = stored.groupBy("sheet_id").agg(
        F.max("effective_at").alias("_at"), F.bool_or(bad | (F.col("schema_version") != SNAPSHOT_VERSION)).alias("_bad")
    )
    newest = per_sheet.where(~F.col("_bad")).agg(F.max_by("sheet_id", F.struct("_at", "sheet_id")).alias("sheet_id"))
    return stored.join(newest, "sheet_id", "left_semi").select(*PRICES.fieldNames())
