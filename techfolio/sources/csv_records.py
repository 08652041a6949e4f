"""CSV files with line breaks inside quotes, read in parallel: physical lines are joined to records across file blocks.

Spark's own reader splits files at line breaks, which cuts such records in two, or with ``multiLine`` reads a file in one
task. Here every block of a file is scanned as text. Where a line ends, inside or outside quotes, depends on where it begins
only, so a line is a function on these two states: most keep or swap the state or lead to one of them. Composed in order
they give the function of a block; composed over the blocks of a file, a table with one row for each block, they give the
state in which every block begins. With it each block numbers its records, and what a block holds of a record that
began before it goes to the block of its beginning.

Quotes open a field only at its start, ``""`` inside quotes is a quote, and what follows a closing quote belongs to the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|(?!")[^,]*+),)*+'
#: Lines that end inside quotes if they begin outside, and if they begin inside.
_OPENS = rf'(?s)\A{_FIELDS}"{_QUOTED}\z'
_STAYS = rf'(?s)\A{_QUOTED}(?:"[^,]*+,{_FIELDS}"{_QUOTED})?\z'
_LINE, _BLOCK, _FILE = "__line", "__block", "__file"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, value, from_out, from_in): all lines in their place, with the state that each ends in (true: inside
    quotes) for either state at its beginning. Numbers of lines ascend inside a block."""
    text = spark.read.option("lineSep", "\n").text(path)
    text = text.select(
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_LINE), "value",
    )
    quotes = F.instr("value", '"') > 0
    return text.withColumns({
        "from_out": quotes & F.col("value").rlike(_OPENS),
        "from_in": ~quotes | F.col("value").rlike(_STAYS),
    })


def _steps(rows: DataFrame) -> DataFrame:
    """``settles``: the state that the line leads to from either beginning (else null); ``swaps``: 1 where it exchanges the two."""
    same = F.col("from_out") == F.col("from_in")
    return rows.withColumns({"settles": F.when(same, F.col("from_out")), "swaps": (F.col("from_out") & ~F.col("from_in")).cast("int")})


def _after(stepped: DataFrame, keys: list[str], order: str, start: Column | None) -> tuple[DataFrame, Column, Column]:
    """Composition of all steps up to each row: ``stepped`` with helper columns, and the state behind the row for either
    state (``start`` given: for that one) at the beginning of its group."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # swaps before and at the last settling line don't count: sums are compared with the sum at that line
    rows = stepped.withColumn("__sum", F.sum("swaps").over(upto))
    mark = F.when(F.col("settles").isNotNull(), F.struct("settles", "__sum"))
    rows = rows.withColumn("__last", F.last(mark, ignorenulls=True).over(upto))

    def state(begin: Column) -> Column:
        swapped = (F.col("__sum") - F.coalesce(F.col("__last.__sum"), F.lit(0))) % 2 == 1
        return F.coalesce(F.col("__last.settles"), begin) != swapped

    return rows, state(F.lit(False) if start is None else start), state(F.lit(True) if start is None else start)


def block_states(rows: DataFrame) -> DataFrame:
    """(file, block, begins): the state in which every block begins. Only lines with quotes travel, without their text."""
    narrow = _steps(rows.select(_FILE, _BLOCK, _LINE, "from_out", "from_in")).filter("settles IS NOT NULL OR swaps = 1")
    composed, out, inside = _after(narrow, [_FILE, _BLOCK], _LINE, None)
    ends = composed.withColumns({"from_out": out, "from_in": inside}).groupBy(_FILE, _BLOCK).agg(
        F.max_by("from_out", _LINE).alias("from_out"), F.max_by("from_in", _LINE).alias("from_in")
    )
    # blocks without a quote keep the state
    every = rows.select(_FILE, _BLOCK).distinct().join(ends, [_FILE, _BLOCK], "left").fillna(False, ["from_out"]).fillna(True, ["from_in"])
    chained, state, _ = _after(_steps(every), [_FILE], _BLOCK, F.lit(False))
    before = F.lag("ends", 1, False).over(Window.partitionBy(_FILE).orderBy(_BLOCK))
    return chained.withColumn("ends", state).withColumn("begins", before).select(_FILE, _BLOCK, "begins")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, record, value): the text of every record. The first record of a file has block 0 and record 1."""
    rows = lines(spark, path)
    placed = rows.join(block_states(rows), [_FILE, _BLOCK])
    by_block = Window.partitionBy(_FILE, _BLOCK).orderBy(_LINE)
    composed, ends, _ = _after(_steps(placed), [_FILE, _BLOCK], _LINE, F.col("begins"))
    stated = composed.withColumn("ends", ends).withColumn("inside", F.coalesce(F.lag("ends").over(by_block), F.col("begins")))
    # blank lines between records are no records
    stated = stated.filter("inside OR trim(value) NOT IN ('', '\r')")
    stated = stated.withColumn("record", F.sum((~F.col("inside")).cast("long")).over(by_block))
    parts = stated.groupBy(_FILE, _BLOCK, "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_LINE, "value"))), lambda x: x["value"]), "\n").alias("value"),
        F.max_by("ends", _LINE).alias("open"),
    )
    # what a block begins with (record 0) goes to the last record that began before it: two parts a block at most
    whole = parts.filter("record > 0 AND NOT open").select(_FILE, _BLOCK, "record", "value")
    pieces = parts.filter("record = 0 OR open").withColumn("at", F.struct(_BLOCK, "record"))
    start = F.last(F.when(F.col("record") > 0, F.col("at")), ignorenulls=True).over(Window.partitionBy(_FILE).orderBy("at"))
    joined = pieces.withColumn("start", start).groupBy(_FILE, "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value")
    )
    return whole.unionByName(joined.select(_FILE, F.col(f"start.{_BLOCK}").alias(_BLOCK), F.col("start.record").alias("record"), "value"))


def has_breaks(rows: DataFrame) -> bool:
    """Whether any record of the files goes over a line break."""
    return not rows.filter("from_out").isEmpty()


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of the files' header, all as strings, nulls where a record has no value; header records are left out.

    A narrow scan looks for a line that opens quotes without closing them. Where there is none, lines are records and
    Spark's reader takes over; else records are put together (:func:`records`), many tasks to a file either way.
    """
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"'}
    if not has_breaks(lines(spark, path)):
        return spark.read.csv(path, multiLine=False, **options)
    # takes no more than the first record
    names = spark.read.csv(path, multiLine=True, **options).columns
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    found = records(spark, path).filter(~((F.col(_BLOCK) == 0) & (F.col("record") == 1)))
    text = F.regexp_replace("value", "\r$", "")
    parsed = found.select(F.from_csv(text, schema, {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}).alias("r"))
    return parsed.select([F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])
