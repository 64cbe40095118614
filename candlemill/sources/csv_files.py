"""Vendor CSV files: a banner line, a header line, then rows; one file per stock in one of two encodings.

Spark's CSV reader reads and converts. One reading of the raw lines gives the facts of each file: whether its bytes suit
UTF-8, whether it has quotes, and its first two lines. Files that may be GB2312 are read once more as lines in it. Files
that agree on encoding, on having quotes and on their header form a group, and a group is one `spark.read.csv`: columns
stand in the same places, so cells are plain columns and only those in use are parsed. Files without a quote are split
into blocks however large they are; those with quotes may have records of several lines and are read whole, a task each.

One bad value or byte turns down a whole file, so the converted rows are written once, the verdict on each file is an
aggregation over them, and the table is the rows of the files that passed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.schemas import BAR_HEADERS, BAR_SCHEMA, FINANCE_HEADER_SUFFIX, FINANCE_TEXT, finance_schema
from candlemill.sources.shared import keep

# Encodings in the order they are tried, and the ending of the statement files in use.
BAR_ENCODINGS = ("utf-8", "gb2312")
FINANCE_ENCODINGS = ("gb2312", "utf-8")
FINANCE_ENDING = "_一般企业.csv"
PATH, REASON = "source_path", "reject_reason"
_ERROR, _HEADER = "_error", "_is_header"
#: What a decoder puts in the place of bytes that suit no character; GB2312 itself has no such character.
REPLACEMENT = "�"


def read_bar_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all bar files of a folder, and one row with a reason for each file turned down.

    Cells of text columns that are empty, or that a short row lacks, are empty text.
    """
    files = _facts(spark, folder, BAR_ENCODINGS, pathGlobFilter="*.csv")
    heads = _parsed_headers(files)
    missing = F.array_except(F.array(*map(F.lit, BAR_HEADERS)), "header")
    heads = keep(_turn_down(heads, F.size(missing) > 0, F.concat(F.lit("missing headers "), F.array_join(missing, ", "))), "files")

    places = lambda header: [_last_place(header, name) for name in BAR_HEADERS]
    raw = _records(spark, heads, BAR_SCHEMA.names, places, lambda header: ("股票代码", "交易日期"))
    # Cells are converted in one projection and judged in the next, from what became of them.
    values = raw.selectExpr("*", *(f"{_bar_value(f)} _{f.name}" for f in BAR_SCHEMA.fields))
    judged = [_bar_fault(f) for f in BAR_SCHEMA.fields if isinstance(f.dataType, (T.DoubleType, T.DateType))]
    made = values.selectExpr(PATH, _HEADER, f"coalesce({', '.join(judged)}) {_ERROR}", *(f"_{f.name} {f.name}" for f in BAR_SCHEMA.fields))
    rows = _kept(made)
    # The header comes once, and not at all where the reader skipped it in place of an empty banner.
    counts = rows.groupBy(PATH).agg(
        F.count_if(~F.col(_HEADER)).alias("n"), F.count_if(_HEADER).alias("headers"), F.min(F.when(~F.col(_HEADER), F.col(_ERROR))).alias("error")
    )
    verdicts = heads.select(PATH, REASON, "banner_empty").join(counts, PATH, "left")
    again = F.coalesce("headers", F.lit(0)) > F.when(F.col("banner_empty"), 0).otherwise(1)
    verdicts = _turn_down(verdicts, again, F.lit("the header comes again as a row"))
    return _used(rows, verdicts)


def read_finance_files(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of all statement files `{folder}/{code}/{code}_一般企业.csv`, and a row for each file turned down.

    The table has the given columns, or those of the first readable file. Other files are fitted to it: missing
    columns are NULL however long a row is, further ones are left out. Rows that repeat the header are left out.
    """
    # Folders are listed by tasks, a part each; a pattern of folders is gone through by the driver, one after the other.
    below = _below(spark, folder)
    own = (F.size(below) == 2) & (below[1] == F.concat(below[0], F.lit(FINANCE_ENDING)))
    files = _facts(spark, folder, FINANCE_ENCODINGS, own, pathGlobFilter=f"*{FINANCE_ENDING}", recursiveFileLookup="true")
    if files.isEmpty():
        spark.read.text(f"{folder}/*/*{FINANCE_ENDING}")  # says so if there are no files at all
    heads = keep(files.withColumn("header", F.split(F.trim("header_line"), ",", -1)), "files")
    clean = lambda header: [h.replace(FINANCE_HEADER_SUFFIX, "") for h in header]

    if columns:
        names = list(columns)
    else:
        names = clean(_first_with_rows(spark, heads))
    schema = finance_schema(names)

    def places(header: list[str]) -> list[int | None]:
        own = clean(header)
        return [_last_place(own, name) if name in own else None for name in names]

    raw = _records(spark, heads, names, places, lambda header: header)
    rows = _kept(raw.selectExpr(PATH, _HEADER, f"cast(null as string) {_ERROR}", *(f"{_finance_value(f)} {_quoted(f.name)}" for f in schema.fields)))
    counts = rows.where(~F.col(_HEADER)).groupBy(PATH).agg(F.count("*").alias("n"), F.min(_ERROR).alias("error"))
    return _used(rows, heads.select(PATH, REASON).join(counts, PATH, "left"))


def accepted(parsed: DataFrame) -> DataFrame:
    """The table rows of a parsed folder."""
    return parsed.filter(F.col(REASON).isNull()).drop(PATH, REASON)


def rejected(parsed: DataFrame) -> DataFrame:
    """The files turned down, with the reason."""
    return parsed.filter(F.col(REASON).isNotNull()).select(PATH, REASON)


#: What reading and converting needs: decoders of the JVM for GB2312, and plans of many columns that fall into parts the
#: JVM compiles; it interprets methods of more than 8,000 bytes.
_SETTINGS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def _reading(spark: SparkSession) -> Iterator[None]:
    """Set what reading needs, for what runs inside."""
    # Listing files or folders takes a few tasks per core rather than one for each.
    tasks = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(2 * spark.sparkContext.defaultParallelism)}
    before = {name: spark.conf.get(name) for name in _SETTINGS | tasks}
    for name, value in (_SETTINGS | tasks).items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _literally(path: str) -> str:
    """A path from file metadata, which is an encoded address, so that its characters stand for themselves in a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _two_lines(line: Column) -> list[Column]:
    """Aggregates that hold a file's first two lines: numbers of lines in a row are even and odd in turn."""
    at = F.struct("_line", line.alias("text"))
    return [F.min(F.when((F.col("_block") == 0) & (F.col("_line") % 2 == i), at)).alias(f"_{i}") for i in (0, 1)]


def _nth(n: int) -> Column:
    first_even = F.coalesce(F.col("_0._line") < F.col("_1._line"), F.col("_0").isNotNull())
    return F.when(first_even == (n == 0), F.col("_0.text")).otherwise(F.col("_1.text"))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumns({PATH: F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})


def _below(spark: SparkSession, folder: str) -> Column:
    """The names on a file's path below the folder."""
    depth = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    depth = depth.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(depth).depth()
    names = F.split(F.regexp_replace(PATH, "^[^:/]*:(//[^/]*)?/*", ""), "/")
    return F.slice(names, depth + 1, F.greatest(F.size(names) - depth, F.lit(0)))


def _facts(spark: SparkSession, where: str, encodings: Sequence[str], only: Column | None = None, **options: str) -> DataFrame:
    """A row per file: encoding, whether it has quotes, whether its banner is empty, header line, and why it is turned down."""
    raw = F.col("value")
    with _reading(spark):
        lines = _numbered(spark.read.options(**options).text(where))
    facts = (lines if only is None else lines.where(only)).groupBy(PATH).agg(
        F.min(F.is_valid_utf8(raw)).alias("utf8"),
        F.min(F.is_valid_utf8(raw) & (F.octet_length(raw) == F.length(raw))).alias("ascii"),
        F.max(F.contains(raw, F.lit('"'))).alias("quoted"),
        F.max(F.octet_length(raw)).alias("longest"),
        *_two_lines(raw),
    )
    facts = facts.select(PATH, "utf8", "ascii", "quoted", "longest", (F.trim(_nth(0)) == "").alias("banner_empty"), _nth(1).alias("raw_header"))
    facts = keep(facts, "facts")
    # As many names as there are files, which the driver lists for a reading anyway.
    doubtful = facts.where(~F.col("ascii") if encodings[0] == "gb2312" else ~F.col("utf8")).select(PATH).collect()
    suits = facts.select(PATH, F.lit(None).cast("boolean").alias("gb2312"), F.lit(None).cast("string").alias("_a"), F.lit(None).cast("string").alias("_b")).limit(0)
    if doubtful:
        with _reading(spark):
            lines = spark.read.schema("text string").options(encoding="GB2312", sep="\u0001", quote="").csv([_literally(r[PATH]) for r in doubtful])
            found = _numbered(lines).groupBy(PATH).agg((~F.max(F.contains("text", F.lit(REPLACEMENT)))).alias("gb2312"), *_two_lines(F.col("text")))
            suits = keep(found.select(PATH, "gb2312", _nth(0).alias("_a"), _nth(1).alias("_b")), "facts")
    facts = facts.join(suits, PATH, "left")
    suits_it = {"utf-8": F.col("utf8"), "gb2312": F.col("ascii") | F.coalesce("gb2312", F.lit(False))}
    encoding = F.when(suits_it[encodings[0]], encodings[0]).when(suits_it[encodings[1]], encodings[1])
    # Lines read by the CSV reader leave out empty ones.
    decoded = F.when(F.col("banner_empty"), F.col("_a")).otherwise(F.col("_b"))
    header = F.when((encoding == "gb2312") & ~F.col("ascii") & (F.trim("raw_header") != ""), decoded).otherwise(F.col("raw_header"))
    facts = facts.select(PATH, encoding.alias("encoding"), "quoted", "longest", F.coalesce("banner_empty", F.lit(True)).alias("banner_empty"), header.alias("header_line"))
    facts = facts.withColumn(REASON, F.lit(None).cast("string"))
    facts = _turn_down(facts, F.col("encoding").isNull(), F.lit(f"neither {encodings[0]} nor {encodings[1]}"))
    return _turn_down(facts, F.col("header_line").isNull(), F.lit("no header line"))


def _turn_down(files: DataFrame, when: Column, why: Column) -> DataFrame:
    return files.withColumn(REASON, F.coalesce(REASON, F.when(when, why)))


def _parsed_headers(files: DataFrame) -> DataFrame:
    """`header`: the cells of the header line."""
    files = keep(files, "files")
    most = files.agg(F.max(F.size(F.split("header_line", ",", -1)))).first()[0] or 1
    cells = F.from_csv("header_line", ", ".join(f"c{i} string" for i in range(most)), {"escape": '"', "maxColumns": str(max(20480, most + 1))})
    named = files.withColumn("_cells", cells).withColumn("header", F.array(*(F.coalesce(F.col(f"_cells.c{i}"), F.lit("")) for i in range(most))))
    return named.drop("_cells")


def _last_place(header: Sequence[str], name: str) -> int:
    """Where a column stands, the last time if twice."""
    return len(header) - 1 - list(reversed(header)).index(name)


def _groups(heads: DataFrame) -> list[Row]:
    good = heads.where(F.col(REASON).isNull()).groupBy("encoding", "quoted", "header")
    return good.agg(F.collect_list(PATH).alias("paths"), F.max("longest").alias("longest")).orderBy("encoding", "quoted", "header").collect()


def _read_group(spark: SparkSession, group: Row) -> DataFrame:
    """Columns c0, c1 and on, and source_path, of all records below the first non-empty line of each file."""
    schema = ", ".join(f"c{i} string" for i in range(len(group.header)))
    options = {
        "encoding": group.encoding, "multiLine": group.quoted, "header": True, "enforceSchema": True, "escape": '"',
        "maxColumns": max(20480, group.longest + 1),
    }
    return spark.read.schema(schema).options(**options).csv([_literally(p) for p in group.paths]).withColumn(PATH, F.col("_metadata.file_path"))


def _records(
    spark: SparkSession, heads: DataFrame, names: Sequence[str],
    places: Callable[[list[str]], list[int | None]], told_by: Callable[[list[str]], Sequence[str]],
) -> DataFrame:
    """(source_path, whether it is the header, the named columns as text) of the records of all good files.

    `places` tells where a header has each of the columns; the header's own record has the names `told_by` in their places.
    """
    parts = []
    with _reading(spark):
        for group in _groups(heads):
            own = [F.col(f"c{group.header.index(name)}") == name for name in told_by(group.header) if name]
            told = F.coalesce(reduce(Column.__and__, own, F.lit(True)), F.lit(False))
            cells = [f"{'cast(null as string)' if at is None else f'c{at}'} {_quoted(name)}" for name, at in zip(names, places(group.header), strict=True)]
            parts.append(_read_group(spark, group).withColumn(_HEADER, told).selectExpr(PATH, _HEADER, *cells))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(PATH, T.StringType()), T.StructField(_HEADER, T.BooleanType()), *(T.StructField(n, T.StringType()) for n in names)]))
    return reduce(DataFrame.unionByName, parts)


def _kept(rows: DataFrame) -> DataFrame:
    with _reading(rows.sparkSession):
        return keep(rows, "vendor_rows")


def _first_with_rows(spark: SparkSession, heads: DataFrame) -> list[str]:
    """The header of the first file by path that is used: one with a record below its header."""
    with _reading(spark):
        for head in heads.where(F.col(REASON).isNull()).orderBy(PATH).toLocalIterator():
            group = Row("encoding", "quoted", "header", "longest", "paths")(head.encoding, head.quoted, head.header, head.longest, [head[PATH]])
            if len(_read_group(spark, group).limit(2).take(2)) > (0 if head.banner_empty else 1):
                return head.header
    raise ValueError("no readable statement file")


def _used(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of the files that pass, and a row with the reason for each that does not."""
    files = _turn_down(verdicts, F.col("error").isNotNull(), F.col("error"))
    files = keep(_turn_down(files, F.coalesce("n", F.lit(0)) == 0, F.lit("no rows")).select(PATH, REASON), "verdicts")
    good = rows.where(~F.col(_HEADER)).drop(_HEADER, _ERROR).join(files.where(F.col(REASON).isNull()).select(PATH), PATH, "left_semi")
    turned_down = files.where(F.col(REASON).isNotNull())
    return good.withColumn(REASON, F.lit(None).cast("string")).unionByName(turned_down, allowMissingColumns=True)


# Expressions for hundreds of columns are SQL text: building them call by call takes the driver seconds.


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(cell: str) -> str:
    """NULL where the cell is no number. A trailing d or f is no part of one, nor is an x inside."""
    # Most cells have none of these letters, which costs less to see than where they stand.
    has = lambda letters: " or ".join(f"contains({cell}, '{c}')" for c in letters)
    ends = rf"({has('dDfF')}) and lower(right(rtrim({cell}), 1)) in ('d', 'f') and {cell} rlike r'[0-9.]\s*[dDfF]\s*$'"
    return f"case when not ({ends}) and not ({has('xX')}) then try_cast({cell} as double) end"


def _bar_value(field: T.StructField) -> str:
    cell = field.name
    if isinstance(field.dataType, T.DoubleType):
        return _number(cell)
    if isinstance(field.dataType, T.IntegerType):
        return f"cast(coalesce(lower({cell}) = 'true', false) as int)"
    if isinstance(field.dataType, T.DateType):
        text = f"replace(trim({cell}), '/', '-')"
        return f"case when {text} rlike '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$' then try_cast({text} as date) end"
    return f"coalesce({cell}, '')"


def _bar_fault(field: T.StructField) -> str:
    """What is wrong with a number or date, from the cell and the value `_name` made of it; empty numbers are NULL."""
    filled = f" and {field.name} <> ''" if isinstance(field.dataType, T.DoubleType) else ""
    return f"case when _{field.name} is null{filled} then concat('{field.name}: cannot read ', coalesce({field.name}, 'nothing')) end"


def _finance_value(field: T.StructField) -> str:
    filled = f"nullif({_quoted(field.name)}, '')"
    return filled if field.name in FINANCE_TEXT else _number(filled)
