"""Reading and writing the text formats: FASTA, GTF/GFF3, hit tables, WIG, BED."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.attributes import format_gff, format_gtf, parse, value_of
from locusframe.operators.intervals import BIN, merged
from locusframe.session import hinted, importable, stored
from locusframe.sources.parts import wig_positions

#: Feature types that have children and an ID of their own.
PARENTS = ("gene", "transcript", "mRNA")

GFF = "seqid string, source string, type string, start long, stop long, score string, strand string, phase string, attrs string"
HITS = (
    "query string, subject string, pident string, alen string, mismatches string, gaps string, qstart string, qend string, "
    "tstart string, tend string, evalue string, bits string"
)


def read_fasta(spark: SparkSession, path: str | Sequence[str], upper: bool = False) -> DataFrame:
    """(seq_name, header, sequence) of plain, .gz or .bz2 files; the name is the header's first word. Records are
    split by Spark, each one row (``parts.fasta_tiles`` is for longer ones); line ends of either kind and blank lines are dropped, and a record may have no sequence. With
    ``upper``, the soft mask is dropped."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^[\s>]+", "").alias("v")).where("v != ''")
    header = F.trim(F.substring_index("v", "\n", 1), F.lit("\r \t"))
    body = F.when(F.instr("v", "\n") > 0, F.expr(r"substring(v, instr(v, '\n') + 1)")).otherwise("")
    return raw.select(F.split(header, r"\s")[0].alias("seq_name"), header.alias("header"), (F.upper if upper else F.lit)(F.regexp_replace(body, r"\s", "")).alias("sequence"))


#: How gzip works for files: the fast way, which makes them a little larger.
FAST = {"zlib.compress.level": "BEST_SPEED"}


def write_text(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """The lines of a table's only column, plain or gzipped."""
    lines.write.options(**FAST).option("compression", compression or "none").text(path)


def wrapped(sequence: Column, width: int) -> Column:
    """Lines of ``width`` letters; what fits one is not searched."""
    return F.when(F.length(sequence) > width, F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")).otherwise(sequence)


def write_fasta(df: DataFrame, path: str, header: str = "seq_name", width: int = 80, compression: str | None = None) -> None:
    """One record a row, wrapped at ``width``."""
    lines = wrapped(F.col("sequence"), width)
    write_text(df.select(F.concat(F.lit(">"), header, F.lit("\n"), lines)), path, compression)


def write_fasta_groups(df: DataFrame, path: str, group: str, header: str = "seq_name", width: int = 80) -> None:
    """FASTA files in a folder for each value of ``group``, such as the parts of a genome."""
    lines = wrapped(F.col("sequence"), width)
    df.select(group, F.concat(F.lit(">"), header, F.lit("\n"), lines).alias("value")).repartition(group).write.partitionBy(group).text(path)


def numbered_lines(spark: SparkSession, path: str | Sequence[str], folders: bool = False) -> DataFrame:
    """(file, line_no, line): lines with their place in their file, from 0. Large files are read in many parts.

    Rows within a part come in order; a part's first line number is the sum of the lines of the parts before. With
    ``folders``, a folder's files, in order of their names, count as one file, as Spark writes it.
    """
    part = ["name", "at"]
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")
    )
    parts = raw.groupBy(*part).agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    # Files' folders and numbers are found for parts, not for lines.
    parts = parts.withColumn("file", F.regexp_replace("name", "/[^/]*$", "") if folders else F.col("name"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy(*part)) - F.col("lines")
    parts = stored(parts.select(*part, "file", (before - F.col("first")).alias("shift")))
    line = F.when(F.contains("line", F.lit("\r")), F.regexp_replace("line", r"\r$", "")).otherwise(F.col("line"))
    return raw.join(hinted(parts), part).select("file", (F.col("n") + F.col("shift")).alias("line_no"), line.alias("line"))


def read_gff(spark: SparkSession, path: str | Sequence[str], raw: bool = False, folders: bool = False) -> DataFrame:
    """Rows of 9 columns with attributes (a map), file and line_no (order within the file); others are dropped.

    With ``raw``, the line itself stays as column line. A path may be a list, or have Hadoop's globs such as ``{a,b}*``.
    """
    lines = numbered_lines(spark, path, folders)
    parts = lines.where(~F.col("line").startswith("#")).withColumn("c", F.split("line", "\t")).where(F.size("c") == 9)
    names = [x.split() for x in GFF.split(", ")]
    columns = [F.col("c")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    rows = parts.select("file", "line_no", *columns, *(["line"] if raw else [])).where("start is not null and stop is not null")
    # Ids come from patterns, so the map is made only for those who read it.
    keys = ("transcript_id", "transcriptId", "Parent", "ID", "gene_id", "gene")
    rows = rows.withColumns({f"_{k}": value_of(F.col("attrs"), k) for k in keys})
    value = lambda k: F.nullif(F.col(f"_{k}"), F.lit(""))
    own = F.when(F.col("type").isin(*PARENTS), value("ID"))
    bare = F.when(F.col("type").isin(*PARENTS) & ~F.col("attrs").rlike('[="]'), F.trim("attrs"))  # some writers give the id alone
    ids = {
        "tx_id": F.coalesce(value("transcript_id"), value("transcriptId"), F.when(F.col("type") != "gene", own), F.trim(F.split(value("Parent"), ",")[0]), value("ID"), bare),
        "gene_id": F.coalesce(value("gene_id"), value("gene"), F.when(F.col("type") == "gene", F.coalesce(own, bare)), F.when(F.col("type").isin(*PARENTS), value("Parent"))),
    }
    return rows.withColumn("attributes", parse(F.col("attrs"))).withColumns(ids).drop(*(f"_{k}" for k in keys))


def read_models(spark: SparkSession, paths: Sequence[str], folders: bool = False) -> DataFrame:
    """The rows of several GTF or GFF3 files (or globs), with file_idx: the place of a file's path in ``paths``."""
    each = [read_gff(spark, p, folders=folders).withColumn("file_idx", F.lit(i).cast("long")) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each)


def _gff_line(attrs: Column) -> Column:
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", *map(cell, ("seqid", "source", "type", "start", "stop", "score", "strand", "phase")), attrs)


def write_gff(df: DataFrame, path: str, order: Sequence[str] = ("seqid", "start", "stop"), compression: str | None = None) -> None:
    """GFF3 lines in this order; column attributes (a map) is written, or attrs as it is. Null becomes a dot."""
    attrs = format_gff(F.col("attributes")) if "attributes" in df.columns else F.coalesce("attrs", F.lit("."))
    write_text(df.orderBy(*order).select(_gff_line(attrs)), path, compression)


def write_gtf(df: DataFrame, path: str, order: Sequence[str] = ("seqid", "start", "stop"), compression: str | None = None) -> None:
    """GTF lines in this order; column attributes (a map) is written as ``k "v";``, or attrs as it is. Files are gzipped if ``compression`` is gzip."""
    attrs = format_gtf(F.col("attributes")) if "attributes" in df.columns else F.coalesce("attrs", F.lit("."))
    write_text(df.orderBy(*order).select(_gff_line(attrs)), path, compression)


def write_groups(df: DataFrame, path: str, order: Sequence[str], rows: Column, compression: str | None = None) -> None:
    """GTF or GFF3 lines of groups such as genes, in this order of the groups; ``rows`` gives those of a group, in their order, as an array of structs.

    Groups are sorted as they are, and their lines made where they are written, so no line is shuffled.
    """
    each = df.orderBy(*order).select("seqid", F.explode(rows).alias("_row"))
    columns = [c for c in each.schema["_row"].dataType.names if c != "seqid"]
    each = each.select("seqid", *(F.col("_row")[c].alias(c) for c in columns))
    write_text((each if "score" in columns else each.withColumn("score", F.lit("."))).select(_gff_line(F.coalesce("attrs", F.lit(".")))), path, compression)


def write_lines(df: DataFrame, path: str, order: Sequence[str] = ("file", "line_no")) -> None:
    """Column line, in the order of the files it came from."""
    df.orderBy(*order).select("line").write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header; null is NA, booleans are True and False."""
    kinds = dict(df.dtypes)
    text = lambda c: F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
    df.select(*(F.coalesce(text(c), F.lit("NA")).alias(c) for c in df.columns)).write.csv(path, sep="\t", header=True)


def write_classes(df: DataFrame, path: str, key: str = "query", value: str = "class") -> None:
    """One JSON map {key: value} over all files of the folder in order of their names, an entry a line; keys must be distinct.

    Entries are sorted by key, and all but the first begin with a comma, so no task needs to know the others' entries.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"))
    least = rows.agg(F.min("k")).first()[0]
    entry = F.regexp_replace(F.to_json(F.create_map("k", "v")), r"(?s)^\{|\}$", "")
    lines = rows.select(F.lit(1).alias("rank"), "k", F.concat(F.when(F.col("k") == F.lit(least), "").otherwise(","), entry).alias("line"))
    ends = df.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "rank int, k string, line string")
    lines.unionByName(ends).orderBy("rank", "k").select("line").write.text(path)


def read_classes(spark: SparkSession, path: str | Sequence[str], key: str = "query", value: str = "class") -> DataFrame:
    """(key, value) of a JSON map with an entry a line."""
    entry = F.regexp_replace(F.trim("value"), r"^,|,$", "")
    parsed = F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), "map<string,string>")
    lines = spark.read.text(path).where(~F.trim("value").isin("{", "}", ""))
    return lines.select(F.explode(parsed).alias(key, value))


def _subject(column: str) -> Column:
    return F.when(F.col(column).rlike(r"[\s\\]"), F.regexp_extract(column, r"^(?:(?!\\t|\\n)\S)*", 0)).otherwise(F.col(column))


def read_hits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A table of 12 columns; what is no number becomes null, subjects end at a blank, tab or their escapes."""
    raw = spark.read.csv(path, sep="\t", quote="", comment="#", schema=HITS)
    numbers = {c: F.col(c).try_cast("double") for c in ("pident", "alen", "qstart", "qend", "tstart", "tend", "evalue", "bits")}
    return raw.withColumns({"subject": _subject("subject"), **numbers})


def read_short_hits(spark: SparkSession, path: str | Sequence[str], folders: bool = False) -> DataFrame:
    """A table of 8 columns with query and target lengths, and line_no; blank lines, comments and shorter lines are
    skipped, columns beyond the eighth too. A line whose numbers are none is skipped as well."""
    names = ("pident", "alen", "evalue", "bits", "qlen", "slen")
    lines = numbered_lines(spark, path, folders).where(~F.col("line").startswith("#")).withColumn("c", F.split("line", "\t")).where(F.size("c") >= 8)
    rows = lines.select("line_no", F.col("c")[0].alias("query"), F.col("c")[1].alias("subject"), *(F.trim(F.col("c")[i + 2]).try_cast("double").alias(n) for i, n in enumerate(names)))
    return rows.dropna(subset=list(names))


def read_wig(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(seqid, pos, value) of fixedStep blocks of any length; a block is read in as many parts as its file."""
    return wig_positions(spark, path)


def wig_runs(df: DataFrame, keys: Sequence[str], step: int = 1) -> DataFrame:
    """(keys, start, n): maximal runs of positions ``step`` apart; one row a position must be given."""
    rows = df.select(*keys, F.pmod("pos", F.lit(step)).alias("_rest"), F.floor(F.col("pos") / step).alias("start"), F.floor(F.col("pos") / step).alias("stop"))
    runs = merged(rows, [*keys, "_rest"])
    return runs.select(*keys, (F.col("start") * step + F.col("_rest")).alias("start"), (F.col("stop") - F.col("start") + 1).alias("n"))


def wig_blocks(df: DataFrame, keys: Sequence[str], step: int = 1, most: int = BIN) -> DataFrame:
    """(keys, start, values): runs of positions ``step`` apart, cut where they pass a multiple of ``most`` steps, so that no
    row holds more values."""
    place = F.floor(F.col("pos") / step)
    tile = df.withColumns({"_tile": F.floor(place / most), "_rest": F.pmod("pos", F.lit(step))})
    order = Window.partitionBy(*keys, "_rest", "_tile").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(order) == step, 0).otherwise(1)
    numbered = tile.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return numbered.groupBy(*keys, "_rest", "_tile", "_run").agg(F.min("pos").alias("start"), values.alias("values")).select(*keys, "start", "values")


def write_wig(df: DataFrame, path: str, keys: Sequence[str] = ("seqid",), step: int = 1) -> None:
    """fixedStep blocks, ordered by sequence and place."""
    head = F.format_string("fixedStep chrom=%s start=%d step=" + str(step), F.col(keys[0]), F.col("start"))
    body = F.array_join(F.transform("values", lambda x: x.cast("string")), "\n")
    wig_blocks(df, keys, step).orderBy(*keys, "start").select(F.concat(head, F.lit("\n"), body)).write.text(path)


def write_bed(df: DataFrame, path: str) -> None:
    """BED6; the start is zero-based, as the format has it."""
    df.select("seqid", (F.col("start") - 1).alias("s"), "stop", "name", F.lit(".").alias("score"), "strand").write.csv(path, sep="\t")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A list such as species names: one a line; blank lines and comments are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != '' and not startswith(name, '#')")


def read_pairs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(name, length) of a list of sequence names, one a line, with a blank between."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2).select(F.col("p")[0].alias("name"), F.col("p")[1].try_cast("long").alias("length"))


def sniff_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, format): what each text file's first lines look like; blank lines count. Only the first part of a file is looked at."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value").where("at = 0").select("file", "value")

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's lines come in order, one file after another."""
        now, n = None, 0
        for batch in batches:
            out = []
            for name, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                now, n = (now, n + 1) if name == now else (name, 0)
                if n in (0, 2):
                    out.append((name, n, line))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["file", "n", "line"])

    importable(spark)
    line = lambda i: F.max(F.when(F.col("n") == i, F.col("line")))
    heads = lines.mapInArrow(first_lines, "file string, n int, line string").groupBy("file").agg(line(0).alias("first"), line(2).alias("third"))
    return heads.select("file", sniffed("first", "third").alias("format"))


def sniffed(first_line: str = "value", third_line: str | None = None):
    """fasta, fastq or unknown, by how a file's first line starts; with a third line, fastq needs a + there."""
    starts = lambda name, mark: F.coalesce(F.trim(F.col(name)).startswith(mark), F.lit(False))
    plus = starts(third_line, "+") if third_line else F.lit(True)
    return F.when(starts(first_line, ">"), "fasta").when(starts(first_line, "@") & plus, "fastq").otherwise("unknown")
