"""Files whose records are longer than a row or a task's part of the file: FASTA to tiles, fixedStep WIG to positions.

A part of a file is read in its own task, which joins consecutive lines to bounded chunks. One row a part says what its end leaves
open: the last header and how much came after it. Sums of these over the parts before give each chunk its record and place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.genome import TILE
from locusframe.functions.sequence import revcomp
from locusframe.session import hinted, importable, stored

NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|Infinity|Inf)[dDfF]?", re.IGNORECASE)


def _headed(mark: str, body: Callable[[str], str | None], gap: str, most: int) -> Callable:
    """Joins the lines of a task's parts: a row for each header (n 0), and chunks of ``most`` units at most of what follows it.

    ``k`` numbers the headers of a part from 1; 0 is what belongs to a header before the part. ``at`` is where the part begins in its file,
    ``place`` how many units of its record come before in this part. ``body`` gives a line's content, or None if it has none; with
    a ``gap`` a unit is a line, else a character.
    """
    names = ["file", "at", "k", "header", "place", "n", "body"]
    kinds = pa.schema([("file", pa.string()), ("at", pa.int64()), ("k", pa.int64()), ("header", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, k, header, place, held, size = None, 0, None, 0, [], 0

        def cut(everything: bool) -> None:
            nonlocal place, held, size
            units = held if gap else "".join(held)
            upto = len(units) if everything else len(units) // most * most
            for i in range(0, upto, most):
                now = units[i : min(i + most, upto)]
                out.append((*part, k, header, place, len(now), gap.join(now) if gap else now))
                place += len(now)
            held, size = list(units[upto:]) if gap else [units[upto:]], len(units) - upto

        for batch in batches:
            for name, at, line in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
                if (name, at) != part:
                    cut(True)
                    part, k, header, place = (name, at), 0, None, 0
                if line.startswith(mark):
                    cut(True)
                    k, header, place = k + 1, line[len(mark) :], 0
                    out.append((*part, k, header, 0, 0, None))
                    continue
                text = body(line)
                if text is not None:
                    held.append(text)
                    size += 1 if gap else len(text)
                    if size >= 16 * most:
                        cut(False)
            if len(out) >= 1_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names)
                out.clear()
        cut(True)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names)

    return run


def headed_chunks(spark: SparkSession, path: str | Sequence[str], mark: str, body: Callable[[str], str | None], gap: str, most: int) -> DataFrame:
    """(file, record_at, record_k, header, place, n, body): chunks of each record of text files with their place in it; n is 0 for a header's own row.

    (file, record_at, record_k) tells records apart. What stands before a file's first header is left out.
    """
    importable(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    chunks = stored(raw.mapInArrow(_headed(mark, body, gap, most), "file string, at long, k long, header string, place long, n long, body string"))
    each = chunks.groupBy("file", "at", "k").agg(F.sum("n").alias("n"), F.max("header").alias("header"))
    ends = each.groupBy("file", "at").agg(F.max(F.struct(F.col("k").alias("last"), "n", "header")).alias("x")).select("file", "at", "x.*")
    order = Window.partitionBy("file").orderBy("at")
    # A part with a header begins a new stretch; parts without one add to what is open.
    parts = ends.withColumn("stretch", F.sum((F.col("last") > 0).cast("int")).over(order))
    within = Window.partitionBy("file", "stretch").orderBy("at")
    parts = parts.withColumns({"upto": F.sum("n").over(within), "own_at": F.first("at").over(within), "own_k": F.first("last").over(within), "own_header": F.first("header").over(within)})
    before = {f"open_{c}": F.lag(x).over(order) for c, x in (("place", "upto"), ("at", "own_at"), ("k", "own_k"), ("header", "own_header"))}
    opened = stored(parts.select("file", "at", *(x.alias(n) for n, x in before.items())))
    rows = chunks.join(hinted(opened), ["file", "at"])
    carried = F.col("k") == 0
    pick = lambda a, b: F.when(carried, F.col(a)).otherwise(F.col(b))
    return rows.select(
        "file", pick("open_at", "at").alias("record_at"), pick("open_k", "k").alias("record_k"), pick("open_header", "header").alias("header"),
        (F.col("place") + F.when(carried, F.coalesce("open_place", F.lit(0))).otherwise(0)).alias("place"), "n", "body",
    ).where("header is not null")


def _bases(upper: bool) -> Callable[[str], str | None]:
    def body(line: str) -> str | None:
        text = "".join(line.split())
        return (text.upper() if upper else text) or None

    return body


def _record_chunks(spark: SparkSession, path: str | Sequence[str], upper: bool, size: int) -> DataFrame:
    header = F.trim("header", F.lit("\r \t"))
    return headed_chunks(spark, path, ">", _bases(upper), "", size).withColumns({"header": header, "seq_name": F.split(header, r"\s")[0]})


RECORD = ["file", "record_at", "record_k", "seq_name", "header"]


COUNTED = ["file", "at", "header", "n"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task's parts and their numbers of letters, without the letters. ``file`` and ``at`` are set only where a part may lack some of a record:
    on its last one, and on what stands before its first (which has no header)."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    one = lambda *row: pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], COUNTED)
    part, header, size = None, None, 0
    for batch in batches:
        files, ats, lines = (batch.column(c) for c in ("file", "at", "value"))
        at = ats.to_numpy()
        new = (at[1:] != at[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(at)] if len(at) else []
        n = pc.binary_length(lines).to_numpy().astype(np.int64)
        for i in np.flatnonzero(pc.match_substring_regex(lines, "[^!-~]").to_numpy(zero_copy_only=False)).tolist():
            n[i] = len("".join(lines[i].as_py().split()))
        headed = pc.starts_with(lines, ">").to_numpy(zero_copy_only=False)
        done = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            now = (files[low].as_py(), int(at[low]))
            if now != part:
                if part:
                    done.append(one(*part, header, size))
                part, header, size = now, None, 0
            marks = np.flatnonzero(headed[low:high])
            letters = np.where(headed[low:high], 0, n[low:high])
            if not len(marks):
                size += int(letters.sum())
                continue
            size += int(letters[: marks[0]].sum())
            names = pc.utf8_slice_codeunits(lines.take(pa.array(marks + low)), 1)
            sums = np.add.reduceat(letters, marks)
            # The first mark ends the record that was open, which began in this part if it has a header.
            done.append(one(*(part if header is None else (None, None)), header, size))
            none = len(marks) - 1
            done.append(pa.record_batch([pa.nulls(none, kinds[0]), pa.nulls(none, kinds[1]), names[:-1], pa.array(sums[:-1])], COUNTED))
            header, size = names[-1].as_py(), int(sums[-1])
        yield from done
    if part:
        yield one(*part, header, size)


def fasta_lengths(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(seq_name, header, length) of all records, those without letters too; no record is ever one row of letters.

    Letters are counted where they are read. Only what crosses the borders of a file's parts, two rows a part, is put together by a shuffle.
    """
    importable(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    rows = stored(raw.mapInArrow(_counted, "file string, at long, header string, n long"))
    # Of a part's two rows the one without a header comes first; it belongs to the last record of the parts before.
    begun = F.count("header").over(Window.partitionBy("file").orderBy("at", F.col("header").isNotNull()))
    crossing = rows.where("file is not null").withColumn("record", begun).groupBy("file", "record").agg(F.max("header").alias("header"), F.sum("n").alias("n"))
    whole = rows.where("file is null").select("header", "n").unionByName(crossing.where("header is not null").select("header", "n"))
    header = F.trim("header", F.lit("\r \t"))
    return whole.select(F.split(header, r"\s", 2)[0].alias("seq_name"), header.alias("header"), F.col("n").alias("length"))


def fasta_tiles(spark: SparkSession, path: str | Sequence[str], size: int = TILE, upper: bool = False) -> DataFrame:
    """(seq_name, header, tile, sequence): the letters from tile * ``size`` + 1 on of each record of plain, .gz or .bz2 FASTA files.

    Equal to cutting ``read_fasta``'s rows, but no row is longer than a tile, and a record of any length is read by as many tasks as its
    file has parts (but for compressed files, and for what a file has on one line). Letters are shuffled once. Records of one name stay
    apart if their files or places differ. Records without letters have no tile.
    """
    rows = _record_chunks(spark, path, upper, size).where("n > 0")
    first = F.floor(F.col("place") / size)
    cut = F.least(F.col("n"), (first + 1) * size - F.col("place")).cast("int")
    piece = lambda tile, at, text: F.struct(tile.alias("tile"), at.alias("at"), text.alias("text"))
    two = F.array(
        piece(first, F.col("place"), F.substring("body", F.lit(1), cut)), piece(first + 1, F.col("place") + cut, F.substring("body", cut + 1, F.col("n").cast("int")))
    )
    each = rows.select(*RECORD, F.explode(F.filter(two, lambda x: x["text"] != "")).alias("x")).select(*RECORD, "x.*")
    whole = each.groupBy(*RECORD, "tile").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return whole.select("seq_name", "header", "tile", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("sequence"))


def tile_blocks(tiles: DataFrame, size: int, margin: int) -> DataFrame:
    """``grammar.blocks`` of tiles (seq_name, tile, sequence) of ``size``: both strands, ``margin`` letters more on each side from the tiles beside it.

    Each tile sends its ends to its neighbours, so the whole sequence is in no row. The margin may not be longer than a tile.
    """
    if margin > size:
        raise ValueError("the margin may not be longer than a tile")
    tiles = tiles.select("seq_name", "tile", "sequence")
    n = F.length("sequence")
    sent = F.array(
        F.struct(F.col("tile").alias("to"), F.lit(1).alias("side"), F.col("sequence").alias("text")),
        F.struct((F.col("tile") + 1).alias("to"), F.lit(0).alias("side"), F.right("sequence", F.lit(margin)).alias("text")),
        F.struct((F.col("tile") - 1).alias("to"), F.lit(2).alias("side"), F.left("sequence", F.lit(margin)).alias("text")),
    )
    lengths = tiles.groupBy("seq_name").agg(F.sum(n.cast("long")).alias("total"), F.count("*").alias("count"))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("text")))
    met = tiles.select("seq_name", F.explode(sent).alias("x")).select("seq_name", "x.*").groupBy("seq_name", "to").agg(side(1).alias("own"), side(0).alias("low"), side(2).alias("high")).where("own is not null")
    fill = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = met.join(lengths, "seq_name").withColumns({
        "letters": F.concat(F.lpad(fill("low"), margin, "N"), "own", F.rpad(fill("high"), margin, "N")), "length": F.length("own"), "i": F.col("to"),
        "strand": F.explode(F.array(F.lit("+"), F.lit("-"))),
    })
    minus = F.col("strand") == "-"
    at = F.col("i") * size
    return rows.select(
        "seq_name", "strand", F.when(minus, F.col("count") - 1 - F.col("i")).otherwise(F.col("i")).alias("block"),
        (F.when(minus, F.col("i") == 0).otherwise(F.col("i") == F.col("count") - 1)).alias("last"),
        F.when(minus, F.col("total") - at - F.col("length") + 1).otherwise(at + 1).alias("first"), F.col("length").cast("int").alias("length"), "total",
        F.when(minus, revcomp(F.col("letters"))).otherwise(F.col("letters")).alias("letters"),
    )


def _value(line: str) -> str | None:
    text = line.strip()
    return text if NUMBER.fullmatch(text) else None


def wig_chunks(spark: SparkSession, path: str | Sequence[str], most: int = 1 << 12) -> DataFrame:
    """(seqid, start, step, values): stretches of fixedStep blocks of ``most`` values at most; ``start`` is the first value's position.

    A block of any length is read by as many tasks as its file has parts. Lines that are no numbers don't count.
    """
    rows = headed_chunks(spark, path, "fixedStep", _value, "\n", most).where("n > 0 and header rlike 'chrom=\\\\S+'")
    fact = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("header", rf"{k}=(\d+)", 1), F.lit("")).cast("long"), F.lit(d))
    step = fact("step", 1)
    values = F.transform(F.split("body", "\n"), lambda x: x.cast("double"))
    return rows.select(F.regexp_extract("header", r"chrom=(\S+)", 1).alias("seqid"), (fact("start", 1) + F.col("place") * step).alias("start"), step.alias("step"), values.alias("values"))


def wig_positions(spark: SparkSession, path: str | Sequence[str], most: int = 1 << 12) -> DataFrame:
    """(seqid, pos, value) of fixedStep blocks."""
    rows = wig_chunks(spark, path, most).select("seqid", "start", "step", F.posexplode("values").alias("i", "value"))
    return rows.select("seqid", (F.col("start") + F.col("i") * F.col("step")).alias("pos"), "value")
