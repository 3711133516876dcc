"""Column functions on sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.session import importable

STOPS = ("TAA", "TAG", "TGA")
STARTS = ("ATG", "TTG", "GTG", "CTG")
#: The standard genetic code (fixed values), by codon in TCAG order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), CODE, strict=True)}


def revcomp(seq: Column) -> Column:
    """Reverse complement; case is kept, N stays N."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def on_strand(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", revcomp(seq)).otherwise(seq)


def codons(seq: Column) -> Column:
    """The whole codons of a sequence, in upper case."""
    # One pass; a lambda over positions would compute ``seq`` anew for each codon where a filter is pushed down.
    return F.regexp_extract_all(F.upper(seq), F.lit("(?s).{3}"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stop_check(seq: Column) -> Column:
    """A struct: length n, whether it is whole codons, the last three bases, and in-frame stop codons before them.

    ``first_internal`` is the first such stop's place (of its first base, from 1), 0 if there is none. Sequences that
    aren't whole codons have no valid and no internal stop.
    """

    def facts(x: Column) -> Column:
        seq, c = x["seq"], x["codons"]
        n = F.length(seq)
        in_frame = (n % 3 == 0) & (n >= 3)
        inner = F.when(in_frame, F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        last = F.when(n >= 3, F.right(seq, F.lit(3))).otherwise("NA")
        places = F.filter(F.transform(inner, lambda c, i: F.when(c.isin(*STOPS), 3 * i + 1)), lambda i: i.isNotNull())
        return bound(places, lambda p: F.struct(
            n.cast("long").alias("n"), in_frame.alias("in_frame"), last.alias("last"), (in_frame & last.isin(*STOPS)).alias("valid_stop"),
            F.size(p).cast("long").alias("internal"), F.coalesce(F.get(p, F.lit(0)), F.lit(0)).cast("long").alias("first_internal"),
        ))

    return bound(bound(F.upper(seq), lambda s: F.struct(s.alias("seq"), codons(s).alias("codons"))), facts)


def translate_cds(seq: Column) -> Column:
    """The peptide of a coding sequence; X for codons with other letters, and what isn't a whole codon at the end is left out."""
    # Bases become digits, 4 for other letters, so a codon read as a number is its place in a table.
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "4"), "ACGT", "0123")
    places = {int("".join(str("ACGT".index(x)) for x in codon)): amino for codon, amino in CODONS.items()}
    table = F.array(*(F.lit(places.get(i, "X")) for i in range(445)))
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("(?s).{3}"), F.lit(0)), lambda c: F.get(table, c.cast("int"))), "")


def cleaned_protein(seq: Column) -> Column:
    """A peptide with the usual sign for stops: a dot becomes a star."""
    return F.translate(seq, ".", "*")


def base_channels(channels: Column, n: int = 5) -> Column:
    """The first ``n`` channels of each position of a one-hot array: the bases without the soft mask."""
    return F.transform(channels, lambda x: F.slice(x, 1, n))


def channel_sums(sequences: DataFrame) -> DataFrame:
    """(seq_name, sums): the five base channels of ``one_hot`` (A, C, G, T, N) summed over each sequence; null for a null one.

    A task counts the bytes of a text and looks their channels up in a table; bytes within a letter of several count for nothing.
    """
    table = np.zeros((256, 5), np.int64)
    table[:, 4] = 1
    table[0x80:0xC0] = 0
    for i, base in enumerate("ACGT"):
        for letter in (base, base.lower()):
            table[ord(letter)] = np.eye(5, dtype=np.int64)[i]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch["sequence"].cast(pa.large_binary())
            out = [np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) @ table if x.is_valid else None for x in each]
            yield pa.record_batch([batch["seq_name"], pa.array(out, pa.list_(pa.int64()))], ["seq_name", "sums"])

    importable(sequences.sparkSession)
    rows = sequences.select("seq_name", "sequence")
    return rows.mapInArrow(sums, f"seq_name {dict(rows.dtypes)['seq_name']}, sums array<long>")


def first_sequences(sequences: DataFrame, n: int, order: str = "seq_ord") -> DataFrame:
    """The first ``n`` sequences in order."""
    return sequences.orderBy(order, "seq_name").limit(n)


def base_rows(seq: Column) -> Column:
    """An array of (pos from 1, base A, C, G, T or N, softmask) for each letter."""
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    return F.transform(
        letters,
        lambda x, i: F.struct(
            (i + 1).cast("long").alias("pos"), F.when(F.upper(x).isin(*"ACGT"), F.upper(x)).otherwise("N").alias("base"), x.isin(*"acgt").alias("softmask")
        ),
    )


def one_hot(base: Column, softmask: Column) -> Column:
    """Channels A, C, G, T, N and softmask."""
    return F.array(*((base == b).cast("int") for b in "ACGTN"), softmask.cast("int"))


def splice_strand(first: Column, last: Column, allowed: tuple[str, ...] = ("gtag", "gcag", "atac")) -> Column:
    """The strand of an intron from its first and last two bases: "+", "-", "both", or null."""
    plus = F.lower(F.concat(first, last))
    minus = F.lower(F.concat(revcomp(last), revcomp(first)))
    return F.when(plus.isin(*allowed) & minus.isin(*allowed), "both").when(plus.isin(*allowed), "+").when(minus.isin(*allowed), "-")
