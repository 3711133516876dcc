"""Column functions on the attribute column of GTF and GFF3 rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(attrs: Column) -> Column:
    return F.filter(F.transform(F.split(attrs, ";"), lambda x: F.trim(x)), lambda x: x != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entry(x: Column) -> Column:
    rest = lambda key: F.substring(x, F.length(key) + 2, F.length(x))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    gff = lambda key: x.contains("=") & ~key.contains(" ")
    plain = _once(F.substring_index(x, " ", 1), lambda key: entry(key, F.trim(rest(key), F.lit('" '))))
    return _once(F.substring_index(x, "=", 1), lambda key: F.when(gff(key), entry(key, rest(key))).otherwise(plain))


def parse(attrs: Column) -> Column:
    """A map from ``k=v;`` or ``k "v";`` (or a mixture); of a repeated key the last value holds."""
    keys = lambda entries: F.transform(entries, lambda e: e["key"])
    last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    repeated = lambda entries: F.size(F.array_distinct(keys(entries))) < F.size(entries)
    # Entries are looked at many times, and lambdas work out what they name each time.
    return _once(F.transform(_parts(attrs), _entry), lambda entries: F.map_from_entries(F.when(repeated(entries), last(entries)).otherwise(entries)))


def value_of(attrs: Column, key: str) -> Column:
    """``parse(attrs)[key]``, empty where there is none, without a map: one pattern finds the last part with this key."""
    own = rf'(?:.*;)? *{re.escape(key)}(?:=([^;]*?) *| [" ]*([^;]*?)[" ]*|)(?:;.*|\z)'
    # Most keys aren't there at all.
    return F.when(~attrs.contains(key), "").otherwise(F.regexp_replace(attrs, rf"(?s)\A(?:{own}|.*)\z", "$1$2"))


def format_gff(attributes: Column) -> Column:
    """ID, Parent, then the others by name, as ``k=v;k=v``."""
    order = lambda k: F.when(k == "ID", "0").when(k == "Parent", "1").otherwise(F.concat(F.lit("2"), k))
    rows = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.struct(order(e["key"]).alias("o"), F.concat(e["key"], F.lit("="), e["value"]).alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), ";")


def format_gtf(attributes: Column) -> Column:
    """gene_id, transcript_id, then the others by name, as ``k "v"; k "v";``."""
    order = lambda k: F.when(k == "gene_id", "0").when(k == "transcript_id", "1").otherwise(F.concat(F.lit("2"), k))
    rows = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.struct(order(e["key"]).alias("o"), F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";')).alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), " ")


def format_pairs(pairs: Sequence[tuple[str, Column]]) -> Column:
    """``k=v;k=v`` in the order given."""
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in pairs))


def parse_pairs(attrs: Column) -> Column:
    """An array of (key, value) of ``k=v;`` or ``k "v";`` attributes in their order; repeated keys stay."""
    return F.transform(_parts(attrs), _entry)


def format_ordered(pairs: Column, gtf: bool = False) -> Column:
    """What ``parse_pairs`` gives as text, in its order."""
    middle, end, between = (' "', '";', " ") if gtf else ("=", "", ";")
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(middle), e["value"], F.lit(end))), between)
