"""Attributes of rows: repeated keys, mixed styles, and ids without a map."""

import contextlib
import io

from pyspark.sql import functions as F

from locusframe.functions.attributes import parse, value_of
from locusframe.sources import text

ODD = [
    'transcript_id "b c"; gene_id "a"; x=1;', "ID=a;Parent=b;ID=c", "ID=a;ID", "ID=a; ID ", "ID=a;ID=", 'note "ID=y"; k', "", None, ";;", "ID=b=c;d", 'ID "1"; ID "2"; a "3"', ' ID = x ; P=" q "',
    'ID  "v"', "ID", "ID x=z", "=v; ID=", 'xID=a;ID=" é "; b "ü=ä"', "IDx=3;gene=7", 'gene "1";gene_id=2', "ID= x ;Parent=p,q", 'Parent="p"; ID;', "a;ID=1 ",
]


def test_single_values_are_those_of_the_map(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "attrs string")
    for key in ("ID", "Parent", "gene", "gene_id", "transcript_id", "a"):
        both = rows.select("attrs", F.nullif(value_of(F.col("attrs"), key), F.lit("")).alias("one"), F.nullif(F.try_element_at(parse(F.col("attrs")), F.lit(key)), F.lit("")).alias("other")).collect()
        assert [r["one"] for r in both] == [r["other"] for r in both], key
    assert rows.select(parse(F.col("attrs"))["ID"]).collect()[1][0] == "c"


def test_ids_are_read_without_a_map(spark, tmp_path):
    (tmp_path / "a.gff").write_text('c\t.\tCDS\t1\t9\t.\t+\t0\ttranscript_id "t"; gene_id "g";\r\nc\t.\tmRNA\t1\t9\t.\t+\t.\tID=m;Parent=h\n')
    rows = text.read_gff(spark, f"file://{tmp_path}/a.gff")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.select("tx_id", "gene_id").explain()
    assert "map_from_entries" not in out.getvalue()
    assert sorted(map(tuple, rows.select("line_no", "tx_id", "gene_id", "attributes").collect())) == [
        (0, "t", "g", {"transcript_id": "t", "gene_id": "g"}), (1, "m", "h", {"ID": "m", "Parent": "h"}),
    ]
