"""Evidence from facts of sequences, without the sequences."""

import random

from pyspark.sql import functions as F

from locusframe.functions.sequence import revcomp
from locusframe.operators import evidence, evidence_run
from locusframe.plans import queries


def test_peptides_are_revised_in_place_as_by_joins(spark):
    made = [
        ("a", "a type:5prime_partial len:6 :1-18(+)", "KKMKKK"), ("b", "b type:internal len:5 :1-15(-)", "KMKKK*"), ("c", "c type:internal", "KMK"), ("d", "d type:complete :1-9(+)", "KMK"),
        ("e", "e type:internal :1-12(+)", "KKKM"), ("e", "e type:5prime_partial :4-15(+)", "KMKK"), ("f", "f type:internal :1-9(+)", "MKK"), ("g", "g type:5prime_partial :1-9(+)", "KKK"),
    ]
    pep = spark.createDataFrame(made, "id string, header string, sequence string")
    classes = spark.createDataFrame([("a", "complete"), ("b", "complete"), ("c", "complete"), ("d", "complete"), ("e", "complete"), ("f", "incomplete"), ("g", "complete")], "query string, class string")
    for rows in (pep, pep.where("id <> 'e'")):
        got = evidence.revised_in_place(rows, classes)
        want = evidence.revised(rows, classes, evidence.shortened(rows))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("id = 'a'").first()["sequence"] == "MKKK"


def test_covered_queries_are_those_of_strict_hits(spark):
    rng = random.Random(3)
    hits = [(f"q{rng.randrange(20)}", f"s{rng.randrange(9)}", rng.choice([0.0, 0.1]), float(rng.choice([90, 95])), float(rng.randrange(60)), float(i), i) for i in range(150)]
    hits = spark.createDataFrame(hits, "query string, subject string, evalue double, pident double, alen double, bits double, qstart int")
    sizes = spark.createDataFrame([(f"q{i}", i * 3) for i in range(18)], "query string, qlen int")
    lengths = spark.createDataFrame([(f"s{i}", i * 8) for i in range(8)] + [("s3", 200)], "subject string, slen long")
    got = evidence.covered_queries(hits, 0.05, 93.0, 0.6, 0.6, sizes, lengths)
    want = evidence.supported_queries(hits.join(sizes, "query"), 0.05, 93.0, 0.6, 0.6, None, lengths).select("query")
    assert 0 < got.count() < 18 and sorted(got.collect()) == sorted(want.collect())


def test_first_stops_say_what_the_letters_before_say(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(90))), rng.randrange(1, 70), rng.randrange(0, 95)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, start int, stop int")
    plus, minus = evidence.first_stops(F.col("s"))
    df = df.select(
        plus.alias("p"), minus.alias("m"), "start", "stop", F.length("s").alias("n"), evidence.has_stop(F.expr("substring(s, 1, start - 1)")).alias("wp"),
        evidence.has_stop(revcomp(F.expr("substring(s, stop + 1)"))).alias("wm"),
    )
    assert df.where("(p > 0 and p + 2 <= start - 1) <> wp or (m > 0 and m + 2 <= n - stop) <> wm").count() == 0
    assert df.where("wp").count() > 9 and df.where("wm").count() > 9


def test_no_sequence_is_stored_or_shuffled(spark, monkeypatch):
    seen = []
    real = evidence_run.stored
    monkeypatch.setattr(evidence_run, "stored", lambda df: seen.append(df.columns) or real(df))
    assert queries.QUERIES["evidence_run"](spark, "/root/testdata/sf0.001").count() == 200
    assert len(seen) >= 5 and not any("sequence" in columns for columns in seen)
