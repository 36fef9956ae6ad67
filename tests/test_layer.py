"""S1, F1-F3, F6 on a stored layer: one validated pass, errors by file, partition pruning."""

import os

import pytest
from pyspark.sql import functions as F

from creditspark.operators.clean import clean
from creditspark.operators.filters import filter_domains, filter_portfolio
from creditspark.params import RunParams
from creditspark.plans.portfolio import run_layer, run_portfolio
from creditspark.schema import MalformedRowsError, MissingColumnsError
from creditspark.sources import layer as L
from creditspark.sources import publish as P
from creditspark.sources.csv import read_csv_portfolio
from creditspark.sources.sample import sample_portfolio

HEADER = "LoanID,Borrower,Sector,Geography,LoanAmount,InterestRate,TermMonths,CreditScore"


def folder(scratch, files):
    path = os.path.join(scratch, "in")
    os.makedirs(path)
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lines(k, n=50, name="Café"):
    return HEADER + "\n" + "".join(f"L-{k}-{i},{name} {i},Retail,NY,{1000 + i},5,12,700\n" for i in range(n))


def test_one_pass_equals_the_reader(spark, scratch):
    path = folder(scratch, {"a.csv": lines(1), "b.csv": lines(2).encode("latin-1"), "c.csv": "﻿" + lines(3, name='"Big ""A"", Ltd"'),
                            "d.csv": HEADER + "\nL-4,,none,,NA,7%,x,\n"})
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ingest", "one pass")
    layer = L.ingest(spark, path, scratch, "one")
    spark.sparkContext.setJobGroup("other", "")
    want = clean(read_csv_portfolio(spark, path))
    assert rows(layer.loans.select(want.columns)) == rows(want) and layer.published.rows["loans"] == 151
    assert len(jobs.getJobIdsForGroup("ingest")) < 20
    assert {r.Borrower for r in layer.loans.where("LoanID = 'L-2-7'").collect()} == {"Café 7"}


def test_sound_files_are_scanned_once(spark, scratch, monkeypatch):
    """The bytes of the input are read by the header, the separator and one pass."""
    path = folder(scratch, {"a.csv": lines(1, 4000)})
    monkeypatch.setattr(L, "encodings", None)  # no second look at the files
    monkeypatch.setattr(L, "_malformed", None)
    assert L.ingest(spark, path, scratch, "once").published.rows["loans"] == 4000


def test_a_file_that_mixes_encodings_is_latin_as_a_whole(spark, scratch):
    mixed = lines(1).encode() + "L-9,Genève,Retail,NY,1,5,12,700\n".encode("latin-1")
    path = folder(scratch, {"a.csv": mixed, "b.csv": lines(2)})
    layer = L.ingest(spark, path, scratch, "mixed")
    want = clean(read_csv_portfolio(spark, path))
    assert rows(layer.loans.select(want.columns)) == rows(want)
    assert layer.loans.where("LoanID = 'L-9'").head().Borrower == "Genève"


def test_rows_that_do_not_fit_name_their_files(spark, scratch):
    path = folder(scratch, {"good.csv": lines(1), "wide.csv": lines(2) + "L-x,B,Retail,NY,1,5,12,700,9,9\n" * 3,
                            "open.csv": lines(3) + 'L-y,"open,Retail,NY,1,5,12,700\n'})
    with pytest.raises(MalformedRowsError) as e:
        L.ingest(spark, path, scratch, "bad")
    assert {os.path.basename(k): v for k, v in e.value.by_file.items()} == {"wide.csv": (3, 0), "open.csv": (0, 1)}
    assert e.value.surplus == 3 and e.value.unbalanced == 1 and "wide.csv" in str(e.value)
    with pytest.raises(P.PublishError):
        L.read_layer(spark, scratch, "bad")
    with pytest.raises(MissingColumnsError):
        L.ingest(spark, folder(os.path.join(scratch, "2"), {"a.csv": "LoanID,LoanAmount\n1,2\n"}), scratch, "missing")


def test_filters_read_one_folder(spark, scratch):
    sectors = ["Retail", "Energy", "Tech", "Unknown", "État/x"]
    loans = sample_portfolio(spark).crossJoin(spark.range(30)).withColumn(
        "Sector", F.array(*[F.lit(s) for s in sectors])[(F.col("id") % 5).cast("int")]).withColumn(
        "LoanID", F.concat("LoanID", F.lit("-"), "id")).drop("id")
    layer = L.write_layer(spark, loans, scratch, "x")
    whole = clean(loans)
    assert rows(layer.loans.select(whole.columns)) == rows(whole)
    assert rows(layer.domains()) == rows(filter_domains(whole))
    for sector, geography in (("Tech", "All"), ("État/x", "All"), ("All", "NY"), ("Retail", "nowhere"), ("no such", "All"), ("no such", "nowhere")):
        got, eff = layer.filtered(sector, geography)
        want, asked = filter_portfolio(whole, sector, geography)
        assert rows(got.select(whole.columns)) == rows(want) and eff.resolve() == asked.resolve(), (sector, geography)
    plan = layer.filtered("Tech", "All")[0]._jdf.queryExecution().executedPlan().toString()
    part = L.sector_part(F.lit("Tech"))
    part = spark.range(1).select(part).head()[0]
    assert f"PartitionFilters: [isnotnull(_part#" in plan and f"= {part})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    files = layer.filtered("Tech", "All")[0].select(F.input_file_name()).distinct().collect()
    assert all(f"_part={part}/" in f[0] for f in files)
    params = RunParams(sector="Tech")
    a, b = run_layer(spark, layer, params), run_portfolio(spark, loans, params)
    assert rows(a.kpis()) == rows(b.kpis()) and rows(a.view.select("LoanID", "Scenario")) == rows(b.view.select("LoanID", "Scenario"))
