"""The jobs: twice over the same input, over growing input, after a failure, and their rows against SQL and plain versions."""

import json

import duckdb
import pytest

from jobs import queries, region_report, text_intake
from jobs.common import configuration, main
from punctaria.functions import scalar

from .test_clustering import plain_dbscan
from .test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_numbers_and_lines_of_numbers(spark):
    texts = ["1 2\n3,4;5\t6\nx 7\n\n-1e3 .5 +2.\n8 nine\n 1,", "1\r\n2", "", None, "one 1.5.2 1e 0x1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [(r["n"], r["l"]) for r in df.select("i", scalar.numbers_in(df["text"]).alias("n"), scalar.data_lines(df["text"]).alias("l")).orderBy("i").collect()]
    assert got == [
        ([1, 2, 3, 4, 5, 6, 7, -1000, 0.5, 2, 8, 1], ["1 2", "3,4;5\t6", "-1e3 .5 +2.", " 1,"]),
        ([1, 2], ["1\r", "2"]), ([], []), ([], []), ([], []),
    ]


def write_texts(spark, folder, numbers):
    made = [(i, None if i % 7 == 0 else f"{i} {i}\nline of words {i}" * (i % 3), ["de", "en", None, ""][i % 4], f"src{i % 2}", i) for i in numbers]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, extra int").coalesce(1).write.mode("append").parquet(folder)


def test_intake_takes_only_what_is_new(spark, tmp_path):
    texts, out, mark = (str(tmp_path / x) for x in ("texts", "out", "mark"))
    write_texts(spark, texts, range(20))
    assert text_intake.run(spark, texts, out, mark)["texts"] == 20
    before = sorted(map(tuple, text_intake.items(spark, out).collect()), key=repr)
    assert text_intake.run(spark, texts, out, mark) | {"totals": 0} == {"batches": 0, "texts": 0, "totals": 0}
    assert sorted(map(tuple, text_intake.items(spark, out).collect()), key=repr) == before
    write_texts(spark, texts, range(20, 50))
    write_texts(spark, texts, [3, 3])  # repeated rows in a new file are new rows
    assert text_intake.run(spark, texts, out, mark)["texts"] == 32
    got = text_intake.items(spark, out)
    assert sorted(r["id"] for r in got.collect()) == sorted([*range(50), 3, 3])
    assert {r["class"] for r in got.collect()} == {"de", "en", "none"}
    assert {r["id"]: (r["n_lines"], r["n_data_lines"], r["n_numbers"]) for r in got.filter("id in (0, 1, 3)").collect()} == {0: (0, 0, 0), 1: (2, 1, 3), 3: (1, 0, 0)}
    totals = spark.read.parquet(f"{out}/totals")
    assert totals.agg({"texts": "sum"}).first()[0] == 52 and totals.agg({"numbers": "sum"}).first()[0] == got.agg({"n_numbers": "sum"}).first()[0]


def test_intake_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    texts, out, mark = (str(tmp_path / x) for x in ("texts", "out", "mark"))
    write_texts(spark, texts, range(10))
    with monkeypatch.context() as m:
        m.setattr(text_intake, "summed", lambda *a: 1 / 0)  # after the items of the batch are written
        with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
            text_intake.run(spark, texts, out, mark)
    assert text_intake.items(spark, out).count() == 10
    assert text_intake.run(spark, texts, out, mark)["texts"] == 10
    assert sorted(r["id"] for r in text_intake.items(spark, out).collect()) == list(range(10))


def write_points(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string").write.mode("overwrite").parquet(folder)


def test_report_of_channels(spark, tmp_path):
    points, out = str(tmp_path / "points"), str(tmp_path / "out")
    made = [(i, (i * 37 % 100) / 4, i * 11 % 10, ["a", "b", None][i % 3]) for i in range(240)]
    write_points(spark, points, [*made, (900, None, 1, "a"), (901, float("nan"), 1, "a"), (None, 1.0, 1, "a")])
    told = region_report.run(spark, points, out)
    assert told["read"] == 243 and told["left_out"] == 3 and told["points"] == 240
    labels = {r["pid"]: r["label"] for r in spark.read.parquet(f"{out}/points").collect()}
    for channel in ("a", "b", None):
        own = [(i, x, u * 3.2) for i, x, u, c in made if c == channel]
        assert [labels[i] for i, *_ in own] == plain_dbscan([p[1:] for p in own], 4.0, 8)
    before = sorted(map(tuple, region_report.report(spark, out).collect()))
    assert {r[-1] for r in before} == {"a", "b", "none"}
    assert region_report.run(spark, points, out) == told
    assert sorted(map(tuple, region_report.report(spark, out).collect())) == before
    write_points(spark, points, [(i, x, u, c) for i, x, u, c in made if c == "b"][:30])  # another run over one channel
    region_report.run(spark, points, out)
    after = sorted(map(tuple, region_report.report(spark, out).collect()))
    assert [r for r in after if r[-1] != "b"] == [r for r in before if r[-1] != "b"]
    assert sum(r[3] for r in after if r[-1] == "b") == 30
    write_points(spark, points, [])
    assert region_report.run(spark, points, out)["points"] == 0


def test_settings_and_command_line(tmp_path, monkeypatch):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"eps": 2.5}))
    assert configuration("region_report", str(own))["eps"] == 2.5 and configuration("region_report")["eps"] == 4.0
    own.write_text(json.dumps({"epsilon": 2.5}))
    with pytest.raises(ValueError):
        configuration("region_report", str(own))

    class Session:
        stopped = False
        builder = type("B", (), {"appName": lambda self, n: self, "config": lambda self, *a: self, "getOrCreate": lambda self: Session()})()

        def stop(self):
            Session.stopped = True

    import jobs.common

    monkeypatch.setattr(jobs.common, "SparkSession", Session)
    called = []
    assert main("text_intake", lambda spark, *paths, settings: called.append((paths, settings["id"])), {"texts": "", "out": ""}, ["a", "b"]) == 0
    assert called == [(("a", "b"), "doc_id")] and Session.stopped
