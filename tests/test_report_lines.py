"""Reports as tables of lines."""

import json

from pyspark.sql import functions as F

from lexigrid.plans import report


def made(spark):
    units = spark.range(40).select(
        F.col("id").alias("unit_id"), F.concat(F.lit("/f"), "id").alias("path"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit("g").alias("name"), F.lit("function").alias("kind")
    )
    pairs = spark.range(30).select(
        F.col("id").alias("i"), (F.col("id") + 1).alias("j"), (0.9 - F.col("id") % 3 / 10).alias("similarity"),
        F.lit(0.5).alias("structural"), F.lit(None).cast("double").alias("distinct"),
    )
    return units, pairs


def test_reports_of_pairs(spark, tmp_path):
    units, pairs = made(spark)
    order = sorted((-round(0.9 - k % 3 / 10, 4), k) for k in range(30))
    for output in ("text", "markdown", "json"):
        saved = report.save(report.pair_report(report.with_refs(pairs, units), output), f"{tmp_path}/{output}")
        # The parts of a saved report follow each other by name.
        text = "".join(p.read_text() for p in sorted((tmp_path / output).glob("part-*")))
        assert saved.count() == len(text.splitlines())
        if output == "json":
            found = [(-x["similarity"], int(x["a"]["path"][2:])) for x in json.loads(text)["pairs"]]
        else:
            body = text.splitlines()[len(report.PAIR_HEAD[output]):]
            assert text.startswith("\n".join(report.PAIR_HEAD[output]))
            found = [(-float(line.strip("| ").split()[0]), int(line.split("/f")[1].split(":")[0])) for line in body]
        assert found == order
    empty = report.pair_report(report.with_refs(pairs.where("false"), units), "json").orderBy("number").collect()
    assert json.loads("".join(r["line"] for r in empty)) == {"pairs": []}


def test_reports_of_clusters(spark):
    units, _ = made(spark)
    members = spark.createDataFrame([(0, 2, 0), (0, 2, 1), (5, 3, 5), (5, 3, 6), (5, 3, 7)], "cluster_id long, cluster_size long, node long")
    lines = [r["line"] for r in report.cluster_report(members, units).orderBy("number").collect()]
    assert lines[0] == "cluster 1 (3 matches):" and lines[4] == "cluster 2 (2 matches):" and len(lines) == 7
    assert [line.split("/f")[1][0] for line in lines if "/f" in line] == ["5", "6", "7", "0", "1"]
    assert len(report.cluster_report(members, units, "markdown", 1).collect()) == 4


def test_pairs_of_a_saved_report_are_found_once(spark, sf, monkeypatch):
    """Ranging reads its rows twice, so they are written before."""
    from lexigrid.plans import catalogue

    ranged, plain = [], catalogue.numbered
    monkeypatch.setattr(catalogue, "numbered", lambda df, *args, **kwargs: (ranged.append(df), plain(df, *args, **kwargs))[1])
    lines = catalogue.report_sink(spark, sf).count()
    assert lines == ranged[0].count()
    assert "FlatMap" not in ranged[0]._jdf.queryExecution().executedPlan().toString()
