import gzip
import json
import time
from dataclasses import dataclass

import pytest
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators import attribution, panel, prepare, promotion
from tidepanel.sources import files, prices, sinks, snapshots, store, tickets
from tidepanel.sources.config import layers, load
from tidepanel.spec import PanelSpec
from tidepanel.streaming import incremental


@dataclass(frozen=True)
class Rules:
    least: int = 2
    months: tuple = (1,)


def test_settings_build_on_one_another(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: [1, 2]}\nb: 2\ndata: {raw: in, far: 's3://x/y'}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "middle.yaml").write_text("extends: ../base.yaml\nrules: {minimum: 5, months: [4, 5]}\n")
    (tmp_path / "own.yaml").write_text("extends: sub/middle.yaml\na: {y: [3], z: 4}\n")
    own = load(tmp_path / "own.yaml")
    assert own.values["a"] == {"x": 1, "y": [3], "z": 4} and own.at("a.z") == 4 and own.at("a.q.r", 7) == 7 and own.at("b.c") is None
    assert own.location("data.raw") == str(tmp_path / "in") and own.location("data.far") == "s3://x/y" and own.location("none") is None
    assert own.fill(Rules, "rules", {"least": "minimum"}) == Rules(5, (4, 5)) and own.fill(Rules, "nothing") == Rules()
    (tmp_path / "one.yaml").write_text("extends: two.yaml\n")
    (tmp_path / "two.yaml").write_text("extends: one.yaml\n")
    with pytest.raises(ValueError):
        layers(tmp_path / "one.yaml")


def test_headers():
    assert [snapshots.normalised(x) for x in (" Internal Pk ", "Ventas ($)", "Fecha-ts", "A  b/c")] == ["internal_pk", "ventas", "fecha_ts", "a_b_c"]


def test_files_of_different_headers_and_last_file_wins(spark, tmp_path):
    (tmp_path / "202401.csv").write_text("ID,Periodo,Estado,Fecha ts\n1,202401,ACTIVE,2023-12-31 10:00:00 +0000\n2,202401,BLOCKED,bad\n")
    (tmp_path / "202402.csv").write_text("Periodo,Extra,ID\n202402,7,1\n202401,8,2\n")
    with gzip.open(tmp_path / "202404.csv.gz", "wt") as f:
        f.write("ID,Periodo,Estado\n1,202404,odd\n")
    (tmp_path / "notes.txt").write_text("x")
    found = snapshots.resolve(spark, str(tmp_path))
    assert [p.rsplit("/")[-1] for p in found] == ["202401.csv", "202402.csv", "202404.csv.gz"]
    rows = {(r["id"], r["period"]): r for r in snapshots.load_panel(spark, str(tmp_path)).collect()}
    assert set(rows) == {(1, 202401), (1, 202402), (1, 202404), (2, 202401)}
    assert rows[2, 202401]["extra"] == 8 and rows[2, 202401]["estado"] is None and rows[1, 202404]["t"] == 2
    assert rows[1, 202401]["tenure_months"] == 0 and rows[1, 202404]["severity"] == 0
    drift = snapshots.header_drift(snapshots.headers(spark, found))
    assert drift[found[1]] == ({"estado", "fecha_ts"}, {"extra"}) and list(drift)[1] == found[2]
    with pytest.raises(FileNotFoundError):
        snapshots.resolve(spark, str(tmp_path / "none"))


def test_nan_becomes_null_and_stale_caches(spark, tmp_path):
    spark.createDataFrame([(1, 202401, float("nan"))], "ID int, Periodo int, v double").write.parquet(str(tmp_path / "a.parquet"))
    assert snapshots.read_one(spark, str(tmp_path / "a.parquet")).first()["v"] is None
    assert snapshots.is_stale(spark, str(tmp_path / "*.parquet"), str(tmp_path / "cache"))
    (tmp_path / "cache").mkdir()
    assert not snapshots.is_stale(spark, str(tmp_path / "*.parquet"), str(tmp_path / "cache"))
    assert not snapshots.is_stale(spark, "s3://bucket/x", str(tmp_path / "cache"))


def test_tickets_and_companies(spark, tmp_path):
    head = '﻿"Ticket ID","Created At","Company ID","Contacts","Ticket Attributes","Ticket Type","Ticket State","Ticket Parts"\n'
    quoted = lambda x: '"' + json.dumps(x).replace('"', '""') + '"'
    line = f'1,1704067200,c1,{quoted({"contacts": [{"external_id": "5", "email": "e@x"}]})},{quoted({"ID de dash": 12})},{quoted({"name": "Bug"})},{quoted([1])},"two\nlines"\n2,bad,,not json,,,,\n'
    (tmp_path / "t.csv").write_text(head + line)
    rows = {r["ticket_id"]: r for r in tickets.load_tickets(spark, str(tmp_path / "t.csv")).collect()}
    assert (rows["1"]["period"], rows["1"]["external_id"], rows["1"]["explicit_id"], rows["1"]["kind"], rows["1"]["state"]) == (202401, "5", "12", "Bug", None)
    assert rows["2"]["created_at"] is None and rows["2"]["external_id"] is None
    refs = [f"{i:024x}" for i in range(20)]
    (tmp_path / "c.csv").write_text("name,ref,number\n" + "".join(f"n{i},{r},{100 + i}\n" for i, r in enumerate([*refs, refs[0]])))
    got = {r["company_ref"]: r["account_id"] for r in tickets.load_companies(spark, str(tmp_path / "c.csv")).collect()}
    assert len(got) == 20 and got[refs[0]] == 100


def test_many_files_of_few_headers_are_few_scans(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02}.csv").write_text(("ID,Periodo,v\n" if i % 2 else "Periodo,ID,w\n") + f"1,202401,{i}\n" if i % 2 else f"Periodo,ID,w\n202401,1,{i}\n")
    out = snapshots.load_raw(spark, str(tmp_path))
    assert [(r["v"], r["w"]) for r in out.collect()] == [(11, None)]  # the last file of all wins, whatever its header
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_time_zone_of_the_session_does_not_matter(spark, tmp_path):
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
        own = spark.createDataFrame([("1", str(1704067200 + 86400 * 31 - 1))], "`Ticket ID` string, `Created At` string")
        assert tickets.flattened(own, {}).first()["period"] == 202401
        (tmp_path / "a.csv").write_text("ID,Periodo,Estado,Fecha ts\n1,202402,ACTIVE,2024-01-01 00:00:00 +0000\n")
        assert round(snapshots.load_panel(spark, str(tmp_path)).first()["tenure_months"], 6) == round(31 / 30.44, 6)
        epochs = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-02 00:00:01' AS a, DATE'1970-01-02' AS b, timestamp_seconds(86401) AS c")
        assert [r[0] for c in "abc" for r in epochs.select(panel.epoch_seconds(F.col(c))).collect()] == [86401, 86400, 86401]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_batches_are_replaced_by_period(spark, tmp_path):
    own = spark.createDataFrame([(1, 202401, 0.5, [("f", 1.0)]), (2, 202402, 0.6, [])], "id int, period int, p double, factors array<struct<feature:string,shap:double>>")
    kept = store.BatchStore(spark, str(tmp_path / "out"))
    assert kept.periods() == [] and kept.health()["status"] == "degraded"
    with pytest.raises(FileNotFoundError):
        kept.load()
    for period in (202401, 202402):
        kept.write(own.filter(F.col("period") == period), period, {"accounts": 1, "importance": [{"feature": "f"}], "threshold": 0.3}, ("parquet", "json"))
    kept.write(own.filter("period = 202402").withColumn("p", F.lit(0.9)), 202402, {"accounts": 1, "threshold": 0.4})
    assert kept.periods() == [202402, 202401] and kept.load().first()["p"] == 0.9 and kept.load(202401).first()["factors"][0]["shap"] == 1.0
    assert json.loads((tmp_path / "out" / "latest.json").read_text())["period"] == 202402
    assert kept.view("summary")["threshold"] == 0.4 and kept.view("importance", 202401) == [{"feature": "f"}] and kept.view("model")["features"] is None
    with pytest.raises(KeyError):
        kept.resolve(202403)
    (tmp_path / "out" / "202405" / "versions" / "1-a").mkdir(parents=True)  # without a commit a batch isn't there
    assert kept.resolve() == 202402 and kept.health(str(tmp_path), str(tmp_path / "out" / "latest.json")) == {"status": "ok", "periods": [202402, 202401], "model": False, "report": True}
    text = spark.createDataFrame([(1, '[{"feature":"a","shap":2.0}]'), (2, "no json"), (3, None)], "id int, factors string")
    kept.write(text, 202406, {})
    got = {r["id"]: len(r["factors"]) for r in kept.load(nested={"factors": "array<struct<feature:string,shap:double>>"}).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_price_books(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("currency: EUR\ndefault_market: ar\nplans: {adv: {ar: 10, mx: null}, fu: {ar: 0}}\nmodules: {tbl: {mx: 2.5}}\n")
    book = prices.PriceBook.load(spark, str(tmp_path / "p.yaml"))
    assert book.currency == "EUR" and book.is_filled and not prices.PriceBook().is_filled and not prices.PriceBook({"fu": {"ar": 0}}).is_filled
    got = {(r["item"], r["market"]): (r["own"], r["price"]) for r in book.rows(spark).collect()}
    assert got["adv", "mx"] == (None, 10.0) and got["adv", "cl"] == (None, 10.0) and got["tbl", "ar"] == (None, None) and got["tbl", "mx"] == (2.5, 2.5)
    panel_ = spark.createDataFrame([(1, "adv-tbl-ar"), (2, "adv-tbl-mx"), (3, "st-kds"), (4, None), (5, "adv-tbl-ar")], "id int, plan string")
    own = {r["id"]: (r["revenue"], r["price_incomplete"]) for r in book.priced(panel_).collect()}
    assert own[1] == (10.0, True) and own[2] == (12.5, False) and own[3] == (0.0, True)
    lacking = {(r["kind"], r["item"], r["market"]): r["accounts"] for r in prices.unpriced(panel_, book).collect()}
    assert lacking == {("module", "tbl", "ar"): 2, ("plan", "st", "ar"): 1, ("module", "kds", "ar"): 1}
    with pytest.raises(FileNotFoundError):
        prices.PriceBook.load(spark, str(tmp_path / "none.yaml"))


def test_prepare_builds_once_and_again_when_stale(spark, tmp_path):
    raw, matrix, slim = tmp_path / "raw", str(tmp_path / "matrix"), str(tmp_path / "slim")
    raw.mkdir()
    head = "ID,Periodo,Estado,Plan,Ventas\n"
    for m in range(1, 7):
        (raw / f"20240{m}.csv").write_text(head + "".join(f"{i},20240{m},ACTIVE,adv-tbl-ar,{i * m}\n" for i in range(1, 4) if i != 3 or m < 3))
    build = prepare.Build(sales=("ventas",))
    run = lambda **more: prepare.prepare(spark, str(raw), matrix, slim, build, **more)
    names = {"state": "estado", "created": None}
    rows = {(r["id"], r["period"]): r for r in run(**names).collect()}
    assert len(rows) == 14 and rows[2, 202404]["ventas_lag_1"] == 6.0 and rows[2, 202404]["sales_total_slope_3m"] == 2.0 and rows[3, 202402]["churn"] == 1
    assert "churn" in spark.read.parquet(slim).columns and "ventas_lag_1" not in spark.read.parquet(slim).columns
    before = files.modified(spark, matrix)
    assert run(**names).count() == 14 and files.modified(spark, matrix) == before  # nothing is built again
    time.sleep(1.1)
    (raw / "202407.csv").write_text(head + "1,202407,ACTIVE,adv-ar,9\n")
    assert run(**names).count() == 15 and files.modified(spark, matrix) > before


def test_price_template_keeps_prices(spark, tmp_path):
    tokens = spark.createDataFrame([("adv", 3), ("tbl", 2), ("what", 1)], "token string, accounts long")
    path = tmp_path / "prices.yaml"
    sinks.price_template(tokens, str(path))
    data = yaml.safe_load(path.read_text())
    data["plans"]["adv"]["ar"] = 9.5
    path.write_text(yaml.safe_dump(data))
    assert sinks.price_template(tokens, str(path))["plans"]["adv"]["ar"] == 9.5


def test_report_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        sinks.report_rows({"x": spark.range(20)}, limit=10)


def test_spec_names_roles(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4)], "acc int, per int, v double, other int")
    assert PanelSpec(id="acc", period="per", sales=("v", "none")).conform(df).columns == ["id", "period", "v"]
    with pytest.raises(ValueError):
        PanelSpec(id="nope").conform(df)


def test_promotion_rules(spark):
    base, better, worse = {"pr_auc": 0.5, "roc_auc": 0.9}, {"pr_auc": 0.51, "roc_auc": 0.895}, {"pr_auc": 0.501, "roc_auc": 0.9}
    said = lambda new, old, forced=False: promotion.verdict(promotion.outcomes(spark, new, old), forced)
    assert said(base, None)["promote"] and said(better, base)["promote"]
    assert said({"pr_auc": 0.505, "roc_auc": 0.89}, base)["promote"]  # both limits to the last digit
    assert not said(worse, base)["promote"] and said(worse, base, True)["promote"] and said(worse, base, True)["failed"]
    assert not said({"pr_auc": 0.52, "roc_auc": 0.8}, base)["promote"]
    low = said({"pr_auc": 0.1, "roc_auc": 0.5}, base, True)
    assert not low["promote"] and "pr_auc least" in low["failed"][0]
    assert not said({"pr_auc": 0.6}, base)["promote"]  # a metric that isn't known isn't met
    page = promotion.as_markdown(low, {"pr_auc": 0.1}, base, "v3", same_test=False)
    assert page.startswith("# v3: not promoted (forced)") and "stored metrics" in page and "| pr_auc | 0.1000 | 0.5000 |" in page


def test_stream_upserts(spark, tmp_path):
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "period", "v")])
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: incremental.follow(spark, str(tmp_path / "in" / "*"), schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    put([(1, 202401, 1), (2, 202401, 1)], "a")
    run()
    put([(2, 202401, 5), (1, 202402, 7)], "b")
    run()
    got = {(r["id"], r["period"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()}
    assert got == {(1, 202401): 1, (2, 202401): 5, (1, 202402): 7}


def test_headers_of_many_files_take_no_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:03d}.csv").write_text(f'ID,Periodo,"a, b{i % 3}"\n{i},202401,x\n')
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("\ufeffID,Periodo\n1,202402\n")
    (tmp_path / "zz.csv").write_text("")
    paths = snapshots.resolve(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("headers", "")
    found = snapshots.headers(spark, paths)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) == 0
    assert len(found) == 302 and found[paths[1]] == ("csv", ("ID", ""), ("Periodo", ""), ("a, b1", ""))
    assert found[paths[300]] == ("csv", ("ID", ""), ("Periodo", "")) and found[paths[301]] == ("csv",)


def test_rows_without_keys_are_spread(spark):
    """Nine of ten tickets have no reference: with no help from adaptive plans or broadcasts no task gets more than thrice the median."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        few = F.when(F.col("id") % 10 == 0, F.col("id").cast("string"))
        rows = spark.range(20_000).select(F.col("id").alias("ticket_id"), F.lit(None).cast("long").alias("explicit_id"), few.alias("company_ref"), few.alias("external_id"))
        companies = spark.range(0, 20_000, 20).select(F.col("id").cast("string").alias("company_ref"), F.col("id").alias("account_id"))
        out = attribution.attribute(rows, companies, spark.range(0, 20_000, 30).toDF("id"))
        sizes = sorted(r["n"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.count("source"), F.max("account_id")).collect())
        assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
        assert {r["source"]: r["tickets"] for r in attribution.report(out).collect()} == {"company": 1000, "external_id": 333, "unattributed": 18667}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_evaluation_reads_as_text():
    text = sinks.evaluation_text({"pr_auc": 0.5, "lift": None}, [{"fraction": 0.05, "n_accounts": 12, "precision": 0.25, "recall": None, "lift": 2.0}])
    assert text == "pr_auc          0.5000\nlift                 -\ntop  5.0%      12 accounts, precision 0.250, recall 0.000, lift 2.00\n"
