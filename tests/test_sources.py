"""Readers, validation, writers and the streaming forms."""

import json

import pytest

from txsieve.operators import features
from txsieve.schema import CANONICAL, RAW
from txsieve.sources import files, validate
from txsieve.streaming import jobs

from .test_engine import T0, by_event, frame, tx

HEAD = ",".join(RAW)
GOOD = "e1,t1,2024-01-01T00:00:00Z,1.1.1.1,2.2.2.2,80,8333,a|b,c,0.5|0.5,1,0.001,p2pkh,US,AS1"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_quarantine(spark, tmp_path):
    bad = [GOOD.replace(",80,", ",x,"), GOOD.replace("2024-01-01T00:00:00Z", "then"), GOOD.replace("0.001", "-1"), GOOD.replace(",80,", ",99999,"), GOOD.replace("0.5|0.5", "0.5|-2"), GOOD.replace("t1", "")]
    path = write(tmp_path / "x.csv", "\n".join([HEAD, GOOD, GOOD.replace("e1", "").replace("2024-01-01T00:00:00Z", "1704067200"), *bad]) + "\n")
    ok, no, run = files.ingest(spark, path, "b1")
    assert ok.count() == 2 and no.count() == len(bad) and [f.dataType for f in ok.schema] == [f.dataType for f in CANONICAL]
    assert {r.event_id for r in ok.collect()} == {"e1", "evt_t1"} and {r.timestamp for r in ok.collect()} == {T0.replace(tzinfo=None)}
    assert all(r.error_reason and len(r.raw_data) <= 500 for r in no.collect())
    m = run.first()
    assert (m.received, m.accepted, m.quarantined, m.status) == (8, 2, 6, "COMPLETED_WITH_QUARANTINE")


def test_json_xml_and_unknown(spark, tmp_path):
    row = dict(zip(RAW, GOOD.split(","), strict=True)) | {"input_addresses": ["a", "b"], "output_addresses": ["c"], "input_amounts": [0.5, 0.5], "output_amounts": [1], "fee": 0.001}
    ok, no, _ = files.ingest(spark, write(tmp_path / "x.json", json.dumps([row, row | {"src_port": -1}])), "b")
    assert ok.count() == 1 and no.count() == 1 and ok.first().input_amounts == [0.5, 0.5]
    body = "".join(f"<{k}>{v}</{k}>" for k, v in zip(RAW, GOOD.split(","), strict=True))
    ok, no, _ = files.ingest(spark, write(tmp_path / "x.xml", f"<transactions><transaction>{body}</transaction></transactions>"), "b")
    assert ok.count() == 1 and ok.first().input_addresses == ["a", "b"]
    with pytest.raises(ValueError):
        files.read_transactions(spark, "x.toml")
    with pytest.raises(ValueError):
        validate.check_source(spark.createDataFrame([("a",)], "txid string"))


@pytest.mark.parametrize("fmt", ["csv", "json", "xml"])
def test_round_trip(spark, tmp_path, fmt):
    df = frame(spark, [tx(0, outs=("b", "c"), amounts=[0.1, 0.00000001]), tx(1, 1.5, outs=(), amounts=[])])
    path = str(tmp_path / f"out.{fmt}")
    files.write_transactions(df, path, fmt)
    raw = files.read_json(spark, path, lines=True) if fmt == "json" else files.read_transactions(spark, path, fmt)
    back = by_event(validate.accepted(validate.canonicalize(raw)))
    want = by_event(df)
    for k in want:
        assert all(back[k][c] == want[k][c] for c in RAW if c != "input_amounts"), (back[k], want[k])


def test_sinks(spark, tmp_path):
    df = frame(spark, [tx(0), tx(1, 90000)])
    files.write_canonical(df, str(tmp_path / "c"))
    assert files.read_parquet(spark, str(tmp_path / "c")).count() == 2
    for n, status in ((1, "A"), (2, "B")):
        files.append_manifest(spark.createDataFrame([("r", status, n)], "run_id string, status string, finished_at int"), str(tmp_path / "m"))
    assert [r.status for r in files.latest_manifest(spark.read.parquet(str(tmp_path / "m"))).collect()] == ["B"]
    files.export_csv(df, str(tmp_path / "e"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "e")).count() == 2
    labels = write(tmp_path / "l.csv", "txid,scenario,is_benign\nt1,benign,TRUE\nt2,fan_in,false\nt1,fan_out,0\n")
    assert {r.txid: r.is_benign for r in files.read_labels(spark, labels).collect()} == {"t1": False, "t2": False}


def test_stream_equals_batch(spark, tmp_path):
    items = [tx(i, 40.0 * i, ins=("a" if i % 3 else "b",), outs=(f"o{i % 2}",), ip=f"1.1.1.{i % 2}") for i in range(12)]
    src = tmp_path / "src"
    for k in range(3):
        frame(spark, items[4 * k : 4 * k + 4]).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", 1).parquet(str(src))
    batch = by_event(features.with_features(frame(spark, items)))
    for name, build, columns in (("ent", jobs.rolling_entity, ("tx_count_1h", "tx_count_24h", "volume_1h")), ("ips", jobs.rolling_ip, ("ip_reuse_count", "ip_reuse_count_24h"))):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = by_event(spark.table(name))
        assert set(got) == set(batch)
        for k in got:
            assert all(abs(got[k][c] - batch[k][c]) < 1e-6 for c in columns)


def test_stream_ingest(spark, tmp_path):
    write_to = tmp_path / "in"
    write_to.mkdir()
    (write_to / "a.csv").write_text("\n".join([HEAD, GOOD, GOOD.replace("0.001", "-1")]) + "\n")
    raw = spark.readStream.schema(validate.RAW_SCHEMA).option("header", True).csv(str(write_to))
    jobs.ingest_stream(raw, "b", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).count() == 1


def test_streaming_plans_build(spark, tmp_path):
    src = str(tmp_path / "s")
    frame(spark, [tx(0)]).write.parquet(src)
    stream = spark.readStream.schema(CANONICAL).parquet(src)
    assert jobs.windowed_counts(stream).isStreaming and jobs.first_of_txid(stream).isStreaming and jobs.lineage(stream).isStreaming


def test_numbers_are_finite_and_times_are_utc(spark):
    """Whatever the session's zone, a time without a zone is UTC; NaN and infinite amounts are no numbers."""
    from pyspark.sql import functions as F

    from txsieve.sources.validate import canonicalize, instant

    raw = [("e", f"t{i}", "2024-01-02T03:04:05", "1.1.1.1", "2.2.2.2", "1", "2", "a", "b", amount, "1", fee) for i, (fee, amount) in enumerate((("0.1", "1"), ("NaN", "1"), ("Infinity", "1"), ("0", "NaN"), ("0", "-Infinity")))]
    names = "event_id txid timestamp src_ip dst_ip src_port dst_port input_addresses output_addresses input_amounts output_amounts fee"
    got = canonicalize(spark.createDataFrame(raw, ", ".join(f"{n} string" for n in names.split()))).select("txid", F.size("reasons").alias("n")).collect()
    assert {r.txid: r.n for r in got} == {"t0": 0, "t1": 1, "t2": 1, "t3": 1, "t4": 1}
    times = ["2024-01-02T03:04:05", "2024-01-02 03:04:05.25", "2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "1704164645", "2024-01-02", "no time"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        at = {r.i: r.u for r in df.select("i", F.unix_micros(instant(F.col("t"))).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    second = 1704164645_000000
    assert at == {0: second, 1: second + 250000, 2: second, 3: second, 4: second, 5: 1704153600_000000, 6: None}


def test_registry_describes_every_feature(spark):
    from txsieve.schema import FEATURES, registry

    rows = registry(spark).collect()
    assert len(rows) == 62 and {r.feature for r in rows} == set(FEATURES) and len(FEATURES) == 61
    assert all(r.definition and r.unit and (r.high is None or r.low <= r.high) for r in rows)
    by = {r.feature: (r.low, r.high, r.low_out) for r in rows}
    assert by["input_count"] == (1.0, None, False) and by["fee_ratio"] == (0.0, 1.0, False) and by["asn_concentration"] == (0.0, 1.0, True)


def test_shared_tables_follow_the_files(spark, tmp_path):
    from txsieve.plans import fixture, queries

    for t in fixture.TABLES:
        spark.range(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    made = []
    make = lambda: made.append(1) or spark.range(1)
    for _ in range(2):
        queries.shared("x", spark, str(tmp_path), make)
    assert len(made) == 1
    spark.range(4).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    queries.shared("x", spark, str(tmp_path), make)
    assert len(made) == 2


def test_uploads_are_checked(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    validate.check_upload(spark, put("ok.csv", f"{HEAD}\n{GOOD}\n".encode()))
    for name, data, why in (
        ("a.txt", b"txid,timestamp\n1,2\n", "only CSV"), ("b.csv", b" \n\n", "empty"), ("c.csv", b"txid,timestamp\n\xff\xfe,2\n", "UTF-8"),
        ("d.csv", b"txid,fee\n1,2\n", "timestamp"), ("e.csv", b"txid,timestamp\n", "no rows"), ("f.csv", b",,\n1,2,3\n", "header"),
    ):
        with pytest.raises(ValueError, match=why):
            validate.check_upload(spark, put(name, data))


def test_small_helpers(spark, tmp_path):
    checked = validate.canonicalize(spark.createDataFrame([("e1", "t1", "1.5"), ("e2", "", "2")], "event_id string, txid string, fee string"))
    files.write_quarantine(validate.quarantined(checked), str(tmp_path / "q"))
    files.write_quarantine(validate.quarantined(checked), str(tmp_path / "q"))
    kept = spark.read.json(str(tmp_path / "q"))
    assert kept.count() == 2 * validate.quarantined(checked).count() and set(kept.columns) == {"batch_id", "raw_data", "error_reason", "timestamp"}
    nested = spark.createDataFrame([("a", [1.5, 2.0]), ("b", [])], "txid string, xs array<double>")
    files.export_json(nested, str(tmp_path / "j"))
    assert {r.txid: list(r.xs) for r in spark.read.schema(nested.schema).json(str(tmp_path / "j")).collect()} == {"a": [1.5, 2.0], "b": []}
    assert files.select_canonical(checked).columns == ["txid", "src_ip", "fee"]
