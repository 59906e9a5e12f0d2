"""Registered queries of sources, validation and streaming, on the fixture.

Raw rows are the fixture as text; some get faults by their id. Files go to the folder of
``spark.checkpoint.dir`` and are read back by the readers or as a stream that ends with its input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.functions.session import cut, prepare
from txsieve.schema import CANONICAL
from txsieve.sources import files, validate
from txsieve.streaming import jobs

from . import fixture, oracle
from .oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_CHAIN = ["lines", "ev", "c0", "c"]

#: Faults of the raw rows: (remainder, modulus) of the event id, column, text. Later ones win in a column.
FAULTS = (
    ((0, 11), "src_port", "x"), ((0, 13), "dst_port", "99999"), ((0, 17), "fee", "-1"), ((0, 19), "timestamp", "then"),
    ((0, 23), "txid", ""), ((0, 29), "src_ip", " "), ((0, 31), "output_amounts", "1|-2"), ((1, 31), "output_amounts", "1|two"),
)
_REASONS = {
    "src_port": "src_port is not a port", "dst_port": "dst_port is not a port", "fee": "fee is not a number of at least 0",
    "timestamp": "timestamp is not a time", "txid": "txid is missing", "src_ip": "src_ip is missing",
    "output_amounts": "output_amounts has a value that is no number of at least 0",
}
_REASON_ORDER = ("txid", "src_ip", "timestamp", "src_port", "dst_port", "fee", "output_amounts")


def query(name: str, oracle_sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle_sql:
            ORACLE[name] = oracle_sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    sc = prepare(spark).sparkContext
    return f"{sc.getCheckpointDir()}/cut-{sc.applicationId}/{uuid.uuid4().hex}"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = files.as_raw(fixture.transactions(prepare(spark), sf_dir))
    key = F.col("event_id").cast("long")
    for (rest, mod), column, text in FAULTS:
        raw = raw.withColumn(column, F.when(key % mod == rest, F.lit(text)).otherwise(F.col(column)))
    return raw


def _why() -> str:
    hit = lambda c: " or ".join(f"k % {m} = {r}" for (r, m), name, _ in FAULTS if name == c)
    items = ", ".join(f"case when {hit(c)} then '{_REASONS[c]}' end" for c in _REASON_ORDER)
    return f"list_filter([{items}], lambda z: z is not null)"


_CHECKED = f"select *, array_to_string(why, '; ') as error_reason from (select event_id, {_why()} as why from (select event_id, cast(event_id as bigint) as k from c))"


@query("val_rules", sql(_CHAIN, "select event_id, error_reason from checked", checked=_CHECKED))
def val_rules(spark, sf_dir):
    """Every raw row, with the rules that it breaks."""
    return validate.canonicalize(faulty(spark, sf_dir)).select("event_id", F.array_join("reasons", "; ").alias("error_reason"))


@query("val_quarantine", sql(_CHAIN, "select error_reason, count(*) as n from checked where error_reason <> '' group by 1", checked=_CHECKED))
def val_quarantine(spark, sf_dir):
    return validate.quarantined(validate.canonicalize(faulty(spark, sf_dir))).groupBy("error_reason").agg(F.count(F.lit(1)).alias("n"))


@query("val_manifest", sql(_CHAIN, """select 'run' as run_id, count(*) as received, count(*) filter (error_reason = '') as accepted, count(*) filter (error_reason <> '') as quarantined,
  case when count(*) = 0 then 'EMPTY' when count(*) filter (error_reason <> '') > 0 then 'COMPLETED_WITH_QUARANTINE' else 'COMPLETED' end as status from checked""", checked=_CHECKED))
def val_manifest(spark, sf_dir):
    return validate.manifest(validate.canonicalize(faulty(spark, sf_dir)), "run").drop("started_at", "finished_at")


@query("val_first_per_txid", sql(_CHAIN, "select 't' || (k % 997) as txid, arg_min(event_id, (ts_us, event_id)) as event_id from (select *, cast(event_id as bigint) as k from c) group by 1"))
def val_first_per_txid(spark, sf_dir):
    """Transaction ids made to repeat: the first row of each stays."""
    tx = fixture.transactions(prepare(spark), sf_dir).withColumn("txid", F.concat(F.lit("t"), (F.col("event_id").cast("long") % 997).cast("string")))
    return validate.first_per_txid(tx).select("txid", "event_id")


_BACK = """select event_id, txid, ts_us, src_ip, dst_ip, src_port, dst_port, array_to_string(ins, '|') as input_addresses, coalesce(array_to_string(outs, '|'), '') as output_addresses,
  cast(len(amts) as bigint) as n_amounts, floor(raw_out * 1000000.0::double + 0.50001::double) / 1000000.0::double as total_output, floor(fee * 1000000.0::double + 0.50001::double) / 1000000.0::double as fee, script_type, geo_country, asn from c"""


def _back(df: DataFrame) -> DataFrame:
    total = F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x)
    near = lambda x: F.floor(x * 1e6 + 0.50001).cast("double") / 1e6
    return df.select(
        "event_id", "txid", F.unix_micros("timestamp").alias("ts_us"), "src_ip", "dst_ip", "src_port", "dst_port",
        F.array_join("input_addresses", "|").alias("input_addresses"), F.array_join("output_addresses", "|").alias("output_addresses"),
        F.size("output_amounts").cast("long").alias("n_amounts"), near(total).alias("total_output"), near(F.col("fee")).alias("fee"), "script_type", "geo_country", "asn",
    )


def _round_trip(fmt: str):
    def run(spark, sf_dir):
        """Written by the writer of the format, read and validated by its reader."""
        path = folder(spark)
        files.write_transactions(fixture.transactions(spark, sf_dir), path, fmt)
        raw = files.read_json(spark, path, lines=True) if fmt == "json" else files.read_transactions(spark, path, fmt)
        return _back(validate.accepted(validate.canonicalize(raw)))

    run.__name__ = f"src_{fmt}"
    return run


for _fmt in ("csv", "json", "xml"):
    query(f"src_{_fmt}", sql(_CHAIN, _BACK))(_round_trip(_fmt))


@query("src_parquet", sql(_CHAIN, _BACK))
def src_parquet(spark, sf_dir):
    """Written by day, read with the canonical schema."""
    path = folder(spark)
    files.write_canonical(fixture.transactions(spark, sf_dir), path)
    return _back(files.read_parquet(spark, path))


@query("snk_export_csv", sql(_CHAIN, "select event_id, '[' || array_to_string(list_transform(ins, lambda a: '\"' || a || '\"'), ',') || ']' as input_addresses from c"))
def snk_export_csv(spark, sf_dir):
    """Nested columns leave as JSON text, quoted for CSV."""
    path = folder(spark)
    files.export_csv(fixture.transactions(spark, sf_dir).select("event_id", "input_addresses"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


# ---- streams ----


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    fixture.transactions(spark, sf_dir).write.parquet(path)
    return spark.readStream.schema(CANONICAL).parquet(path)


def drained(df: DataFrame) -> DataFrame:
    """Run a stream over all its input and read what it wrote."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("st_ingest", sql(_CHAIN, "select event_id from checked where error_reason = ''", checked=_CHECKED))
def st_ingest(spark, sf_dir):
    """Raw text as a stream; accepted rows are read back."""
    path = folder(spark)
    faulty(spark, sf_dir).write.option("header", True).csv(f"{path}/raw")
    raw = spark.readStream.schema(validate.RAW_SCHEMA).option("header", True).csv(f"{path}/raw")
    jobs.ingest_stream(raw, "run", f"{path}/good", f"{path}/bad", f"{path}/log").awaitTermination()
    return spark.read.parquet(*jobs.committed(spark, f"{path}/good")).select("event_id")


@query("st_entity_state", sql(oracle.ROWS, f"""select event_id, cast(count(*) over m5 as double) as tx_count_5m, cast(count(*) over h1 as double) as tx_count_1h, cast(count(*) over d1 as double) as tx_count_24h,
  floor(sum(raw_out) over h1 * 1000.0::double + 0.50001::double) / 1000.0::double as volume_1h, cast(row_number() over (partition by entity order by ts_us, txid, event_id) - 1 as double) as history_count from c
  window m5 as (partition by entity order by ts_us range between {oracle.M5} preceding and current row), h1 as (partition by entity order by ts_us range between {oracle.H1} preceding and current row),
  d1 as (partition by entity order by ts_us range between {oracle.D1} preceding and current row)"""))
def st_entity_state(spark, sf_dir):
    df = drained(jobs.rolling_entity(stream(spark, sf_dir)))
    return df.select("event_id", "tx_count_5m", "tx_count_1h", "tx_count_24h", (F.floor(F.col("volume_1h") * 1e3 + 0.50001).cast("double") / 1e3).alias("volume_1h"), "history_count")


@query("st_ip_state", sql([*_CHAIN, "net0", "net"], "select event_id, ip_reuse_count, ip_reuse_count_24h from net where ip is not null"))
def st_ip_state(spark, sf_dir):
    return drained(jobs.rolling_ip(stream(spark, sf_dir))).select("event_id", "ip_reuse_count", "ip_reuse_count_24h")


@query("st_lineage", sql(oracle.LINEAGE, """select event_id, parent_id from (select t.event_id, arg_min(struct_pack(id := pid, ts := pts), t.pos) as p, any_value(t.ts_us) as ts_us from (
    select t.event_id, t.pos, t.ts_us, arg_max(g.event_id, (g.ts_us, g.event_id)) as pid, max(g.ts_us) as pts from taken t join given g
      on g.address = t.address and (g.ts_us, g.txid, g.event_id) < (t.ts_us, t.txid, t.event_id) group by 1, 2, 3) t where t.ts_us - t.pts <= 3600000000 group by 1) x, lateral (select x.p.id as parent_id)"""))
def st_lineage(spark, sf_dir):
    """The parent of each transaction: the latest output, within an hour, to the first input that has one."""
    links = drained(jobs.lineage(stream(spark, sf_dir)))
    return links.groupBy("event_id").agg(F.min_by("parent_id", "pos").alias("parent_id"))


def arrivals(spark: SparkSession, sf_dir: str, batches: int, width_us: int | None) -> DataFrame:
    """The fixture as a stream of ``batches`` files by time; each tenth row comes late.

    ``width_us``: how late, in time; a whole batch if None.
    """
    path = folder(spark)
    df = cut(fixture.transactions(spark, sf_dir).withColumn("us", F.unix_micros("timestamp")))
    lo, hi = df.agg(F.min("us"), F.max("us")).first()
    late = F.col("event_id").cast("long") % 10 == 3
    at = lambda us: F.least(F.lit(batches - 1), F.floor((us - lo) * batches / F.lit(hi - lo + 1))).cast("int")
    number = F.when(late, at(F.col("us")) + 1).otherwise(at(F.col("us"))) if width_us is None else at(F.when(late, F.col("us") + width_us).otherwise(F.col("us")))
    df = df.withColumn("number", number)
    for k in range(batches + 1):  # files are read in the order of their times
        df.where(F.col("number") == k).drop("us", "number").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", 1).parquet(path)


@query("st_late_rows", sql(_CHAIN, """select event_id, r.late, cast(case when not r.late then coalesce(n.h1, 0) end as double) as ip_reuse_count, cast(case when not r.late then coalesce(n.d1, 0) end as double) as ip_reuse_count_24h,
  cast(case when r.late then 0 else coalesce(n.later, 0) end as bigint) as later_rows from late r left join n using (event_id)""").replace("select event_id, r.late", """, b0 as (
    select event_id, txid, ts_us, src_ip as ip, least(2, (ts_us - (select min(ts_us) from c)) * 3 // ((select max(ts_us) - min(ts_us) + 1 from c))) + case when cast(event_id as bigint) % 10 = 3 then 1 else 0 end as b
    from c where src_ip <> 'unknown_ip'),
  top as (select ip, b, max(ts_us) as m from b0 group by all),
  late as (select b0.*, coalesce(ts_us < (select max(m) from top where top.ip = b0.ip and top.b < b0.b) - 600000000, false) as late from b0),
  n as (select x.event_id, count(*) filter (y.ts_us between x.ts_us - 3600000000 and x.ts_us) as h1, count(*) filter (y.ts_us between x.ts_us - 86400000000 and x.ts_us) as d1,
      count(*) filter (y.ts_us > x.ts_us) as later
    from late x join late y on x.ip = y.ip and x.event_id <> y.event_id and not y.late and (y.b < x.b or y.b = x.b and (y.ts_us, y.txid, y.event_id) < (x.ts_us, x.txid, x.event_id)) group by 1)
select event_id, r.late"""))
def st_late_rows(spark, sf_dir):
    """Three batches; a tenth of the rows come one batch late: some are counted between earlier ones, some are late."""
    return drained(jobs.rolling_ip(arrivals(spark, sf_dir, 3, None))).select("event_id", "late", "ip_reuse_count", "ip_reuse_count_24h", "later_rows")


@query("st_lineage_hops", sql([*_CHAIN, "given", "taken"], """select c.event_id, p.p.id as parent_id, h.hops from c left join tp p using (event_id) join th h using (event_id)""").replace("select c.event_id, p.p.id", """, tp as (
    select event_id, arg_min(struct_pack(id := pid, ts := pts), pos) as p from (
      select t.event_id, t.pos, t.ts_us, arg_max(g.event_id, (g.ts_us, g.txid, g.event_id)) as pid, max(g.ts_us) as pts
      from taken t join given g on g.address = t.address and (g.ts_us, g.txid, g.event_id) < (t.ts_us, t.txid, t.event_id) group by 1, 2, 3)
    where ts_us - pts <= 3600000000 group by 1),
  th(event_id, hops) as (
    select event_id, cast(1 as bigint) from c where event_id not in (select event_id from tp)
    union all select tp.event_id, th.hops + 1 from th join tp on tp.p.id = th.event_id)
select c.event_id, p.p.id"""))
def st_lineage_hops(spark, sf_dir):
    """Four batches; a tenth of the rows come eight minutes late, and raise what was linked before."""
    path = folder(spark)
    jobs.lineage_stream(arrivals(spark, sf_dir, 4, 480_000_000), f"{path}/lineage", f"{path}/log").awaitTermination()
    return jobs.lineage_result(spark, f"{path}/lineage").select("event_id", "parent_id", "hops")


@query("st_first_of_txid", sql(_CHAIN, "select event_id, txid from c"))
def st_first_of_txid(spark, sf_dir):
    """Every row comes twice; one of each id passes."""
    once = stream(spark, sf_dir)
    return drained(jobs.first_of_txid(once.select(*once.columns, F.explode(F.array(F.lit(1), F.lit(2))).alias("_twice")).drop("_twice"))).select("event_id", "txid")


@query("st_windowed_counts", sql(_CHAIN, """select w as start_us, entity, count(*) as n from (select entity, ts_us, unnest(range(ts_us // 300000000 * 300000000 - 3300000000, ts_us // 300000000 * 300000000 + 1, 300000000)) as w from c)
  where w + 3600000000 <= (select max(ts_us) // 1000 * 1000 - 600000000 from c) group by 1, 2"""))
def st_windowed_counts(spark, sf_dir):
    """Windows of an hour every five minutes that the watermark has closed."""
    df = drained(jobs.windowed_counts(stream(spark, sf_dir)))
    return df.select(F.unix_micros("start").alias("start_us"), "entity", "n")
