"""Sources and sinks: written from the test tables, read back, compared with the tables."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import linked, logins, query, sql, trades
from riskloom.model.scoring import submission
from riskloom.operators.aggregates import logins_per_hour
from riskloom.operators.joins import link_timeline, timeline
from riskloom.session import scratch_path
from riskloom.sources import files, schemas


@query(
    "s1_csv_declared",
    sql(
        """SELECT CAST(log_id AS VARCHAR) AS log_id, timelong, CAST(device AS BIGINT) AS device,
          CAST(ip AS BIGINT) AS ip, CAST(city AS BIGINT) AS city, CAST(result AS BIGINT) AS result,
          instant AS "timestamp", CAST(type AS BIGINT) AS type, CAST(id AS VARCHAR) AS id, is_scan, is_sec,
          login_time AS "time" FROM login""",
        "login",
    ),
)
def s1(spark, d):
    path = scratch_path(spark, "login-csv")
    # The log's origin is a word in the test data and a number in the declared schema.
    files.write_csv(logins(spark, d).withColumn("log_from", F.lit(None).cast("long")), path)
    return files.read_csv(spark, path, schemas.login_schema()).drop("log_from")


@query(
    "s1_csv_overrides",
    sql(
        """SELECT CAST(log_id AS VARCHAR) AS log_id, CAST(timelong AS INT) AS timelong, device, log_from, ip, city, result,
          instant AS "timestamp", type, CAST(id AS VARCHAR) AS id, is_scan, is_sec, login_time AS "time" FROM login""",
        "login",
    ),
)
def s1_overrides(spark, d):
    """All columns; the keys are declared as text, the other types are inferred."""
    path = scratch_path(spark, "login-csv")
    files.write_csv(logins(spark, d), path)
    return files.read_csv(spark, path, overrides={"log_id": "string", "id": "string"})


@query(
    "s1_csv_corrupt_lines",
    sql(
        """SELECT CAST(id AS INT) AS id, count(*) FILTER (WHERE log_id % 7 <> 0) AS fitting,
          count(*) FILTER (WHERE log_id % 7 = 0) AS others FROM login GROUP BY id""",
        "login",
    ),
)
def s1_corrupt(spark, d):
    """Each seventh login has a word for its duration, which is declared a number: those lines are kept apart."""
    path = scratch_path(spark, "login-csv")
    broken = F.when(F.col("log_id") % 7 == 0, "unknown").otherwise(F.col("timelong").cast("string"))
    files.write_csv(logins(spark, d).select("id", "log_id", broken.alias("timelong"), "time"), path)
    good, bad = files.ingest_csv(spark, path, {"timelong": "bigint"}, share=0.5)
    fitting = good.groupBy("id").agg(F.count("timelong").alias("fitting"))
    others = bad.groupBy(F.substring_index(files.CORRUPT, ",", 1).cast("int").alias("id")).agg(F.count(F.lit(1)).alias("others"))
    return fitting.join(others, "id", "full").na.fill(0, ["fitting", "others"])


@query(
    "s2_csv_inferred",
    sql("""SELECT CAST(rowkey AS INT) AS rowkey, trade_time AS "time", CAST(id AS INT) AS id, is_risk FROM trade""", "trade"),
)
def s2(spark, d):
    path = scratch_path(spark, "trade-csv")
    files.write_csv(trades(spark, d), path)
    return files.read_csv(spark, path)


@query(
    "s3_submission_sink",
    sql(
        """SELECT CAST(rowkey AS VARCHAR) AS rowkey, CASE WHEN login_device = 3 THEN 1 ELSE 0 END AS is_risk
        FROM linked""",
        "linked",
    ),
)
def s3(spark, d):
    trade = linked(spark, d)
    flagged = trade.where("login_device is not null").select(
        "rowkey", (F.col("login_device") == 3).cast("int").alias("is_risk")
    )
    path = scratch_path(spark, "submission")
    files.write_submission(submission(trade, flagged), path)
    return files.read_csv(spark, path, schemas.SUBMISSION, header=False)


@query(
    "s4_table_sink",
    sql(
        """SELECT id, CAST(login_time AS DATE) AS "date", CAST(hour(login_time) AS INT) AS "hour",
          count(DISTINCT log_id) AS log_id FROM login GROUP BY ALL""",
        "login",
    ),
)
def s4(spark, d):
    path = scratch_path(spark, "per-hour")
    files.write_csv(logins_per_hour(logins(spark, d)), path)
    return files.read_csv(spark, path, "id long, date date, hour int, log_id long")


@query("s4_parquet_sink", sql("SELECT rowkey, id, is_risk, login_id FROM linked", "linked"))
def s4_parquet(spark, d):
    path = scratch_path(spark, "linked")
    files.write_parquet(linked(spark, d), path, ["is_risk"])
    return spark.read.parquet(path).select("rowkey", "id", F.col("is_risk").cast("int"), "login_id")


@query("s4_laid_out_logs", sql("SELECT rowkey, id, login_id FROM linked", "linked"))
def s4_laid_out(spark, d):
    """Both logs as one table laid out by user and sorted by time, linked where they lie."""
    path = scratch_path(spark, "log")
    name = f"riskloom_{path.rsplit('-', 1)[1]}"
    laid_out = files.write_laid_out(timeline(trades(spark, d), logins(spark, d)), name, "id", ["_at"], path=path)
    return link_timeline(laid_out).select("rowkey", "id", "login_id")
