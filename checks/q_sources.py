"""Scans, sinks and round trips."""

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import big, query, time_text
from medstrand.operators import sequence as sq
from medstrand.sources import outputs, readers, sinks


@query(
    "scan_parquet",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
)
def scan_parquet(spark, d):
    return (
        readers.read_table(spark, f"{d}/orders.parquet")
        .filter("o_totalprice > 100000 AND o_orderstatus = 'F'")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query(
    "csv_roundtrip",
    """SELECT patient_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, code, value, unit FROM raw""",
)
def csv_roundtrip(spark, d):
    path = sinks.scratch_path(spark, "raw.csv")
    st.raw_events(spark, d).write.option("header", True).csv(path)
    rows = readers.read_table(spark, path, "patient_id string, start string, end string, code string, value string, unit string")
    return rows.select("patient_id", "start", "code", "value", "unit")


@query(
    "parquet_roundtrip",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def parquet_roundtrip(spark, d):
    path = sinks.scratch_path(spark, "customer")
    sinks.write_table(st.table(spark, d, "customer"), path, overwrite=False)
    return readers.read_table(spark, path).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "rrf_scan",
    """SELECT CUI, source AS SAB, code AS CODE FROM concepts WHERE source IN ('ECONOMY', 'PROMO')""",
)
def rrf_scan(spark, d):
    path = sinks.scratch_path(spark, "MRCONSO.RRF")
    line = F.concat_ws("|", "CUI", F.lit("ENG"), "source", "code", F.lit('a "quoted" name'), F.lit(""))
    st.concept_map(spark, d).select(line.alias("value")).write.text(path)
    return readers.read_rrf(
        spark, path, ["CUI", "LAT", "SAB", "CODE", "STR"], ["CUI", "SAB", "CODE"], "SAB IN ('ECONOMY', 'PROMO') AND LAT = 'ENG'"
    )


@query(
    "rrf_columns",
    """SELECT s_nationkey::BIGINT % 3 AS nation, s_name AS "COL", 'column of ' || (s_nationkey % 3) AS "DES" FROM supplier""",
)
def rrf_columns(spark, d):
    """Column lists of three files, read from the release's own file list, and what it says of each column."""
    s = st.table(spark, d, "supplier")
    nation = (F.col("s_nationkey") % 3).cast("string")
    files = s.groupBy(nation.alias("FIL")).agg(F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("FMT"))
    described = s.select(F.col("s_name").alias("COL"), F.concat(F.lit("column of "), nation).alias("DES"), nation.alias("FIL"))
    parts = [
        readers.column_descriptions(described, str(n), readers.rrf_columns(files, str(n))).select(
            F.lit(n).cast("bigint").alias("nation"), "COL", "DES"
        )
        for n in range(3)
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "catalog",
    """SELECT 'nation' AS name, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT 'customer', c_custkey FROM customer""",
)
def catalog(spark, d):
    """Tables of one base directory, one Parquet, one CSV with its schema, and one that is absent."""
    base = sinks.scratch_path(spark, "catalog")
    sinks.write_table(st.table(spark, d, "nation").select("n_nationkey"), f"{base}/nation.parquet")
    st.table(spark, d, "customer").select("c_custkey").write.option("header", True).csv(f"{base}/customer.csv")
    tails = {"nation": "/nation.parquet", "customer": "customer.csv", "region": None}
    found = readers.read_catalog(spark, base + "/", tails, {"customer": "c_custkey bigint"})
    assert found.pop("region") is None
    parts = [df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("bigint").alias("key")) for name, df in found.items()]
    return parts[0].union(parts[1])


@query(
    "report_sink",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1""",
)
def report_sink(spark, d):
    path = sinks.scratch_path(spark, "report")
    lines = st.table(spark, d, "lineitem")
    report = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    sinks.write_report(report, path)
    return readers.read_csv(spark, path, "l_returnflag string, n bigint, quantity bigint")


@query(
    "vocab_parse",
    """SELECT id, split_part(token, ':', 1) AS source, split_part(token, ':', 2) AS code, token AS vocab_token
       FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '[' || p_type || ']' ELSE p_type || ':' || p_partkey END AS token
             FROM part) WHERE token LIKE '%:%'""",
)
def vocab_parse(spark, d):
    path = sinks.scratch_path(spark, "vocab")
    token = F.expr("case when p_partkey % 9 = 0 then concat('[', p_type, ']') else concat(p_type, ':', p_partkey) end")
    sinks.write_vocabulary(st.table(spark, d, "part").select(F.col("p_partkey").alias("id"), token.alias("token")), path)
    return readers.parse_vocabulary(readers.read_vocabulary(spark, path)).withColumn("id", big("id"))


@query(
    "split_sink",
    """SELECT split, label, count(*) AS n, sum(person_id)::BIGINT AS ids FROM classed JOIN splitmap ON person_id = omop_person_id
       GROUP BY 1, 2""",
)
def split_sink(spark, d):
    from medstrand.operators.splits import split_membership

    path = sinks.scratch_path(spark, "splits")
    sinks.write_splits(split_membership(st.classed(spark, d), st.split_map(spark, d)), path)
    back = readers.read_parquet(spark, path)
    return back.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum("person_id").alias("ids"))


@query(
    "multi_task_labels",
    """SELECT 'task_' || substr(o_orderpriority, 1, 1) AS task, CAST(o_custkey AS VARCHAR) AS patient_id,
         CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS value,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS prediction_time
       FROM orders WHERE substr(o_orderpriority, 1, 1) <> '5'""",
)
def multi_task_labels(spark, d):
    base = sinks.scratch_path(spark, "tasks")
    rows = st.table(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("t"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("value"),
        F.lit("boolean").alias("label_type"),
        time_text("o_orderdate").alias("prediction_time"),
    )
    for digit in "12345":
        task = "chexpert" if digit == "5" else f"task_{digit}"
        one = rows.filter(F.col("t") == digit).drop("t")
        one.write.option("header", True).csv(f"{base}/{task}/labeled_patients.csv")
    ddl = "patient_id string, value string, label_type string, prediction_time string"
    return readers.read_label_tasks(spark, base, ddl, ("chexpert",)).drop("label_type")


@query(
    "dataset_length",
    """SELECT sum(floor(n * 0.3))::BIGINT AS length FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""",
)
def dataset_length(spark, d):
    """One file a language, told apart by the name of the file a row was read from."""
    path = sinks.scratch_path(spark, "by-language")
    st.table(spark, d, "documents").select("doc_id", "lang").repartition("lang").write.partitionBy("lang").parquet(path)
    return sq.dataset_length(readers.with_file(readers.read_parquet(spark, path)), 0.3)


@query(
    "vocab_parts",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, 'ORDER:' || o_orderkey AS token FROM orders""",
)
def vocab_parts(spark, d):
    """A vocabulary written and read by several tasks; ids are the line numbers over all files."""
    path = sinks.scratch_path(spark, "vocab-parts")
    orders = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ORDER:"), "o_orderkey").alias("token"))
    sinks.write_vocabulary(orders, path, parts=6)
    return readers.read_vocabulary(spark, path).withColumn("id", big("id"))


@query(
    "rrf_faults",
    """SELECT CASE WHEN o_orderkey % 5 < 2 THEN 'fits' WHEN o_orderkey % 5 = 2 THEN 'short' WHEN o_orderkey % 5 = 3 THEN 'long' ELSE 'open' END AS fault,
         CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey END AS key, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS status,
         CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS good
       FROM orders""",
)
def rrf_faults(spark, d):
    """Lines that fit, some with an empty column, and lines with a column less, one more or no last delimiter."""
    path = sinks.scratch_path(spark, "faulty.RRF")
    line = F.expr(
        "case o_orderkey % 5 when 0 then concat(o_orderkey, '|', o_orderstatus, '|') when 1 then concat(o_orderkey, '||') "
        "when 2 then concat(o_orderkey, '|') when 3 then concat(o_orderkey, '|', o_orderstatus, '|x|') else concat(o_orderkey, '|', o_orderstatus) end"
    )
    st.table(spark, d, "orders").select(line.alias("value")).write.text(path)
    good, bad = readers.read_rrf_checked(spark, path, ["KEY", "STATUS"])
    kept = good.select(F.lit("fits").alias("fault"), big("KEY").alias("key"), F.col("STATUS").alias("status"), F.lit(1).alias("good"))
    none = F.lit(None)
    return kept.union(bad.select("_fault", none.cast("bigint"), none.cast("string"), F.lit(0)))


@query(
    "job_outputs",
    """SELECT 'orders' AS name, o_orderkey::BIGINT AS key, n FROM orders, (SELECT count(*) AS n FROM orders)
       UNION ALL SELECT 'customers', c_custkey, n FROM customer, (SELECT count(*) AS n FROM customer)""",
)
def job_outputs(spark, d):
    """Two tables written together and read by their manifest, with the rows it names."""
    base = sinks.scratch_path(spark, "job")
    tables = {
        f"{base}/orders": st.table(spark, d, "orders").select(F.col("o_orderkey").alias("key")),
        f"{base}/customers": st.table(spark, d, "customer").select(F.col("c_custkey").alias("key")),
    }
    outputs.write_together(spark, tables, f"{base}/manifest.json")
    rows = outputs.read_manifest(spark, f"{base}/manifest.json")
    parts = [
        df.select(F.lit(path.rpartition("/")[2]).alias("name"), big("key").alias("key"), F.lit(rows[path]).cast("bigint").alias("n"))
        for path, df in outputs.read_together(spark, f"{base}/manifest.json").items()
    ]
    return parts[0].union(parts[1])
