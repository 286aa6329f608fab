"""Job history and model catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jobs as J
from ..operators import catalog as C
from ..operators import jobs as OPS
from ..sources import jobs as JS
from .registry import query

# Registry: every order is a submitted job. Accounting: line items are its records, later ones win;
# their keys are shifted so that some jobs lack accounting and some records lack a job.
_REGISTRY = """
    (SELECT o_orderkey::VARCHAR AS job_id, 'job-' || o_custkey AS job_name,
       CASE WHEN o_orderstatus = 'P' THEN 'serve' END AS type, o_orderpriority AS model,
       CASE WHEN o_orderstatus <> 'O' THEN 'vllm' END AS engine,
       CASE WHEN o_orderkey % 3 = 0 THEN '/logs/' END AS logs_dir,
       CASE WHEN o_orderkey % 10 = 0 THEN '--' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS submitted
     FROM orders)
    """
_STATE = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'COMPLETED' WHEN 'RF' THEN 'RUNNING'
      WHEN 'NO' THEN 'PENDING' WHEN 'AO' THEN 'FAILED' WHEN 'NF' THEN 'TIMEOUT' ELSE 'UNKNOWN' END"""
_ACCOUNTING = f"""
    (SELECT job_id::VARCHAR AS job_id, {_STATE} AS state, l_partkey, l_suppkey, secs, mins, l_shipdate
     FROM (SELECT l_orderkey + 1000 AS job_id, *, (l_quantity * 3661)::BIGINT AS secs, l_quantity::BIGINT * 7 AS mins,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn
       FROM lineitem) WHERE rn = 1)
    """
_HMS = "format('{:02d}:{:02d}:{:02d}', secs // 3600, secs % 3600 // 60, secs % 60)"


def registry(t):
    """Orders as registry documents, one job per document."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    entry = F.struct(
        F.concat(F.lit("job-"), "o_custkey").alias("job_name"),
        F.when(status == "P", "serve").alias("type"),
        F.col("o_orderpriority").alias("model"),
        F.when(status != "O", "vllm").alias("engine"),
        F.when(key % 3 == 0, "/logs/").alias("logs_dir"),
        F.when(key % 10 == 0, "not a date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("submitted_at"),
    )
    return JS.registry_jobs(
        t.orders.select(F.to_json(F.create_map(key.cast("string"), entry)).alias("value"))
    )


def accounting(t, columns=JS.ACCOUNTING_COLUMNS, only=None):
    """Line items as accounting payloads of one record, with the state in one of four layouts."""
    mark = F.concat("l_returnflag", "l_linestatus")
    state = (
        F.when(mark == "AF", '{"current":["completed"],"reason":"None"}')
        .when(mark == "RF", '"Running"')
        .when(mark == "NO", '["pending","x"]')
        .when(mark == "AO", '{"CURRENT":"failed"}')
        .when(mark == "NF", '"TIMEOUT"')
        .otherwise('{"current":[]}')
    )
    minutes = (F.col("l_quantity").cast("bigint") * 7).cast("string")
    limit = F.when(F.col("l_linestatus") == "F", minutes).otherwise(
        F.concat(
            F.lit('{"set":true,"infinite":'), F.when(F.col("l_returnflag") == "A", "true").otherwise("false"),
            F.lit(',"number":'), minutes, F.lit("}"),
        )
    )
    text = F.concat(
        F.lit('{"jobs":[{"job_id":'), (F.col("l_orderkey") + 1000).cast("string"),
        F.when(F.col("l_linestatus") == "F", ',"job_state":').otherwise(',"job_state":" ","state":'), state,
        F.lit(',"name":"n'), F.col("l_partkey").cast("string"),
        F.lit('","partition":" gpu'), (F.col("l_suppkey") % 4).cast("string"),
        F.lit(' ","time":{"start":'), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string"),
        F.lit(',"elapsed":'), (F.col("l_quantity") * 3661).cast("bigint").cast("string"),
        F.lit(',"limit":'), limit, F.lit("}}]}"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    docs = t.lineitem.select(order.alias("seq"), text.alias("value"))
    return JS.accounting_jobs(JS.accounting_entries(docs, order_by="seq"), columns, only)


_LISTED = """job_id, job_name AS name, coalesce(type, 'batch') AS type, model, coalesce(engine, '--') AS engine, submitted"""


@query(
    "jobs_all",
    f"""
    SELECT {_LISTED}, coalesce(state, 'UNKNOWN') AS state,
      CASE WHEN state IS NULL THEN '--' ELSE {_HMS} END AS elapsed
    FROM {_REGISTRY} r LEFT JOIN {_ACCOUNTING} a USING (job_id)
    """,
)
def jobs_all(t):
    return OPS.newest_first(OPS.all_jobs(registry(t), accounting(t, ("state", "elapsed"))))


@query(
    "jobs_active",
    f"""
    SELECT {_LISTED}, state, {_HMS} AS elapsed
    FROM {_REGISTRY} r JOIN {_ACCOUNTING} a USING (job_id) WHERE state IN ('RUNNING', 'PENDING')
    """,
)
def jobs_active(t):
    return OPS.active_jobs(registry(t), accounting(t, ("state", "elapsed")))


@query(
    "job_detail",
    f"""
    SELECT job_id, coalesce(job_name, 'n' || l_partkey) AS name, coalesce(type, 'batch') AS type,
      coalesce(state, 'UNKNOWN') AS state, coalesce(model, '--') AS model, coalesce(engine, '--') AS engine,
      coalesce('gpu' || l_suppkey % 4, '--') AS "partition", '--' AS nodes, coalesce(submitted, '--') AS submitted,
      coalesce(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), '--') AS start,
      CASE WHEN l_partkey IS NULL THEN '--' ELSE {_HMS} END AS elapsed,
      CASE WHEN l_partkey IS NULL OR unlimited THEN '--'
        ELSE format('{{:02d}}:{{:02d}}:00', mins // 60, mins % 60) END AS time_limit,
      '--' AS working_dir, '--' AS input, '--' AS output,
      coalesce('/logs/' || CASE WHEN logs_dir IS NOT NULL THEN job_id END || '.out', '--') AS log_stdout,
      coalesce('/logs/' || CASE WHEN logs_dir IS NOT NULL THEN job_id END || '.err', '--') AS log_stderr,
      job_name IS NOT NULL AS tracked
    FROM {_REGISTRY} r FULL JOIN (SELECT *, state = 'FAILED' AS unlimited FROM {_ACCOUNTING}) a USING (job_id)
    """,
)
def job_detail(t):
    return OPS.job_details(registry(t), accounting(t))


@query(
    "jobs_running",
    f"""
    SELECT a.job_id, state FROM {_ACCOUNTING} a SEMI JOIN {_REGISTRY} r USING (job_id)
    WHERE state IN ('RUNNING', 'PENDING')
    """,
)
def jobs_running(t):
    return OPS.by_number(OPS.running_jobs(registry(t), accounting(t, ("state",))).select("job_id", "state"))


@query(
    "job_durations",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q * 90061 + 59 AS seconds,
      format('{:02d}:{:02d}:{:02d}', (q * 90061 + 59) // 3600, (q * 90061 + 59) % 3600 // 60, (q * 90061 + 59) % 60) AS shown,
      strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS started,
      CASE WHEN l_linenumber = 1 THEN NULL ELSE q END AS memory_gb
    FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)
    """,
)
def job_durations(t):
    """Elapsed texts with days to seconds and back, epoch seconds and memory sizes."""
    total = F.col("l_quantity").cast("bigint") * 90061 + 59
    text = F.format_string(
        "%d-%02d:%02d:%02d", F.floor(total / 86400), F.floor(total % 86400 / 3600), F.floor(total % 3600 / 60), total % 60
    )
    seconds = J.elapsed_seconds(text)
    memory = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") == 1, "MB").otherwise("GB"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        seconds.cast("bigint").alias("seconds"), J.duration_text(seconds).alias("shown"),
        J.epoch_text(F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))).alias("started"),
        J.gigabytes(memory).cast("bigint").alias("memory_gb"),
    )


@query(
    "catalog_engines",
    """
    SELECT p_partkey, coalesce(array_to_string(list_filter_engines, ','), '') AS engines,
      CASE WHEN p_size % 2 = 0 THEN hf_name ELSE name END AS engine_model
    FROM (SELECT *, [x for x in [CASE WHEN coalesce(name, 'NA') NOT IN ('', 'NA') THEN 'ollama' END,
            CASE WHEN coalesce(hf_name, 'NA') NOT IN ('', 'NA') THEN 'vllm' END] IF x IS NOT NULL] AS list_filter_engines
      FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'NA' WHEN 1 THEN NULL ELSE p_name END AS name,
          CASE p_size % 3 WHEN 0 THEN '' ELSE p_brand END AS hf_name FROM part))
    """,
)
def catalog_engines(t):
    """Parts as catalog entries, some without a name for one engine."""
    size = F.col("p_size")
    entries = t.part.select(
        "p_partkey", "p_size",
        F.when(size % 4 == 0, "NA").when(size % 4 != 1, F.col("p_name")).alias("name"),
        F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("hf_name"),
    )
    engine = F.when(size % 2 == 0, "vllm").otherwise("ollama")
    return C.with_engines(entries).select(
        "p_partkey", F.array_join("engines", ",").alias("engines"),
        C.engine_name(engine, F.col("name"), F.col("hf_name")).alias("engine_model"),
    )


@query(
    "catalog_quality",
    """
    SELECT p_partkey, array_to_string([x for x in [
        CASE WHEN NOT temperature BETWEEN 0 AND 1 THEN 'temperature in [0,1]' END,
        CASE WHEN p_retailprice > 1400 THEN 'top_p in [0,1]' END,
        CASE WHEN max_tokens < 1 THEN 'max_tokens >= 1' END,
        CASE WHEN p_size < 10 THEN 'top_k >= 0' END,
        CASE WHEN NOT regexp_matches(gpu_memory, '^\\d+GB$') THEN 'gpu_memory format' END,
        CASE WHEN p_size % 3 = 0 THEN 'cuda_version format' END,
        CASE WHEN p_size > 45 THEN 'gpu_memory_utilization in [0,1]' END,
        CASE WHEN p_size > 40 THEN 'engine' END,
        CASE WHEN lo > hi OR hi > 1 THEN 'temperature_range' END,
        CASE WHEN p_size > 25 THEN 'batch_size_range' END,
        CASE WHEN p_size % 4 = 1 OR p_size > 30 THEN 'concurrent_range' END,
        CASE WHEN p_size = 1 THEN 'max_tokens_limit >= 1' END] IF x IS NOT NULL], '|') AS violations
    FROM (SELECT p_partkey, p_size, p_retailprice, p_retailprice / 1500 AS temperature, p_size - 5 AS max_tokens,
        p_size || CASE WHEN p_size % 7 = 0 THEN 'MB' ELSE 'GB' END AS gpu_memory,
        p_size / 50 AS lo, p_retailprice / 1600 AS hi FROM part)
    """,
)
def catalog_quality(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    entries = t.part.select(
        "p_partkey",
        (price / 1500).alias("temperature"),
        (size - 5).alias("max_tokens"),
        F.concat(size.cast("string"), F.when(size % 7 == 0, "MB").otherwise("GB")).alias("gpu_memory"),
        F.when(size > 40, "other").when(size % 2 == 0, "ollama2").otherwise("my-vllm").alias("engine"),
        F.array(size / 50, price / 1600).alias("temperature_range"),
        F.array(size, F.lit(25)).alias("batch_size_range"),
        (price / 1400).alias("top_p"),
        (size - 10).alias("top_k"),
        F.create_map(
            F.lit("cuda_version"), F.when(size % 3 == 0, "12.4").otherwise(F.concat(F.lit(">="), size.cast("string"), F.lit(".0"))),
            F.lit("gpu_memory_utilization"), (size / 45).cast("string"),
        ).alias("requirements"),
        F.when(size % 4 == 1, F.array(size)).otherwise(F.array(size, F.lit(30))).alias("concurrent_range"),
        F.when(size > 2, size).otherwise(size - 1).alias("max_tokens_limit"),
    )
    return C.check_quality(entries).select("p_partkey", F.array_join("violations", "|").alias("violations"))
