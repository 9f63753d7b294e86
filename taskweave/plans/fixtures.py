"""Views over the given tables that stand in for labelled tasks, matched panels, predictions and scores, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.operators.labels import merged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(text: Column, chars: int = 1) -> Column:
    """A number below 2**32 from 8 hex digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), chars, 8), 16, 10).cast("long")


THREE = r"^\s*\S+\s+\S+\s+\S"  #: A text of three words or more.
#: Runs of whitespace that are not one space already.
BLANKS = r"\s{2,}|[\t\n\x0B\f\r]"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _tasks(documents: DataFrame, labels: DataFrame, how: str = "left") -> DataFrame:
    docs = documents.join(labels, "doc_id", how)
    text = F.trim(F.regexp_replace("text", BLANKS, " "))
    w = F.split(text, " ", 7)  # six words and the rest
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    rest = lambda a: F.when(text.isNotNull(), F.coalesce(F.get(F.split(text, " ", a), F.lit(a - 1)), F.lit("")))
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "E0").when((F.col("quality") == 0) & (F.col("toxic") == 0), "E1").when((F.col("quality") == 1) & (F.col("toxic") == 1), "E2").when((F.col("quality") == 0) & (F.col("toxic") == 1), "E3")
    return docs.select(
        F.col("doc_id").alias("task_id"), F.concat("source", F.lit("-"), "lang").alias("jobrole_id"), part(1, 2).alias("jobrole_title"), F.col("lang").alias("sector_title"), rest(3).alias("task"),
        part(3, 1).alias("action"), part(4, 3).alias("object"), F.when(F.col("doc_id") % 5 != 0, rest(7)).alias("purpose"), label.alias("label"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with a label and a text, and ``y``, the merged label. A task is not empty if the document has a third word, which its start tells."""
    documents = table(spark, sf_dir, "documents").where(F.col("text").rlike(THREE))
    return _tasks(documents, table(spark, sf_dir, "labels"), "inner").where("label is not null").withColumn("y", merged(F.col("label")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    wrong = F.when(y == "E0", "E1").when(y == "E1", "E23").otherwise("E0")
    return labelled(spark, sf_dir).select("task_id", "jobrole_id", "task", y.alias("y_true"), F.when(bucket(F.concat(F.lit("p|"), "task_id")) % 100 < 20, wrong).otherwise(y).alias("y_pred"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, y, s0, s1, s2): scores from -2 to 3, higher by one for the true class."""
    one = lambda k, c: (F.round((bucket(F.concat(F.lit(f"s{k}|"), "task_id")) % 4001) / 1000.0 - 2 + (F.col("y") == c).cast("int"), 3)).alias(f"s{k}")
    return labelled(spark, sf_dir).select("task_id", "y", one(0, "E0"), one(1, "E1"), one(2, "E23"))


PROMPTS, MODELS = ("legacy", "production", "production_legacy_anchors"), ("gpt_4o", "gpt_5_2")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child, grain) of the panel. Rows lie by parent, so what is grouped by a parent and more stays where it is."""
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.lit(0).cast("long").alias("child"), F.lit(True).alias("_own"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("long").alias("child"), F.lit(False).alias("_own"))
    found = parents.unionByName(children).repartition("parent").groupBy("parent", "child", "_own").agg(F.count("*").alias("_n"))
    every = found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.when(F.col("_own"), F.col("_n").cast("int")).otherwise(1))))  # orders count as often as they come
    return every.select("parent", "child", F.when(F.col("_own"), "raw_parent").otherwise("atomic_child").alias("grain"))


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, m) for p in PROMPTS for m in MODELS], "prompt string, model string")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.col("parent").cast("string"), F.col("child").cast("string"), "grain", "prompt", "model")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(m).alias("model")) for p in PROMPTS for m in MODELS])).alias("x")
    return units(spark, sf_dir).select("*", each).select("parent", "child", "grain", "x.*").withColumn("key", key).withColumn("call_id", F.substring(F.sha2("key", 256), 1, 20))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda chars: F.conv(F.substring("_md5", chars, 8), 16, 10).cast("long") % 100
    e0 = F.when(F.col("prompt") == "legacy", 75).when(F.col("prompt") == "production", 40).otherwise(55) - F.when(F.col("model") == "gpt_5_2", 10).otherwise(0)
    digest = F.explode(F.array(F.md5("key")))  # a filter on what follows from it does not make it a second time
    rows = manifest(spark, sf_dir).withColumn("_md5", digest).withColumn("h1", number(1)).withColumn("e0", e0)
    h9 = number(9)
    label = F.when(F.col("h1") < F.col("e0"), "E0").when(F.col("h1") < F.col("e0") + 0.4 * (100 - F.col("e0")), "E1").when(F.col("h1") < F.col("e0") + 0.95 * (100 - F.col("e0")), "E2").otherwise("E3")
    return rows.withColumn("status", F.when(h9 < 2, "error").otherwise("success")).withColumn("label", label).withColumn("attempt_count", (F.col("h1") % 3 + 1).cast("int")).withColumn("latency_ms", (F.col("h1") * 17 % 900 + 100).cast("double")).drop("e0", "_md5")


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, raw): three shapes of answers, and garbage."""
    l = F.col("label")
    raw = F.when(F.col("status") == "error", "upstream timeout").when(F.col("h1") % 3 == 0, F.concat(F.lit('{"label":"'), l, F.lit('"}'))).when(F.col("h1") % 3 == 1, F.concat(F.lit("Answer.\nLABEL (E0/E1/E2/E3): **"), l, F.lit("**"))).otherwise(F.concat(l, F.lit(" - because it is so")))
    return responses(spark, sf_dir).select("call_id", raw.alias("raw"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, history, sector, role) of the panel's parents."""
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "E1").when(p == "2-HIGH", "E2").when(p == "3-MEDIUM", "E3").otherwise("E0")
    orders = table(spark, sf_dir, "orders")
    return orders.join(table(spark, sf_dir, "customer"), orders["o_custkey"] == F.col("c_custkey")).select(F.col("o_orderkey").alias("parent"), label.alias("history"), F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("role"))


def scoring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """A scoring log from events, batch or stream."""
    t = F.col("event_type")
    label = F.when(t == "view", "E0").when(t.isin("click", "signup"), "E1").otherwise("E23")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("cohort"), label.alias("label"), ((F.col("event_id") * 37 % 1000) / 1000.0).alias("review_score"), ((F.col("event_id") * 53 % 1000) / 1000.0).alias("coverage"))


#: The same views as DuckDB CTEs.
H = "('0x' || substr(md5({0}), {1}, 8))::BIGINT"
h = lambda text, chars=1: H.format(text, chars)

CTE_TASKS = r"""
base AS (SELECT d.doc_id, d.lang, d.source, string_split(trim(regexp_replace(d.text, '\s+', ' ', 'g')), ' ') AS w, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
tasks AS (SELECT doc_id AS task_id, source || '-' || lang AS jobrole_id, array_to_string(w[1:2], ' ') AS jobrole_title, lang AS sector_title, array_to_string(w[3:], ' ') AS task,
  array_to_string(w[3:3], ' ') AS action, array_to_string(w[4:6], ' ') AS object, CASE WHEN doc_id % 5 <> 0 THEN array_to_string(w[7:], ' ') END AS purpose,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'E0' WHEN quality = 0 AND toxic = 0 THEN 'E1' WHEN quality = 1 AND toxic = 1 THEN 'E2' WHEN quality = 0 AND toxic = 1 THEN 'E3' END AS label FROM base),
labelled AS (SELECT *, CASE WHEN label IN ('E2', 'E3') THEN 'E23' ELSE label END AS y FROM tasks WHERE label IS NOT NULL AND task <> '')"""
CTE_PRED = CTE_TASKS + f""",
predictions AS (SELECT task_id, jobrole_id, task, y AS y_true, CASE WHEN {h("'p|' || task_id")} % 100 < 20 THEN CASE y WHEN 'E0' THEN 'E1' WHEN 'E1' THEN 'E23' ELSE 'E0' END ELSE y END AS y_pred FROM labelled)"""
CTE_SCORES = CTE_TASKS + f""",
scores AS (SELECT task_id, y, round(({h("'s0|' || task_id")} % 4001) / 1000.0 - 2 + (y = 'E0')::INT, 3) AS s0, round(({h("'s1|' || task_id")} % 4001) / 1000.0 - 2 + (y = 'E1')::INT, 3) AS s1, round(({h("'s2|' || task_id")} % 4001) / 1000.0 - 2 + (y = 'E23')::INT, 3) AS s2 FROM labelled)"""
CTE_PANEL = f"""
units AS (SELECT o_orderkey AS parent, 0::BIGINT AS child, 'raw_parent' AS grain FROM orders UNION ALL SELECT DISTINCT l_orderkey, l_linenumber::BIGINT, 'atomic_child' FROM lineitem),
manifest AS (SELECT *, substr(sha256(key), 1, 20) AS call_id FROM (SELECT parent, child, grain, prompt, model, concat_ws('|', parent, child, grain, prompt, model) AS key FROM units, (VALUES ('legacy'), ('production'), ('production_legacy_anchors')) p(prompt), (VALUES ('gpt_4o'), ('gpt_5_2')) m(model))),
coded AS (SELECT *, {h('key')} % 100 AS h1, {h('key', 9)} % 100 AS h9, CASE prompt WHEN 'legacy' THEN 75 WHEN 'production' THEN 40 ELSE 55 END - CASE model WHEN 'gpt_5_2' THEN 10 ELSE 0 END AS e0 FROM manifest),
responses AS (SELECT parent, child, grain, prompt, model, key, call_id, h1, CASE WHEN h9 < 2 THEN 'error' ELSE 'success' END AS status, CASE WHEN h1 < e0 THEN 'E0' WHEN h1 < e0 + 0.4 * (100 - e0) THEN 'E1' WHEN h1 < e0 + 0.95 * (100 - e0) THEN 'E2' ELSE 'E3' END AS label, (h1 % 3 + 1)::INT AS attempt_count, (h1 * 17 % 900 + 100)::DOUBLE AS latency_ms FROM coded),
history AS (SELECT o_orderkey AS parent, CASE o_orderpriority WHEN '1-URGENT' THEN 'E1' WHEN '2-HIGH' THEN 'E2' WHEN '3-MEDIUM' THEN 'E3' ELSE 'E0' END AS history, c_mktsegment AS sector, c_custkey AS role FROM orders JOIN customer ON o_custkey = c_custkey)"""
CTE_LOG = """
log AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id % 10 AS cohort, CASE WHEN event_type = 'view' THEN 'E0' WHEN event_type IN ('click', 'signup') THEN 'E1' ELSE 'E23' END AS label, (event_id * 37 % 1000) / 1000.0 AS review_score, (event_id * 53 % 1000) / 1000.0 AS coverage FROM events)"""
