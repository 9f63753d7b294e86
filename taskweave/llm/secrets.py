"""Secret scans over a ledger of text blobs, with DataFrame functions only.

Each version of a path (a document) is a blob, addressed by the SHA-256 of its text. The ledger, a Parquet folder that runs append to,
has a row for each blob and rule version that was scanned, with the spans found. The version is a digest of the rules. A run scans the blobs whose pair
with the present rules is not in the ledger, once each however many paths hold them, and joins spans back to all paths. Digests are held
against the ledger alone; only texts of blobs that it lacks travel.

A null text is the empty blob. Texts of any length are scanned whole. A null id is a path like any other; repeated rows are paths of one
blob. Spans that begin together are in the rules' order. An empty table gives no rows. Other columns, whatever their names, are carried
by ``redact`` and not looked at otherwise.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.shared import new_path, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters at least."""

    kind: str
    pattern: str
    group: int
    least: int


#: The kinds in their order, and their patterns.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
SALTS = 16
#: Digests of unseen blobs that are broadcast to pick their texts; more are joined in a shuffle.
FEW_BLOBS = 1 << 19
SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
LEDGER = "blob binary, rule_version string, spans " + SPANS


def version_of(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text: Column, rule: Rule) -> Column:
    """(before, whole, value): each match, the text between it and the one before, and the match's value."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    return F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), whole.alias("whole"), value.alias("value"))


LENGTHS = "array<struct<rank:int,place:int,before:int,whole:int,value:int>>"


def _lengths(text: Column, rank: int, rule: Rule) -> Column:
    """Each match's number, and how many characters lie before it, in it and in its value."""
    found = F.transform(_matches(text, rule), lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), F.length(m["before"]).alias("before"), F.length(m["whole"]).alias("whole"), F.length(m["value"]).alias("value")))
    found = F.filter(found, lambda m: m["whole"].isNotNull())  # what follows the last match
    return F.when(text.rlike(rule.pattern), found.cast(LENGTHS)).otherwise(F.array().cast(LENGTHS))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) rows with the spans of all rules, by start, then by the rules' order; offsets in code points.

    Matches become rows, whose places are running sums within a blob and rule, so that a text of many matches costs no more for each.
    """
    each = texts.select("blob", F.explode_outer(F.concat(*[_lengths(F.col("text"), rank, rule) for rank, rule in enumerate(rules)])).alias("m")).select("blob", "m.*")
    stop = F.sum(F.col("before") + F.col("whole")).over(Window.partitionBy("blob", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    of_rule = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    placed = each.withColumn("stop", stop)
    span = F.struct((F.col("stop") - F.col("whole")).alias("start"), "rank", of_rule([r.kind for r in rules]).alias("kind"), "stop")
    good = F.when(F.col("rank").isNotNull() & (F.col("value") >= of_rule([r.least for r in rules])), span)
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(good)).cast(SPANS).alias("spans"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at a path; None where nothing is stored yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def addressed(versions: DataFrame) -> DataFrame:
    return versions.select("path", blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))


def unseen_texts(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(blob, text), once for each blob that ``ledger`` has no row of."""
    every = addressed(versions)
    new = written(versions.select(blob_of(F.col("text")).alias("blob")).distinct().join(ledger.select("blob"), "blob", "left_anti"), "unseen")
    few = new.count() <= FEW_BLOBS
    return every.join(F.broadcast(new) if few else new, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))


def record(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans what ``ledger`` has no row of and appends it there. ``versions``: rows of (path, text)."""
    spark = versions.sparkSession
    held = ledger_at(spark, ledger)
    if held is None:
        blobs = addressed(versions).groupBy("blob").agg(F.first("text").alias("text"))  # copies are reduced before they travel
    else:
        blobs = unseen_texts(versions, held.where(F.col("rule_version") == version_of(rules)))
    scan(blobs, rules).select("blob", F.lit(version_of(rules)).alias("rule_version"), "spans").write.mode("append").option("compression", "zstd").parquet(ledger)


def held_spans(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, salt, spans) of the blobs with any, for each salt: a blob of many paths is joined in parts."""
    known = ledger_at(spark, ledger).where((F.col("rule_version") == version_of(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    return known.select("blob", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "spans")


def scan_versions(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans) of all ``versions``, rows of (path, text), by the ledger at a path, to which this run adds; without one, by a new ledger."""
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    record(versions, ledger, rules)
    paths = addressed(versions).select("path", "blob", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(held_spans(spark, ledger, rules), ["blob", "salt"], "left").select("path", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _marked(rule: Rule, mark: str):
    def piece(m: Column) -> Column:
        kept = F.substring(m["whole"], F.lit(1), F.length(m["whole"]) - F.length(m["value"]))
        return F.concat(m["before"], F.when(m["whole"].isNull(), "").when(F.length(m["value"]) >= rule.least, F.concat(kept, F.lit(mark))).otherwise(m["whole"]))

    return piece


def redacted(text: Column, mark: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with the value of each secret replaced by ``mark``."""
    for rule in rules:
        text = F.when(text.rlike(rule.pattern), F.array_join(F.transform(_matches(text, rule), _marked(rule, mark)), "")).otherwise(text)
    return text


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their secrets replaced, with all their columns: those that the scan finds any in, by ledger and paths.

    A text is rewritten where its blob has spans; rows whose text is null stay as they are.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    record(docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")), ledger, rules)
    keyed = docs.select(F.struct("*").alias("row"), blob_of(F.col(text_col)).alias("blob"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"))
    text = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNotNull(), redacted(text, rules=rules)).otherwise(text).alias(text_col)
    return keyed.join(held_spans(spark, ledger, rules), ["blob", "salt"], "left").select([clean if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    versions = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    found = scan_versions(versions)
    counts = [F.size(F.filter("spans", _is_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


ORACLE = r"""
WITH rule(rank, kind, pattern, grp, least) AS (
  VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
         (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)
), part AS (
  SELECT doc_id, 0 AS rank, string_split_regex(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS b,
    regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM documents
  UNION ALL SELECT doc_id, 1, string_split_regex(coalesce(text, ''), 'AKIA[A-Z0-9]+'), regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') AS m, m FROM documents
  UNION ALL SELECT doc_id, 2, string_split_regex(coalesce(text, ''), '[0-9a-f]+'), regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') AS m, m FROM documents
), one AS (
  SELECT doc_id, rank, unnest(b[1:len(m)]) AS b, unnest(m) AS m, unnest(v) AS v, unnest(generate_series(1, len(m))) AS i FROM part
), placed AS (
  SELECT doc_id, rank, length(v) AS n, (sum(length(b) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop, length(m) AS long FROM one
), span AS (
  SELECT doc_id, rank, kind, stop - long AS start, kind || ':' || (stop - long) || ':' || stop AS name FROM placed JOIN rule USING (rank) WHERE n >= least
), found AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(name, ',' ORDER BY start, rank) AS spans FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)
"""
