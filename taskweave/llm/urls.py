"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule that fits decides. A url that no rule fits
gets the model's verdict. The model is trained from a small labelled URL table, given as rows or taken from ``url_table``, and its
probabilities are turned from the table's share of urls to block to ``PRIOR``.

Urls of any length are judged whole. A probability that equals ``BLOCK_AT`` blocks. A null url, or one without ``://``, has an empty host and path; the model judges it like any other. Repeated rows each get a row. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.llm.linear import Rows, fit, sigmoid
from taskweave.llm.url_table import LABELLED
from taskweave.llm.words import hash_words, mix, text_bytes

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

GRAMS = (3, 4, 5)
BITS = 40
PENALTY, BLOCK_AT = 0.05, 0.5
#: The share of urls to block where the filter is used; the labelled table has about as many of either kind.
PRIOR = 0.1


def rest_of(url: Column) -> Column:
    """What follows the first ``://``, or an empty text."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(column: pa.Array) -> list[np.ndarray]:
    """Of each text the numbers of its distinct character n-grams."""
    data, texts = text_bytes(column)
    found, text = [], []
    for n in GRAMS:
        start = np.arange(max(0, len(data) - n + 1))
        owner = np.searchsorted(texts, start, side="right") - 1
        inside = start + n <= texts[owner + 1] if len(start) else np.zeros(0, dtype=bool)
        start, owner = start[inside], owner[inside]
        found.append((mix(hash_words(data, start, start + n, True) ^ np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        text.append(owner)
    text, found = np.concatenate(text), np.concatenate(found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    text, found = text[new], found[new]
    edges = np.searchsorted(text, np.arange(len(column) + 1))
    return [found[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def train(hosts: list[str], paths: list[str], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The known n-grams' numbers, ascending, and their weights, then the intercept, which is that for ``PRIOR``."""
    found = grams(pa.array([f"^{h}$ {p}" for h, p in zip(hosts, paths, strict=True)], pa.string()))
    known = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    rows = Rows([np.searchsorted(known, x) for x in found])
    weights = fit(rows, len(known), np.zeros((len(rows), 0)), np.array(y, dtype=np.float64), np.ones(len(rows)), PENALTY)
    weights[-1] += np.log(PRIOR / (1 - PRIOR)) - np.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    return known, weights


def probabilities(shapes: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How likely each ``^host$ path`` is one to block."""
    known, weights = model
    own = [x[np.isin(x, known)] for x in grams(shapes)]
    return sigmoid(Rows([np.searchsorted(known, x) for x in own]).dot(weights[:-1]) + weights[-1])


def _judge(model_of):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(probabilities(batch.column("shape"), model_of.value))], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return run


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block). ``labelled``: a small table of (url, label)."""
    spark = pages.sparkSession
    table = labelled if labelled is not None else spark.createDataFrame(list(LABELLED), "url string, label int")
    seen = table.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").where("label is not null").collect()  # small by contract
    model = spark.sparkContext.broadcast(train([r.host for r in seen], [r.path for r in seen], [r.label for r in seen]))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("match", matched(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "match.rule", "match.verdict", F.concat(F.lit("^"), "host", F.lit("$ "), "path").alias("shape"))
    out = rows.mapInArrow(_judge(model), f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, p_block double")
    learned = F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", learned)).withColumnRenamed("page_id", id_col)


def op4(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
