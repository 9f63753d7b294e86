"""Queries: text features, retrieval and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import features as X
from taskweave.operators import fields as P
from taskweave.operators import labels as L
from taskweave.operators import retrieval as R
from taskweave.plans import fixtures as V
from taskweave.plans.registry import query
from taskweave.shared import written

W = "WITH " + V.CTE_TASKS
c = F.col

# Word n-grams as a lateral unnest in DuckDB.
TOK = ", tok AS (SELECT task_id, y, regexp_extract_all(lower(task), '[\\p{L}\\p{N}_]{2,}') AS w FROM labelled)"
GRAM = lambda n: f"SELECT task_id, array_to_string(w[i:i + {n - 1}], ' ') AS term FROM (SELECT task_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM tok)"
COUNTS = TOK + f", grams AS ({GRAM(1)} UNION ALL {GRAM(2)}), counts AS (SELECT task_id, term, count(*)::BIGINT AS tf FROM grams GROUP BY ALL)"
VOCAB = COUNTS + ", vocab AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS total FROM counts GROUP BY term HAVING count(*) >= 2)"
TFIDF = VOCAB + ", raw AS (SELECT task_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS w FROM counts JOIN vocab USING (term)), weights AS (SELECT task_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY task_id)) AS weight FROM raw)"


def rows(spark, sf):
    return V.labelled(spark, sf)


def counts(spark, sf):
    return X.term_counts(rows(spark, sf), "task_id", (X.Grams("word", 1, 2), c("task")))


def weights(spark, sf):
    return X.tfidf_of(rows(spark, sf), "task_id", (X.Grams("word", 1, 2), c("task")))


@query("ft_word_ngrams", W + COUNTS + " SELECT task_id, term, tf FROM counts")
def ft_word_ngrams(spark, sf):
    return counts(spark, sf)


CHARS = ", t AS (SELECT task_id, regexp_replace(lower(task), '\\s+', ' ', 'g') AS t FROM labelled), cg AS (SELECT task_id, substr(t, i, 3) AS term FROM (SELECT task_id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM t) UNION ALL SELECT task_id, substr(t, i, 4) FROM (SELECT task_id, t, unnest(generate_series(1, length(t) - 3)) AS i FROM t))"


RAW = ", t AS (SELECT task_id, regexp_replace(strip_accents(lower(task)), '\\s+', ' ', 'g') AS t FROM labelled), cg AS (" + " UNION ALL ".join(f"SELECT task_id, substr(t, i, {n}) AS term FROM (SELECT task_id, t, unnest(generate_series(1, length(t) - {n - 1})) AS i FROM t)" for n in range(3, 7)) + ")"


@query("ft_char_ngrams", W + RAW + " SELECT task_id, term, count(*)::BIGINT AS tf FROM cg GROUP BY ALL")
def ft_char_ngrams(spark, sf):
    """Three to six characters, without accents."""
    return X.term_counts(rows(spark, sf), "task_id", (X.Grams("char", 3, 6, plain=True), c("task")))


WB = ", p AS (SELECT task_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(task), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM labelled), wb AS (SELECT task_id, substr(w, i, 3) AS term FROM (SELECT task_id, w, unnest(generate_series(1, greatest(length(w) - 2, 1))) AS i FROM p) UNION ALL SELECT task_id, substr(w, i, 4) FROM (SELECT task_id, w, unnest(generate_series(1, length(w) - 3)) AS i FROM p WHERE length(w) > 3))"


@query("ft_char_wb_ngrams", W + WB + " SELECT task_id, term, count(*)::BIGINT AS tf FROM wb GROUP BY ALL")
def ft_char_wb_ngrams(spark, sf):
    return X.term_counts(rows(spark, sf), "task_id", (X.Grams("char_wb", 3, 4), c("task")))


@query("ft_vocab", W + VOCAB + " SELECT term, df, total FROM vocab ORDER BY total DESC, term LIMIT 200")
def ft_vocab(spark, sf):
    return X.vocabulary(counts(spark, sf), 2, 200)


@query("ft_tfidf", W + TFIDF + " SELECT task_id, term, round(weight, 6) AS weight FROM weights")
def ft_tfidf(spark, sf):
    return weights(spark, sf).select("task_id", "term", F.round("weight", 6).alias("weight"))


def block_sql(name: str, terms: str, weight: float) -> str:
    return f"""(WITH bt AS ({terms}), bc AS (SELECT task_id, term, count(*) AS tf FROM bt GROUP BY ALL), bd AS (SELECT term, count(*) AS df FROM bc GROUP BY term HAVING count(*) >= 2),
br AS (SELECT task_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS w FROM bc JOIN bd USING (term)) SELECT task_id, '{name}=' || term AS term, round({weight} * w / sqrt(sum(w * w) OVER (PARTITION BY task_id)), 6) AS weight FROM br)"""


WORDS_OF = lambda column: f"SELECT task_id, unnest(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM labelled"
SLUG = "'A_' || trim(regexp_replace(lower(coalesce(action, '')), '[^a-z0-9]+', '_', 'g'), '_') || '__O_' || trim(regexp_replace(lower(coalesce(object, '')), '[^a-z0-9]+', '_', 'g'), '_')"


def action_object():
    return F.concat(X.slug("A_", c("action")), X.slug("__O_", c("object")))


def field_sql(i: int, block: P.Block, grams: str) -> str:
    """One block's weights: frequencies of training rows, terms of all rows."""
    return f"""g{i} AS ({grams}), c{i} AS (SELECT task_id, term, count(*) AS tf FROM g{i} GROUP BY ALL), d{i} AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c{i} WHERE task_id % 4 <> 0 GROUP BY term HAVING count(*) >= {block.least_df} ORDER BY total DESC, term LIMIT {block.most}),
b{i} AS (SELECT task_id, '{block.name}' AS block, term, {block.weight} * w / sqrt(sum(w * w) OVER (PARTITION BY task_id)) AS weight FROM (SELECT task_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM labelled WHERE task_id % 4 <> 0)) / (1 + df)) + 1) AS w FROM c{i} JOIN d{i} USING (term)))"""


def grams_sql(block: P.Block) -> str:
    text = f"strip_accents(trim(regexp_replace(coalesce({block.column}, ''), '\\s+', ' ', 'g')))"
    if block.analyser == "slug":
        slug = lambda column: f"trim(regexp_replace(lower(strip_accents(coalesce({column}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"
        return f"SELECT task_id, 'a_' || {slug('action')} || '__o_' || {slug('object')} AS term FROM labelled"
    sizes = range(block.low, block.high + 1)
    if block.analyser == "word":
        return " UNION ALL ".join(f"SELECT task_id, array_to_string(w[i:i + {n - 1}], ' ') AS term FROM (SELECT task_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT task_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM labelled))" for n in sizes)
    if block.analyser == "char":
        return " UNION ALL ".join(f"SELECT task_id, substr(t, i, {n}) AS term FROM (SELECT task_id, t, unnest(generate_series(1, length(t) - {n - 1})) AS i FROM (SELECT task_id, lower({text}) AS t FROM labelled))" for n in sizes)
    words = f"SELECT task_id, ' ' || unnest(list_filter(string_split(lower({text}), ' '), lambda x: x <> '')) || ' ' AS w FROM labelled"
    short = f"SELECT task_id, w AS term FROM ({words}) WHERE length(w) <= {block.low}"
    return short + "".join(f" UNION ALL SELECT task_id, substr(w, i, {n}) FROM (SELECT task_id, w, unnest(generate_series(1, length(w) - {n - 1})) AS i FROM ({words}) WHERE length(w) > {n if n == block.low else n - 1})" for n in sizes)


CHAMPION = P.PROFILES["champion"]
FIELDS = ", ".join(field_sql(i, b, grams_sql(b)) for i, b in enumerate(CHAMPION))


@query("ft_field_blocks", W + ", " + FIELDS + " " + " UNION ALL ".join(f"SELECT task_id, block, md5(string_agg(term, '|' ORDER BY term)) AS terms, count(*)::BIGINT AS n, round(sum(weight), 5) AS total, round(max(weight), 6) AS top FROM b{i} GROUP BY task_id, block" for i in range(len(CHAMPION))))
def ft_field_blocks(spark, sf):
    """All eight blocks, fitted on three quarters of the tasks and applied to all: of each row and block the known terms and their weights."""
    every = rows(spark, sf)
    model = P.FieldFeatures(idCol="task_id", blocks=CHAMPION).fit(every.where("task_id % 4 <> 0"))
    name = P.of_block(CHAMPION, [b.name for b in CHAMPION])
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return model.lists(every).select("task_id", name.alias("block"), F.md5(F.array_join(F.array_sort("terms"), "|")).alias("terms"), F.size("terms").cast("long").alias("n"), F.round(total, 5).alias("total"), F.round(F.array_max("weights"), 6).alias("top"))


@query("ft_multiview", W + " SELECT * FROM " + block_sql("char", CHARS.split("cg AS (", 1)[1][:-1].replace(" FROM t)", " FROM (SELECT task_id, regexp_replace(lower(task), '\\s+', ' ', 'g') AS t FROM labelled))"), 0.5) + " UNION ALL SELECT * FROM " + block_sql("role", WORDS_OF("jobrole_title"), 0.25))
def ft_multiview(spark, sf):
    return X.blocks(rows(spark, sf), "task_id", [("char", (X.Grams("char", 3, 4), c("task")), 0.5), ("role", (X.Grams("word"), c("jobrole_title")), 0.25)]).withColumn("weight", F.round("weight", 6))


@query("ft_cross_action_object", W + f" SELECT task_id, {SLUG} AS slug FROM labelled")
def ft_cross_action_object(spark, sf):
    return rows(spark, sf).select("task_id", action_object().alias("slug"))


STOPS = "(" + ", ".join(f"'{w}'" for w in X.STOP) + ")"
CONTENT = lambda column, n: f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOPS})[1:{n}]"


@query("ft_cross_title_task", W + f", p AS (SELECT task_id, unnest({CONTENT('jobrole_title', 6)}) AS a, {CONTENT('task', 18)} AS bs FROM labelled) SELECT task_id, a || '__X__' || unnest(bs) AS term FROM p")
def ft_cross_title_task(spark, sf):
    return rows(spark, sf).select("task_id", F.explode(X.cross_pairs(c("jobrole_title"), c("task"), 6, 18)).alias("term"))


@query("ft_cross_context_task", W + f", p AS (SELECT task_id, unnest(list_concat({CONTENT('jobrole_title', 8)}, {CONTENT('sector_title', 5)})) AS a, {CONTENT('task', 45)} AS bs FROM labelled) SELECT task_id, a || '|' || unnest(bs) AS term FROM p UNION ALL SELECT task_id, 'context=' || a FROM p UNION ALL SELECT task_id, 'task=' || unnest({CONTENT('task', 45)}) FROM labelled")
def ft_cross_context_task(spark, sf):
    content = lambda x, n: F.slice(F.filter(X.word_tokens(x), lambda t: ~t.isin(*X.STOP)), 1, n)
    context, task = F.concat(content(c("jobrole_title"), 8), content(c("sector_title"), 5)), content(c("task"), 45)
    pairs = F.flatten(F.transform(context, lambda a: F.transform(task, lambda b: F.concat(a, F.lit("|"), b))))
    every = F.concat(pairs, F.transform(context, lambda a: F.concat(F.lit("context="), a)), F.transform(task, lambda b: F.concat(F.lit("task="), b)))
    return rows(spark, sf).select("task_id", F.explode(every).alias("term"))


NB = COUNTS + ", nb AS (SELECT term, 1 + count(*) FILTER (y = 'E0') AS p, 1 + count(*) FILTER (y <> 'E0') AS q FROM counts JOIN labelled USING (task_id) GROUP BY term), ratio AS (SELECT term, ln(p / (SELECT sum(p) FROM nb)) - ln(q / (SELECT sum(q) FROM nb)) AS ratio FROM nb)"


def ratios(spark, sf):
    return X.nb_ratio(counts(spark, sf), "task_id", rows(spark, sf).select("task_id", "y"), c("y") == "E0")


@query("ft_nb_ratio", W + NB + " SELECT term, round(ratio, 6) AS ratio FROM ratio")
def ft_nb_ratio(spark, sf):
    return ratios(spark, sf).select("term", F.round("ratio", 6).alias("ratio"))


@query("ft_scale", "WITH " + V.CTE_SCORES + " SELECT task_id, round((s0 - (SELECT avg(s0) FROM scores)) / (SELECT stddev_pop(s0) FROM scores), 6) AS s0, round((s1 - (SELECT avg(s1) FROM scores)) / (SELECT stddev_pop(s1) FROM scores), 6) AS s1 FROM scores")
def ft_scale(spark, sf):
    out = X.scaled(V.scores(spark, sf).select("task_id", "s0", "s1"), ["s0", "s1"])
    return out.select("task_id", F.round("s0", 6).alias("s0"), F.round("s1", 6).alias("s1"))


@query("ft_dense_join", W + ", e AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings) SELECT task_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS norm FROM labelled JOIN e ON vec_id = task_id")
def ft_dense_join(spark, sf):
    dense = V.table(spark, sf, "embeddings").select(c("vec_id").alias("task_id"), X.unit(c("embedding")).alias("dense"))
    return rows(spark, sf).join(dense, "task_id").select("task_id", F.round(c("dense")[0], 6).alias("first"), F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("ft_top_terms", W + COUNTS + " SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 50")
def ft_top_terms(spark, sf):
    return X.top_terms(counts(spark, sf))


@query("ft_active_and_coverage", W + VOCAB + " SELECT task_id, count(v.term)::BIGINT AS active, round(coalesce(sum(tf) FILTER (v.term IS NOT NULL), 0) / sum(tf), 6) AS known_share FROM counts k LEFT JOIN vocab v USING (term) GROUP BY task_id")
def ft_active_and_coverage(spark, sf):
    k = counts(spark, sf)
    return X.activity(k, "task_id", X.vocabulary(k)).select("task_id", "active", F.round("known_share", 6).alias("known_share"))


# --- retrieval and rules --------------------------------------------------------------------------------------------

SPLIT = TFIDF + ", ask AS (SELECT * FROM weights WHERE task_id % 4 = 0), known AS (SELECT * FROM weights WHERE task_id % 4 <> 0), sim AS (SELECT a.task_id AS row, b.task_id AS other, sum(a.weight * b.weight) AS s FROM ask a JOIN known b USING (term) GROUP BY ALL)"


def split_lists(spark, sf):
    """The same rows as stored lists of terms; weights are made once for both sides."""
    lists = written(R.term_lists(weights(spark, sf).withColumnRenamed("task_id", "row")), "lists")
    return lists.where("row % 4 = 0"), lists.where("row % 4 <> 0")


def labels_of(spark, sf):
    return rows(spark, sf).select(c("task_id").alias("row"), c("y").alias("label"))


@query("join_shared_terms", W + SPLIT + " SELECT row, other, round(s, 6) AS similarity FROM sim")
def join_shared_terms(spark, sf):
    return R.compared_lists(*split_lists(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("rt_knn_vote", W + SPLIT + """, near AS (SELECT row, other, round(s, 9) AS s FROM sim QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(s, 9) DESC, other) <= 15), d AS (SELECT row, other, greatest(round(1 - s, 9), 0) AS d, max((round(1 - s, 9) <= 0)::INT) OVER (PARTITION BY row) AS zero FROM near),
v AS (SELECT d.row, y AS label, round(sum(CASE WHEN zero = 1 THEN (d <= 0)::INT::DOUBLE ELSE 1 / greatest(d, 1e-9) END), 6) AS v FROM d JOIN labelled ON task_id = other GROUP BY ALL) SELECT row, arg_min(label, (-v, label)) AS label FROM v GROUP BY row""")
def rt_knn_vote(spark, sf):
    return R.knn_vote(R.compared_lists(*split_lists(spark, sf), 15), labels_of(spark, sf))


@query("rt_class_similarity", W + SPLIT + ", m AS (SELECT task_id FROM labelled WHERE y = 'E1' AND task_id % 4 <> 0) SELECT row, round(max(s), 6) AS top, round(sum(s) / (SELECT count(*) FROM m), 6) AS mean FROM sim WHERE other IN (SELECT task_id FROM m) GROUP BY row")
def rt_class_similarity(spark, sf):
    ask, known = split_lists(spark, sf)
    members = known.join(rows(spark, sf).where("y = 'E1'").select(c("task_id").alias("row")), "row", "left_semi")
    return R.class_similarity(ask, members).select("row", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"))


@query("rt_centroids", W + SPLIT + ", cs AS (SELECT y AS label, term, sum(weight) AS w FROM known JOIN labelled USING (task_id) GROUP BY ALL), cn AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM cs) SELECT task_id AS row, label, round(sum(weight * w), 6) AS similarity FROM ask JOIN cn USING (term) GROUP BY ALL")
def rt_centroids(spark, sf):
    every = labels_of(spark, sf).withColumn("asked", c("row") % 4 == 0)
    return R.tfidf_centroids(counts(spark, sf).withColumnRenamed("task_id", "row"), every, L.CLASSES).withColumn("similarity", F.round("similarity", 6))


RULES = COUNTS + """, ru AS (SELECT y AS label, term, count(*) AS b FROM counts JOIN labelled USING (task_id) GROUP BY ALL), sc AS (SELECT label, term, b / (SELECT count(*) FROM labelled) AS support, (b / (SELECT count(*) FROM counts k WHERE k.term = ru.term)) / ((SELECT count(*) FROM labelled l WHERE l.y = ru.label) / (SELECT count(*) FROM labelled)) AS lift FROM ru),
good AS (SELECT label, term, round(ln(1 + lift - 1) * support, 9) AS score FROM sc WHERE round(support, 9) >= 0.01 AND round(lift, 9) >= 1.15 QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(ln(1 + lift - 1) * support, 9) DESC, term) <= 40)"""


@query("ru_association", W + RULES + ", s AS (SELECT task_id, label, round(sum(score), 9) AS s FROM counts JOIN good USING (term) GROUP BY ALL), t AS (SELECT task_id, arg_min(label, (-s, label)) AS label FROM s GROUP BY task_id) SELECT l.task_id AS row, coalesce(t.label, 'E0') AS label FROM labelled l LEFT JOIN t USING (task_id)")
def ru_association(spark, sf):
    terms = counts(spark, sf).select(c("task_id").alias("row"), "term")
    labels = labels_of(spark, sf)
    return R.apply_rules(terms, R.association_rules(terms, labels), labels.select("row"), "E0")


@query("ru_phrase_gate", W + COUNTS + ", st AS (SELECT term, round(avg((y = 'E1')::INT), 9) AS conf, count(*) AS sup FROM counts JOIN labelled USING (task_id) WHERE task_id % 4 <> 0 GROUP BY term HAVING count(*) >= 2), b AS (SELECT task_id, max((conf, sup)) AS m FROM counts JOIN st USING (term) GROUP BY task_id) SELECT l.task_id AS row, round(coalesce(m[1], 0), 6) AS confidence, coalesce(m[2], 0)::BIGINT AS support, CASE WHEN coalesce(m[1], 0) >= 0.5 AND coalesce(m[2], 0) >= 2 THEN 'E1' ELSE 'E0' END AS label FROM labelled l LEFT JOIN b USING (task_id)")
def ru_phrase_gate(spark, sf):
    terms = counts(spark, sf).select(c("task_id").alias("row"), "term")
    every = rows(spark, sf).select(c("task_id").alias("row"), (c("y") == "E1").cast("int").alias("positive"))
    out = R.phrase_scores(terms, every.where("row % 4 <> 0"), every.select("row"))
    return out.select("row", F.round("confidence", 6).alias("confidence"), "support", F.when((c("confidence") >= 0.5) & (c("support") >= 2), "E1").otherwise("E0").alias("label"))


KEYWORDS = ["the", "of", "and", "de", "la", "und"]


@query("ru_keyword_count", W + ", p AS (SELECT task_id, ' ' || regexp_replace(lower(task), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS t FROM labelled) SELECT task_id, (" + " + ".join(f"(contains(t, ' {w} '))::INT" for w in KEYWORDS) + ")::INT AS hits FROM p")
def ru_keyword_count(spark, sf):
    return rows(spark, sf).select("task_id", R.keyword_hits(c("task"), KEYWORDS).alias("hits"))


@query("ru_regex_gate", W + " SELECT task_id, CASE WHEN regexp_matches(lower(task), '(^| )(design|write|the) ') THEN 'E1' ELSE y END AS label FROM labelled")
def ru_regex_gate(spark, sf):
    return rows(spark, sf).select("task_id", R.regex_gate(c("y"), F.lower("task"), "(^| )(design|write|the) ", "E1").alias("label"))
