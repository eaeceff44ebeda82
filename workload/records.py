"""Run log, document corpus, model registry and request limits over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tabguard.operators import admission, block_index, change_tables, corpus, experiments, leakage, registry, vector_index
from tabguard.session import scratch_path
from tabguard.sources import sinks
from tabguard.streaming import admission as streaming
from tabguard.streaming.ordered_admission import admit_stream_in_order, rocksdb_state
from workload.catalog import query, table
from workload.disclosure import rounded

# ------------------------------------------------------------------ run log: one run per part

RUNS_SQL = """
WITH runs AS (
  SELECT 'exp_' || p_partkey AS experiment_id, CASE WHEN p_size % 2 = 0 THEN 'GaussianCopula' ELSE 'PAR' END AS method,
         CASE WHEN p_partkey % 10 <> 3 THEN '2026-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS timestamp,
         CAST(p_size * 100 AS BIGINT) AS num_rows, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS sensitive_column,
         p_retailprice / 1000 AS epsilon, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS epochs
  FROM part)
"""


def runs(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    day = F.lpad((size % 28 + 1).cast("string"), 2, "0")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("exp_"), k.cast("string")).alias("experiment_id"),
        F.when(size % 2 == 0, "GaussianCopula").otherwise("PAR").alias("method"),
        F.when(k % 10 != 3, F.concat(F.lit("2026-01-"), day)).alias("timestamp"),
        (size * 100).cast("long").alias("num_rows"), F.when(k % 4 == 0, F.col("p_brand")).alias("sensitive_column"),
        (F.col("p_retailprice") / 1000).alias("epsilon"), F.when(k % 3 == 0, size.cast("long")).alias("epochs"),
    )


CONFIG_SCAN_SQL = RUNS_SQL + """
SELECT p_brand AS experiment_id, max(method) AS method, max(timestamp) AS timestamp, CAST(sum(num_rows) AS BIGINT) AS num_rows,
       CAST(NULL AS VARCHAR) AS sensitive_column, CAST(NULL AS DOUBLE) AS epsilon, CAST(max(epochs) AS BIGINT) AS epochs,
       CAST(NULL AS VARCHAR) AS sequence_key, CAST(NULL AS VARCHAR) AS sequence_index, 'running' AS status, CAST(NULL AS VARCHAR) AS error
FROM runs JOIN part ON experiment_id = 'exp_' || p_partkey GROUP BY p_brand
"""


@query(CONFIG_SCAN_SQL)
def experiment_config_scan(spark, sf_dir):
    """One configuration file per brand (old layouts lack keys), plus a broken file that must not matter."""
    path = scratch_path(spark, "experiments")
    brand = table(spark, sf_dir, "part").select(F.concat(F.lit("exp_"), F.col("p_partkey").cast("string")).alias("experiment_id"), "p_brand")
    merged = runs(spark, sf_dir).join(brand, "experiment_id").groupBy(F.col("p_brand").alias("experiment_id")).agg(
        F.max("method").alias("method"), F.max("timestamp").alias("timestamp"), F.sum("num_rows").alias("num_rows"),
        F.max("epochs").alias("epochs"), F.lit("running").alias("status"),
    )
    documents = merged.select(F.to_json(F.struct("*")).alias("value"), F.xxhash64("experiment_id").alias("file"))
    broken = spark.createDataFrame([("{not json", -1)], "value string, file long")
    documents.unionByName(broken).repartition("file").write.partitionBy("file").text(path)
    return sinks.read_configs(spark, path + "/*/*.txt")


@query(RUNS_SQL + "SELECT experiment_id, method, timestamp FROM runs ORDER BY coalesce(timestamp, '') DESC, experiment_id")
def experiment_history(spark, sf_dir):
    return experiments.history(runs(spark, sf_dir)).select("experiment_id", "method", "timestamp")


@query(RUNS_SQL + """
SELECT 'exp_' || o_orderkey AS experiment_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'report' WHEN r.experiment_id IS NOT NULL THEN 'config' ELSE 'not_found' END AS source,
       CASE WHEN o_orderkey % 5 = 0 THEN 'note ' || o_orderstatus ELSE '' END AS notes
FROM orders LEFT JOIN runs r ON r.experiment_id = 'exp_' || o_orderkey
""")
def experiment_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("experiment_id", F.concat(F.lit("exp_"), F.col("o_orderkey").cast("string")))
    reports = orders.filter(F.col("o_orderkey") % 3 == 0).select("experiment_id", F.to_json(F.struct("o_totalprice")).alias("document"))
    notes = orders.filter(F.col("o_orderkey") % 5 == 0).select("experiment_id", F.concat(F.lit("note "), F.col("o_orderstatus")).alias("text"))
    found = experiments.resolve(orders.select("experiment_id"), runs(spark, sf_dir), reports, notes)
    return found.select("experiment_id", "source", "notes")


@query("""
SELECT c_custkey AS experiment_id, coalesce(arg_max(event_type, (ts, event_id)), 'not_found') AS status
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
""")
def experiment_status(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_id"))
    return experiments.latest_status(events, asked)


CHANGES_SQL = """
WITH ch AS (SELECT CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'add' WHEN 'signup' THEN 'add' ELSE 'update' END AS op,
              user_id * 10 + event_id % 10 AS id, ts, event_id AS seq, 'g' || event_id % 6 AS "graphId", value AS x, event_type AS comment,
              event_id % 2 = 0 AS resolved FROM events)
, st AS (SELECT *, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER w AS state FROM ch
         WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, live AS (SELECT id, arg_max(op, (ts, seq)) FILTER (op <> 'update') AS last_op FROM ch GROUP BY id)
, cur AS (SELECT ch.* FROM ch JOIN live USING (id) WHERE last_op = 'add' AND op <> 'delete'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1)
"""


def changes(spark, sf_dir):
    kind, event = F.col("event_type"), F.col("event_id")
    op = F.when(kind == "error", "delete").when(kind.isin("click", "signup"), "add").otherwise("update")
    return table(spark, sf_dir, "events").select(
        op.alias("op"), (F.col("user_id") * 10 + event % 10).alias("id"), "ts", event.alias("seq"),
        F.concat(F.lit("g"), (event % 6).cast("string")).alias("graphId"), F.col("value").alias("x"), kind.alias("comment"),
        (event % 2 == 0).alias("resolved"),
    )


@query(CHANGES_SQL + 'SELECT id, ts, "graphId", x, comment, resolved FROM cur')
def annotations_current(spark, sf_dir):
    return experiments.current_rows(changes(spark, sf_dir), ["graphId", "x", "comment", "resolved"])


def _in_batches(spark, tag, log, payload):
    """The log in three batches, each with changes from all of its time, and a compaction after the second."""
    kept = change_tables.ChangeTable(spark, scratch_path(spark, tag), tuple(payload))
    kept.create(log.filter(F.col("seq") % 3 == 0), ranges=16)
    kept.append(log.filter(F.col("seq") % 3 == 1))
    kept.compact()
    kept.append(log.filter(F.col("seq") % 3 == 2))
    return kept.current()


@query(CHANGES_SQL + 'SELECT id, ts, "graphId", x, comment, resolved FROM cur')
def annotations_merged(spark, sf_dir):
    return _in_batches(spark, "annotations", changes(spark, sf_dir), ["graphId", "x", "comment", "resolved"])


@query("SELECT user_id AS id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def experiment_status_merged(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.lit("add").alias("op"), F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return _in_batches(spark, "status", log, ["status"])


REJECTED_SQL = CHANGES_SQL + "SELECT op, id, seq FROM st WHERE op <> 'add' AND (state IS NULL OR state <> 'add')"


@query(REJECTED_SQL)
def annotations_rejected(spark, sf_dir):
    return experiments.rejected_changes(changes(spark, sf_dir)).select("op", "id", "seq")


@query(REJECTED_SQL.replace("user_id * 10 + event_id % 10", "event_id % 3"))
def annotations_rejected_hot_ids(spark, sf_dir):
    """A third of the log belongs to each id, so every id is cut into pieces."""
    hot = changes(spark, sf_dir).withColumn("id", F.col("seq") % 3)
    return experiments.rejected_changes(hot, piece_rows=500).select("op", "id", "seq")


@query(CHANGES_SQL + 'SELECT "graphId", count(*) AS annotations, count(*) FILTER (NOT resolved) AS open_annotations FROM cur GROUP BY 1')
def annotations_per_graph(spark, sf_dir):
    current = experiments.current_rows(changes(spark, sf_dir), ["graphId", "x", "comment", "resolved"])
    return experiments.annotations_per_graph(current)


@query("SELECT user_id AS experiment_id, arg_max(props, (ts, event_id)) AS text FROM events GROUP BY user_id")
def experiment_notes(spark, sf_dir):
    return experiments.upsert_text(table(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"), F.col("props").alias("text"), "ts", F.col("event_id").alias("seq")))


@query("""
WITH s AS (SELECT c_name || '__run_b-' || c_custkey % 3 AS name, CAST(c_custkey AS BIGINT) AS saved_at FROM customer)
SELECT name, saved_at, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ') AS title
FROM s ORDER BY saved_at DESC, name
""")
def saved_sessions(spark, sf_dir):
    return experiments.saved_sessions(table(spark, sf_dir, "customer").select(
        F.concat("c_name", F.lit("__run_b-"), (F.col("c_custkey") % 3).cast("string")).alias("name"), F.col("c_custkey").alias("saved_at")))


@query(RUNS_SQL + """
SELECT 'fork_' || o_orderkey AS experiment_id, experiment_id AS parent_id, CAST(o_orderdate AS VARCHAR)[1:10] AS timestamp, method, num_rows,
       sensitive_column, epsilon, epochs, 'pending' AS status
FROM orders JOIN runs ON experiment_id = 'exp_' || o_custkey
""")
def experiment_forks(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fork_"), F.col("o_orderkey").cast("string")).alias("new_id"),
        F.concat(F.lit("exp_"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
    )
    return experiments.fork(runs(spark, sf_dir), requests)


@query("""
WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey - p_partkey % 50 ELSE p_partkey - 1 END AS parent
                     FROM part)
, walk AS (SELECT id AS experiment_id, id AS node, 0 AS depth FROM f
           UNION ALL SELECT experiment_id, f.parent, depth + 1 FROM walk JOIN f ON f.id = walk.node WHERE f.parent IS NOT NULL)
SELECT experiment_id, arg_max(node, depth) AS root_id, max(depth) AS depth FROM walk GROUP BY experiment_id
""")
def experiment_lineage(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.when(k % 50 == 0, None).when(k % 3 == 0, k - k % 50).otherwise(k - 1)
    return experiments.lineage(table(spark, sf_dir, "part").select(k.alias("experiment_id"), parent.alias("parent_id")))


@query(RUNS_SQL + """
SELECT experiment_id, timestamp AS date, method, epsilon, CASE WHEN o_orderkey % 4 = 0 THEN 'PASSED' ELSE 'WARNING: LEAKAGE DETECTED' END AS status,
       CAST(o_orderkey % 4 AS BIGINT) AS leaked_rows, o_totalprice AS min_distance
FROM runs JOIN orders ON experiment_id = 'exp_' || o_orderkey
""")
def compliance_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("experiment_id", F.concat(F.lit("exp_"), F.col("o_orderkey").cast("string")))

    def rows(section, metric, value):
        return F.struct(F.lit(section).alias("section"), F.lit(None).cast("string").alias("column"), F.lit(metric).alias("metric"),
                        value.cast("string").alias("value"))

    reports = orders.select("experiment_id", F.inline(F.array(
        rows("privacy", "leaked_rows", F.col("o_orderkey") % 4), rows("dcr", "min_distance", F.col("o_totalprice")),
        rows("dcr", "max_distance", F.col("o_totalprice") * 2))))
    return leakage.compliance_summary(runs(spark, sf_dir), reports)


@query("""
SELECT 'exp_' || o_orderkey AS experiment_id, '{"section":"privacy","metric":"status","value":"' || o_orderstatus || '"}' AS document FROM orders
""")
def report_documents(spark, sf_dir):
    """Report rows written as JSON documents and read back."""
    reports = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("exp_"), F.col("o_orderkey").cast("string")).alias("experiment_id"), F.lit("privacy").alias("section"),
        F.lit(None).cast("string").alias("column"), F.lit("status").alias("metric"), F.col("o_orderstatus").alias("value"))
    documents = sinks.report_documents(reports)
    path = scratch_path(spark, "report")
    sinks.write_documents(documents.select(F.concat_ws("\t", "experiment_id", "document").alias("document")), path)
    back = F.split("value", "\t")
    return spark.read.text(path).select(back[0].alias("experiment_id"), back[1].alias("document"))


# ------------------------------------------------------------------ corpus

PAGES_SQL = r"""
WITH raw AS (SELECT CAST(doc_id AS VARCHAR) || '.pdf' AS filename, string_split(text, chr(10)) AS parts FROM documents)
, cut AS (SELECT filename, unnest(range(1, len(parts) + 1)) AS page_number, unnest(parts) AS part FROM raw)
, pages AS (SELECT filename, CAST(page_number AS INT) AS page_number, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM cut
            WHERE length(regexp_replace(part, '^\s+|\s+$', '', 'g')) > 50)
"""


def pages(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "text")
    return corpus.ingest_pages(documents, separator="\n")


PAGES_HEAD = PAGES_SQL.replace("FROM documents)", "FROM documents)").replace("pages AS", "pg AS")


@query(PAGES_HEAD + "SELECT filename, page_number, length(text) AS chars, md5(text) AS digest FROM pg")
def corpus_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("filename", "page_number", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(PAGES_HEAD + "SELECT count(DISTINCT filename) AS total_documents, count(*) AS total_pages FROM pg")
def corpus_statistics(spark, sf_dir):
    return corpus.corpus_statistics(pages(spark, sf_dir))


@query(PAGES_HEAD + "SELECT filename, count(*) AS pages FROM pg GROUP BY filename")
def corpus_files(spark, sf_dir):
    return corpus.corpus_files(pages(spark, sf_dir))


QUESTION = "the patients and the data of privacy, les données de la"


SEARCH_SQL = PAGES_HEAD + r"""
, tok AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM pg)
, terms AS (SELECT unnest(['the', 'patients', 'and', 'data', 'of', 'privacy', 'les', 'données', 'de', 'la']) AS term)
, tf AS (SELECT filename, page_number, term, len(list_filter(t, lambda x: x = term)) AS f, len(t) AS dl FROM tok, terms)
, df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term)
, n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok)
, sc AS (SELECT filename, page_number, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS s
         FROM tf JOIN df USING (term), n GROUP BY filename, page_number)
SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, filename, page_number) AS INT) AS rank, filename, page_number,
       round(s / max(s) OVER (), 6) AS score, text
FROM sc JOIN pg USING (filename, page_number) QUALIFY rank <= 7
"""


@query(SEARCH_SQL)
def page_search(spark, sf_dir):
    return rounded(corpus.search_pages(pages(spark, sf_dir), QUESTION, top_k=7), "score")


@query(SEARCH_SQL)
def page_search_index(spark, sf_dir):
    """The same search through an index of its terms."""
    path = scratch_path(spark, "index")
    corpus.build_index(pages(spark, sf_dir), path)
    return rounded(corpus.search_index(pages(spark, sf_dir), path, QUESTION, top_k=7), "score")


@query(SEARCH_SQL)
def page_search_blocks(spark, sf_dir):
    """The same search through posting blocks: two appends, the second with copies under other names that are then deleted."""
    every, index = pages(spark, sf_dir), block_index.BlockIndex(spark, scratch_path(spark, "blocks"))
    half = F.pmod(F.xxhash64("filename", "page_number"), F.lit(2))
    copies = every.filter("page_number = 1").withColumn("filename", F.concat(F.lit("copy-"), "filename"))
    index.create()
    index.append(every.filter(half == 0))
    index.append(every.filter(half == 1).unionByName(copies))
    index.delete(copies)
    return rounded(index.search(every, QUESTION, top_k=7), "score")


VECTOR_SQL = """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))
   / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])), 6) AS score
FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10
"""


@query(VECTOR_SQL)
def vector_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.filter("vec_id = 0").first()["embedding"]
    return rounded(corpus.nearest_vectors(vectors, list(wanted), top_k=10), "score")


def _vector_index(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings")
    vector_index.build_vector_index(vectors, path)
    return path, vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(VECTOR_SQL)
def vector_search_index(spark, sf_dir):
    """The same search through the index, completed by its bounds."""
    path, vectors = _vector_index(spark, sf_dir)
    found = vector_index.search_vector_index(spark, path, vectors.filter("query_id = 0"), top_k=10, exact=True)
    return rounded(found.select(F.col("key").alias("vec_id"), "score"), "score")


@query("SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM embeddings)) AS results, TRUE AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_search_index_recall(spark, sf_dir):
    """Recall of the probed lists alone against a scan of all vectors, for every 50th vector as a query."""
    path, vectors = _vector_index(spark, sf_dir)
    asked = vectors.filter("query_id % 50 = 0")
    found = vector_index.search_vector_index(spark, path, asked, top_k=10)
    exact = vector_index.nearest_exactly(vectors.select(F.col("query_id").alias("key"), "vector"), asked, 10)
    both = exact.select("query_id", "key", F.lit(1).alias("exact")).join(found.select("query_id", "key", F.lit(1).alias("found")), ["query_id", "key"], "full")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("found").alias("results"),
                    (F.count_if(F.col("exact").isNotNull() & F.col("found").isNotNull()) >= F.count("exact") * 0.95).alias("recall_reached"))


@query('SELECT event_type || user_id AS "query", ts AS timestamp, CAST(event_id % 9 + 1 AS BIGINT) AS top_k FROM events ORDER BY ts DESC, "query"')
def search_history(spark, sf_dir):
    return corpus.search_history(table(spark, sf_dir, "events").select(
        F.concat("event_type", F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("timestamp"), (F.col("event_id") % 9 + 1).alias("top_k")))


# Three highlights for most documents (some overlap, some leave the text), none for every 4th.
MARKS_SQL = """
WITH h AS (SELECT doc_id, k AS highlight_id, CAST((doc_id * 31 + k * 47) % 97 AS INT) AS s, CAST((doc_id * 31 + k * 47) % 97 + doc_id % 60 AS INT) AS e,
             CASE WHEN k = 1 THEN 'green' ELSE 'yellow' END AS color, 'c' || k AS comment
           FROM documents, range(0, 3) AS r(k) WHERE doc_id % 4 <> 1)
, b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, highlight_id), 0) AS p FROM h)
, last AS (SELECT doc_id, arg_max(e, (s, highlight_id)) AS le FROM h GROUP BY doc_id)
, seg AS (
  SELECT b.doc_id, p AS position, 0 AS part, p AS f, s AS t, NULL AS color, NULL AS comment FROM b WHERE s > p
  UNION ALL SELECT b.doc_id, s, 1, s, e, color, comment FROM b
  UNION ALL SELECT d.doc_id, coalesce(le, 0), 2, coalesce(le, 0), CAST(length(text) AS INT), NULL, NULL FROM documents d LEFT JOIN last USING (doc_id)
    WHERE le IS NULL OR le < length(text))
SELECT doc_id, position, part, substr(text, f + 1, greatest(t - f, 0)) AS text, color, comment FROM seg JOIN documents USING (doc_id)
"""


@query(MARKS_SQL)
def highlight_segments(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = ((F.col("doc_id") * 31 + F.col("highlight_id") * 47) % 97).cast("int")
    marks = documents.filter(F.col("doc_id") % 4 != 1).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("highlight_id")).select(
        "doc_id", "highlight_id", start.alias("start"), (start + F.col("doc_id") % 60).cast("int").alias("end"),
        F.when(F.col("highlight_id") == 1, "green").otherwise("yellow").alias("color"),
        F.concat(F.lit("c"), F.col("highlight_id").cast("string")).alias("comment"))
    return corpus.highlight_segments(documents, marks)


# ------------------------------------------------------------------ model registry: one entry per event

AS_OF = dt.datetime(2024, 2, 5)
ENTRIES_SQL = """
WITH m AS (SELECT 'key' || event_id AS cache_key, CASE WHEN event_id % 17 <> 0 THEN ts END AS cached_at, value::DOUBLE AS size_mb,
             ts + to_seconds(CAST(event_id % 977 AS BIGINT) * 600) AS last_accessed FROM events)
"""
LIMIT_GB = 20.0


def entries(spark, sf_dir):
    moved = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) * 0 + (F.col("event_id") % 977) * 600)
    shifted = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.unix_micros(moved))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("key"), F.col("event_id").cast("string")).alias("cache_key"),
        F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("cached_at"), F.col("value").cast("double").alias("size_mb"),
        shifted.cast("timestamp_ntz").alias("last_accessed"),
    )


@query(ENTRIES_SQL + "SELECT cache_key, coalesce(cached_at >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY, FALSE) AS valid FROM m")
def registry_validity(spark, sf_dir):
    return registry.valid_entries(entries(spark, sf_dir), AS_OF).select("cache_key", "valid")


@query(ENTRIES_SQL + f"""
, live AS (SELECT *, sum(size_mb) OVER (ORDER BY last_accessed DESC, cache_key ROWS UNBOUNDED PRECEDING) AS kept FROM m
           WHERE cached_at >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY)
SELECT cache_key, CASE WHEN kept > {LIMIT_GB} * 1024 THEN 'evict' ELSE 'keep' END AS action FROM live
UNION ALL SELECT cache_key, 'expire' FROM m WHERE cached_at IS NULL OR cached_at < TIMESTAMP '2024-02-05' - INTERVAL 30 DAY
""")
def registry_retention(spark, sf_dir):
    return registry.retention_plan(entries(spark, sf_dir), AS_OF, max_gigabytes=LIMIT_GB).select("cache_key", "action")


@query(ENTRIES_SQL + f"""
, u AS (SELECT cache_key, cached_at, CASE WHEN right(cache_key, 1) IN ('1', '4') THEN NULL ELSE date_trunc('day', last_accessed) END AS last_accessed, size_mb FROM m)
, live AS (SELECT *, sum(size_mb) OVER (ORDER BY last_accessed DESC NULLS LAST, cache_key ROWS UNBOUNDED PRECEDING) AS kept FROM u
           WHERE cached_at >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY)
SELECT cache_key, CASE WHEN kept > {LIMIT_GB} * 1024 THEN 'evict' ELSE 'keep' END AS action FROM live
UNION ALL SELECT cache_key, 'expire' FROM u WHERE cached_at IS NULL OR cached_at < TIMESTAMP '2024-02-05' - INTERVAL 30 DAY
""")
def registry_retention_unused(spark, sf_dir):
    """Entries that were never used, and many of one moment: none is lost, the unused are evicted first."""
    unused = F.substring("cache_key", -1, 1).isin("1", "4")
    rows = entries(spark, sf_dir).withColumn("last_accessed", F.when(~unused, F.date_trunc("day", "last_accessed")))
    return registry.retention_plan(rows, AS_OF, max_gigabytes=LIMIT_GB).select("cache_key", "action")


@query(ENTRIES_SQL + """
SELECT count(*) AS entries, round(sum(size_mb) / 1024, 6) AS total_gb, min(cached_at) AS oldest, max(cached_at) AS newest FROM m
""")
def registry_statistics(spark, sf_dir):
    return rounded(registry.registry_statistics(entries(spark, sf_dir)), "total_gb")


@query(ENTRIES_SQL + "SELECT cache_key, CAST(date_diff('day', CAST(cached_at AS DATE), DATE '2024-02-05') AS INT) AS age_days FROM m")
def registry_ages(spark, sf_dir):
    return registry.entry_ages(entries(spark, sf_dir), AS_OF).select("cache_key", "age_days")


@query("""
SELECT TRUE AS same_when_repartitioned, TRUE AS same_when_sorted, FALSE AS same_with_copy, FALSE AS same_when_renamed, count(*) AS rows, 11 AS columns FROM lineitem
""")
def dataset_fingerprint(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")

    def mark(df):
        return registry.fingerprint(df).first()["fingerprint"]

    own = mark(items)
    return registry.fingerprint(items).select(
        F.lit(mark(items.repartition(7, "l_suppkey")) == own).alias("same_when_repartitioned"),
        F.lit(mark(items.orderBy("l_shipdate")) == own).alias("same_when_sorted"),
        F.lit(mark(items.unionAll(items.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1))) == own).alias("same_with_copy"),
        F.lit(mark(items.withColumnRenamed("l_tax", "tax")) == own).alias("same_when_renamed"), "rows", "columns",
    )


# ------------------------------------------------------------------ request limits

DAY = 86_400
#: Requests in a file of the late log, at least where it has several.
ARRIVAL_ROWS = 250_000
# Greedy admission by recursion over each key's log: keep the last two admitted times.
ADMIT_SQL = """
WITH RECURSIVE e AS (SELECT {key} AS k, event_id, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events)
, w AS (
  SELECT k, event_id, ts, i, TRUE AS admitted, [epoch_us(ts)] AS st FROM e WHERE i = 1
  UNION ALL
  SELECT e.k, e.event_id, e.ts, e.i, len(list_filter(w.st, lambda x: x > epoch_us(e.ts) - {us})) < {limit},
         CASE WHEN len(list_filter(w.st, lambda x: x > epoch_us(e.ts) - {us})) < {limit}
              THEN list_append(list_filter(w.st, lambda x: x > epoch_us(e.ts) - {us}), epoch_us(e.ts))
              ELSE list_filter(w.st, lambda x: x > epoch_us(e.ts) - {us}) END
  FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
"""


@query(ADMIT_SQL.format(key="user_id", us=DAY * 1_000_000, limit=2) + """
SELECT k AS user_id, event_id, ts, admitted, CAST(len(st) AS INT) AS in_window, CAST(greatest(0, 2 - len(st)) AS INT) AS remaining,
       ts + INTERVAL 1 DAY AS reset_at FROM w
""")
def request_admission(spark, sf_dir):
    return admission.admit_requests(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", limit=2, window_seconds=DAY).drop("limit")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
                            CASE WHEN user_id % 3 = 0 THEN 4 WHEN user_id % 3 = 1 THEN 1 ELSE 2 END AS lim FROM events)
, w AS (SELECT k, i, event_id, lim, TRUE AS admitted, [t] AS st FROM e WHERE i = 1
        UNION ALL SELECT e.k, e.i, e.event_id, e.lim, len(list_filter(st, lambda x: x > e.t - 86400000000)) < e.lim,
          CASE WHEN len(list_filter(st, lambda x: x > e.t - 86400000000)) < e.lim THEN list_append(list_filter(st, lambda x: x > e.t - 86400000000), e.t)
               ELSE list_filter(st, lambda x: x > e.t - 86400000000) END
        FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
SELECT k AS user_id, event_id, lim AS "limit", admitted FROM w
""")
def request_admission_own_limits(spark, sf_dir):
    """Each user has a limit of its own."""
    kind = F.col("user_id") % 3
    log = table(spark, sf_dir, "events").withColumn("rate_limit", F.when(kind == 0, 4).when(kind == 1, 1).otherwise(2))
    return admission.admit_requests(log, ["user_id"], "ts", "event_id", "rate_limit", DAY).select("user_id", "event_id", "limit", "admitted")


@query(ADMIT_SQL.format(key="event_type", us=3600 * 1_000_000, limit=3) + "SELECT k AS event_type, event_id, admitted FROM w")
def request_admission_hot_keys(spark, sf_dir):
    """Five keys hold the whole log; each is cut into pieces that are replayed to a fixed point."""
    decided = admission.admit_requests(
        table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", limit=3, window_seconds=3600, piece_rows=1000)
    return decided.select("event_type", "event_id", "admitted")


@query(ADMIT_SQL.format(key="user_id", us=DAY * 1_000_000, limit=2) + """
SELECT k AS user_id, 2 AS "limit", CAST(greatest(0, 2 - arg_max(len(st), i)) AS INT) AS remaining, max(ts) + INTERVAL 1 DAY AS reset_at FROM w GROUP BY k
""")
def request_quota(spark, sf_dir):
    decided = admission.admit_requests(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", limit=2, window_seconds=DAY)
    return admission.quota(decided, ["user_id"], limit=2)


@query("""
SELECT DISTINCT event_type, ts, count(*) OVER (PARTITION BY event_type, ts) AS at_once,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS requests
FROM events
""")
def trailing_request_count(spark, sf_dir):
    return admission.trailing_counts(table(spark, sf_dir, "events"), ["event_type"], "ts", window_seconds=3600)


def _stream(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    return spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")


def _run(df, spark, tag, mode="append"):
    out = scratch_path(spark, tag)
    started = df.writeStream.outputMode(mode).format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, tag + "-log")).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(ADMIT_SQL.format(key="user_id", us=DAY * 1_000_000, limit=2) + """
SELECT event_id AS order_id, admitted, CAST(len(st) AS INT) AS in_window FROM w
""")
def request_admission_stream(spark, sf_dir):
    decided = streaming.admit_stream(_stream(spark, sf_dir), ["user_id"], "ts", "event_id", limit=2, window_seconds=DAY)
    return _run(decided, spark, "admitted").select("order_id", "admitted", "in_window")


@query(ADMIT_SQL.format(key="user_id", us=DAY * 1_000_000, limit=2) + """
SELECT event_id AS order_id, admitted, CAST(len(st) AS INT) AS in_window FROM w
WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 172800000
""")
def request_admission_late(spark, sf_dir):
    """Requests that come up to a day late, in five parts: the decisions are those of the ordered log."""
    log = table(spark, sf_dir, "events")
    # Up to 23 hours behind its time, by a hash of the request.
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(23 * 3600 * 1_000_000))
    span = log.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    arrived = log.withColumn("part", F.floor((arrival - F.lit(span["a"])) * 5 / F.lit(span["b"] - span["a"] + 1)))
    # Each part in as many files as the others, so that a batch of the stream is a part.
    rows = dict(arrived.groupBy("part").count().collect())
    files = max(1, min(rows.get(i, 0) for i in range(5)) // ARRIVAL_ROWS)
    folder = scratch_path(spark, "late-requests")
    for i in range(5):
        # A part after the other: the source reads files in the order of their time.
        arrived.filter(F.col("part") == i).drop("part").repartition(files).write.mode("append").parquet(folder)
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(folder)
    decided = admit_stream_in_order(source, ["user_id"], "ts", "event_id", limit=2, window_seconds=DAY, lateness="2 days")
    with rocksdb_state(spark):
        return _run(decided, spark, "late-admitted").select("order_id", "admitted", "in_window")


@query("""
WITH b AS (SELECT event_type, unnest(generate_series(CAST(floor(epoch(ts) / 600) * 600 - 3000 AS BIGINT), CAST(floor(epoch(ts) / 600) * 600 AS BIGINT), 600)) AS s FROM events)
, w AS (SELECT s, event_type, count(*) AS requests FROM b GROUP BY ALL)
SELECT make_timestamp(s * 1000000) AS window_start, event_type, requests FROM w
WHERE make_timestamp((s + 3600) * 1000000) <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)
""")
def request_count_stream(spark, sf_dir):
    counted = streaming.request_counts(_stream(spark, sf_dir), ["event_type"], "ts", window="1 hour", slide="10 minutes")
    return _run(counted, spark, "counts").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "requests")
