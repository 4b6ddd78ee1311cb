"""Queries over short texts that differ from row to row, with counts that are not zero, and round trips through files and
streams; each with the same result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, sql
from ..operators import audit, detect, generate, labeler, score
from ..session import shared_dir
from ..sources import files
from ..streaming import incremental
from . import decisions as D

_A, _B, _J = D.PARTS["surname"], D.PARTS["owner"], D.PARTS["judge"]
#: Two names that stand twice each, and one to keep.
TEXT = "a || ' traf ' || b || '. ' || a || ' sah ' || b || ' bei ' || j || '.'"
#: Places of the names.
B1, A2, B2, J1 = "length(a) + 6", "length(a) + length(b) + 8", "2 * length(a) + length(b) + 13", "2 * length(a) + 2 * length(b) + 18"
IDENTIFIERS = "'Nummer 756.' || n || '.5678.06, Konto CH10 0023 0023 0023 ' || n || ' 8, Postfach ' || k || ', Parzelle Nr. ' || k || ', Kennzeichen BE ' || m || '.'"
_DIGITS = ("CAST(o_orderkey AS STRING) AS k", "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS n", "CAST(o_orderkey % 900 + 100 AS STRING) AS m")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, o (the order's number), the names a, b and j, and text."""
    orders = _orders(spark, sf_dir)
    rows = D.spread(orders.selectExpr("CAST(o_orderkey AS STRING) AS doc_id", "o_orderkey", "o_custkey"), orders)
    rows = rows.selectExpr("doc_id", "o_orderkey AS o", f"{_A} AS a", f"{_B} AS b", f"{_J} AS j")
    return rows.selectExpr("*", f"{TEXT} AS text")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _span(at: str, name: str, entity: str, kind: str) -> str:
    return f"named_struct('start', CAST({at} AS INT), 'end', CAST({at} + length({name}) AS INT), 'text', {name}, 'entity', '{entity}', 'kind', '{kind}')"


def _edit(at: str, name: str, label: str) -> str:
    return f"named_struct('start', CAST({at} AS INT), 'end', CAST({at} + length({name}) AS INT), 'replacement', {label})"


def _scored(spark: SparkSession, sf_dir: str, *edits: str) -> tuple[DataFrame, DataFrame]:
    gold = ", ".join((_span("0", "a", "A", "person"), _span(B1, "b", "B", "company"), _span(A2, "a", "A", "person"), _span(B2, "b", "B", "company")))
    rows = _rows(spark, sf_dir).selectExpr("doc_id AS id", "o", "'de' AS language", "a", "b", "j", "text", f"array({gold}) AS gold", "array(named_struct('text', j, 'kind', 'court_official', 'count', 1)) AS keep")
    rows = rows.selectExpr("*", f"filter(array({', '.join(edits)}), e -> e IS NOT NULL) AS edits").withColumn("output", spans.splice(F.col("text"), F.col("edits")))
    return rows.select("id", "language", "text", "gold", "keep"), rows.select("id", "o", "b", "output", "edits")


def score_variants(spark, sf_dir):
    """Perfect, one label for two, two labels for one, leaked and over-redacted rows in turn."""
    edits = (
        _edit("0", "a", "'X.'"), f"CASE WHEN o % 5 <> 3 THEN {_edit(B1, 'b', 'CASE WHEN o % 5 = 1 THEN ' + repr('X.') + ' ELSE ' + repr('Y.') + ' END')} END",
        _edit(A2, "a", "CASE WHEN o % 5 = 2 THEN 'Z.' ELSE 'X.' END"), f"CASE WHEN o % 5 <> 3 THEN {_edit(B2, 'b', 'CASE WHEN o % 5 = 1 THEN ' + repr('X.') + ' ELSE ' + repr('Y.') + ' END')} END",
        f"CASE WHEN o % 5 = 4 THEN {_edit(J1, 'j', repr('[…]'))} END",
    )
    scores = score.score(*_scored(spark, sf_dir, *edits))
    return scores.select("id", "gold", "leaked", "keep", "keep_redacted", "multi", "consistent", "label_collisions", "extra_chars", F.coalesce(F.element_at("leaked_by_kind", F.lit("company")), F.lit(0)).alias("companies"))


def free_form_variants(spark, sf_dir):
    verb = "CASE WHEN o % 3 = 0 THEN named_struct('start', CAST(length(a) + 1 AS INT), 'end', CAST(length(a) + 5 AS INT), 'replacement', CASE WHEN o % 6 = 0 THEN 'traf 3' ELSE 'mied' END) END"
    return score.free_form_totals(*_scored(spark, sf_dir, _edit("0", "a", "'X.'"), verb))


def flagged_leaks(spark, sf_dir):
    cases, results = _scored(spark, sf_dir, _edit("0", "a", "'X.'"), _edit(A2, "a", "'X.'"))
    risks = results.where("o % 2 = 0").select(F.col("id").alias("doc_id"), F.lit(8).alias("start"), F.lit(9).alias("end"))
    return score.flagged_leaks(cases, results, risks)


def missed_place_labels(spark, sf_dir):
    """Hand labels joined with the places that stay in the output of every second row."""
    rows = _rows(spark, sf_dir)
    gold = ", ".join((_span(B1, "b", "V", "place"), _span(B2, "b", "V", "place")))
    cases = rows.selectExpr("doc_id AS id", f"array({gold}) AS gold")
    results = rows.selectExpr("doc_id AS id", f"CASE WHEN o % 2 = 1 THEN array({_edit(B1, 'b', repr('V.'))}, {_edit(B2, 'b', repr('V.'))}) ELSE array() END AS edits")
    labels = rows.selectExpr("doc_id AS case", "'V' AS entity", "CASE WHEN o % 4 = 0 THEN 'cue' ELSE 'none' END AS label")
    return score.label_counts(score.missed_places(cases, results), labels)


def usage_totals(spark, sf_dir):
    use = lambda n: f"named_struct('calls', {n}, 'prompt_tokens', 7 * {n}, 'completion_tokens', 2 * {n}, 'seconds', 0.5 * {n})"
    return score.usage_totals(_rows(spark, sf_dir).selectExpr(f"map('extract', {use('(o % 3)')}, 'audit', {use('(o % 2)')}) AS usage"))


def position_maps(spark, sf_dir):
    edits = f"array({_edit('0', 'a', repr('X.'))}, {_edit(B1, 'b', repr('A longer name'))}) AS edits"
    rows = _rows(spark, sf_dir).selectExpr("doc_id", "o", f"CAST({A2} AS INT) AS at", edits)
    rows = rows.withColumn("there", spans.to_output(F.col("at"), F.col("edits")))
    inside = spans.to_original(F.col("there") - 3, F.col("edits"))
    return rows.select("doc_id", "there", spans.to_original(F.col("there"), F.col("edits")).alias("back"), inside.alias("inside"))


def aligned_rewrites(spark, sf_dir):
    rows = _rows(spark, sf_dir).selectExpr("doc_id", "0 AS chunk_no", "0 AS start", "text AS part", "replace(text, a, 'X.') AS new")
    return labeler.align(rows).select("doc_id", "output", F.forall("edits", lambda e: e["end"] >= e["start"]).alias("ordered"))


def reader_quotes(spark, sf_dir):
    """A second reader's quotes at their place in the output, by document and by window."""
    rows = _rows(spark, sf_dir)
    outputs = rows.select("doc_id", F.col("text").alias("output"))
    quotes = rows.select("doc_id", F.explode(F.array(F.col("b"), F.lit("nowhere"))).alias("quote"), F.lit("low").alias("severity"), F.lit("seen").alias("reason"), F.lit("reader").alias("source"))
    by_window = quotes.drop("source").withColumn("chunk_no", F.lit(0))
    found = audit.relocate(outputs, quotes).unionByName(audit.locate_in_chunk(outputs, by_window))
    return found.groupBy("doc_id", "start", "end", "quote", "source").agg(F.count("*").alias("times"))


def quasi_identifiers(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ents = rows.selectExpr("doc_id", "inline(array(struct('keep' AS action, 'occupation' AS type, array(b) AS names, 'B' AS basis), struct('remove' AS action, 'birth_date' AS type, array(a) AS names, 'B' AS basis)))")
    return audit.quasi_identifiers(rows.select("doc_id", F.col("text").alias("output")), ents).select("doc_id", "start", "quote", "severity", "reason", "source")


def published_names(spark, sf_dir):
    ents = _rows(spark, sf_dir).selectExpr("doc_id", "inline(array(struct('keep' AS action, 'court_official' AS type, array(j, a || ' ' || j) AS names), struct('keep' AS action, 'private_company' AS type, array(b) AS names), struct('pseudonymize' AS action, 'lawyer' AS type, array(a) AS names)))")
    return audit.published(ents).select("doc_id", F.array_join("names", "|").alias("names"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr("o_orderkey", *_DIGITS).selectExpr("o_orderkey AS doc_id", f"{IDENTIFIERS} AS text")


def detect_identifiers(spark, sf_dir):
    return detect.pattern_mentions(_identified(spark, sf_dir)).select("doc_id", "text", "type")


def sql_detect_spans(spark, sf_dir):
    """The same through the SQL function."""
    sql.register(spark)
    _identified(spark, sf_dir).createOrReplaceTempView("lacuna_identified")
    return spark.sql("SELECT doc_id, s.text, s.type FROM lacuna_identified LATERAL VIEW explode(detect_spans(text)) t AS s")


def sql_redact(spark, sf_dir):
    sql.register(spark)
    _identified(spark, sf_dir).createOrReplaceTempView("lacuna_identified")
    return spark.sql("SELECT doc_id, r.output, r.n_edits FROM lacuna_identified, LATERAL redact(text) r")


def stream_detect(spark, sf_dir):
    """The same from files that arrive as a stream."""
    source, sink = _path(spark, "stream-in"), _path(spark, "stream-out")
    rows = _identified(spark, sf_dir)
    rows.write.parquet(source)
    found = incremental.detect_stream(spark.readStream.schema(rows.schema).parquet(source))
    found.writeStream.option("checkpointLocation", _path(spark, "stream-state")).trigger(availableNow=True).start(sink, format="parquet").awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "text", "type")


def stream_windowed_counts(spark, sf_dir):
    source, name = _path(spark, "stream-in"), f"windows_{uuid.uuid4().hex}"
    rows = _identified(spark, sf_dir).withColumn("ts", F.expr("timestamp_seconds(1924992000 + 3600 * (doc_id % 48))"))
    rows.write.parquet(source)
    counts = incremental.windowed_counts(spark.readStream.schema(rows.schema).parquet(source))
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", _path(spark, "stream-state")).queryName(name).trigger(availableNow=True).start(format="memory")
    query.awaitTermination()
    return spark.table(name).select(F.unix_timestamp("window.start").alias("begin"), "type", F.col("count").alias("mentions"))


def jsonl_gzip_round_trip(spark, sf_dir):
    path = _path(spark, "cases")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), "text").write.option("compression", "gzip").json(path)
    return files.read_cases(spark, path).select("id", "language", F.md5("text").alias("digest"))


def results_scan(spark, sf_dir):
    """Of several rows with one id in a file the last stays; rows without an id go."""
    path = _path(spark, "results")
    orders = _orders(spark, sf_dir).select("o_orderkey")
    # The rows of an order stand in one file, in their order; no file has all rows.
    rows = D.spread(orders, orders, "o_orderkey").selectExpr("CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey AS STRING) END AS id", "explode(sequence(1, CAST(o_orderkey % 3 AS INT) + 1)) AS version")
    files.append_results(rows.sortWithinPartitions("version"), path)
    return files.read_results(spark, path, "id string, version int")


def todo_resume(spark, sf_dir):
    path = _path(spark, "results")
    cases = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"))
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    files.append_results(done, path)
    return files.todo(cases, path)


def written_splits(spark, sf_dir):
    path = _path(spark, "splits")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    files.write_splits(docs.withColumn("split", generate.split_of(F.col("id"))), path)
    return spark.read.json(path).groupBy("split").agg(F.count("*").alias("cases"))


def label_tsv(spark, sf_dir):
    path = _path(spark, "labels")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS INT) AS no", "n_name AS case", "'U' AS entity", "CAST(n_regionkey AS INT) AS mentions", "'cue' AS label", "concat('er sagte \"', n_name, '\"') AS context")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path, sep="\t")
    return files.read_labels(spark, path)


def json_rows(spark, sf_dir):
    """Rows to JSON objects and back."""
    rows = _rows(spark, sf_dir).select("doc_id", "o", "text")
    return files.from_dicts(files.to_dicts(rows), rows.schema)


QUERIES = {
    f.__name__: f
    for f in (
        score_variants, free_form_variants, flagged_leaks, missed_place_labels, usage_totals, position_maps, aligned_rewrites, reader_quotes, quasi_identifiers, published_names,
        detect_identifiers, sql_detect_spans, sql_redact, stream_detect, stream_windowed_counts, jsonl_gzip_round_trip, results_scan, todo_resume, written_splits, label_tsv, json_rows,
    )
}


def oracle_sql() -> dict[str, str]:
    rows = f"WITH n AS (SELECT CAST(o_orderkey AS STRING) AS doc_id, o_orderkey AS o, {_A} AS a, {_B} AS b, {_J} AS j FROM orders), t AS (SELECT *, {TEXT} AS text FROM n) "
    digits = f"WITH d AS (SELECT o_orderkey AS doc_id, {', '.join(_DIGITS)} FROM orders) "
    marks = (("'756.' || n || '.5678.06'", "identifier"), ("'CH10 0023 0023 0023 ' || n || ' 8'", "identifier"), ("'Postfach ' || k", "address"), ("k", "parcel_number"), ("'BE ' || m", "identifier"))
    found = digits + " UNION ALL ".join(f"SELECT doc_id, {e} AS text, '{t}' AS type FROM d" for e, t in marks)
    big = lambda e, name: f"CAST({e} AS BIGINT) AS {name}"
    totals = lambda p, n: f"SELECT '{p}' AS pass, CAST(sum(o % {n}) AS DOUBLE) AS calls, CAST(sum(7 * (o % {n})) AS DOUBLE) AS prompt_tokens, CAST(sum(2 * (o % {n})) AS DOUBLE) AS completion_tokens, CAST(sum(0.5 * (o % {n})) AS DOUBLE) AS seconds FROM n"
    split = "CASE WHEN list_reduce(list_prepend(0, list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda x, c: (x * 16 + c) % 7) = 0 THEN 'dev' ELSE 'test' END"
    reason = f"'occupation{audit.KEPT[0]}B{audit.KEPT[1]}'"
    return {
        "score_variants": rows
        + f"SELECT doc_id AS id, {big('4', 'gold')}, {big('CASE WHEN o % 5 = 3 THEN 2 ELSE 0 END', 'leaked')}, {big('1', 'keep')}, {big('CASE WHEN o % 5 = 4 THEN 1 ELSE 0 END', 'keep_redacted')}, {big('CASE WHEN o % 5 = 3 THEN 1 ELSE 2 END', 'multi')}, "
        + f"{big('CASE WHEN o % 5 IN (2, 3) THEN 1 ELSE 2 END', 'consistent')}, {big('CASE WHEN o % 5 = 1 THEN 1 ELSE 0 END', 'label_collisions')}, {big('CASE WHEN o % 5 = 4 THEN length(j) ELSE 0 END', 'extra_chars')}, {big('CASE WHEN o % 5 = 3 THEN 2 ELSE 0 END', 'companies')} FROM t",
        "free_form_variants": "SELECT count(*) FILTER (o_orderkey % 3 = 0) AS edits, count(*) FILTER (o_orderkey % 3 = 0) AS decisions, count(*) FILTER (o_orderkey % 6 = 0) AS decisions_with_digits FROM orders",
        "flagged_leaks": rows + f"SELECT doc_id AS id, {big('CASE WHEN o % 2 = 0 THEN 1 ELSE 0 END', 'leaks_flagged')} FROM t",
        "missed_place_labels": rows + "SELECT CASE WHEN o % 4 = 0 THEN 'cue' ELSE 'none' END AS label, count(*) AS entities, CAST(2 * count(*) AS BIGINT) AS mentions, count(*) AS decisions FROM t WHERE o % 2 = 0 GROUP BY 1",
        "usage_totals": rows + totals("extract", 3) + " UNION ALL " + totals("audit", 2),
        "position_maps": rows + f"SELECT doc_id, CAST({A2} - length(a) + 2 - length(b) + 13 AS INT) AS there, CAST({A2} AS INT) AS back, CAST({B1} + length(b) AS INT) AS inside FROM t",
        "aligned_rewrites": rows + "SELECT doc_id, replace(text, a, 'X.') AS output, true AS ordered FROM t",
        "reader_quotes": rows + f"SELECT doc_id, CAST({B1} AS INT) AS start, CAST({B1} + length(b) AS INT) AS \"end\", b AS quote, 'reader' AS source, {big('2', 'times')} FROM t",
        "quasi_identifiers": rows + " UNION ALL ".join(f"SELECT doc_id, CAST({at} AS INT) AS start, b AS quote, 'low' AS severity, {reason} AS reason, 'quasi-identifier' AS source FROM t" for at in (B1, B2)),
        "published_names": rows + "SELECT doc_id, a || ' ' || j || '|' || j AS names FROM t",
        "detect_identifiers": found,
        "sql_detect_spans": found,
        "sql_redact": digits + "SELECT doc_id, 'Nummer […], Konto […], […], Parzelle Nr. […], Kennzeichen […].' AS output, CAST(5 AS INT) AS n_edits FROM d",
        "stream_detect": found,
        "stream_windowed_counts": digits + "SELECT CAST(1924992000 + 3600 * (doc_id % 48) AS BIGINT) AS begin, type, CAST(sum(n) AS BIGINT) AS mentions FROM (SELECT doc_id FROM d), (VALUES ('identifier', 3), ('address', 1), ('parcel_number', 1)) v(type, n) GROUP BY ALL",
        "jsonl_gzip_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, md5(text) AS digest FROM documents",
        "results_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 3 + 1 AS INT) AS version FROM orders WHERE o_orderkey % 10 <> 9",
        "todo_resume": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "written_splits": f"SELECT {split} AS split, count(*) AS cases FROM documents GROUP BY 1",
        "label_tsv": "SELECT CAST(n_nationkey AS INT) AS no, n_name AS case, 'U' AS entity, CAST(n_regionkey AS INT) AS mentions, 'cue' AS label, 'er sagte \"' || n_name || '\"' AS context FROM nation",
        "json_rows": rows + "SELECT doc_id, o, text FROM t",
    }
