"""What keeps queries in proportion to their input: a decision is dealt with in one row, and nothing of it is written or
shuffled on the way."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402
from lacuna.functions import document, patterns as P, sql  # noqa: E402
from lacuna.plans import decisions  # noqa: E402
from lacuna.session import shared_dir  # noqa: E402
from lacuna.sources import files  # noqa: E402

#: Queries and the shuffles of their plans: the rows are spread by doc_id, and some are counted afterwards.
SHUFFLES = {
    "redact_bger": 1,
    "generate_cases": 1,
    "audit_risks": 2,
    "entity_summary": 2,
    "free_form_edits": 2,
    "kept_spans": 1,
    "placeholder_letters": 1,
    "redact_zh": 1,
    "score_cases": 1,
    "residence_cue_rule": 2,
    "review_zh": 1,
    "score_rollup": 3,
    "screen_quotes": 1,
    "labeler_recorded": 3,
    "detect_patterns": 1,
    "entities_bger": 1,
    "classify_placeholders": 1,
    "resolve_types": 1,
    "keep_names": 1,
    "type_votes": 1,
    "audit_case_numbers": 1,
    "score_variants": 2,
    "reader_quotes": 5,
    # others
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    orders = spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"))
    orders.write.parquet(f"{folder}/orders.parquet")
    spark.range(7).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SHUFFLES)
def test_a_decision_is_dealt_with_in_one_row(spark, tables, name):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = __spark_entry__.queries()[name](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|Single)", plan)) <= SHUFFLES[name], plan
    assert df.count() > 0 and set(os.listdir(folder)) == before


def test_patterns_are_found_where_they_can_match_and_nowhere_else():
    parts = (
        "756.1234.5678.90", "CH10 0023 0023 0023 4567 8", "a.b@c.d-e.ch", "@x@y.z.ch", "+41 78 902 13 31", "0041 (0)78 9021331", "079 123 45 67", "Amselgasse 7", "ABweg 1 Cweg 2", "weg",
        "Mattenweg  14a", ", 4901 Birkenwil", "\n", ", ", "Rue de la Paix 3", "Via Roma 12", "Postfach 12", "Parzelle Nr. 2'345", "Kennzeichen BE 654 321", "0", " ", "str.\t5", "é", "_", "CH-3011 Bern\n",
    )
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        assert document.identifiers(text) == sql.scan(text), text


def test_names_are_found_as_by_their_pattern():
    draw = random.Random(5)
    for _ in range(10_000):
        text = "".join(draw.choice(("Ahorner", "s", "’s", "'s", " ", "\n", "A.", "B", "_", "x", "Edda Felber", "é")) for _ in range(draw.randint(1, 8)))
        for name in ("Ahorner", "A. B", "", "s", "Edda Felber"):
            for suffix in ("", P.GENITIVE):
                rx = r"(?<!\w)" + r"\s+".join(map(re.escape, name.split())) + suffix + r"(?!\w)"
                assert document.find(text, name, bool(suffix)) == [m.span() for m in re.finditer(rx, text)], (text, name)


def test_parts_grow_with_the_orders(spark, tables, monkeypatch):
    monkeypatch.setattr(decisions, "PART_ROWS", 5)
    assert __spark_entry__.queries()["type_votes"](spark, tables).rdd.getNumPartitions() >= 12
    monkeypatch.setattr(decisions, "PART_ROWS", 1000)
    assert __spark_entry__.queries()["type_votes"](spark, tables).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_results_are_in_many_files_and_parts(spark, tables, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 100)
    df = __spark_entry__.queries()["results_scan"](spark, tables)
    assert len(df.inputFiles()) > 1 and df.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, df.collect())) == sorted((str(k), k % 3 + 1) for k in range(60) if k % 10 != 9)
