import hashlib

from pyspark.sql import functions as F

from fixtures import MENTIONS, TEXT, documents, mentions
from lacuna.operators import audit, generate, labeler, score
from lacuna.plans.review import anonymize, review
from lacuna.sources import files
from lacuna.streaming.incremental import redact_stream

PUBLISHED = (
    "Mitwirkend:\nOberrichter Milaner, Vorsitz,\nGerichtsschreiberin Reiher.\nVerfahrensbeteiligte\nA.________,\n"
    "Kläger,\nvertreten durch Rechtsanwalt Xaver Schwaner,\nund\nB.________ AG, mit Sitz in U.________,\n"
    "Beklagte.\nA.________ wohnt in U.________ und klagt gegen die B.________ AG."
)
EDITS = "array<struct<start:int,end:int,replacement:string>>"


def test_generate_and_score(spark):
    rows = spark.createDataFrame([("t1", "de", PUBLISHED), ("none", "de", "kein Platzhalter"), ("en", "en", "A.________")], "doc_id string, language string, text string")
    cases = generate.generate(rows).cache()
    case = cases.first()
    assert cases.count() == 1 and sorted({g.kind for g in case.gold}) == ["address", "company", "person", "place"]
    assert len(case.gold) == 7 and all(case.text[g.start : g.end] == g.text for g in case.gold)
    assert {k.text: k["count"] for k in case.keep} == {"Milaner": 1, "Reiher": 1, "Xaver Schwaner": 1}
    assert case.split == ("dev" if int(hashlib.sha256(b"t1").hexdigest(), 16) % 7 == 0 else "test")
    named = cases.withColumnRenamed("doc_id", "id")
    perfect = spark.createDataFrame([("t1", case.text, [(g.start, g.end, "X") for g in case.gold])], f"id string, output string, edits {EDITS}")
    nothing = spark.createDataFrame([("t1", case.text, [])], f"id string, output string, edits {EDITS}")
    best, worst = score.score(named, perfect), score.score(named, nothing)
    row = best.first()
    assert (row.leaked, row.gold, row.keep, row.keep_redacted, row.extra_chars, row.multi, row.consistent, row.label_collisions) == (0, 7, 3, 0, 0, 3, 3, 2)
    assert worst.first().leaked == 7 and worst.first().leaked_by_kind == worst.first().gold_by_kind
    total = score.aggregate(best).first()
    assert (total.cases, total.recall, total.zero_leak_cases, total.consistency) == (1, 1.0, 1.0, 1.0)
    scopes = {r.scope: r for r in score.rollup(worst).collect()}
    assert (scopes["all"].recall, scopes["de"].cases, scopes["fr"].cases, scopes["it"].recall, scopes["fr"].consistency) == (0.0, 1, 0, 1.0, 0.0)
    assert score.missed_places(named, nothing).first().mentions == 2
    rule = score.residence_rule(named, nothing).first()
    assert (rule.gold, rule.leaked, rule.recovered, rule.extra) == (7, 7, 2, 0)
    assert {r.kind: r.recall for r in score.recall_by_kind(worst).collect()} == dict.fromkeys(("person", "company", "place", "address"), 0.0)
    assert generate.build_report(cases).first()[1:] == (1, 7, 3)


def test_free_form(spark):
    cases = spark.createDataFrame([("x", "A met Edda Felber. on 3 May", [(6, 17, "Edda Felber", "A", "person")])], f"id string, text string, gold {files.GOLD}")
    edits = [(6, 17, "anybody"), (0, 1, "B.________"), (22, 23, "4"), (5, 6, " "), (17, 17, " […] ")]
    results = spark.createDataFrame([("x", edits)], f"id string, edits {EDITS}")
    assert [e.start for e in score.free_form(cases, results).first().edits] == [22]
    assert tuple(score.free_form_totals(cases, results).first()) == (1, 1, 1)


def test_review_and_audit(spark):
    text = TEXT + "Nach dem Beschluss ZK.2031.00456 der Vorinstanz und dem Urteil 4A_301/2031 ist er Töpfer. keramik Ahorner-Keramik"
    docs = documents(spark, [("d", text)])
    named = mentions(spark, [("d", [*MENTIONS, ("Töpfer", "occupation", "")])])
    quotes = spark.createDataFrame(
        [("d", "A.________ und Dorothea Kranichner", "low", "r", "reader"), ("d", "Begehren dringt nicht durch", "low", "r", "reader"), ("d", "nicht im Text Oha", "low", "r", "reader")],
        "doc_id string, quote string, severity string, reason string, source string",
    )
    row = review(docs, named, "bger-2020", quotes).first()
    found = {(r.quote, r.severity, r.source) for r in row.risks}
    assert ("ZK.2031.00456", "medium", "cross-instance") in found and ("Töpfer", "low", "quasi-identifier") in found
    assert ("Ahorner", "high", "leftover") not in {(q, s, x) for q, s, x in found if q == "Alwin"}
    assert not any(q.startswith("4A_301") for q, *_ in found)
    assert ("Begehren dringt nicht durch", "low", "reader") in found and not any("Kranichner" in q for q, *_ in found)
    assert row.language == "de" and not row.social_insurance and row.guard_ok
    assert [e.label for e in row.entities if e.label][:2] == ["A.________", "U.________"] and row.risks == sorted(row.risks, key=lambda r: (r.start, -r.end))


def test_flagged_leaks_map_positions(spark):
    cases = spark.createDataFrame([("x", [(10, 14, "Leak", "A", "person"), (0, 4, "Hans", "B", "person")])], f"id string, gold {files.GOLD}")
    results = spark.createDataFrame([("x", [(0, 4, "A.________")])], f"id string, edits {EDITS}")
    risks = spark.createDataFrame([("x", 16, 20)], "doc_id string, start int, end int")
    assert score.flagged_leaks(cases, results, risks).first().leaks_flagged == 1
    assert score.flagged_leaks(cases, results, risks.where("start = 0")).first().leaks_flagged == 0


def test_labeler(spark):
    assert labeler.salvage_items('{"mentions": [{"a": 1}, {"b": 2}, {"c"') == [{"a": 1}, {"b": 2}] and labeler.salvage_items("none") == []

    def fake(pass_, part, language, context):
        if "overlong" in part:
            raise labeler.LabelerError("max_tokens", '{"m": [{"mention": "Z", "role": "", "type": "place"}, {"men')
        if "broken" in part:
            raise labeler.LabelerError("no reply")
        return [{"mention": w, "role": context[:3], "type": "private_person"} for w in part.split() if w[:1].isupper()]

    docs = spark.createDataFrame([(1, "de", "Hans und\nPeter gehen"), (2, "de", "overlong Text"), (3, "de", "broken")], "doc_id long, language string, text string")
    rows = {(r.doc_id, r.mention, r.role, r.error) for r in labeler.extract(docs, fake, 12).collect()}
    assert rows == {(1, "Hans", "", None), (1, "Peter", "- H", None), (2, "Z", "", None), (3, None, None, "no reply")} | ({(2, "Text", "- Z", None)} & rows)
    rewritten = spark.createDataFrame([("d", 0, 0, "Hans geht.", "A. geht."), ("d", 1, 10, " Ja 3.", "<<< Ja 4.>>>")], "doc_id string, chunk_no int, start int, part string, new string")
    out = labeler.align(rewritten).first()
    assert out.output == "A. geht. Ja 4." or out.output == "A. geht.Ja 4."
    assert any(e.replacement == "4" for e in out.edits)


def test_anonymize_with_sweep(spark):
    docs = documents(spark, [("d", "Edda Felber klagt gegen Gero Holder. Der Richter Falko Milaner entschied.")])
    labels = spark.createDataFrame([("d", 0, "Edda Felber", "", "private_person")], "doc_id string, seq long, mention string, role string, type string")
    sweep = spark.createDataFrame([("d", 0, "Gero Holder", "party", "private_person"), ("d", 1, "Falko Milaner", "x", "private_person"), ("d", 2, "Edda Felber", "x", "private_person")], "doc_id string, seq long, name string, reason string, type string")
    found, applied = anonymize(docs, labels, sweep=sweep)
    assert applied.first().output == "A.________ klagt gegen B.________. Der Richter Falko Milaner entschied."
    assert {(m.text, m.source) for m in found.collect()} == {("Edda Felber", "labeler"), ("Gero Holder", "sweep")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Guten Tag\nWelt")
    assert tuple(files.read_texts(spark, str(tmp_path / "a.txt")).first()) == ("a", "Guten Tag\nWelt", "", "")
    (tmp_path / "b.json").write_text('{"text":\n "x", "language": "fr"}')
    assert tuple(files.read_documents(spark, str(tmp_path / "b.json")).first()) == ("b", "x", "fr", "")
    (tmp_path / "l.tsv").write_text('no\tcase\tentity\tmentions\tlabel\tcontext\n1\tc\tU\t2\tcue\t"er sagte ""ja"""\n')
    assert files.read_labels(spark, str(tmp_path / "l.tsv")).first().context == 'er sagte "ja"'
    cases = spark.createDataFrame([("a", "dev"), ("b", "test"), ("c", "test")], "id string, split string")
    assert files.todo(cases, str(tmp_path / "out")).count() == 3
    files.append_results(spark.createDataFrame([("a", None), ("b", "failed")], "id string, error string"), str(tmp_path / "out"))
    assert [r.id for r in files.todo(cases, str(tmp_path / "out")).collect()] == ["c"]
    files.write_splits(cases, str(tmp_path / "splits"))
    assert files.read_cases(spark, str(tmp_path / "splits/split=test")).count() == 2


def test_stream_redacts_new_files_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for text in ("Mail an a.b@post.example.ch bitte.", "Nichts zu tun."):
        documents(spark, [("d" + str(len(text)), text)]).write.mode("append").parquet(source)
        redact_stream(spark, source, sink, state).awaitTermination()
    rows = spark.read.parquet(sink).select("output").collect()
    assert sorted(r.output for r in rows) == ["Mail an […] bitte.", "Nichts zu tun."]


def test_sample_per_language(spark):
    rows = [(f"c{k}", "de" if k % 2 else "fr", "x" * (16000 if k == 3 else 5)) for k in range(12)]
    got = generate.sample_per_language(spark.createDataFrame(rows, "doc_id string, language string, text string"), 2).orderBy("place").collect()
    key = lambda i: hashlib.sha256(i.encode()).hexdigest()
    expected = [i for lang in ("de", "fr") for i in sorted((i for i, x, t in rows if x == lang and len(t) < 15001), key=key)[:2]]
    assert [r.doc_id for r in got] == expected
