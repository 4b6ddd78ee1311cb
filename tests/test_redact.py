import pytest
from fixtures import MENTIONS, TEXT, documents, mentions
from pyspark.sql import functions as F

from lacuna.functions import spans
from lacuna.operators import detect, redact
from lacuna.plans.rules import available_packs, letters, load_pack


SECOND = TEXT.index("Birkenwil", TEXT.index("Gemeinde"))


def run(spark, pack, text=TEXT, labelled=MENTIONS):
    docs = documents(spark, [("d", text)])
    found = detect.union_mentions(mentions(spark, [("d", labelled)]), detect.pattern_mentions(docs))
    ents, applied = redact.redact(docs, found, load_pack(pack), strict=True)
    return docs, ents, applied, applied.first()


@pytest.fixture(scope="module")
def federal(spark):
    return run(spark, "bger-2020")


def test_federal_rules(federal):
    row = federal[3]
    written = [
        ("Alwin Ahorner", "A.________"), ("Amselgasse 7, 4901 Birkenwil", "[…]"), ("Ahorner Keramik", "B.________"), ("Birkenwil", "U.________"),
        ("Birkenwil", "U.________"), ("Ahorner", "A.________"), ("Ahorner Keramik", "B.________"), ("Ahorners", "A.________"),
    ]
    expected, at = [], 0
    for name, label in written:
        at = TEXT.index(name, at)
        expected.append((at, at + len(name), name, label))
        at += len(name)
    assert [(e.start, e.end, e.original, e.replacement) for e in row.edits] == expected
    assert row.guard_ok and all(e.basis for e in row.edits)
    for name in ("Falkner", "Storcher", "Dorothea Kranichner", "Mattenweg 14, 3011 Bern", "B.________ AG", "Gemeinde U.________"):
        assert name in row.output
    assert {e.replacement for e in row.edits if e.type == "private_person"} == {"A.________"}


def test_zurich_rules_differ(spark):
    row = run(spark, "zh-entscheide-2025")[3]
    assert len(row.edits) == 11
    assert "Kranichner" not in row.output and "A.," in row.output and "Gerichtsschreiber B.\n" in row.output
    assert [e.replacement for e in row.edits][:4] == ["A.", "B", "C.", "[…]"]
    assert "Mattenweg 14" in row.output


def test_address_follows_its_owner(spark):
    text = "Gemeinde Birkenwil, Drosselweg 22, 4902 Birkenwil,\nBeklagte.\n"
    named = [("Gemeinde Birkenwil", "public_body", "Beklagte")]
    for pack, kept in (("bger-2020", True), ("zh-entscheide-2025", False)):
        assert ("Drosselweg 22" in run(spark, pack, text, named)[3].output) is kept


def test_guard_catches_changes(spark, federal):
    changed = federal[2].withColumn("changed", F.replace("output", F.lit("Streitsache"), F.lit("Streitsachen")))
    row = changed.select(spans.untouched(F.col("text"), F.col("output"), F.col("edits")).alias("a"), spans.untouched(F.col("text"), F.col("changed"), F.col("edits")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_kept_and_summary(spark, federal):
    docs, ents, applied, row = federal
    kept = redact.kept_spans(docs, ents, applied)
    spots = [TEXT[k.start : k.end] for k in kept.first().kept]
    assert spots == ["Falkner", "Storcher", "Dorothea Kranichner", "Finanzdirektion des Kantons Bern", "Mattenweg 14, 3011 Bern"]
    rows = redact.summary(ents, applied, kept).orderBy("place").collect()
    assert [(r.label, r.type, r["count"]) for r in rows][2] == ("A.________", "private_person", 3)
    assert rows[2]["names"] == ["Alwin Ahorner", "A. Ahorner", "Ahorner"]


def test_positions_map_both_ways(federal):
    row = federal[2].select(
        spans.to_output(F.lit(SECOND), F.col("edits")).alias("there"), spans.to_original(spans.to_output(F.lit(SECOND), F.col("edits")), F.col("edits")).alias("back"), "output"
    ).first()
    assert row.output[row.there :].startswith("U.________") and row.back == SECOND


def test_letters_and_packs():
    people, places = letters("ABCDEFGHIJKLMNOPQRST", ""), letters("UVWXYZ", "ABCDEFGHIJKLMNOPQRST")
    assert people[19:28] == list("TUVWXYZ") + ["AA", "AB"] and places[:8] == list("UVWXYZ") + ["AA", "AB"]
    assert available_packs() == ["bger-2020", "zh-entscheide-2025"]
    with pytest.raises(KeyError):
        load_pack("no-such-pack")


def test_expert_in_social_insurance(spark):
    text = "Die IV-Stelle beauftragte Gero Holder mit einem Gutachten."
    out = run(spark, "bger-2020", text, [("Gero Holder", "expert", "expert")])[3]
    assert "Gero Holder" not in out.output and out.edits[0].basis == "Art. 6 Abs. 2"
    assert "Gero Holder" in run(spark, "bger-2020", text.replace("IV-Stelle", "Behörde"), [("Gero Holder", "expert", "expert")])[3].output
