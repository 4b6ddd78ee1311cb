import json
import sys

from lacuna import __main__ as cli
from test_score import PUBLISHED


def run(monkeypatch, spark, *args):
    monkeypatch.setattr(cli, "get_session", lambda *a: spark)
    monkeypatch.setattr(sys, "argv", ["lacuna", *args])
    cli.main()


def test_build_then_bench_then_nothing_left(spark, tmp_path, monkeypatch):
    sources = tmp_path / "sources.jsonl"
    sources.write_text("\n".join(json.dumps({"decision_id": f"t{k}", "language": "de", "full_text": PUBLISHED}) for k in range(9)))
    cases, out = str(tmp_path / "cases"), str(tmp_path / "results")
    run(monkeypatch, spark, "build", str(sources), "--out", cases)
    for _ in range(2):  # the second run finds all of them done
        run(monkeypatch, spark, "bench", f"{cases}/split=dev,{cases}/split=test", "--out", out)
        assert spark.read.json(out).select("id").count() == 9
    rows = {r.scope: r for r in spark.read.json(out + ".summary").collect()}
    assert rows["all"].cases == rows["de"].cases == 9 and rows["fr"].cases == 0 and 0 < rows["all"].recall < 0.3


def test_redact_texts(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("Mail an a.b@post.example.ch bitte.")
    run(monkeypatch, spark, "redact", str(tmp_path / "a.txt"), "--out", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().output == "Mail an […] bitte."
