import pytest

from mnemospark.sources import bundles, python_code, transcripts


def test_bad_lines_are_told_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","turn":1,"text":"hi"}\nnot json\n{"type":"assistant","turn":2}\n')
    good, bad = transcripts.json_lines(spark, str(tmp_path))
    assert sorted(r.turn for r in good.collect()) == [1, 2]
    assert [r.value for r in bad.collect()] == ["not json"]


def test_message_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"role": "user", "content": "a"},\n {"role": "assistant", "content": "b"}]')
    assert [(r.turn, r.role, r.text) for r in transcripts.message_lists(spark, str(tmp_path)).orderBy("turn").collect()] == [(0, "user", "a"), (1, "assistant", "b")]


def test_identifiers(spark):
    assert transcripts.identifier("table_1") == "table_1"
    for name in ("a b", "1a", "a;drop", ""):
        with pytest.raises(ValueError):
            transcripts.identifier(name)
    with pytest.raises(ValueError):
        transcripts.jdbc(spark, "http://x", "t", "id", 0, 1, 1)


def test_outline():
    found = python_code.outline("class A:\n    def f(self):\n        return g(self)\n\ndef g(x):\n    return x\n")
    assert [(n, k, p) for n, k, _, _, p, _ in found] == [("A", "class", ""), ("f", "function", "A"), ("g", "function", "")]
    assert found[1][5] == "g,self" and python_code.outline("def (") == []


def test_directories_are_scanned_and_compared(spark, tmp_path):
    for name, text in {"a.py": "1", "sub/b.py": "2", ".git/c": "3", "sub/node_modules/x/d.js": "4", "e.md": "5"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    before = spark.createDataFrame(bundles.directory(spark, str(tmp_path)).collect())
    assert sorted(r.path for r in before.collect()) == ["a.py", "e.md", "sub/b.py"]
    (tmp_path / "a.py").write_text("changed")
    (tmp_path / "e.md").unlink()
    (tmp_path / "new.txt").write_text("n")
    got = {r.path: r.change for r in bundles.changes(before, bundles.directory(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a.py": "modified", "e.md": "deleted", "new.txt": "added"}


def test_bundles_keep_everything_and_refuse_other_versions(spark, tmp_path):
    a = spark.createDataFrame([("1", "n", "é\n\x00 {}"), ("2", "n", "")], "artifact_id string, namespace string, content string")
    m = spark.createDataFrame([(7, "n", "fact", 3)], "memory_id long, namespace string, text string, confirmations long")
    bundles.export_bundle(a, m, str(tmp_path / "out"))
    got = sorted((r.kind, r.id, r.content, r.confirmations) for r in bundles.import_bundle(spark, str(tmp_path / "out")).collect())
    assert got == [("artifact", "1", "é\n\x00 {}", None), ("artifact", "2", "", None), ("memory", "7", "fact", 3)]
    for line in ('{"format_version":1,"kind":"memory","id":"1"}', '{"format_version":2,"kind":"other"}', "no json"):
        (tmp_path / "bad.jsonl").write_text(line + "\n")
        with pytest.raises(Exception, match="not a line of a bundle"):
            bundles.import_bundle(spark, str(tmp_path / "bad.jsonl")).collect()
