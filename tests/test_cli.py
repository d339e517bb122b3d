"""Every command, end to end, on small files."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.sources import readers


@pytest.fixture(scope="module")
def hooks():
    """Stand-ins for models, importable by name."""
    own = types.ModuleType("cli_hooks")
    own.back = lambda: lambda texts: ["a cow has 12 legs" if "༡༢" in t else "a cow" for t in texts]
    own.ways = lambda s, t: lambda texts: [x.upper() for x in texts]
    own.encode = lambda s, t: lambda src, tgt: ([[len(w) for w in x.split()] for x in src], [[1] for _ in tgt])
    own.broken = lambda: 1 / 0
    sys.modules["cli_hooks"] = own
    yield own
    del sys.modules["cli_hooks"]


def run(*argv):
    cli.main([str(x) for x in argv])


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def test_prepare_and_training_set(spark, tmp_path, hooks, capsys):
    rows = [f"དཀར་{i} ནང,row {i}" for i in range(8)] + ["དཀར་0 ནང,row 0", "ཁ,leak", "ཁ,x", "ག,y"]
    write_lines(tmp_path / "c.csv", ["dz,en", *rows])
    write_lines(tmp_path / "m", ["ནང"])
    run("prepare", "--csv", tmp_path / "c.csv", "--sizes", "train=10", "validation=1", "test=1", "--out", tmp_path / "d", "--markers", tmp_path / "m")
    made = spark.read.parquet(str(tmp_path / "d"))
    assert {r.split: r["count"] for r in made.groupBy("split").count().collect()} == {"train": 16, "validation": 2, "test": 2}
    assert "དཀར་0།" not in made.first().src and json.loads(spark.read.text(str(tmp_path / "d-manifest")).first()[0])["preprocessing"]["boundary_marker_count"] == 1
    assert '"leaked": 1, "dup": 1' in capsys.readouterr().out
    with pytest.raises(ValueError):
        run("prepare", "--csv", tmp_path / "c.csv", "--sizes", "train=1", "--out", tmp_path / "x")
    made.where("split = 'test'").drop("split").write.parquet(str(tmp_path / "extra"))
    run("training-set", "--data", tmp_path / "d", "--extra-data", tmp_path / "extra", "--out", tmp_path / "t", "--tokenizer", "cli_hooks:encode", "--max-length", 2, "--eval-subset", 1)
    out = spark.read.parquet(str(tmp_path / "t"))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 18, "validation": 1, "test": 2}
    assert out.where(F.size("input_ids") > 2).isEmpty() and out.where("input_ids is null or labels is null").isEmpty()


def test_respace(spark, tmp_path, capsys):
    write_lines(tmp_path / "mono", ["ཀ་ ནང་ ཁ།"] * 10)
    run("respace", "learn", "--mono", tmp_path / "mono", "--out", tmp_path / "m", "--min-count", 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["ཀ", "ནང"]
    run("respace", "validate", "--mono", tmp_path / "mono", "--markers", tmp_path / "m")
    assert '"lines": 3, "boundaries": 6, "recovered": 6, "missed": 0, "exact": 3, "recall": 1.0' in capsys.readouterr().out


def test_monolingual(spark, tmp_path, capsys):
    text = "ཀ་ཁ་ག་ང་༡།ཀ།"
    rows = [("http://bbs.bt/a", 0.9, text), ("http://bbs.bt/b", 0.9, text), ("http://rfa.org", 0.9, text), ("http://bbs.bt/c", None, text)]
    spark.createDataFrame(rows, "url string, og_language_score double, og_full_text string").write.parquet(str(tmp_path / "docs"))
    run("monolingual", "--docs", tmp_path / "docs", "--out", tmp_path / "o", "--max-syllables", 9)
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["ཀ་ཁ་ག་ང་༡།"]
    out = capsys.readouterr().out
    assert '"sentences": 1, "with_numeral": 1' in out and '"reject_reason": "blocked", "n": 1' in out


def test_terms(spark, tmp_path, capsys):
    write_lines(tmp_path / "c.csv", ["dz,en", *["བ་ མང་,the cow and many more words", "བ་,a cow"] * 4, "ཏ་,a horse"])
    write_lines(tmp_path / "seeds", ["# seeds", "animals\tcow", "animals\tyak"])
    run("terms", "discover", "--csv", tmp_path / "c.csv", "--seeds", tmp_path / "seeds", "--out", tmp_path / "draft")
    assert readers.read_tsv(spark, str(tmp_path / "draft"), ["category", "en", "dz"], 3).first().category == "animals"
    run("terms", "discover", "--csv", tmp_path / "c.csv", "--out", tmp_path / "own")
    assert [r.en for r in readers.read_tsv(spark, str(tmp_path / "own"), ["category", "en", "dz"], 3).collect()] == ["cow"]
    run("term-tables", "--csv", tmp_path / "c.csv", "--seeds", tmp_path / "seeds", "--out", tmp_path / "tables")
    assert '"category": "animals", "high": 1, "medium": 0, "low": 0, "missing": 1' in capsys.readouterr().out
    write_lines(tmp_path / "t.tsv", ["animals\tcow\tབ་", "animals\thorse\tཏ་\tརྟ་", "animals\tyak\tགཡག་"])
    run("terms", "check", "--csv", tmp_path / "c.csv", "--terms", tmp_path / "t.tsv")
    out = capsys.readouterr().out
    assert "\nREADY" in out and '"kind": "none", "category": "animals", "term": "yak", "carriers": 0' in out
    write_lines(tmp_path / "p.tsv", ["good day\tབདེ་"])
    run("terms", "build", "--csv", tmp_path / "c.csv", "--terms", tmp_path / "t.tsv", "--phrases", tmp_path / "p.tsv", "--out", tmp_path / "b", "--cross-per-term", 1)
    out = capsys.readouterr().out
    assert '"counter": "phrase", "n": 8' in out and '"counter": "terms_without_carrier", "n": 1' in out and '"counter": "kept", "n": 9' in out
    assert spark.read.parquet(str(tmp_path / "b")).where("src = 'Cow' AND tgt = 'བ་'").count() == 6
    write_lines(tmp_path / "bad.tsv", ["animals\tcow\tcow"])
    run("terms", "check", "--csv", tmp_path / "c.csv", "--terms", tmp_path / "bad.tsv")
    assert "NOT READY" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("terms", "build", "--csv", tmp_path / "c.csv", "--terms", tmp_path / "bad.tsv", "--out", tmp_path / "x")


def test_backtranslate(spark, tmp_path, hooks, capsys):
    write_lines(tmp_path / "mono", ["བ་ ལུ་ ༡༢", "བ་ ༣", "ཀ་ ཁ་"])
    run("backtranslate", "--translator", "cli_hooks:back", "--mono", tmp_path / "mono", "--out", tmp_path / "o")
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(rows) == 7 and all(r.src.startswith("<bt> ") for r in rows)
    run("backtranslate", "--translator", "cli_hooks:back", "--mono", tmp_path / "mono", "--out", tmp_path / "p", "--limit", 1, "--no-tag", "--digit-aug", 0)
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [("a cow has 12 legs", "བ་ ལུ་ ༡༢")]


def test_evaluate_and_translate(spark, tmp_path, hooks, capsys):
    spark.createDataFrame([("ཀ ༡", "ABC DEF 1 X")], "sentence_dzo_Tibt string, sentence_eng_Latn string").write.parquet(str(tmp_path / "b"))
    run("evaluate", "--translator", "cli_hooks:ways", "--benchmark", tmp_path / "b", "--out", tmp_path / "m", "--tokenizer", "syllables=cli_hooks:broken")
    own = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect()))
    assert own["dzo2eng"]["bleu_tokenizer"] == "13a" and own["eng2dzo"]["n"] == 1
    for lang, text in (("dzo_Tibt", "ཀ"), ("eng_Latn", "a")):
        spark.createDataFrame([(1, text)], "id int, text string").write.parquet(str(tmp_path / "l" / lang))
    run("evaluate", "--translator", "cli_hooks:ways", "--benchmark", tmp_path / "l", "--limit", 1)
    assert "per language" in capsys.readouterr().out
    run("translate", "--translator", "cli_hooks:ways", "--direction", "en2dz", "give 2", "x")
    out = capsys.readouterr().out
    assert '"src": "give 2", "hyp": "GIVE 2"' in out and '"n": 1, "kept": 1' in out
