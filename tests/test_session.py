"""The public surface, SQL functions, and whole index documents."""

import json

import matchloom
from matchloom.commands import main
from matchloom.plans.reports import index_text
from matchloom.sources.files import read_index
from tests.catalogues import MIRRORS


def test_public_names(spark, tmp_path):
    assert all(getattr(matchloom, name) is not None for name in matchloom.__all__) and not hasattr(matchloom, "nothing")
    (tmp_path / "c.txt").write_text(MIRRORS, encoding="utf-8")
    matcher = matchloom.Matcher.from_file(spark, f"file://{tmp_path}/c.txt")
    assert matcher.match("traves")["status"] == "ambiguous" and matcher.match("yan güzgü", "sol")["attributes"]["side"] == "sol"
    rows = spark.createDataFrame([(1, "yan güzgü")], "qid long, phrase string")
    assert matcher.match(rows).first().result.part_id == matcher.match("yan güzgü")["part_id"] == "KZ-020"
    words = matchloom.CategoryMatcher.from_catalogue(matcher.catalogue)
    assert words.resolve("güzgü")["category"] == "Кузов и оптика"
    assert words.resolve(rows.withColumnRenamed("phrase", "word")).first().result.status == "category_resolved"
    matcher.close()
    words.close()


def test_category_command(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text(MIRRORS, encoding="utf-8")
    at = ["--dict", f"file://{tmp_path}/c.txt"]
    assert main(["index", *at, "--out", str(tmp_path / "index.json")]) == 0
    capsys.readouterr()
    for where in (at, ["--index", f"file://{tmp_path}/index.json"]):
        assert main(["category", "kabel", "--raw", "kabel lazımdır", *where]) == 0
        got = json.loads(capsys.readouterr().out)
        assert got["status"] == "category_ambiguous" and got["matched_by"] == "containment" and got["raw_text_passthrough"] == "kabel lazımdır"


def test_index_document_is_checked(spark, tmp_path):
    catalogue = matchloom.parse_text(spark, MIRRORS.replace("синонимы: traves, emblema (logo, loqo)", "синонимы: traves, güzgü"))
    text = index_text(matchloom.category_index(catalogue))
    (tmp_path / "whole.json").write_text(text, encoding="utf-8")
    whole = read_index(spark, f"file://{tmp_path}/whole.json")
    held = json.loads(text)
    assert sorted(map(tuple, whole.ambiguous.collect())) == [("güzgü", "Кузов и оптика"), ("güzgü", "Подвеска")]
    assert {(r.key, r.category) for r in whole.index.collect()} == {(k, c) for k, cs in held["index"].items() for c in cs}
    assert whole.meta.first().total_words == len(held["index"]) and whole.mismatches().count() == 0
    held["meta"]["total_words"] += 1
    held["ambiguous_words"] = {"fara": ["Кузов и оптика"]}
    (tmp_path / "wrong.json").write_text(json.dumps(held), encoding="utf-8")
    wrong = {(r.what, r.said, r.found) for r in read_index(spark, f"file://{tmp_path}/wrong.json").mismatches().collect()}
    n = len(held["index"])
    assert wrong == {("total_words", str(n + 1), str(n)), ("ambiguous_words: fara", "Кузов и оптика", None), ("ambiguous_words: güzgü", None, "Кузов и оптика"), ("ambiguous_words: güzgü", None, "Подвеска")}
    (tmp_path / "bare.json").write_text('{"index": {"a": ["x"]}}', encoding="utf-8")
    bare = read_index(spark, f"file://{tmp_path}/bare.json")
    assert [tuple(r) for r in bare.index.collect()] == [("a", "x")] and bare.ambiguous.count() == 0


def test_sql_functions(spark):
    matchloom.register(spark, matchloom.parse_text(spark, MIRRORS))
    one = spark.sql("SELECT match_key('  SAĞ, İki!') AS k, words_of('Sol / ön') AS w, similarity_of('güzgü', 'guzgu') AS s, side_of('soldan, RIGHT right') AS side, position_of('nothing') AS p, similarity_of('', '') AS e").first()
    assert tuple(one) == ("sağ iki", ["sol", "ön"], 1 - 2 / 5, "sol,sağ", None, 1.0)
    spark.createDataFrame([(1, "Güzgü."), (2, "traves arxa"), (3, "none")], "qid long, phrase string").createOrReplaceTempView("asked")
    rows = spark.sql("SELECT qid, e.part_id, e.tier, c.category FROM asked LEFT JOIN LATERAL exact_parts(phrase) e LEFT JOIN LATERAL exact_categories(phrase) c ORDER BY qid, e.at")
    assert [tuple(r) for r in rows.collect()] == [(1, "KZ-020", 2, "Кузов и оптика"), (1, "KZ-022", 2, "Кузов и оптика"), (2, "AS-017", 1, "Подвеска"), (3, None, None, None)]
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()
