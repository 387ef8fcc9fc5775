"""Matching against a plain model, and the documented examples."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from matchloom.commands import main
from matchloom.functions.attributes import FRONT, LEFT, REAR, RIGHT
from matchloom.functions.text import AZ_LOWER, AZ_UPPER, match_key, round3, similarity, words
from matchloom.functions.variants import name_variants, slash_expansion, subcategory_of
from matchloom.operators.categories import ambiguous_words, category_index, index_meta, resolve_categories, resolve_one
from matchloom.operators.funnel import answered, fold_answers, funnel
from matchloom.operators.matching import match, match_one
from matchloom.operators.near import NearIndex, near_keys
from matchloom.operators.quality import collisions, require, stale
from matchloom.plans.reports import canonical_lines, canonical_names, export, index_document
from matchloom.sources.catalogue import parse_file, parse_text
from matchloom.sources.files import read_category_index, read_report, result_json, write_results, write_text
from matchloom.streaming.phrases import match_stream
from tests.catalogues import MIRRORS, WIDGETS

TOKEN = re.compile("[0-9a-zçğıəöüşA-ZÇĞİIƏÖÜŞЀ-ӿ]+")


def key_of(text):
    return " ".join(t.translate(str.maketrans(AZ_UPPER, AZ_LOWER)).lower() for t in TOKEN.findall(text))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def alike(a, b):
    return 1.0 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


class Model:
    """A plain matcher over the collected tables of a catalogue."""

    def __init__(self, catalogue):
        self.parts = {r.part_id: r for r in catalogue.parts.collect()}
        self.members = {}
        for r in sorted(catalogue.members.collect(), key=lambda r: r.pos):
            self.members.setdefault(r.leaf_code, []).append(r.part_id)
        self.names, self.synonyms = ({} for _ in range(2))
        for index, rows, ref in ((self.names, catalogue.names, "part_id"), (self.synonyms, catalogue.synonyms, "leaf_code")):
            for r in sorted(rows.collect(), key=lambda r: (r.key_ord, r.ref_ord)):
                index.setdefault(r.key, []).append(r[ref])

    def near(self, key, index, t):
        scores = {k: alike(key, k) for k in index}
        good = {k: s for k, s in scores.items() if s >= t}
        best = max(good.values(), default=None)
        return best, [r for k, s in good.items() if s == best for r in index[k]]

    def of_leaves(self, codes):
        return [p for c in codes for p in self.members.get(c, [])]

    def match(self, phrase, raw=None, t=0.9, category=None):
        key, score = key_of(phrase), 1.0
        if key in self.names:
            ids = list(self.names[key])
            own = {self.parts[p].leaf_code for p in ids}
            ids += self.of_leaves([c for c in self.synonyms.get(key, []) if c not in own])
        elif key in self.synonyms:
            ids = self.of_leaves(self.synonyms[key])
        else:
            score, ids = self.near(key, self.names, t)
            if not ids:
                score, codes = self.near(key, self.synonyms, t)
                ids = self.of_leaves(codes)
        ids = [p for p in dict.fromkeys(ids) if category is None or self.parts[p].category == category]
        out = {"status": ["no_match", "single_match"][len(ids)] if len(ids) < 2 else "ambiguous", "ids": ids, "score": round(score, 3) if ids else None, "side": None, "position": None, "needs": []}
        if len(ids) == 1:
            said = key_of(" ".join(x for x in (phrase, raw) if x)).split()
            for name, flag, one, two in (("side", "side_flag", (LEFT, "sol"), (RIGHT, "sağ")), ("position", "position_flag", (FRONT, "ön"), (REAR, "arxa"))):
                if self.parts[ids[0]][flag]:
                    found = ",".join(w for names, w in (one, two) if set(said) & set(names))
                    out[name] = found or None
                    out["needs"] += [] if found else [name]
        return out


@pytest.fixture(scope="module")
def mirrors(spark):
    return parse_text(spark, MIRRORS).persist()


@pytest.fixture(scope="module")
def widgets(spark):
    return parse_text(spark, WIDGETS).persist()


def flat(result):
    ids = [result["part_id"]] if result["part_id"] else [c["part_id"] for c in result["candidates"]]
    return {"status": result["status"], "ids": ids, "score": result["match_score"], "side": result["attributes"]["side"], "position": result["attributes"]["position"], "needs": result["needs_clarification"]}


def test_catalogue_tables(mirrors):
    parts = {r.part_id: r for r in mirrors.parts.collect()}
    assert "ZZ-999" not in parts and parts["AS-016"].name_az == "Traves yeni" and parts["AS-016"].leaf_code == "kz-lamp"
    assert parts["LO-001"].category == "" and parts["KZ-006"].category == "Кузов и оптика"
    leaves = {r.leaf_code: r for r in mirrors.leaves.collect()}
    assert leaves["kz-mirror"].subcategory == "Güzgülər / Kənar" and leaves["as-hub"].subcategory == "Stupisa (toplar) / podşipniklər"
    assert [r.line for r in mirrors.rejects.orderBy("line_no").collect()] == [x for x in MIRRORS.split("\n") if "ZZ-999" in x or "orphan word" in x or "nothing" in x]
    keys = [r.key for r in mirrors.synonyms.orderBy("key_ord", "ref_ord").collect()]
    assert keys == ["güzgü", "emblema", "fara dəsti", "kabel fara", "traves", "emblema logo", "loqo"]


def test_inline_example(widgets):
    assert flat(match_one(widgets, "widget"))["ids"] == ["XX-001", "XX-002", "XX-003"]
    assert flat(match_one(widgets, "alfa"))["ids"] == ["XX-001"]
    assert flat(match_one(widgets, "beta"))["ids"] == ["XX-002"]
    assert flat(match_one(widgets, "beta syn"))["ids"] == ["XX-002", "XX-003"]
    none = match_one(widgets, "gama")
    assert none["status"] == "no_match" and "match_score" not in none
    assert match_one(widgets, "gama", threshold=0.8)["part_id"] == "XX-003"
    assert [tuple(r) for r in collisions(widgets).collect()] == [("widget", ["XX-001"], ["grp-b"])]
    with pytest.raises(ValueError):
        require(collisions(widgets), "collisions")


def test_against_the_model(spark, mirrors, widgets):
    rng = random.Random(6)
    for catalogue in (mirrors, widgets):
        model = Model(catalogue)
        keys = [*model.names, *model.synonyms]
        rows = []
        for k in range(160):
            text = rng.choice(keys)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(["", "a", "ü", " "]) + text[at + rng.randint(0, 1) :]
            raw = rng.choice([None, "", "sol ön", "SAĞ tərəf", "right, back", "RIGHT on ədəd", "слева сзади справа"])
            rows.append((k, rng.choice([text, text.upper(), f"({text})."]), raw, rng.choice([0.9, 0.9, 0.8, 0.75, 1.0, 0.0, -1.0]), rng.choice([None, None, "Подвеска", "Кузов и оптика", ""])))
        rows += [(900, "", None, 0.9, None), (901, "", None, 0.0, None), (902, "?!", "x", 0.5, None)]
        df = spark.createDataFrame(rows, "qid long, phrase string, raw_text string, threshold double, restrict_category string")
        got = {r.qid: r.result.asDict(recursive=True) for r in match(df, catalogue).collect()}
        for qid, *row in rows:
            assert flat(got[qid]) == model.match(*row), row
    odd = match(spark.createDataFrame([(1, None), (1, "beta")], "qid long, phrase string"), widgets).collect()
    assert sorted(r.result.status for r in odd) == ["no_match", "single_match"]
    assert match(df.limit(0), mirrors).count() == 0


def test_examples(mirrors):
    assert flat(match_one(mirrors, "traves"))["ids"] == ["AS-016", "AS-017"]
    assert match_one(mirrors, "yan güzgü")["needs_clarification"] == ["side"]
    hub = match_one(mirrors, "stupitsa podsipniki", "sol qabaq")
    assert hub["part_id"] == "AS-007" and hub["attributes"] == {"side": "sol", "position": "ön"} and 0.9 <= hub["match_score"] < 1
    assert match_one(mirrors, "stupitsa podsipniki", threshold=1.0)["status"] == "no_match"
    assert match_one(mirrors, "Stupitsa podşipniki", "on ədəd")["needs_clarification"] == ["side", "position"]
    for text in ("güzgü korpusu", "güzgü qapağı", "крышка зеркала", "Корпус зеркала"):
        assert match_one(mirrors, text)["part_id"] == "KZ-022"
    # the restriction comes after the tier: the exact name of another category is not passed over
    assert match_one(mirrors, "Yan güzgü", restrict_category="Подвеска")["status"] == "no_match"


def test_text_functions(spark):
    rng = random.Random(2)
    letters = "aIİıəƏçÇşğü ЁёЖa9.,/-é K"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["Radiator.", "(fara)", "sol/sağ, ön!", "😀a"]
    pairs = list(zip(texts, reversed(texts)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", match_key(F.col("a")).alias("key"), similarity(F.col("a"), F.col("b")).alias("s"), words(F.col("a")).alias("w"))
    for r in df.collect():
        assert r.key == key_of(r.a) and r.s == alike(r.a, r.b) and " ".join(r.w) == r.key


def test_rounding_is_exact(spark):
    rows = [(1.0 - d / n,) for n in range(1, 401) for d in range(n) if 1.0 - d / n >= 0.001]
    got = spark.createDataFrame(rows, "s double").select("s", round3(F.col("s")).alias("r")).collect()
    assert all(r.r == round(r.s, 3) for r in got)


def test_variants(spark):
    names = ["Turbo (nadduv) datçiki", "EVAP sistemi/klapanı (yanacaq kömürü)", "A/B", "Güzgü korpusu / qapağı", "a/b c/d e/f g/h", "a/b/c/d/e c/d/e/f", "x (p/q) (r) ()", " /a b", "a//b c", "plain"]
    want = {
        "Turbo (nadduv) datçiki": {"Turbo (nadduv) datçiki", "nadduv"},
        "EVAP sistemi/klapanı (yanacaq kömürü)": {"EVAP sistemi/klapanı (yanacaq kömürü)", "yanacaq kömürü", "EVAP sistemi", "EVAP klapanı"},
        "A/B": {"A/B"},
        "Güzgü korpusu / qapağı": {"Güzgü korpusu / qapağı", "Güzgü korpusu", "Güzgü qapağı"},
        "a/b c/d e/f g/h": {"a/b c/d e/f g/h", *map(" ".join, itertools.product("ab", "cd", "ef", "gh"))},
        "a/b/c/d/e c/d/e/f": {"a/b/c/d/e c/d/e/f"},
        "x (p/q) (r) ()": {"x (p/q) (r) ()", "p/q", "p", "q", "r"},
        " /a b": {"/a b"},
        "a//b c": {"a//b c", "a c", "b c"},
        "plain": {"plain"},
    }
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", name_variants(F.col("n")).alias("v"), slash_expansion(F.col("n")).alias("s")).collect():
        assert set(r.v) == want[r.n] and r.v == sorted(r.v) and set(r.s) <= want[r.n]
    leaves = {"Stupisa (toplar) / podşipniklər / Ступицы/подшипники": "Stupisa (toplar) / podşipniklər", "🆕 Bir": "Bir", "Только": "Только", "A / Б / C": "A / Б / C", "A / Б / В": "A"}
    for r in spark.createDataFrame([(n,) for n in leaves], "n string").select("n", subcategory_of(F.col("n")).alias("s")).collect():
        assert r.s == leaves[r.n]


def test_categories(spark, mirrors):
    index = category_index(mirrors).persist()
    assert resolve_one(index, "Güzgü.") == {"status": "category_resolved", "category": "Кузов и оптика", "raw_text_passthrough": "Güzgü.", "match_score": 1.0}
    both = resolve_one(index, "emblema", "emblema lazımdır")
    assert both["status"] == "category_resolved" and both["raw_text_passthrough"] == "emblema lazımdır"
    inside = resolve_one(index, "kabel", "")
    assert inside == {"status": "category_ambiguous", "candidates": ["Кузов и оптика"], "question": "К какой категории относится деталь?", "raw_text_passthrough": "kabel", "matched_by": "containment"}
    assert resolve_one(index, "tr")["status"] == "category_unknown" and resolve_one(index, "zzznotaword")["status"] == "category_unknown"
    assert resolve_one(index, "travess", threshold=0.8)["match_score"] == 0.857
    assert resolve_one(index, "raves")["candidates"] == ["Кузов и оптика", "Подвеска"]
    assert index_meta(index).first().total_words == index.select("key").distinct().count()
    # the old names of a part that is defined again count for its new leaf
    assert ambiguous_words(index).count() == 0 and index.filter("key = 'подрамник'").first().category == "Кузов и оптика"
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "güzgü")], "qid long, word string")
    assert sorted(r.result.status for r in resolve_categories(rows, index).collect()) == ["category_resolved", "category_unknown", "category_unknown"]


def test_funnel(spark, mirrors):
    index = category_index(mirrors)
    rows = spark.createDataFrame([(1, "traves", None), (2, "kabel", None), (3, "fara", "sol"), (4, "yan güzgü", "sol"), (5, "qwertyuiop", None)], "qid long, phrase string, raw_text string")
    got = {r.qid: r for r in funnel(rows, mirrors, index).collect()}
    assert [got[k].next_question for k in range(1, 6)] == ["none", "category", "category", "none", "none"]
    assert got[4].result.attributes.side == "sol" and got[5].category_result.status == "category_unknown"
    answers = [("s", 1, "cat", "Подвеска"), ("s", 2, "part", "AS-017"), ("t", 1, "cat", "x"), ("t", 2, "restart", None), ("u", 1, "part", "p"), ("u", 2, "side", "sol"), ("u", 3, "cat", "c")]
    state = fold_answers(spark.createDataFrame(answers, "session string, step int, event string, value string"))
    held = {r.session: (r.category, r.part_id, r.side) for r in state.collect()}
    assert held == {"s": ("Подвеска", "AS-017", None), "t": (None, None, None), "u": ("c", None, None)}
    asked = answered(spark.createDataFrame([(1, "traves", "s")], "qid long, phrase string, session string"), mirrors, state, index).first()
    assert asked.chosen == "AS-017" and asked.next_question == "none"
    answers = [("b", 1, "cat", "Кузов и оптика"), ("c", 1, "cat-other", None), ("d", 1, "part-other", None), ("e", 1, "part-other", None), ("e", 2, "part", "AS-016")]
    state = fold_answers(spark.createDataFrame(answers, "session string, step int, event string, value string"))
    said = [(1, "raves", "a"), (2, "raves", "b"), (3, "raves", "c"), (4, "traves", "d"), (5, "traves", "e"), (6, "yan güzgü", "x")]
    asked = {r.qid: r for r in answered(spark.createDataFrame(said, "qid long, phrase string, session string"), mirrors, state, index).collect()}
    assert [asked[k].next_question for k in range(1, 7)] == ["category", "none", "none", "phrase", "none", "side"]
    assert asked[2].restrict_category == "Кузов и оптика" and asked[3].restrict_category is None and asked[5].chosen == "AS-017"


def test_reports_and_files(spark, mirrors, tmp_path):
    rows = canonical_names(mirrors).collect()
    assert [r.category for r in rows if r.heading] == ["", "Кузов и оптика", "Подвеска"]
    lines = [r.line for r in canonical_lines(mirrors).collect()]
    assert lines[3] == "> 8 parts · 5 leaves." and lines[-1] == "| AS-017 | Traves arxa |" and "### Güzgülər / Kənar" in lines
    write_text(canonical_lines(mirrors), f"file://{tmp_path}/report")
    back = read_report(spark, f"file://{tmp_path}/report")
    assert [(r.part_id, r.name_az) for r in back.orderBy("part_ord").collect()] == [(r.part_id, r.name_az) for r in rows]
    index = category_index(mirrors)
    (tmp_path / "index.json").write_text(index_document(index).first().value, encoding="utf-8")
    again = read_category_index(spark, f"file://{tmp_path}/index.json")
    assert not stale(again, index) and stale(again.limit(1), index)
    data = json.loads(export(mirrors).first().value)
    assert data["parts"]["KZ-020"]["side"] is True and data["synonym_index"]["emblema"] == ["kz-mirror"]
    assert list(data["groups"]) == ["no-cat", "kz-mirror", "kz-lamp", "as-hub", "as-traves"]
    results = match(spark.createDataFrame([(1, "yan güzgü"), (2, "none at all")], "qid long, phrase string"), mirrors)
    texts = [json.loads(r[0]) for r in results.orderBy("qid").select(result_json(F.col("result"))).collect()]
    assert texts[0]["match_score"] == 1.0 and "match_score" not in texts[1] and texts[1]["part_id"] is None
    write_results(results, f"file://{tmp_path}/results")
    assert spark.read.json(f"file://{tmp_path}/results").count() == 2
    (tmp_path / "catalogue.txt").write_text(MIRRORS, encoding="utf-8")
    assert parse_file(spark, f"file://{tmp_path}/catalogue.txt").parts.count() == mirrors.parts.count() == 8


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text(MIRRORS, encoding="utf-8")
    (tmp_path / "w.txt").write_text(WIDGETS, encoding="utf-8")
    at = ["--dict", f"file://{tmp_path}/c.txt"]
    assert main(["yan güzgü", "--raw", "sol", *at]) == 0 and json.loads(capsys.readouterr().out)["attributes"]["side"] == "sol"
    assert main(["audit", *at]) == 0 and main(["audit", "--dict", f"file://{tmp_path}/w.txt"]) == 1
    for name in ("names", "index"):
        out = [name, *at, "--out", str(tmp_path / name)]
        assert main([*out, "--check"]) == 1 and main(out) == 0 and main([*out, "--check"]) == 0
        text = (tmp_path / name).read_bytes()
        assert text.endswith(b"\n") and not text.endswith(b"\n\n")
        (tmp_path / name).write_bytes(text[:-1])
        assert main([*out, "--check"]) == 1
    assert (tmp_path / "index").read_text().startswith('{\n "index": {\n  "')
    back = read_category_index(spark, f"file://{tmp_path}/index")
    assert not stale(back, category_index(parse_file(spark, at[1])))


def test_nothing_stays_persisted(spark, mirrors):
    rows = spark.createDataFrame([(1, "fara"), (2, "farra dest")], "qid long, phrase string")
    held = []
    for _ in range(3):
        match(rows, mirrors).collect()
        resolve_categories(rows.withColumnRenamed("phrase", "word"), category_index(mirrors)).collect()
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
    assert held[0] == held[2]


def test_near_keys_against_all_pairs(spark):
    rng = random.Random(11)
    letters = "abcdeü"
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(300)})
    asked = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) if rng.random() < 0.3 else rng.choice(keys)[rng.randint(0, 2) :] + rng.choice(["", "a", "bb"]), rng.choice([0.9, 0.8, 0.7, 0.55, 0.3, 1.0, 0.0])) for _ in range(150)]
    pairs = spark.createDataFrame(sorted(set(asked)), "key string, threshold double")
    index = spark.createDataFrame([(k, n, 3 + n % 2) for n, k in enumerate(keys)], "key string, key_ord int, tier int")
    got = {}
    for r in near_keys(pairs, NearIndex(index)).collect():
        got.setdefault((r.key, r.threshold), set()).add((r.tier, r.score, r.found))
    for key, t in set(asked):
        hits = [(3 + n % 2, alike(key, k), k) for n, k in enumerate(keys) if alike(key, k) >= t]
        best = min(((tier, -score) for tier, score, _ in hits), default=None)
        assert got.get((key, t), set()) == {h for h in hits if (h[0], -h[1]) == best}


def test_stream(spark, mirrors, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qid": 1, "phrase": "traves"}\n{"qid": 2, "phrase": "yan güzgü"}\n', encoding="utf-8")
    seen = []
    stream = spark.readStream.schema("qid long, phrase string").json(f"file://{tmp_path}/in")
    query = match_stream(stream, mirrors, lambda out, n: seen.extend((n, r.qid, r.result.status) for r in out.collect()), f"file://{tmp_path}/at")
    assert query.awaitTermination(90)
    assert sorted(seen) == [(0, 1, "ambiguous"), (0, 2, "single_match")]
