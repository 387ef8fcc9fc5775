"""The catalogue's parse: splits, files, line ends, against a plain reading of the grammar."""

import random
import re

import pytest

from matchloom.sources.catalogue import MARKER, classified, parse, parse_file, parse_text, parse_texts, read_lines, text_lines
from matchloom.sources.datasource import read_catalogue, write_catalogue
from matchloom.sources.deltas import Store
from tests.catalogues import MIRRORS, WIDGETS


def told(text):
    """line_no, kind, category and leaf_code of one text, line by line."""
    inside, category, leaf, out = False, "", None, []
    for n, line in enumerate(text.splitlines()):
        if MARKER in line:
            inside = True
            continue
        if not inside:
            continue
        kind = None
        if m := re.match(r"#{6,}\s*(.+?)\s*#{6,}\s*$", line):
            kind, category, leaf = "category", m[1].replace("🆕", "").strip(), None
        elif m := re.match(r"\s*▸\s*(.+?)\s*\[([a-z0-9-]+)\]", line):
            kind, leaf = "leaf", m[2]
        elif re.match(r"\s*[A-Z]{2,3}-\d+\s+.+?\s+\|\s+.+?\s+\[side:(true|false)\|position:(true|false)\]\s*$", line):
            kind = "part"
        elif re.match(r"\s*синонимы:\s*.+$", line):
            kind = "synonyms"
        out.append((n, kind, category, leaf))
    return out


def text_of(seed, n=120):
    rng = random.Random(seed)
    lines = [rng.choice(["intro", "▸ No [no]", "###### No ######"]) for _ in range(rng.randint(0, 9))] + [f"x {MARKER} x"]
    for k in range(n):
        lines.append(rng.choice([f"###### Cat {k % 5} 🆕 ######", f"▸ Leaf {k} / Лист [l-{k % 7}] (1)", f"  AB-{k % 9}  Раз {k} | Bir {k}  [side:true|position:false]", f" синонимы: a{k}, , b", "junk", "", f"again {MARKER}"] + [f"  CD-{k}  Два | Iki  [side:false|position:true]"] * 4))
    return lines


@pytest.mark.parametrize("split", [1, 3, 10_000])
def test_splits_carry_headings(spark, split):
    texts = ["\n".join(text_of(k)) for k in range(4)] + ["", "no section\n▸ A [a]"]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, value string")
    got = {}
    for r in classified(text_lines(df), split).collect():
        assert r.place == (r.file << 32) + r.line_no
        got.setdefault(r.file, []).append((r.line_no, r.kind, r.category, r.leaf_code))
    for file, text in enumerate(texts):
        seen = [x for x in sorted(got.get(file, []), key=lambda x: x[0]) if x[0] < len(text.splitlines())]
        assert seen == told(text)


def test_no_window_takes_all_lines(spark):
    plan = classified(text_lines(spark.createDataFrame([(0, MIRRORS)], "file long, value string")))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x85", " "])
def test_files_are_read_in_splits(spark, tmp_path, end):
    texts = [end.join(text_of(k, 300)) + end * (k % 2) for k in range(3)]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_lines(spark, f"file://{tmp_path}")
        if end == "\n":
            assert lines.select("line").rdd.getNumPartitions() >= 1 and spark.read.text(f"file://{tmp_path}", lineSep="\n").rdd.getNumPartitions() > 10
        got = {}
        for r in lines.collect():
            got.setdefault(r.file, {})[r.line_no] = r.line
        for k, text in enumerate(texts):
            want = dict(enumerate(text.splitlines()))
            assert {n: x for n, x in got[k].items() if n in want} == want and set(got[k].values()) <= {*want.values(), ""}
        whole, split = parse_texts(spark.createDataFrame(list(enumerate(texts)), "file long, value string")), parse_file(spark, f"file://{tmp_path}")
        for one, other in zip((whole.parts, whole.names, whole.synonyms, whole.leaves), (split.parts, split.names, split.synonyms, split.leaves)):
            assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr) != []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_several_texts_keep_their_sections_apart(spark):
    both = parse_texts(spark.createDataFrame([(1, WIDGETS), (0, MIRRORS), (2, "  ZZ-100  A | B  [side:true|position:true]")], "file long, value string"))
    one, other = parse_text(spark, MIRRORS), parse_text(spark, WIDGETS)
    assert {r.part_id for r in both.parts.collect()} == {r.part_id for c in (one, other) for r in c.parts.collect()}
    order = [r.part_id for r in both.parts.orderBy("part_ord").collect()]
    assert order.index("XX-001") > order.index("AS-017")
    assert parse(text_lines(spark.createDataFrame([], "file long, value string"))).parts.count() == 0


def test_deltas_equal_one_parse(spark, tmp_path):
    rng = random.Random(3)
    store, texts = Store(spark, f"file://{tmp_path}/store"), {}
    assert store.catalogue().parts.count() == 0
    for n in range(4):
        delta = {k: None if rng.random() < 0.3 else "\n".join(text_of(10 * n + k, 40)) for k in rng.sample(range(4), 2)}
        real = store.ledger.enter
        if n == 2:  # lost before it is entered: nothing has changed, and it can be applied again
            store.ledger.enter = lambda version: None
            store.apply(spark.createDataFrame(list(delta.items()), "file long, value string"))
            store.ledger.enter = real
            assert store.versions() == [0, 1]
        assert store.apply(spark.createDataFrame(list(delta.items()), "file long, value string")) == n
        texts |= delta
        whole = parse_texts(spark.createDataFrame([(k, t) for k, t in texts.items() if t is not None], "file long, value string"))
        got = store.catalogue()
        for name in ("parts", "leaves", "members", "names", "synonyms", "rejects"):
            one, other = getattr(whole, name), getattr(got, name)
            assert sorted(map(tuple, one.select(sorted(one.columns)).collect()), key=repr) == sorted(map(tuple, other.select(sorted(other.columns)).collect()), key=repr), name


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_data_source(spark, tmp_path, split):
    texts = ["\n".join(text_of(k, 60)) + end for k, end in enumerate(["", "\n", "\r\nx\x85y z\r"])]
    (tmp_path / "in").mkdir()
    for k, text in enumerate(texts):
        (tmp_path / "in" / f"{k}.txt").write_bytes(text.encode())
    got = {}
    for r in read_catalogue(spark, f"file://{tmp_path}/in", split).collect():
        got.setdefault(r.file, []).append((r.line_no, r.line))
    for k, text in enumerate(texts):
        assert [x for _, x in sorted(got[k])] == text.splitlines()
    lines = text_lines(spark.createDataFrame([(0, texts[0])], "file long, value string"))
    for parts in (5, 1):  # the second one takes the place of the first
        write_catalogue(lines, f"file://{tmp_path}/out", parts)
        (tmp_path / "out" / "lost-1-1.part").write_text("▸ Lost [lost]")  # of a writer that never committed
        back = parse(read_catalogue(spark, f"file://{tmp_path}/out", max(split, 1000)))
        whole = parse(lines)
        for name, columns in (("parts", ["part_id", "name_az", "category", "leaf_code", "side_flag"]), ("names", ["key", "part_id"]), ("synonyms", ["key", "leaf_code"]), ("rejects", ["line"])):
            assert sorted(map(tuple, getattr(back, name).select(columns).collect()), key=repr) == sorted(map(tuple, getattr(whole, name).select(columns).collect()), key=repr) != []
        assert [r.part_id for r in back.parts.orderBy("part_ord").collect()] == [r.part_id for r in whole.parts.orderBy("part_ord").collect()]
    with pytest.raises(Exception, match="is there already"):
        lines.select("file", "line_no", "line").coalesce(1).write.format("catalogue").mode("append").save(f"file://{tmp_path}/out")
