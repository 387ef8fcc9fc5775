"""Written token ids against the library, and codes against the ids they hold."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm.queries import public_file, word_bpe
from matchloom.llm.token_output import Codes, encoder, pack, read_tokens, splits_alike, token_at, tokens_at, write_tokens


def test_tokens_equal_the_library(spark, sf_dir, tmp_path):
    texts = ["Plain Text's don't 12", "", None, "東京 <|endoftext|> é̃ ½ İ", "ÀÖ ß ŁÓDŹ", "tab\tnew\nline  ", "a" * 3000, "привет Мир", "\x00\x1c!!\x85x", "ה שׁ! x"]
    rows = [(k % 7 if k < 9 else None, t) for k, t in enumerate(texts)] + [(3, "same"), (3, "same")]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, salt string")
    path = f"file://{tmp_path}/tokens"
    write_tokens(df, path, word_bpe())
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    model = Tokenizer.from_file(word_bpe())
    ids = {t: model.encode(t or "", add_special_tokens=False).ids + [1] for t in [*texts, "same"]}
    want = Counter((d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: -1 if d is None else d)
    assert token_at(spark, path, at - 1) == 1
    empty = f"file://{tmp_path}/none"
    write_tokens(df.limit(0), empty, word_bpe())
    assert read_tokens(spark, empty).count() == 0
    assert encoder(word_bpe()).encode("the the").tolist() == model.encode("the the", add_special_tokens=False).ids


def test_codes_give_any_token():
    rng = np.random.default_rng(1)
    for n, most in ((0, 5), (1, 5), (1, 2**32), (511, 300), (512, 70_000), (5000, 2**32)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        codes = Codes(pack(ids))
        assert len(codes) == n and codes.all().tolist() == ids.tolist()
        for k in rng.integers(0, n, 60) if n else ():
            assert codes[int(k)] == ids[k]


def test_another_tokenizer_file(spark, sf_dir, tmp_path):
    path = public_file("byte_bpe_50k.json")
    assert splits_alike(word_bpe()) and not splits_alike(path)
    texts = ["Plain Text's  don't 12\n\n", "", "x" * 500, "東京 é"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect()]
    model = Tokenizer.from_file(path)
    for text, ids in zip(texts, encoder(path).encode_many([t or "" for t in texts])):
        assert ids.tolist() == model.encode(text or "", add_special_tokens=False).ids
    at = f"file://{tmp_path}/other"
    write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), at, path, end_id=50256)
    want = {k: zlib.crc32(np.array(model.encode(t or "", add_special_tokens=False).ids + [50256], "<u4").tobytes()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in read_tokens(spark, at).collect()} == want


def test_one_id_reads_one_page(spark, tmp_path):
    """Bytes that the file system gives for one id, of files of several megabytes that are not compressed."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6000))) for _ in range(300)]
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, word_bpe())
    ids = [x for t in texts for x in [*encoder(word_bpe()).encode(t).tolist(), 1]]
    files = [x for x in (tmp_path / "tokens").iterdir() if x.suffix == ".parquet"]
    size = sum(x.stat().st_size for x in files)
    assert size > 1.9 * len(ids)
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    read = lambda: stats.getLong("bytesRead")
    at = [0, len(ids) - 1, *rng.sample(range(len(ids)), 6)]
    token_at(spark, path, 5)
    before = read()
    tokens_at(spark, path, [])
    base = read() - before
    before = read()
    assert tokens_at(spark, path, at) == [ids[k] for k in at]
    assert (read() - before - base) / len(at) < 0.1 * size
    for wrong in (-1, len(ids)):
        with pytest.raises(IndexError):
            token_at(spark, path, wrong)
