"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, langid, line_dedup, minhash, mixing, mpeg_audio, ranked_search, reference_parse, suffix_dedup, token_counts, token_output
from .storage import read, scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def public_file(name: str) -> str:
    """The place of a public tokenizer's file; its package is only needed by the queries that read one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_bpe() -> str:
    return public_file("piece_bpe_32k.model")


def word_bpe() -> str:
    return public_file("word_bpe_49k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search_benchmark(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op1_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, k, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item, k, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
starts AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM p, sizes WHERE i + n - 1 <= len(w)),
occ AS (SELECT s.doc_id, s.i, s.n, x.item, x.k FROM starts s JOIN windows x ON x.n = s.n AND x.win = s.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, k, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.taken(read(spark, sf_dir, "documents"))


ORACLES["op2_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS mixed FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS r FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             CAST(coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped,
             CAST(sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM o),
l AS (SELECT arg_min((total - stopped) / rest, r) FILTER (WHERE 3 * source_size >= (total - stopped) / rest * w) AS lev FROM c),
t AS (SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), lev * w), 0.0) AS target FROM c, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mixed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
slices AS (SELECT source, no, quota, least(CAST(sum(quota) OVER (ORDER BY no) AS UHUGEINT) * 18446744073709551616::UHUGEINT // CAST(sum(quota) OVER () AS UHUGEINT), 18446744073709551615::UHUGEINT) AS high,
                  coalesce(CAST(sum(quota) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS UHUGEINT) * 18446744073709551616::UHUGEINT // CAST(sum(quota) OVER () AS UHUGEINT), 0::UHUGEINT) AS low
           FROM (SELECT source, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no, CAST(floor(target) AS BIGINT) AS quota FROM t) WHERE (SELECT sum(floor(target)) FROM t) > 0),
n AS (SELECT CAST(sum(quota) AS BIGINT) // 8192 AS slots FROM slices),
points AS (SELECT i, (CAST(i AS UHUGEINT) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS point FROM (SELECT unnest(generate_series(0, slots - 1)) AS i FROM n)),
drawn AS (SELECT i AS slot, source, no, quota, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rank FROM points JOIN slices ON point >= low AND (point < high OR no = (SELECT max(no) FROM slices))),
had AS (SELECT s.source, s.no, CAST(ceil(quota / 8192) AS BIGINT) AS need, (SELECT count(*) FROM drawn d WHERE d.no = s.no) AS had FROM slices s),
left_open AS (SELECT source, no, unnest(generate_series(had, need - 1)) AS rank FROM had WHERE need > had),
planned AS (SELECT source, rank, slot FROM drawn WHERE rank * 8192 < quota
            UNION ALL SELECT source, rank, row_number() OVER (ORDER BY rank, no) - 1 + (SELECT slots FROM n) FROM left_open),
g AS (SELECT p.*, d.source, CASE WHEN p.size > 0 THEN (quota // p.source_size) * p.size + greatest(0, least(start + p.size, quota % p.source_size) - start) ELSE 0 END AS taken,
             CASE WHEN start < quota % p.source_size THEN quota // p.source_size ELSE quota // p.source_size - 1 END AS lap FROM p JOIN d USING (doc_id)),
e AS (SELECT *, start // 8192 AS first_rank, (least(lap * source_size + start + size, quota) - 1) // 8192 AS last_rank FROM g)
SELECT doc_id, e.size, source_size, target, taken, CASE WHEN taken > 0 THEN a.slot END AS first_slot, CASE WHEN taken > 0 THEN z.slot END AS last_slot
FROM e LEFT JOIN planned a ON a.source IS NOT DISTINCT FROM e.source AND a.rank = first_rank LEFT JOIN planned z ON z.source IS NOT DISTINCT FROM e.source AND z.rank = last_rank
"""


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its output holds when read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT).alias("role"), F.lit(hard).alias("text"))
    done = chat.format_conversations(rows.unionByName(hard)).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "exact",
    )


ORACLES["op3_chat_formatting"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN regexp_matches(text, '###|</turn>|\\\\') THEN regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') ELSE text END AS body,
             replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\;') AS head FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars, TRUE AS exact
FROM e GROUP BY conv_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), word_bpe())


def language_model(docs: DataFrame) -> langid.Model | None:
    """A model of the labelled documents outside the held-out quarter."""
    return langid.fit(docs.filter(_quarter() != 2), piece_bpe())


def _quarter() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that five documents or more hold."""
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id < g.keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CAST(gone AS INT)), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them."""
    docs = read(spark, sf_dir, "documents")
    kept = docs.select("doc_id", "text", (_quarter() == 2).alias("held_out"))
    return langid.predict(kept, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG audio stream, and what the stored stream holds."""
    stored, _ = written(mpeg_audio.encode(read(spark, sf_dir, "documents")), "media")
    return mpeg_audio.probe(stored)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classes(minhash.near_duplicates(read(spark, sf_dir, "documents")))


# all pairs of texts by the shingles they share, and the connected components of those alike
ORACLES["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (SELECT DISTINCT id, CASE WHEN len(w) = 0 THEN 'text ' || text ELSE 'words ' || array_to_string(w[i : i + 4], ' ') END AS shingle FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.8),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
every AS (SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN t USING (text) LEFT JOIN class USING (id))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM every
"""


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that are found elsewhere."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


# all windows of 200 bytes, as pieces of hexadecimal text
ORACLES["op9_suffix_array_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, 1000 * k AS base, substr(h, 2000 * k + 1, 2398) AS part FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2000)) AS k FROM d)),
w AS (SELECT r, base + j AS i, md5(substr(part, 2 * j + 1, 400)) AS win FROM (SELECT *, unnest(generate_series(0, least(999, length(part) // 2 - 200))) AS j FROM p WHERE length(part) >= 400)),
hit AS (SELECT r, i FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)),
step AS (SELECT r, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY r ORDER BY i)),
run AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM step) GROUP BY r, k),
cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run),
kept AS (SELECT d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k, sum(z - a) AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as directly addressable codes, and read back."""
    path = scratch(spark, "tokens")
    token_output.write_tokens(read(spark, sf_dir, "documents"), path, word_bpe())
    return token_output.read_tokens(spark, path)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, read(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
stat AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT k, item_id, term, count(*) AS times FROM b GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, stat GROUP BY term),
s AS (SELECT k, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)))) AS BIGINT) AS score FROM asked JOIN p USING (term) JOIN df USING (term), stat GROUP BY k, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words or more that an earlier document holds."""
    return reference_parse.remove_repeated_passages(read(spark, sf_dir, "documents")).drop("kept")


# all windows of 13 words
ORACLES["op12_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS j FROM win JOIN first USING (h) WHERE least < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector."""
    done = centroids.cluster(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Assignments and centroids round by round, over rows of single components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (SELECT vec_id, c, dist FROM (SELECT vec_id, c, CAST(sum((e.q - m.q) * (e.q - m.q)) AS BIGINT) AS dist FROM e JOIN m{k} m USING (j) GROUP BY vec_id, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT c, j, CAST(sum(q) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN e USING (vec_id) GROUP BY c, j),
m{k + 1} AS (SELECT c, j, CASE WHEN n IS NULL THEN q ELSE (s - ((s % n) + n) % n) // n END AS q FROM m{k} LEFT JOIN s{k} USING (c, j))""")
    return ",".join(steps)


ORACLES["op13_centroid_clustering"] = f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS q FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept QUALIFY c < 16),
m0 AS (SELECT c, j, q FROM seeds JOIN e USING (vec_id)),{_rounds_sql(3)},
digest AS (SELECT c, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN digest USING (c)
"""


QUERIES["op1_benchmark_decontamination"] = op1_benchmark_decontamination
QUERIES["op2_source_mix"] = op2_source_mix
QUERIES["op3_chat_formatting"] = op3_chat_formatting
QUERIES["op4_token_counts"] = op4_token_counts
QUERIES["op5_line_dedup"] = op5_line_dedup
QUERIES["op6_language_id"] = op6_language_id
QUERIES["op7_mpeg_audio"] = op7_mpeg_audio
QUERIES["op8_minhash_near_dedup"] = op8_minhash_near_dedup
QUERIES["op9_suffix_array_dedup"] = op9_suffix_array_dedup
QUERIES["op10_token_output"] = op10_token_output
QUERIES["op11_ranked_search"] = op11_ranked_search
QUERIES["op12_substring_dedup"] = op12_substring_dedup
QUERIES["op13_centroid_clustering"] = op13_centroid_clustering
