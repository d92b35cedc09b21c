"""The registered queries of these operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, exactdup, lines, lm, neardup, quality, search, sharding, spelling, substrings, versions, warc
from tideline.llm.common import table

#: The least score of a document that is kept.
GOOD = 0.3


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    made = sharding.shard(table(spark, folder, "documents").select("doc_id", "text"), 8)
    return made.select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        F.col("grown").alias("grown_shard"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    made = neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc.doc_id", "class_id", "class_size", "n_links", "kept")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    made = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return made.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    made = substrings.remove_repeated(table(spark, folder, "documents"))
    return made.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    made = warc.deduplicated(table(spark, folder, "pages"))
    return made.select(
        F.col("source").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("origin").cast("long").alias("refers_to"),
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    made = lines.drop_recurring_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), sha256(F.col("text")).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    made = bpe.encode(table(spark, folder, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op9_recurrent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return versions.edited_versions(table(spark, folder, "documents"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_ngram_jaccard_join, op3_quality_classifier, op4_decontamination, op5_substring_dedup, op6_warc,
        op7_line_dedup, op8_bpe, op9_recurrent_scores, op10_exact_dedup, op11_spelling_variants, op12_document_fingerprints,
        op13_ranked_search,
    )
}
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: CRC-32 of half a byte, by the rule of its polynomial.
NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ 0xEDB88320 * (_c & 1)
    NIBBLES[_i] = _c
RUNS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{6,}')"
#: A SHA-1 in hexadecimal (h) in base 32: five hexadecimal digits are four digits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '')"""
ORACLES: dict[str, str] = {
    # the generator's states as hugeint; a text's CRC-32 goes by half bytes, the lower one first
    "op1_sharding": f"""
        WITH RECURSIVE hexed AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        halves AS (
            SELECT doc_id, size, list_transform(range(0, strlen(h)), lambda i: CAST(instr('0123456789ABCDEF', substr(h, CAST(xor(i, 1) + 1 AS BIGINT), 1)) - 1 AS BIGINT)) AS halves
            FROM hexed
        ),
        summed AS (
            SELECT doc_id, size, xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), halves), lambda c, b: xor(c >> 4, CAST({NIBBLES} AS BIGINT[])[(xor(c, b) & 15) + 1])
            )) AS crc FROM halves
        ),
        jumps AS (
            SELECT doc_id, CAST(doc_id AS HUGEINT) AS state, CAST(0 AS BIGINT) AS reach, CAST(0 AS BIGINT) AS at8, CAST(0 AS BIGINT) AS at9 FROM documents
            UNION ALL
            SELECT doc_id, (state * 2862933555777941757 + 1) % 18446744073709551616,
                CAST(floor((reach + 1) * (2147483648.0::DOUBLE / (CAST(((state * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS BIGINT),
                CASE WHEN reach < 8 THEN reach ELSE at8 END, CASE WHEN reach < 9 THEN reach ELSE at9 END
            FROM jumps WHERE reach < 9
        ),
        landed AS (SELECT doc_id, CAST(at8 AS INTEGER) AS shard, CAST(at9 AS INTEGER) AS grown_shard FROM jumps WHERE reach >= 9),
        spread AS (
            SELECT *, ((CAST(xor(doc_id, crc) AS HUGEINT) * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS spread
            FROM summed JOIN landed USING (doc_id)
        )
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY spread, doc_id, crc, size) - 1 AS slot, grown_shard FROM spread
    """,
    # a word goes if one of the 35 windows that end at it or behind it starts elsewhere too
    "op5_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
        cells AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM docs),
        windows AS (
            SELECT doc_id, words[place] AS word, place,
                CASE WHEN place + 34 <= len(words) THEN array_to_string(words[place:place + 34], ' ') END AS run FROM cells
        ),
        runs AS (SELECT run, count(*) AS n FROM windows WHERE run IS NOT NULL GROUP BY run),
        marked AS (SELECT doc_id, word, place, coalesce(n, 0) > 1 AS again FROM windows LEFT JOIN runs USING (run)),
        covered AS (
            SELECT doc_id, word, place, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
            FROM marked
        ),
        kept AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS text
            FROM covered GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
    "op6_warc": f"""
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS origin FROM hashed)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
            CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> origin THEN origin END AS refers_to FROM firsts
    """,
    "op10_exact_dedup": r"""
        WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM normal
    """,
    # levenshtein counts bytes there, so letters beyond ASCII first become other single bytes
    "op11_spelling_variants": f"""
        WITH RECURSIVE found AS (SELECT doc_id, unnest({RUNS}) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
        coded AS (
            SELECT run, n, flatten(list_transform(
                string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END
            )) AS bytes FROM counted
        ),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(bytes, lambda b: [CAST(b & 15 AS BIGINT), CAST(b >> 4 AS BIGINT)]))),
                lambda c, b: xor(c >> 4, CAST({NIBBLES} AS BIGINT[])[(xor(c, b) & 15) + 1])
            )) AS h FROM coded
        ),
        edited AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY ALL HAVING sum(n) >= 5),
        single AS (
            SELECT word, n, array_to_string(list_transform(
                string_split(word, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE chr(greatest(1, ord(c) - 159)) END
            ), '') AS code
            FROM words
        ),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM single a JOIN single b
            ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.code, b.code) = 1
        ),
        tops AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS top, max(other_n) AS top_n FROM near GROUP BY ALL
        ),
        judged AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN top END AS form,
                CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n
            FROM words w LEFT JOIN tops USING (word)
        ),
        chain AS (
            SELECT word, word AS root, 0 AS depth FROM judged
            UNION ALL
            SELECT c.word, j.form, depth + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
        ),
        lasts AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY ALL)
        SELECT word, form, root, n, n_near, form_n FROM judged JOIN lasts USING (word)
    """,
    "op13_ranked_search": f"""
        WITH asked AS (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        queries AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
        words AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
        lens AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lens),
        found AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM queries) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM found GROUP BY ALL), totals
        ),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS impact
            FROM found JOIN lens USING (doc_id) JOIN weights USING (term), totals
        ),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
            FROM queries JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
