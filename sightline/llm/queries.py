"""The queries of this package: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    chunk_recipes,
    decontamination,
    jaccard_join,
    mixing,
    prefix_trie,
    quality_classifier,
    rule_ledger,
    secret_scans,
    spelling,
    suffix_dedup,
    token_counts,
    token_files,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_token_files")
def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary())


@query("op3_token_counts")
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


@query("op6_warc_archives", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f""")
def _warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op7_mixed_sources")
def _mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).per_document()


_LEDGER_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    x AS (SELECT doc_id, i, word, lag(word) OVER o AS before, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d,
                 lead(word, 4) OVER o AS e FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    y AS (SELECT doc_id, i, word, before, e IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) > 1 AS twice FROM x),
    z AS (SELECT doc_id, word = before AS echo, max(twice::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM y),
    r AS (SELECT doc_id, sum(covered) AS n_repeat_words, count(*) FILTER (WHERE echo) AS n_echoes FROM z GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(lines)::BIGINT AS n_lines, coalesce(n_echoes, 0)::BIGINT AS n_echoes,
                 length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals
          FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id),
    f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
                 + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT + 16 * (100 * n_echoes > 20 * n_words)::BIGINT
                 + 32 * (100 * n_capitals > 60 * n_letters)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT
                 + 128 * (word_chars > 15 * n_words)::BIGINT AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"""


@query("op2_rule_ledger", _LEDGER_SQL)
def _rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.judge(rule_ledger.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rule_ledger.rejected(book["failed"], "base").alias("base_failed"), "kept", "failed")


@query("op1_secret_scans")
def _secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(secret_scans.joined("base"), 256).alias("base_sha256"), secret_scans.joined("found").alias("spans"))


@query("op9_quality_classifier")
def _quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LEAKS_SQL = r"""
    WITH t AS (SELECT doc_id, 'd' AS kind, text FROM documents UNION ALL
               SELECT min(item_id), 'i', any_value(text) FROM benchmark GROUP BY regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')),
    a AS (SELECT doc_id AS id, kind, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM t),
    p AS (SELECT id, kind, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM a),
    l AS (SELECT id, kind, pos, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4,
                 lead(w, 5) OVER o AS w5, lead(w, 6) OVER o AS w6, lead(w, 7) OVER o AS w7 FROM p WINDOW o AS (PARTITION BY kind, id ORDER BY pos)),
    s AS (SELECT id, kind, pos, 0 AS mask, [w, w1, w3, w4, w7] AS seed FROM l WHERE w7 IS NOT NULL UNION ALL
          SELECT id, kind, pos, 1, [w, w2, w3, w5, w6] FROM l WHERE w6 IS NOT NULL UNION ALL
          SELECT id, kind, pos, 2, [w, w1, w2, w4, w5] FROM l WHERE w5 IS NOT NULL),
    h AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.pos - i.pos AS shift
          FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.mask = i.mask AND d.seed = i.seed),
    e AS (SELECT h.*, i.n, i.pos, CASE WHEN d.w = i.w THEN 1 ELSE -1 END AS v
          FROM h JOIN p i ON i.kind = 'i' AND i.id = h.item_id LEFT JOIN p d ON d.kind = 'd' AND d.id = h.doc_id AND d.pos = h.shift + i.pos),
    c AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS total FROM e),
    m AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM c),
    b AS (SELECT doc_id, item_id, shift, n, max(total - low) AS score FROM m GROUP BY ALL)
    SELECT doc_id, item_id, max(score)::INT AS score FROM b WHERE score >= least(10, ceil(n * 0.7)) GROUP BY ALL"""


@query("op4_spaced_seed_leaks", _LEAKS_SQL)
def _spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))  # texts without id are found one by one


@query("op8_jaccard_join")
def _jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def _suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295::BIGINT)"


_TRIE_SQL = f"""
    WITH RECURSIVE t AS (SELECT conv_id, list(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, text) AS said,
                      list(strlen(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST, text) AS sizes
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT *, {_crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 9 AS h FROM t),
    r AS (SELECT o.conv_id, list_concat(coalesce(f.said[1:o.h], []), o.said[o.h + 1:]) AS said, list_concat(coalesce(f.sizes[1:o.h], []), o.sizes[o.h + 1:]) AS sizes
          FROM h o LEFT JOIN t f ON f.conv_id = o.conv_id - o.conv_id % 5),
    p AS (SELECT conv_id, len(said) AS size, d, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS b, said[1:d]::VARCHAR AS key, CASE WHEN d > 0 THEN said[1:d - 1]::VARCHAR END AS up
          FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM r)),
    n AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv, count(*) AS n, any_value(b) AS b,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends FROM p GROUP BY d, key),
    k AS (SELECT up AS key, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
    m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (key)),
    a AS (SELECT key AS top, key, up, (kids = 0)::BIGINT AS leaf, (n - 1) * b AS saved FROM m UNION ALL
          SELECT u.key, a.key, u.up, leaf, saved FROM a JOIN m c ON c.key = a.top JOIN m u ON u.key = c.up),
    s AS (SELECT top AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY top)
    SELECT m.conv AS conv_id, m.d AS depth, u.conv AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
    FROM m JOIN s USING (key) LEFT JOIN n u ON u.key = m.up"""


@query("op11_prefix_trie", _TRIE_SQL)
def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))))


@query("op12_chunk_recipes", r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)""")
def _chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_SPELLING_SQL = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    r AS (SELECT run, length(run) AS size, hex(encode(concat(doc_id, ':', run))) AS code, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
    c AS (SELECT *, {_crc32_sql("list_transform(range(0, length(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::BIGINT)")} AS h FROM r),
    o AS (SELECT CASE WHEN h % 31 = 0 THEN concat(run[1:h % size], run[h % size + 2:]) ELSE run END AS word, n FROM c),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    x AS (SELECT word, n, i, concat(word[1:i - 1], word[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
    e AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION
          SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
    b AS (SELECT word, count(*) AS n_near, arg_min(other, {{'r': -m, 'w': encode(other)}}) AS other, max(m) AS m FROM e GROUP BY word),
    f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
    g AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.next)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON g.word = f.word AND g.next IS NULL"""


@query("op13_spelling_variants", _SPELLING_SQL)
def _spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
