"""The registered queries of this package, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.llm import conversations, language, lexical_search, mixing, neighbours, ngram_join, online_packing, passages, pii, secret_scan, seq_packing, vector_dedup, warc
from rundiff.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
reps AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets GROUP BY list_sort(s)),
item AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM reps),
num AS (SELECT rep, len(s) AS n FROM reps),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM item a JOIN item b ON a.t = b.t AND a.rep < b.rep
  AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM common JOIN num x ON x.rep = a JOIN num y ON y.rep = b WHERE c * 100 >= (x.n + y.n - c) * 80),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE least(reps.rep, coalesce(m, reps.rep)) END AS component_id
FROM sets JOIN reps ON list_sort(sets.s) = reps.s LEFT JOIN low ON low.a = reps.rep"""
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The tokenizer file of the packing query, where the public tokenizers are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM s WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, s.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM s LEFT JOIN f ON f.d = s.d AND s.n >= 100"""
)
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents")).drop("row_key")


@query()
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op7 over web pages, with all its evidence: markup, address suffix, host and domain."""
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    return language.identify_language(pages, "page_id", "text", "declared", "host", "suffix").drop("row_key")


@query()
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query()
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[])) AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), num AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN num ON num.a = vec_id"""
)
def op10_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def byte_tokenizer_path() -> str:
    """The byte-level tokenizer file of the online packing query."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_online(table(spark, sf_dir, "documents"), byte_tokenizer_path())


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(list_distinct(terms)) AS term, terms FROM d),
items AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
hits AS (SELECT doc_id, n, term, len(list_filter(terms, lambda x: x = term))::BIGINT AS tf FROM tf WHERE term IN (SELECT term FROM items)),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM hits, size GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM items JOIN hits USING (term) JOIN weight USING (term), size GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0) WHERE rank <= 10"""
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 bit by bit, as the SQL engine has none; the cost program goes through the turns one by one.
@query(
    r"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * len(name))),
  lambda a, k: xor((CASE WHEN k % 8 = 0 THEN xor(a, ascii(name[k // 8 + 1])::BIGINT) ELSE a END) >> 1,
  3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(a, ascii(name[k // 8 + 1])::BIGINT) ELSE a END) & 1)))) % 20 AS fate FROM h),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault,
  coalesce((lag(role) OVER w)[1] || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', '|user:'), (1, 2, 3, 'I', '|user:'), (3, 2, 3, 'I', '|user:'),
  (2, 3, 3, 'I', '|assistant:'), (0, 3, 6, 'II', '|user:|assistant:'), (1, 3, 6, 'II', '|user:|assistant:')) AS t(s, t, c, e, l)),
arc AS (SELECT conv_id, i, s, t, c, e, l FROM f, (VALUES (0), (1), (2), (3)) AS st(s), LATERAL (
  SELECT s AS t, 4 AS c, 'D' AS e, '' AS l
  UNION ALL SELECT CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE fault WHEN 3 THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
    WHERE fault IN (0, 3) AND ((role[1] = 's' AND s = 0) OR (role[1] = 'u' AND s <> 2) OR (role[1] = 'a' AND s = 2))
  UNION ALL SELECT CASE s WHEN 2 THEN 3 ELSE 2 END, CASE fault WHEN 3 THEN 6 ELSE 3 END, 'R', chr(10) || CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || text WHERE fault IN (0, 3))),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0, 'e': '', 'l': ''} AS best FROM f
  UNION ALL SELECT dp.conv_id, dp.i + 1, arc.t, min({'c': best.c + ins.c + arc.c, 'e': best.e || ins.e || arc.e, 'l': best.l || replace(ins.l, '|', chr(10)) || arc.l})
  FROM dp JOIN ins ON ins.s = dp.s JOIN arc ON arc.conv_id IS NOT DISTINCT FROM dp.conv_id AND arc.i = dp.i + 1 AND arc.s = ins.t GROUP BY dp.conv_id, dp.i, arc.t),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (odd) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
won AS (SELECT dp.conv_id, min({'c': best.c + ins.c, 'e': best.e || ins.e, 'l': best.l || replace(ins.l, '|', chr(10))}) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.s = dp.s AND (ins.t = 3 OR (ins.t = 0 AND dp.s = 0)) GROUP BY dp.conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(best.l[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM k.conv_id"""
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations")), copies=F.col("copies"))
