"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.llm import bpe, chat, chat_repair, decontaminate, embedding_dedup, exact_dedup, line_dedup, prefix_trie, quality, secret_scan, sharding, simhash, token_files
from signalmart.llm.common import read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents`` by the 50k byte-level ranks."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole ``documents`` equal to an earlier one, or of five words and similarity 0.8 to one, go; what is left of each text."""
    return line_dedup.summary(read_table(spark, sf_dir, "documents"), threshold=0.8, min_tokens=5)


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), sets AS (
  SELECT doc_id, place, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS words FROM lines
), judged AS (
  SELECT words, len(words) AS n, min((doc_id, place)) AS first FROM sets WHERE len(words) >= 1 GROUP BY words
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY first) AS id FROM judged
), tokens AS (
  SELECT id, n, unnest(words) AS word FROM numbered WHERE n >= 5
), freq AS (
  SELECT word, count(*) AS f FROM tokens GROUP BY word
), ranked AS (
  SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS pos FROM tokens JOIN freq USING (word)
), heads AS (
  SELECT * FROM ranked WHERE pos <= n - ceil(0.8 * n) + 1
), pairs AS (
  SELECT DISTINCT a.id AS later, b.id AS earlier FROM heads a JOIN heads b ON a.word = b.word AND b.id < a.id AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
), similar_to AS (
  SELECT DISTINCT later AS id FROM (
    SELECT later, x.n + y.n AS both_n, len(list_intersect(x.words, y.words)) AS o
    FROM pairs JOIN numbered x ON x.id = later JOIN numbered y ON y.id = earlier
  ) WHERE 5 * o >= 4 * (both_n - o)
), verdict AS (
  SELECT s.doc_id, s.place, s.line, m.id IS NOT NULL AND ((s.doc_id, s.place) <> m.first OR v.id IS NOT NULL) AS removed
  FROM sets s LEFT JOIN numbered m ON s.words = m.words LEFT JOIN similar_to v ON v.id = m.id
)
SELECT d.doc_id, coalesce(count(place), 0)::BIGINT AS n_lines, coalesce(sum(removed::INT), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT removed), '')) AS kept_sha256
FROM documents d LEFT JOIN verdict v ON v.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into 24 shards whose row counts are at most one apart."""
    dealt = sharding.assign(read_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        "doc_id",
        (F.col("bytes") + 8).alias("size"),
        F.col("crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of every ``benchmark`` item, looked for in every whole text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate.find_phrases(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("found.items")), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``: the base kinds and linked multipart credentials."""
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secret_scan.count_of("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, within equal labels, at cosine 0.98 or more."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.98)


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links,
  (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(b) FROM reach WHERE a = e.vec_id) AS kept
FROM embeddings e
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents``, write the files in doc_id order, read them back."""
    files = token_files.write_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(files)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most two differing bits, over whole ``documents``."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of the whole ``conversations``, rendered."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns FROM placed GROUP BY conv_id
), distinct_whole AS (
  SELECT min(conv_id) AS conv_id, turns FROM whole GROUP BY turns
), prefixes AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM distinct_whole)
), kept AS (
  SELECT conv_id FROM distinct_whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = w.turns)
)
SELECT conv_id, ((place - 1) // 256)::INT AS part, count(*)::BIGINT AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY 1, 2
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn quality from the labels that aren't held out; score every whole text of ``documents``."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _crc32_sql(text: str) -> str:
    """DuckDB expression for the CRC-32 of an ASCII string."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}))"


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of equal texts, white space aside, over whole ``documents``."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM normal WINDOW best AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the whole ``conversations`` and repair them by the cheapest audit."""
    turns = read_table(spark, sf_dir, "conversations")
    return chat_repair.repair(chat_repair.damaged(turns), turns)


OP12_SQL = (
    r"""
WITH RECURSIVE shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), fated AS (
  SELECT *, {crc} % 20 AS fate FROM shown
), copied AS (
  SELECT *, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0
), placed AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role0 END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS place
  FROM copied
), faulty AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
      WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS last_initial
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM faulty GROUP BY conv_id
), audits AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, place, p0, p1, i2, list_min([p3, {{'c': i2.c + 3, 'a': i2.a || 'I'}}])
  FROM (
    SELECT *, list_min([p2, {{'c': p0.c + 3, 'a': p0.a || 'I'}}, {{'c': p1.c + 3, 'a': p1.a || 'I'}}, {{'c': p3.c + 3, 'a': p3.a || 'I'}}]) AS i2
    FROM (
      SELECT conv_id, place, {{'c': s0.c + 4, 'a': s0.a || 'D'}} AS p0,
        list_min([{{'c': s1.c + 4, 'a': s1.a || 'D'}}, {{'c': s0.c + extra + no_system, 'a': s0.a || 'K'}}]) AS p1,
        list_min([{{'c': s2.c + 4, 'a': s2.a || 'D'}},
          {{'c': s0.c + extra + no_user, 'a': s0.a || 'K'}}, {{'c': s1.c + extra + no_user, 'a': s1.a || 'K'}}, {{'c': s3.c + extra + no_user, 'a': s3.a || 'K'}},
          {{'c': s0.c + 3 + extra, 'a': s0.a || 'R'}}, {{'c': s1.c + 3 + extra, 'a': s1.a || 'R'}}, {{'c': s3.c + 3 + extra, 'a': s3.a || 'R'}}]) AS p2,
        list_min([{{'c': s3.c + 4, 'a': s3.a || 'D'}}, {{'c': s2.c + extra + no_assistant, 'a': s2.a || 'K'}}, {{'c': s2.c + 3 + extra, 'a': s2.a || 'R'}}]) AS p3
      FROM (
        SELECT a.conv_id, f.place, s0, s1, s2, s3, CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 0 END AS extra,
          CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS no_system, CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END AS no_user,
          CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END AS no_assistant
        FROM audits a JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.place = a.place + 1
      )
    )
  )
), best AS (
  SELECT c.*, list_min([s0, s3]) AS found FROM counts c JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.place = c.n
), letters AS (
  SELECT conv_id, unnest(string_split(found.a, '')) AS edit, generate_subscripts(string_split(found.a, ''), 1) AS spot FROM best
), numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY spot) AS step FROM letters
), turns AS (
  SELECT n.conv_id, n.edit, n.spot, n.step, f.role, CASE WHEN n.edit = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN n.step = 1 AND n.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered n LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.place = n.place
  WHERE n.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (step - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY spot) AS body
  FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(found.c, 0) AS cost, coalesce(found.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
).format(crc=_crc32_sql("key"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over the whole ``conversations``, each rebuilt with the first turns of another."""
    turns, totals = prefix_trie.rebuilt(prefix_trie.placed_turns(read_table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, totals)


OP13_SQL = f"""
WITH placed AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(turn ORDER BY place) AS turns, conv_id - conv_id % 5 AS base, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM placed GROUP BY conv_id
), whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM own c LEFT JOIN own b ON b.conv_id = c.base
), nodes AS (
  SELECT turns[1:d] AS key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(max(strlen(turns[d].t)), 0) AS saved
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole) GROUP BY 1, 2
), families AS (
  SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), grown AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.depth = n.depth AND f.key = n.key
), subtrees AS (
  SELECT key[1:d] AS key, d AS depth, sum(saved) AS saved, sum((n_children = 0)::INT) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM grown) GROUP BY 1, 2
), ends AS (
  SELECT turns AS key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM whole GROUP BY turns
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM grown n JOIN subtrees s ON s.depth = n.depth AND s.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1] LEFT JOIN ends e ON e.key = n.key
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_token_files": op7_token_files,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_chat_repair": op12_chat_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_chat_repair": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
