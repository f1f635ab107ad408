"""One query for each operator of this subpackage, on its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_search, chat, conversation_repair, embedding_dedup, minhash_dedup, packing, pii_boosting, sentencepiece_codec, sharding, suffix_dedup, token_counts, toxicity, vector_codes

#: Production parameters: the shards that documents are dealt to.
SHARDS = [f"shard-{k:02d}" for k in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.summary(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sharding.place(docs, SHARDS)


def op6_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), binary_search.sign_code(F.col("embedding")).alias("code"))
    found = binary_search.top_k(codes, codes.where("id % 50 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(added).withColumn("parts", chat.text_part(F.col("text")))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repair(damaged, dropped_col="dropped"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boosting.digest(pii_boosting.find(table(spark, sf_dir, "documents")))


OP10_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS safe,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS safe_role FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, safe_role, safe)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, safe_role, safe) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|><|says|><|done|>') + length(safe_role) + length(safe))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP2_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

OP6_SQL = """
WITH codes AS (SELECT vec_id, [(x > 0)::INT FOR x IN embedding[1:64]] AS bits FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(q.bits, c.bits)])::INT AS distance
  FROM codes q, codes c WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM split, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

def _vector_codes_sql() -> str:
    """The contract's arithmetic with every part against every entry, round by round."""
    out = """WITH kept AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64)"""
    near = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)])::BIGINT"
    for r in range(3):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := {near}, e := e)) AS m FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)"""
        if r < 2:
            out += f""",
s{r} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e)"""
    return out + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


OP11_SQL = _vector_codes_sql()

def _repair_sql() -> str:
    """Costs and whole audits of the four states, row by row: the least of (cost, audit) is the cheapest and ASCII-least."""
    blank = r"'[^\x20\x09-\x0D]'"
    add = lambda q, cost, edit, only="true": f"{{'c': a.{q}.c + CASE WHEN {only} THEN {cost} ELSE 1000000 END, 'a': a.{q}.a || '{edit}'}}"
    cut, may = "(x.k LIKE '%.')::INT", "x.k <> 'x'"
    keep = lambda q, role: add(q, cut, "K", f"x.k LIKE '{role}%'")
    rename = lambda q: add(q, f"2 + {cut}", "R", may)
    users = ", ".join([*map(rename, ("q0", "q1", "q3")), *(keep(q, "u") for q in ("q0", "q1", "q3"))])
    took = f"""{{'k': x.k, 'q0': {add("q0", 3, "D")}, 'q1': least({add("q1", 3, "D")}, {keep("q0", "s")}),
      'q2': least({add("q2", 3, "D")}, {users}), 'q3': least({add("q3", 3, "D")}, {rename("q2")}, {keep("q2", "a")})}}"""
    put = f"""{{'k': x.k, 'q0': a.q0, 'q1': a.q1, 'q2': least(a.q2, {add("q0", 2, "I")}, {add("q1", 2, "I")}, {add("q3", 2, "I")}), 'q3': least(a.q3, {add("q2", 2, "I")})}}"""
    state = lambda k, far: f"{{'k': {k}, 'q0': {{'c': 0::BIGINT, 'a': ''}}, 'q1': {{'c': {far}::BIGINT, 'a': ''}}, 'q2': {{'c': {far}::BIGINT, 'a': ''}}, 'q3': {{'c': {far}::BIGINT, 'a': ''}}}}"
    return f"""WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [CASE WHEN k % 8 = 0 THEN ascii(id[k // 8 + 1])::BIGINT ELSE 0 END FOR k IN range(8 * length(id))]),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind FROM keyed),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM crc, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM rows_),
placed AS (SELECT *, row_number() OVER w AS r, lead(role[1:1]) OVER w AS next FROM copies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
seen AS (SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 'b' WHEN again THEN 'd' WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (next IS NOT NULL AND role[1:1] || next NOT IN ('su', 'ua', 'au')) AS illegal,
    list(CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE '' END || CASE WHEN fault = 't' THEN '.' ELSE '' END END ORDER BY r) AS ks FROM seen GROUP BY conv_id),
best AS (SELECT * EXCLUDE (e), least(e.q0, e.q3) AS m FROM (SELECT * EXCLUDE (ks), list_reduce(list_concat([{state("''", 1000000)}],
    [{state("y", 0)} FOR y IN list_concat(flatten([['+', '+', k] FOR k IN ks]), ['+', '+'])]), lambda a, x: CASE WHEN x.k = '+' THEN {put} ELSE {took} END) AS e FROM facts)),
edits AS (SELECT conv_id, j, m.a[j] AS e, length(replace(m.a[1:j], 'I', '')) AS r FROM best, range(1, length(m.a) + 1) t(j)),
left_ AS (SELECT conv_id, j, e, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY j) - 1 AS p, first_value(e = 'K' AND role[1:1] = 's') OVER (PARTITION BY conv_id ORDER BY j) AS sys FROM edits LEFT JOIN seen USING (conv_id, r) WHERE e <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (p - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS l FROM left_ GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.c, 0) AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(l, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best USING (conv_id) LEFT JOIN lines USING (conv_id)"""


OP12_SQL = _repair_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_binary_search": op6_binary_search,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op6_binary_search": OP6_SQL, "op7_minhash_dedup": OP7_SQL, "op10_chat_formatting": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_conversation_repair": OP12_SQL}
