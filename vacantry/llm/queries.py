"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, embeddings, exact, langid, lm, mixing, phrases, pieces, sharding, simhash, toxicity
from .words import fold

#: Target weights of the mixture: every fifth source counts up to five times as much.
MIX_WEIGHTS = {f"src{i}": 1.0 + i % 5 for i in range(20)}
MIX_SEED = 42
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, other=1.0, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "text", "mix_copy", "mix_copies", "mix_order")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def model_file() -> str:
    """The public tokenizer's model, installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every text, and the text decoded from each."""
    docs = table(spark, sf_dir, "documents")
    drawn = pieces.sample_encode(docs, model_file=model_file(), k=2, decoded=True)
    return drawn.select(
        "doc_id",
        "sample",
        F.size("pieces").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        "log_prob",
        "perturbed",
        "inclusion",
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is all documents labelled as of good quality, the background all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm.difference_from_marked(docs, labels.where("quality = 1"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def language_model(docs: DataFrame) -> dict:
    """Learnt from the documents outside the held-out fold, sampled by a hash of their ids and texts."""
    return langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2), order=F.xxhash64("doc_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, language_model(docs)).withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.format_chat(chat.canonical(rows.select("conv_id", "turn", "role", "text").unionByName(more)))
    read = chat.read_back(made)
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read by the driver alone."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, length(coalesce(text, '')) AS chars,
         CASE WHEN source IN ({", ".join(repr(s) for s in MIX_WEIGHTS)}) THEN source ELSE 'other' END AS g,
         ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT g, sum(chars)::BIGINT AS chars,
             CASE WHEN g = 'other' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + substr(g, 4)::INT % 5 END AS w FROM d GROUP BY g HAVING sum(chars) > 0),
r AS (SELECT g, w / (SELECT sum(w) FROM s) * (SELECT sum(chars)::BIGINT FROM s) / chars AS rate FROM s),
p(g, rate, k, p, c) AS (
  SELECT g, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT g, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < rate + 12 * sqrt(rate) + 40),
n AS (SELECT d.doc_id, d.source, d.text, d.u, d.g, count(p.k) AS copies FROM d JOIN p ON p.g = d.g AND p.c <= d.u GROUP BY ALL)
SELECT doc_id, source, text, i::INT AS mix_copy, copies::INT AS mix_copies,
       ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_order
FROM (SELECT *, unnest(generate_series(1, copies)) AS i FROM n)
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(text, '[^<\\]', '', 'g')) + length(regexp_replace(role, '[^<>\\]', '', 'g')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size + 17)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t
"""

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
e AS (SELECT c.*, string_split(phrase, ' ') AS ws FROM c),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
           FROM e, range(2, 4) s(m), range(1, 4) u(i) WHERE m < k AND i <= k - m + 1 GROUP BY 1, 2),
kept AS (SELECT e.* FROM e LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * kept.a) // (l.a + r.a) AS score
         FROM kept, range(1, 4) t(j), f l, f r
         WHERE j < kept.k AND l.lang = kept.lang AND r.lang = kept.lang AND l.phrase = array_to_string(ws[1:j], ' ') AND r.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""

LEAK_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS x
      FROM b WHERE len(w) > 0),
s AS (SELECT k, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS x
      FROM d, (SELECT DISTINCT m FROM q)),
h AS (SELECT k, i, s.m, item FROM s JOIN q ON s.m = q.m AND s.x = q.x),
n AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT k, i, m FROM h)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""


def queries() -> dict:
    return {
        "op1_mix": op1_mix,
        "op2_simhash": op2_simhash,
        "op3_pieces": op3_pieces,
        "op4_lm_score": op4_lm_score,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_language": op7_language,
        "op8_shard": op8_shard,
        "op9_chat": op9_chat,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_align": op11_align,
        "op12_phrases": op12_phrases,
        "op13_decontaminate": op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute-force versions in tests/llm."""
    return {"op1_mix": MIX_SQL, "op5_embedding_dedup": EMBEDDING_SQL, "op9_chat": CHAT_SQL, "op10_exact_dedup": EXACT_SQL, "op12_phrases": PHRASE_SQL, "op13_decontaminate": LEAK_SQL}
