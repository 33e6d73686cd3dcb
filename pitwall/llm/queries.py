"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm import (chat, decontaminate, embeddings, extract, language, lines, mixing, phrases, repair,
                         secret_scan, sharding, simhash, substring)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "lcs", "answer", "start", "latent")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"))
    return chosen.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                         (F.col("size") * F.col("copies")).alias("taken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id"))
    model = language.train(docs, "text", "lang", F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(table(spark, sf_dir, "conversations"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by weights fitted on made labelled pages."""
    model = extract.train(extract.made_pages(spark))
    found = extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return found.select("page_id", "url", F.col("main_text").alias("text"),
                        F.length("main_text").cast("long").alias("n_chars"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: its faults after damage, the cheapest repair and the repaired rows' digest."""
    turns = table(spark, sf_dir, "conversations")
    reports, repaired = repair.repair(repair.damage(turns))
    key = lambda df, c: df.withColumn("key", repair.key_of(F.col(c)))
    found = key(reports, "conv").drop("conv").join(repair.digests(repaired), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (key(turns.select("conv_id").distinct(), "conv_id").join(found, "key", "left")
            .select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_benchmark_decontamination, op2_embedding_near_dedup, op3_source_mixing, op4_substring_dedup,
        op5_line_dedup, op6_language_id, op7_secret_scan, op8_simhash_near_dedup, op9_sharding,
        op10_chat_formatting, op11_html_extraction, op12_conversation_repair, op13_phrase_collocations)}


# DuckDB SQL where SQL can express the whole result; the others are tested by brute force in tests/llm.
ORACLE_SQL = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok
         AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id) AS n_links, min(y) AS component_id, vec_id = min(y) AS kept
FROM v JOIN reach ON x = vec_id GROUP BY vec_id""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 49] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d) x),
low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p
         FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN low USING (s) WHERE first < doc_id) x),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_chat_formatting": """
WITH conv AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn) AS s
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
inner_prefix AS (SELECT DISTINCT s[1:i] AS s FROM (SELECT s, unnest(range(1, len(s))) AS i FROM conv) p)
SELECT min(conv_id) AS conv_id, len(s) AS n_turns, count(*) AS n_snapshots,
       array_to_string(list_transform(s, lambda t: '<|im_start|>' || coalesce(t.r, 'unknown') || chr(10)
                                              || coalesce(t.x, '') || '<|im_end|>' || chr(10)), '') AS chat
FROM conv ANTI JOIN inner_prefix USING (s) GROUP BY s""",
}

ORACLE_SQL["op13_phrase_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
every AS (SELECT lang, w[i:i + k - 1] AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM word, range(1, 4) x(k)) y),
f AS (SELECT lang, s, count(*) AS n FROM every GROUP BY lang, s HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w)) AS n FROM word GROUP BY lang),
alone AS (SELECT lang, s, n FROM f WHERE len(s) > 1 AND NOT EXISTS (
          SELECT 1 FROM f g WHERE g.lang = f.lang AND len(g.s) = 3 AND len(f.s) = 2
          AND (g.s[1:2] = f.s OR g.s[2:3] = f.s) AND 100 * g.n >= 50 * f.n)),
cut AS (SELECT c.lang, c.s, c.n AS a, c.k, x.n AS l, y.n AS r, 1000000 * c.n::HUGEINT * c.n // (x.n::HUGEINT * y.n) AS score
        FROM (SELECT *, unnest(range(1, len(s))) AS k FROM alone) c
        JOIN f x ON x.lang = c.lang AND x.s = c.s[1:c.k] JOIN f y ON y.lang = c.lang AND y.s = c.s[c.k + 1:]),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, k) AS o FROM cut),
best AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(s, ' ')) AS rank,
                array_to_string(s, ' ') AS phrase, a, l, r, score FROM low WHERE o = 1)
SELECT best.lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000"""


def _repair_moves() -> str:
    """Rows (letter, g, g2, cost, audit): from grammar state g to g2 by up to two inserts and one row's edit.

    States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Letters: role initial (x: another), upper case if
    truncated, D if the row must go.
    """
    due, rows = {0: 2, 1: 2, 2: 3, 3: 2}, []
    for letter in "suaxSUAXD":
        for g in range(4):
            at, cost, audit = g, 0, ""
            for _ in range(3):
                rows.append((letter, g, at, cost + 2, audit + "D"))
                if letter != "D":
                    cut = 5 * letter.isupper()
                    rows.append((letter, g, due[at], cost + 1 + cut, audit + "R"))
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((at, letter.lower()))
                    if to:
                        rows.append((letter, g, to, cost + cut, audit + "K"))
                at, cost, audit = due[at], cost + 5, audit + "I"
    return ", ".join(map(str, rows))


ORACLE_SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''),
                lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))),
                lambda r, b: xor(r >> 1, (xor(r, b) & 1) * 3988292384)), 4294967295) % 20 AS h FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM dam),
flt AS (SELECT conv_id, turn, role, text, pos, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair,
               CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault FROM num),
sig AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN fault = 'truncated' THEN upper(i) ELSE i END AS letter
        FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS i FROM flt) q),
move(letter, g, g2, cost, audit) AS (VALUES {_repair_moves()}),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS g, '000000000' AS s FROM sig
  UNION ALL SELECT d.conv_id, d.pos + 1, m.g2, min(lpad(CAST(CAST(d.s[1:9] AS BIGINT) + m.cost AS VARCHAR), 9, '0')
                                                 || d.s[10:] || m.audit)
  FROM dp d JOIN sig f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
  JOIN move m ON m.letter = f.letter AND m.g = d.g GROUP BY d.conv_id, d.pos, m.g2),
size AS (SELECT conv_id, max(pos) AS n FROM sig GROUP BY conv_id),
best AS (SELECT d.conv_id, min(lpad(CAST(CAST(s[1:9] AS BIGINT) + e.cost AS VARCHAR), 9, '0') || s[10:] || e.audit) AS s
         FROM dp d JOIN size z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND d.pos = z.n
         JOIN (VALUES (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) e(g, cost, audit) ON e.g = d.g GROUP BY d.conv_id),
edit AS (SELECT conv_id, unnest(string_split(s[10:], '')) AS e, unnest(range(1, length(s) - 8)) AS p FROM best),
place AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS pos FROM edit),
kept AS (SELECT p.conv_id, e, p, role, text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p) AS o,
                first_value(e = 'K' AND role[1] = 's') OVER (PARTITION BY p.conv_id ORDER BY p) AS s
         FROM place p LEFT JOIN sig f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND p.e <> 'I' WHERE e <> 'D'),
done AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
         FROM kept GROUP BY conv_id),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(b.s[1:9] AS BIGINT), 0) AS cost, coalesce(b.s[10:], '') AS audit,
       sha256(coalesce(d.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
