"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, cuckoo, htmldiff, infill, langid, linedup, mixing, phrases, pieces, pii, quality, repair, setjoin
from tidemark.llm.common import fold, table
from tidemark.session import write_stage


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id leaves ``remainder``; rows without an id never teach."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(True))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary(vocabulary_path())
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    digested = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                              F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    decoded = pieces.decode(digested, vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"),
                      F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
                      "emptied", F.sha2("text", 256).alias("text_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)),
                        F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(4, 2)
    model = langid.fit(docs, ~out)
    return (langid.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected"))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = phrases.with_next(table(spark, sf_dir, "documents"), parts)
    edited = pairs.withColumn("next_text", phrases.following("text"))
    marked = edited.withColumn("f", phrases.fingerprint_edit("text", "next_text")).select(
        "doc_id", "part", "halo", F.xxhash64("text").alias("text"), F.length("text").cast("long").alias("n_chars"), "f.*")
    nearby = marked.withColumn("next_fingerprint", phrases.following("fingerprint")).where("halo = 0")
    return nearby.select("doc_id", "n_chars",
                         *(F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                         phrases.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                         phrases.likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "group_id", "kept")


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restore("output", "form"), 256).alias("restored_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    rows = repair.damage(told)
    found = write_stage(repair.repair(rows), "repair-found")
    digests = repair.digests(repair.apply(rows, found))
    every = repair.matched(told.select("conv_id").distinct(), found, "conv_id", how="left")
    return repair.matched(every, digests, "conv_id", how="left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_sentencepiece, op3_quality, op4_line_dedup, op5_pii,
    op6_language, op7_phrases, op8_exact_dedup, op9_html, op10_near_dedup, op11_set_join, op12_infill, op13_repair)}


#: SQL of the queries that SQL can express.
ORACLES = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op1_mix_sources": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w
            FROM d GROUP BY source),
        p AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS pot FROM s),
        -- fullest sources first: what each rate would be with the first k of them full
        q AS (
            SELECT *, (pot - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS rate
            FROM p WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        r AS (SELECT max(rate) AS rate FROM q),
        t AS (
            SELECT source, source_size, least(cap, w * (SELECT rate FROM r)) AS target,
                   CAST('0x' || substr(md5('17/' || coalesce(source, '')), 1, 6) AS BIGINT) AS start
            FROM p),
        l AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.start,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 16777216 + 0.5) AS BIGINT) ELSE 0 END AS step,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key, d.doc_id) - 1 AS place
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (((start + (place + 1) * step) >> 24) - ((start + place * step) >> 24)) * size AS taken
        FROM l""",
    "op11_set_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        l AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op12_infill": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (
            SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
            FROM d),
        c AS (
            SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM u),
        p AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                   array_to_string(units[b + 1:], '') AS suffix
            FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    # states (rows done, role before) are kept with their cheapest, least edits; more than one
    # insertion in a row pays only at the end
    "op13_repair": """
        WITH RECURSIVE bytes AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                  lambda c: CAST(ord(c) AS BIGINT)) AS key
            FROM conversations),
        sums AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], key), lambda crc, b:
                   list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                               lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS damage
            FROM bytes),
        damaged AS (
            SELECT conv_id, turn, unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
                   CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM sums WHERE damage <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
        told AS (
            SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                        WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN '-' ELSE 't' END AS fault
            FROM placed),
        paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM told),
        facts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM paired GROUP BY conv_id),
        best AS (
            SELECT conv_id, 0::BIGINT AS i, '' AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM facts
            UNION ALL
            SELECT conv_id, i, q, cost, audit, lines FROM (
                SELECT b.conv_id, t.i, CASE e.edit WHEN 'D' THEN b.q WHEN 'K' THEN t.initial ELSE b.next END AS q,
                       b.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN e.edit <> 'D' AND t.fault = 't' THEN 1 ELSE 0 END AS cost,
                       b.audit || e.edit AS audit,
                       CASE e.edit WHEN 'D' THEN b.lines WHEN 'K' THEN list_append(b.lines, t.role || ':' || t.text)
                            ELSE list_append(b.lines, CASE b.next WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text) END AS lines
                FROM (
                    SELECT *, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS next FROM (
                        SELECT conv_id, i, q, cost, audit, lines FROM best
                        UNION ALL
                        SELECT conv_id, i, CASE q WHEN 'u' THEN 'a' ELSE 'u' END, cost + 2, audit || 'I',
                               list_append(lines, CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END) FROM best)) b
                JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1
                CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(edit)
                WHERE e.edit = 'D' OR t.fault IN ('t', '-') AND (e.edit = 'R' OR b.q || t.initial IN ('s', 'u', 'su', 'ua', 'au')))
            QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
        ended AS (
            SELECT f.*, b.cost + CASE q WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END AS cost,
                   b.audit || CASE q WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
                   list_concat(b.lines, CASE q WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END) AS lines
            FROM facts f JOIN best b ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i),
        repaired AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id""",
}
