"""The operators' queries over their whole tables, each next to the SQL that must give the same rows
where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.llm.byte_pairs import encode_bytes
from vocale.llm.common import held_out, remainder, table
from vocale.llm.filter_audit import audit
from vocale.llm.fingerprints import compare_edited
from vocale.llm.grid_join import near_duplicates
from vocale.llm.jaccard_join import similar_documents
from vocale.llm.languages import fit_languages, predict_languages
from vocale.llm.line_runs import dedup_lines
from vocale.llm.merkle import Manifest
from vocale.llm.packing import pack_tokens
from vocale.llm.quality import fit_quality, score_quality
from vocale.llm.sentence_pieces import encode_pieces
from vocale.llm.token_counts import token_counts
from vocale.llm.toxicity import fit_toxicity, score_toxicity


def op1_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return compare_edited(table(spark, root, "documents"))


def op2_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = fit_toxicity(docs, table(spark, root, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op3_languages(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    prototypes = fit_languages(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    predicted = predict_languages(docs, prototypes)
    return predicted.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack_tokens(table(spark, root, "documents"))


def op5_sentence_pieces(spark: SparkSession, root: str) -> DataFrame:
    return encode_pieces(table(spark, root, "documents"))


def op6_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    kept = dedup_lines(table(spark, root, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts(table(spark, root, "documents"))


def op8_embedding_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "embeddings"))


def op9_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = fit_quality(docs, table(spark, root, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return similar_documents(table(spark, root, "documents"))


def op11_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tree = Manifest(table(spark, root, "documents"), offered={"text": lowered}, changed=remainder(F.col("doc_id"), 5) == 0)
    return tree.proofs().select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_filter_audit(spark: SparkSession, root: str) -> DataFrame:
    return audit(table(spark, root, "documents"), table(spark, root, "labels"))


def op13_byte_pairs(spark: SparkSession, root: str) -> DataFrame:
    coded = encode_bytes(table(spark, root, "documents"), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_toxicity, op3_languages, op4_packing, op5_sentence_pieces, op6_line_dedup,
    op7_token_counts, op8_embedding_duplicates, op9_quality, op10_jaccard_join, op11_merkle_manifest, op12_filter_audit, op13_byte_pairs, pipeline,
)}

BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def merkle_sql(levels: int = 6, top_levels: int = 3) -> str:
    """The tree level by level, each row's value folded along: one table of nodes and one of rows
    a level, for up to 16 ** levels rows a source and 16 ** top_levels sources."""
    def value(x):
        return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"

    rows = ", ".join(f"{value(c)} AS {c}_" for c in ("doc_id", "source", "lang", "n_chars", "text"))
    text = f"CASE WHEN crc_5 THEN translate(text, {UPPER}) ELSE text END"
    head = "doc_id_ || source_ || lang_ || n_chars_ || "
    steps = []
    for k in range(levels + top_levels):
        if k == levels:  # the subroots become the leaves of one group
            steps.append(f"n{k} AS (SELECT 0 AS g, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS i, d, name FROM m{k})")
            steps.append(f"""f{k} AS (SELECT e.* EXCLUDE (g, i, sub), n.g, n.i, n.d AS sub
                FROM e{k} e JOIN n{k} n ON n.name IS NOT DISTINCT FROM e.name)""")
        steps.append(f"c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n{k})")
        steps.append(f"""{'m' if k == levels - 1 else 'n'}{k + 1} AS (
            SELECT g, any_value(name) AS name, i // 16 AS i,
                CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
            FROM c{k} GROUP BY g, i // 16)""")
        steps.append(f"""{'e' if k == levels - 1 else 'f'}{k + 1} AS (
            SELECT f.r, any_value(f.doc_id) AS doc_id, any_value(f.leaf) AS leaf, any_value(f.name) AS name,
                any_value(f.sub) AS sub, f.g, any_value(f.i) // 16 AS i,
                CASE WHEN any_value(c) = 1 THEN any_value(f.folded)
                    ELSE sha256(string_agg(CASE WHEN n.i = f.i THEN f.folded ELSE n.d END, '' ORDER BY n.i)) END AS folded,
                any_value(f.proof) || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i <> f.i), '') AS proof
            FROM f{k} f JOIN c{k} n ON n.g = f.g AND n.i // 16 = f.i // 16 GROUP BY f.r, f.g)""")
    last = levels + top_levels
    return f"""
        WITH crcs AS (
            SELECT t.i, list_reduce([t.i] || range(8), lambda c, x: xor(c // 2, CASE c % 2 WHEN 1 THEN 3988292384 ELSE 0 END)) AS v
            FROM range(256) t(i)
        ), crc AS (SELECT list(v ORDER BY i) AS v FROM crcs),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id, source AS name, text, {rows}, coalesce(xor(4294967295, list_reduce(
                [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda c, x: xor(c // 256, v[1 + xor(c % 256, x)]))) % 5 = 0, false) AS crc_5
            FROM documents, crc
        ), leaves AS (
            SELECT r, doc_id, name, sha256({head} text_) AS d, sha256({head} {value(text)}) AS folded FROM docs
        ), groups AS (SELECT name, row_number() OVER (ORDER BY name NULLS FIRST) AS g FROM (SELECT DISTINCT name FROM docs)),
        ordered AS (
            SELECT l.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i
            FROM leaves l JOIN groups ON l.name IS NOT DISTINCT FROM groups.name
        ), n0 AS (SELECT g, name, i, d FROM ordered),
        f0 AS (SELECT r, doc_id, d AS leaf, name, NULL::VARCHAR AS sub, g, i, folded, '' AS proof FROM ordered),
        {", ".join(steps)}
        SELECT doc_id, leaf, sub AS subroot, n.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
            folded = n.d AS verified
        FROM f{last}, n{last} n
    """


ORACLES = {
    "op11_merkle_manifest": merkle_sql(),
    "op6_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), lines AS (
            SELECT doc_id, r, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split
        ), keyed AS (
            SELECT *, translate(trim(line, {BLANKS}), {UPPER}) AS k FROM lines
        ), crowded AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, r, pos, line, coalesce(doc_id IS DISTINCT FROM keeper AND c.k IS NOT NULL, false) AS out
            FROM keyed LEFT JOIN crowded c USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT out), '')) AS kept_sha256
        FROM marked GROUP BY doc_id, r
    """,
    "op8_embedding_duplicates": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(u, w) AS (
            SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(top, vec_id)) AS component_id,
            vec_id <= coalesce(top, vec_id) AS kept
        FROM embeddings
        LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) d ON d.u = vec_id
        LEFT JOIN (SELECT u, min(w) AS top FROM reach GROUP BY u) c ON c.u = vec_id
    """,
    "op10_jaccard_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        common AS (
            SELECT a.doc_id AS u, b.doc_id AS w, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
            FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
        ), links AS (SELECT u, w FROM common WHERE 100 * c >= 75 * (na + nb - c)),
        reach(u, w) AS (
            SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
        )
        SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(top, doc_id)) AS component_id
        FROM sets LEFT JOIN (SELECT u, min(w) AS top FROM reach GROUP BY u) c ON c.u = doc_id
    """,
    "op12_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), marked AS (
            SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
                    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
                coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
                coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS bad
            FROM texts
        ), counts AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
            FROM marked GROUP BY part, fails
        ), f AS (SELECT unnest(range(1, 6)) AS i),
        orders AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), steps AS (
            SELECT o, s.i AS step, o[s.i] AS filter, o[1 : s.i - 1] AS before FROM orders, f s
        ), looked AS (
            SELECT *, fails[filter] AS hit, len(list_filter(before, lambda x: fails[x])) > 0 AS gone,
                len(list_filter(fails, lambda x: x)) AS k
            FROM counts, steps
        ), summed AS (
            SELECT part, o, step, filter,
                coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept,
                coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
                coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
                coalesce(sum(n) FILTER (hit AND k = 1), 0) AS unique_fails,
                coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
                coalesce(sum(bad) FILTER (hit AND NOT gone), 0) AS toxic_lost
            FROM looked GROUP BY part, o, step, filter
        )
        SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x::INT)), '') AS filter_order,
            step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
            unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
        FROM summed
    """,
}
