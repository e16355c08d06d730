"""The registered queries of the dealt operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import ann, descent, fim, jaccard, langid, lines, mixing, negatives, pack_files, pack_search, quality, toxicity, warc
from metricloom.llm.common import Registry, held_out, table

REGISTRY = Registry()

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@REGISTRY.query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are not learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    known = labels.where(~held_out(F.col("doc_id"), 5, 0) & F.col("label").isNotNull())
    model = toxicity.fit(docs, known)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


@REGISTRY.query()
def op2_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return ann.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def boilerplate_ctes(source: str) -> str:
    """``site_marks`` (source, marks) for a relation with source and text; pages of one text are one page."""
    return rf"""
    site_lines AS (
        SELECT source, line, count(DISTINCT page) AS n_pages
        FROM (SELECT source, md5(text) AS page, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM {source}
              WHERE source IS NOT NULL AND text IS NOT NULL)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
    site_totals AS (SELECT source, count(DISTINCT coalesce(md5(text), '')) AS n_host FROM {source} WHERE source IS NOT NULL GROUP BY source),
    site_marks AS (
        SELECT source, list(line) AS marks FROM site_lines JOIN site_totals USING (source)
        WHERE n_pages >= {lines.MIN_PAGES} AND n_pages > {lines.MAX_RATIO} * n_host GROUP BY source)"""


CLEANED_SQL = "CASE WHEN marks IS NULL OR text IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(marks, x)), chr(10)) END"

LINES_SQL = f"""
WITH {boilerplate_ctes("documents")}
SELECT doc_id, source, {CLEANED_SQL} AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       CASE WHEN text IS NULL OR marks IS NULL THEN 0
            ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(marks, x))) END AS n_dropped
FROM documents LEFT JOIN site_marks USING (source)"""


@REGISTRY.query(LINES_SQL)
def op3_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, "source", report=True)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {warc.MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


@REGISTRY.query(WARC_SQL)
def op4_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as written to WARC archives and read back through the capture index."""
    return warc.archive_round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))


def measures_ctes(source: str) -> str:
    """``verdicts`` (doc_id, the digest columns, base_failed, kept) for a relation with unique doc_id and text."""
    return rf"""
    q_words AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM {source}),
    q_places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM q_words),
    q_grams AS (
        SELECT doc_id, p, [word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] AS g,
               lead(word, 4) OVER d AS last_word, lag(word) OVER d AS before, word
        FROM q_places WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    q_counts AS (SELECT doc_id, p, word, before, last_word IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM q_grams),
    q_covered AS (
        SELECT doc_id, word, before, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM q_counts),
    q_repeat AS (
        SELECT doc_id, sum(c) AS n_repeat_words, count(*) FILTER (word = before) AS n_adjacent, count(DISTINCT word) AS n_distinct,
               count(*) FILTER (word[-1] IN ('!', '?')) AS n_marked
        FROM q_covered GROUP BY doc_id),
    q_lines AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM q_words),
    q_doubled AS (
        SELECT doc_id, sum(n - 1) AS n_dup_lines
        FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(l) AS line FROM q_lines)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
    q_all AS (
        SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
               CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
               length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
               coalesce(n_marked, 0) AS n_marked, coalesce(n_adjacent, 0) AS n_adjacent, coalesce(n_distinct, 0) AS n_distinct
        FROM q_words JOIN q_lines USING (doc_id) LEFT JOIN q_repeat USING (doc_id) LEFT JOIN q_doubled USING (doc_id)),
    verdicts AS (
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               {" OR ".join(f"({r.fails})" for r in quality.RULES if r.name in quality.BASE)} AS base_failed,
               NOT ({" OR ".join(f"({r.fails})" for r in quality.RULES)}) AS kept
        FROM q_all)"""


@REGISTRY.query(f"WITH {measures_ctes('documents')} SELECT * FROM verdicts")
def op5_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements of every document, the base verdict and the production policy's."""
    docs = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    bits = F.col("_ledger.fail_bits")
    measured = [F.col(f"_ledger.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return docs.select("doc_id", *measured, (~quality.passes(bits, "base-1")).alias("base_failed"), quality.passes(bits).alias("kept"))


@REGISTRY.query()
def op6_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document under three-word shingles and a similarity of 0.9."""
    return jaccard.near_duplicates(table(spark, folder, "documents"), size=3, percent=90)


@REGISTRY.query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; the held-out fold is not learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@REGISTRY.query()
def op8_packed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document as read back from the packed binary files."""
    return pack_files.packed_round_trip(table(spark, folder, "documents").select("doc_id", "text"))


@REGISTRY.query()
def op9_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_search.pack_documents(table(spark, folder, "documents"))


def mixing_dims() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "form": mixing.text_form(F.col("text"))}


def rates_ctes(source: str) -> str:
    """``mixed`` (doc_id, mix_rate, draw and the columns of ``source``) for a relation of documents."""
    groups = ("g0", "g1", "g2")
    steps, before = [], "r_0"
    for i in range(mixing.SWEEPS):
        for g in groups:
            name = f"r_{i}_{g}"
            steps.append(
                f"{name} AS (SELECT g0, g1, g2, tokens, aim_g0, aim_g1, aim_g2, coalesce(weight * aim_{g} / nullif(sum(weight) OVER (PARTITION BY {g}), 0), 0) AS weight FROM {before})"
            )
            before = name
    margins = ", ".join(
        f"m_{i} AS (SELECT v{i}, CASE WHEN sum(tokens) >= {mixing.MIN_SHARE} * (SELECT sum(tokens) FROM m_raw) THEN v{i} ELSE '{mixing.OTHER}' END AS g{i} FROM m_raw GROUP BY v{i})"
        for i in range(3)
    )
    aims = ", ".join(
        f"a_{i} AS (SELECT g{i}, pow(sum(tokens)::DOUBLE, {mixing.TEMPERATURE}) AS aim FROM m_cells GROUP BY g{i})" for i in range(3)
    )
    shares = ", ".join(f"a_{i}.aim / (SELECT sum(aim) FROM a_{i}) AS aim_g{i}" for i in range(3))
    joins = " ".join(f"JOIN a_{i} USING (g{i})" for i in range(3))
    return f"""
    m_docs AS (
        SELECT *, coalesce(source, '{mixing.NULL}') AS v0, coalesce(lang, '{mixing.NULL}') AS v1,
               CASE WHEN n_mix < 100 THEN 'note' WHEN n_mix < 400 THEN 'article' WHEN n_mix < 1500 THEN 'essay' ELSE 'book' END AS v2
        FROM (SELECT *, len({WORDS_SQL}) AS n_mix FROM {source})),
    m_raw AS (SELECT v0, v1, v2, sum(n_mix)::BIGINT AS tokens FROM m_docs GROUP BY ALL),
    {margins},
    m_groups AS (SELECT * FROM m_raw JOIN m_0 USING (v0) JOIN m_1 USING (v1) JOIN m_2 USING (v2)),
    m_cells AS (SELECT g0, g1, g2, sum(tokens) AS tokens FROM m_groups WHERE tokens > 0 GROUP BY ALL),
    {aims},
    r_0 AS (SELECT g0, g1, g2, tokens, tokens::DOUBLE AS weight, {shares} FROM m_cells {joins}),
    {", ".join(steps)},
    m_rates AS (SELECT g0, g1, g2, weight / tokens / max(weight / tokens) OVER () AS rate FROM {before}),
    m_final AS (SELECT v0, v1, v2, CASE WHEN tokens > 0 THEN rate ELSE 1.0 END AS mix_rate FROM m_groups LEFT JOIN m_rates USING (g0, g1, g2)),
    mixed AS (
        SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT / 4503599627370496.0 < mix_rate AS mix_kept
        FROM m_docs JOIN m_final USING (v0, v1, v2))"""


@REGISTRY.query(f"WITH {rates_ctes('documents')} SELECT doc_id, round(mix_rate + 3.7e-9, 6) AS mix_rate, mix_kept FROM mixed")
def op10_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling rate and draw of every document, raked to source, language and form of text."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    found = mixing.mix(docs, mixing_dims(), report=True)
    return found.select("doc_id", F.round(F.col("mix_rate") + 3.7e-9, 6).alias("mix_rate"), "mix_kept")


NEGATIVES_SQL = f"""
WITH g AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS own, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM g AS a JOIN g AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT own AND 100 * score BETWEEN {negatives.LOW_PERCENT} * positive_score AND {negatives.HIGH_PERCENT} * positive_score)
WHERE rank <= {negatives.NEGATIVES}"""


@REGISTRY.query(NEGATIVES_SQL)
def op11_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, among all rows."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, relabel=relabel)


NEAR_VECTORS_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {descent.THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


@REGISTRY.query(NEAR_VECTORS_SQL)
def op12_descent_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector under a cosine of 0.95."""
    found = descent.near_duplicate_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


FIM_SQL = rf"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('{fim.SEED}:' || doc_id) AS h
    FROM documents),
c AS (
    SELECT *, len(units)::BIGINT AS n, [('0x' || h[1:8])::BIGINT % (len(units) + 1), ('0x' || h[9:16])::BIGINT % (len(units) + 1)] AS cuts,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {fim.FIM_PERCENT} THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
    FROM u),
p AS (
    SELECT *, coalesce(array_to_string(units[1:list_min(cuts)], ''), '') AS prefix, coalesce(array_to_string(units[list_min(cuts) + 1:list_max(cuts)], ''), '') AS middle,
           coalesce(array_to_string(units[list_max(cuts) + 1:], ''), '') AS suffix
    FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@REGISTRY.query(FIM_SQL)
def op13_displaced_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and rebuilt from that."""
    found = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"), digests=True)
    return found.select("doc_id", "fim.*")
