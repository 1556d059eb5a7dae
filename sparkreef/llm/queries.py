"""The queries of the corpus operators: thin, over whole tables, with the operators' defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.llm import conversations, html_text, line_dedup, media, mixing, packing, phrases, quality, secrets, simhash, substring_dedup, toxicity, url_filter
from sparkreef.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op2_quality_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("beyond")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json")).drop("row")


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.train(docs, labels)


def op4_toxicity_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity_model(spark, sf_dir, docs))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so each vector is played as a melody and the recordings are aligned."""
    vectors = table(spark, sf_dir, "embeddings")
    return media.align_recordings(vectors, "vec_id", "embedding", media.from_notes)


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mended = conversations.repair_conversations(conversations.damage(turns))
    hashed = mended.withColumn("repaired_sha256", F.sha2(F.array_join("repaired", "\n").cast("binary"), 256)).drop("repaired")
    return conversations.with_every(hashed, turns, repaired_sha256=F.sha2(F.lit("").cast("binary"), 256))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_text.extract_text(pages.select("page_id", "url", "html"), html_text.train(pages))
    return texts.select("row.page_id", "row.url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_fences": op2_quality_fences,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity_dictionaries": op4_toxicity_dictionaries,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_flow_mixing": op6_flow_mixing,
    "op7_url_rules": op7_url_rules,
    "op8_chroma_alignment": op8_chroma_alignment,
    "op9_simhash_pivots": op9_simhash_pivots,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_main_text": op13_main_text,
}


def _conversation_sql() -> str:
    """Turn by turn, the four states as strings: the cost in twelve digits, then the audit."""

    def after(state: str, cost: str, edits: str) -> str:
        return f"lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || {edits}"

    def said(state: str, role: str, inserted: str = "") -> str:
        own = f"left(r.role, 1) = '{role}'"
        extra = 2 if inserted else 0
        letter = f"'{inserted}' || CASE WHEN {own} THEN 'K' ELSE '{'R' if role == 'u' else 'S'}' END"
        return after(state, f"r.kept + CASE WHEN {own} THEN {extra} ELSE {extra + 2} END", letter)

    def gone(state: str) -> str:
        return after(state, "3", "'D'")

    opened = after("f.s0", "r.kept + CASE WHEN left(r.role, 1) = 's' THEN 0 ELSE 100000000000 END", "'K'")
    never = "'100000000000'"
    return rf"""
        WITH RECURSIVE damaged AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295::BIGINT, list_reduce(
                       list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
                       lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END), 4294967295::BIGINT)) % 20 AS fault
            FROM conversations),
        rows_left AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM damaged WHERE fault <> 0)),
        ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
        marked AS (
            SELECT id, turn, role, text,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last_character,
                   row_number() OVER (PARTITION BY id, role, text ORDER BY turn NULLS FIRST) AS said
            FROM rows_left JOIN ids ON rows_left.conv_id IS NOT DISTINCT FROM ids.conv_id),
        faults AS (
            SELECT *, CASE WHEN last_character = '' THEN 3 WHEN said > 1 THEN 2 WHEN last_character NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
            FROM marked),
        numbered AS (
            SELECT *, CASE WHEN fault >= 2 THEN 100000000000 ELSE fault END AS kept,
                   row_number() OVER w AS pos,
                   lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
            FROM faults WINDOW w AS (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, fault)),
        fold AS (
            SELECT id, 0::BIGINT AS pos, '000000000000' AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM ids
            UNION ALL
            SELECT f.id, r.pos, {gone("f.s0")}, least({gone("f.s1")}, {opened}),
                   least({gone("f.s2")}, {said("f.s0", "u")}, {said("f.s1", "u")}, {said("f.s3", "u")}, {said("f.s2", "u", "J")}),
                   least({gone("f.s3")}, {said("f.s2", "a")}, {said("f.s0", "a", "I")}, {said("f.s1", "a", "I")}, {said("f.s3", "a", "I")})
            FROM fold f JOIN numbered r ON r.id = f.id AND r.pos = f.pos + 1),
        best AS (
            SELECT id, substr(least(s0, s3, {after("s2", "2", "'J'")}, {after("s1", "4", "'IJ'")}), 13) AS edits,
                   left(least(s0, s3, {after("s2", "2", "'J'")}, {after("s1", "4", "'IJ'")}), 12)::BIGINT AS cost
            FROM (SELECT id, unnest(max_by({{'s0': s0, 's1': s1, 's2': s2, 's3': s3}}, pos)) FROM fold GROUP BY id)),
        counted AS (
            SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
                   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (illegal) AS illegal
            FROM numbered GROUP BY id),
        tokens AS (
            SELECT id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT id, regexp_extract_all(edits, '[IJ]*[DKRS]|[IJ]+$') AS t FROM best)),
        lines AS (
            SELECT id, pos, 0 AS part, CASE left(token, 1) WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' END AS line FROM tokens
            UNION ALL SELECT id, pos, 1, CASE substr(token, 2, 1) WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' END FROM tokens
            UNION ALL SELECT tokens.id, tokens.pos, 2, CASE right(token, 1) WHEN 'K' THEN role WHEN 'R' THEN 'user' WHEN 'S' THEN 'assistant' END || ':' || text
                      FROM tokens JOIN numbered ON numbered.id = tokens.id AND numbered.pos = tokens.pos),
        texts AS (SELECT id, string_agg(line, chr(10) ORDER BY pos, part) AS repaired FROM lines GROUP BY id)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, translate(edits, 'JS', 'IR') AS audit,
               sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM ids JOIN best USING (id) LEFT JOIN counted USING (id) LEFT JOIN texts USING (id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
                  FROM documents)),
        owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner < doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
        FROM lines LEFT JOIN owners USING (key) GROUP BY doc_id""",
    "op2_quality_fences": r"""
        WITH c AS (
            SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents),
        runs AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, d) AS n
            FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS d
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3))),
        repeats AS (
            SELECT doc_id, count(DISTINCT at_word) AS n
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_word FROM runs WHERE n > 1) GROUP BY doc_id),
        counted AS (
            SELECT c.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
            FROM c LEFT JOIN repeats USING (doc_id)),
        based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
        measured AS (
            SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure,
                   unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
                           1000 * n_repeat_words // greatest(n_words, 1), 10 * word_chars // greatest(n_words, 1)]) AS value
            FROM based),
        grouped AS (
            SELECT grouping(lang, source) AS level, lang, source, measure, count(*) AS n,
                   list_sort(list(value - value % (2 ** greatest(length(bin(value)) - 10, 0))::BIGINT)) AS v
            FROM measured WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
        fenced AS (
            SELECT level, lang, source, measure, n, v[(n + 3) // 4] AS q1, v[(3 * n + 3) // 4] AS q3,
                   3 * greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 20 WHEN 'dup_lines' THEN 100 WHEN 'repeats' THEN 60 ELSE 10 END) AS reach
            FROM grouped),
        beyond AS (
            SELECT DISTINCT m.doc_id
            FROM measured m
            JOIN fenced o ON o.level = 0 AND o.measure = m.measure AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
            JOIN fenced g ON g.level = 1 AND g.measure = m.measure AND g.lang IS NOT DISTINCT FROM m.lang
            JOIN fenced a ON a.level = 3 AND a.measure = m.measure
            WHERE m.value > CASE WHEN o.n >= 200 THEN o.q3 + o.reach WHEN g.n >= 200 THEN g.q3 + g.reach ELSE a.q3 + a.reach END
               OR m.measure = 'word_length'
                  AND m.value < CASE WHEN o.n >= 200 THEN o.q1 - o.reach WHEN g.n >= 200 THEN g.q1 - g.reach ELSE a.q1 - a.reach END)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept
        FROM based""",
    "op11_conversation_repair": _conversation_sql(),
    "op12_phrase_mining": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
        grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM places),
        counted AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS v, count(*) AS f
            FROM grams WHERE i + k - 1 <= len(w) GROUP BY lang, k, phrase HAVING count(*) >= 100),
        totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
        cuts AS (
            SELECT lang, phrase, v, k, f, cut, array_to_string(v[1:cut], ' ') AS lp, array_to_string(v[cut + 1:k], ' ') AS rp
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1)),
        scored AS (
            SELECT c.lang, c.phrase, c.k, c.f AS a, lf.f AS l, rf.f AS r, n,
                   (1000::HUGEINT * c.f * n // (lf.f::HUGEINT * rf.f))::BIGINT AS score, cut
            FROM cuts c JOIN counted lf ON lf.lang = c.lang AND lf.phrase = c.lp JOIN counted rf ON rf.lang = c.lang AND rf.phrase = c.rp
            JOIN totals ON totals.lang = c.lang),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        kept AS (
            SELECT * FROM weakest s
            WHERE NOT EXISTS (SELECT 1 FROM counted o WHERE o.lang = s.lang AND o.k > s.k AND o.f >= s.a
                                AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
