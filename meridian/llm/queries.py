"""Registered queries of the corpus operators and their SQL, read by __spark_entry__.py."""

from __future__ import annotations

from .common import table
from .divergence import divergences
from .exact_dedup import duplicate_groups
from .gru import score_documents
from .langid import identify
from .nearest import nearest
from .ngram_join import near_duplicates
from .packing import pack
from .pieces import Pieces, encode_documents
from .repair import damage_and_repair
from .secrets import RULES, find_secrets
from .simhash import simhash_groups
from .substring_dedup import drop_repeats
from .warc import round_trip


def op3_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op1_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), count_links=True)


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents"))


def op8_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


def op10_lm_score(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_ngram_join, op3_exact_dedup, op4_packing, op5_warc, op6_secret_scan, op7_suffix_dedup, op8_nearest, op9_sentencepiece, op10_lm_score, op11_source_divergence, op12_conversation_repair, op13_simhash)
}


def _span_sql() -> str:
    """Spans of every rule, their positions summed from the gaps between matches and the matches."""
    ours = {"hex": "[0-9a-f]{32,}"}  # the same rule without Java's possessive mark
    parts = []
    for number, rule in enumerate(RULES):
        pattern = ours.get(rule.kind, rule.pattern).replace("'", "''")
        parts.append(f"""
        SELECT k, {number} AS number, '{rule.kind}' AS kind, w, v, g,
               unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS v,
                     regexp_split_to_array(t, '{pattern}') AS g
              FROM d WHERE regexp_matches(t, '{pattern}')) WHERE true""")
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate(RULES))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(parts)}),
        p AS (SELECT k, number, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS s,
                     length(w[i]) AS n FROM m WHERE length(v[i]) >= CASE number {least} END),
        q AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM p),
        a AS (SELECT k, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
                     string_agg(x, ',' ORDER BY s, number) FILTER (number < 3) AS base, string_agg(x, ',' ORDER BY s, number) AS spans FROM q GROUP BY k)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a ON d.k = a.k"""


ORACLE = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_secret_scan": _span_sql(),
    "op8_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, octet_length(encode(h)) AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((get_bit(bits, 5 * i) * 16 + get_bit(bits, 5 * i + 1) * 8 + get_bit(bits, 5 * i + 2) * 4 + get_bit(bits, 5 * i + 3) * 2 + get_bit(bits, 5 * i + 4)) AS INTEGER), 1), '' ORDER BY i)
                FROM (SELECT CAST(range AS INTEGER) AS i FROM range(32))) AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM (SELECT *, CAST(unhex(sha1(h)) AS BIT) AS bits FROM g)""",
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        c AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS whole FROM c GROUP BY ALL HAVING count(*) >= 10),
        size AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM kept GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        cell AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(cell.n, 0) AS n,
                     CAST(1 + (1000000000 * (coalesce(cell.n, 0) + 2)) // (coalesce(total.n, 0) + 2 * size.v) AS HUGEINT) AS p,
                     CAST(1 + (1000000000 * (kept.whole + 2)) // (size.n + 2 * size.v) AS HUGEINT) AS q
              FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN cell USING (lang, source, term)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
    "op12_conversation_repair": """
        WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        harmed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS harm FROM raw, poly),
        live AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
                        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                 FROM (SELECT *, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) FROM harmed WHERE harm <> 0)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(sha256(text))) AS place,
                           rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM live),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM ordered),
        judged AS (SELECT conv_id, turn, role, text, place, before, substr(role, 1, 1) AS own, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || own NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM judged GROUP BY ALL),
        ids AS (SELECT *, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
        steps AS (SELECT c, place, role, text, own, fault FROM judged JOIN ids ON judged.conv_id IS NOT DISTINCT FROM ids.conv_id),
        -- edits before a row: none, or one or two rows inserted; then the row's own
        move AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'I', 5, 'u', chr(10) || 'user:'), ('', 'II', 10, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', '', 0, 's', ''), ('s', 'I', 5, 'u', chr(10) || 'user:'), ('s', 'II', 10, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
                 ('u', '', 0, 'u', ''), ('u', 'I', 5, 'a', chr(10) || 'assistant:'), ('u', 'II', 10, 'u', chr(10) || 'assistant:' || chr(10) || 'user:'), ('a', '', 0, 'a', ''), ('a', 'I', 5, 'u', chr(10) || 'user:'), ('a', 'II', 10, 'a', chr(10) || 'user:' || chr(10) || 'assistant:')) m(was, letters, price, now, lines)),
        edit AS (SELECT * FROM (VALUES ('', 'K', 's', 's'), ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'), ('', 'R', '', 'u'), ('s', 'R', '', 'u'), ('u', 'R', '', 'a'), ('a', 'R', '', 'u'), ('', 'D', '', ''), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a')) e(state, letter, needs, becomes)),
        walk AS (SELECT c, CAST(0 AS BIGINT) AS place, '' AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM ids
            UNION ALL
            SELECT w.c, s.place, e.becomes, min({'cost': CAST(w.best.cost + m.price + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND s.fault = 3 THEN 5 ELSE 0 END AS BIGINT),
                        'audit': w.best.audit || m.letters || e.letter,
                        'lines': w.best.lines || m.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || s.role || ':' || s.text ELSE chr(10) || CASE e.becomes WHEN 'u' THEN 'user:' ELSE 'assistant:' END || s.text END})
            FROM walk w JOIN steps s ON s.c = w.c AND s.place = w.place + 1 JOIN move m ON m.was = w.state JOIN edit e ON e.state = m.now
            WHERE (e.letter = 'D' OR s.fault IN (0, 3)) AND (e.letter <> 'K' OR e.needs = s.own) GROUP BY w.c, s.place, e.becomes),
        ended AS (SELECT w.c, min({'cost': w.best.cost + m.price, 'audit': w.best.audit || m.letters, 'lines': w.best.lines || m.lines}) AS best
                  FROM walk w JOIN ids USING (c) LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN move m ON m.was = w.state
                  WHERE w.place = coalesce(k.n, 0) AND (m.now = 'a' OR m.now = '') GROUP BY w.c)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
        FROM ids JOIN ended USING (c) LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
