"""The registered queries of this subpackage, with production parameters, and the SQL that checks some of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteferry.llm.conversation_repair import conversation_key, damage, repair_conversations, repair_summary
from siteferry.llm.exact_dedup import exact_duplicates
from siteferry.llm.html_text import extract_text
from siteferry.llm.line_dedup import duplicate_lines
from siteferry.llm.mixing import mix
from siteferry.llm.near_dedup import near_duplicates
from siteferry.llm.packing import pack
from siteferry.llm.quality import quality_network, score_quality
from siteferry.llm.repeated_spans import remove_repeats
from siteferry.llm.spelling import spelling_variants, word_counts
from siteferry.llm.topk import top_k
from siteferry.llm.toxicity import score_toxicity, toxicity_model
from siteferry.llm.url_filter import judge_urls, rule_table

# Rules of the url query: host, path prefix, verdict. Fixed by its contract.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The vocabulary file that the packing query is defined with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), word_tokenizer())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, quality_network(documents, _table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_toxicity(documents, toxicity_model(documents, _table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    summary = repair_summary(repair_conversations(damage(conversations)))
    ids = conversations.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    counts = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    # of a conversation that lost every row nothing is left to repair
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(summary, "key", "left").drop("key").fillna(counts | nothing)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("spans", lambda s: s["end"] - s["start"])
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_topk": op2_topk,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_mix": op8_mix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversations": op11_conversations,
    "op12_repeats": op12_repeats,
    "op13_spelling": op13_spelling,
}

_OP2_SQL = """
WITH whole AS (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
    FROM whole AS q JOIN whole AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP9_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
    SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256
FROM n JOIN g ON n.t = g.t
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_OP10_SQL = rf"""
WITH RECURSIVE cut AS (
    SELECT page_id, html, url,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), placed AS (
    SELECT page_id, html, split_part(url, '://', 1) AS scheme, strpos(url, '://') > 0 AS whole,
        translate(regexp_extract(rest, '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
    FROM cut
), live AS (
    SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS page
    FROM placed WHERE whole AND regexp_matches(html, '(?i)canonical|http-equiv')
), tags AS (
    SELECT *, unnest(regexp_extract_all(page, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM live
), linked AS (
    SELECT *, replace(CASE
        WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b')
            THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
            THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        ELSE '' END, '&amp;', '&') AS target
    FROM tags
), aimed AS (
    SELECT host || path || query AS a, CASE
        WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
        WHEN starts_with(target, '//') THEN scheme || ':' || target
        WHEN starts_with(target, '/') THEN scheme || '://' || host || target
        WHEN NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')
            THEN scheme || '://' || host || regexp_extract('/' || ltrim(path, '/'), '^(.*/)', 1) || target
        END AS aim
    FROM linked WHERE target <> ''
), edges AS (
    SELECT a, translate(regexp_extract(split_part(aim, '://', 2), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || regexp_extract(split_part(aim, '://', 2), '^[^/?#]*([^#]*)', 1) AS b
    FROM aimed WHERE aim IS NOT NULL
), both_ways AS (
    SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
    SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES {_RULE_ROWS}
), places AS (
    SELECT host, path FROM placed
    UNION SELECT regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM both_ways
), ruled AS (
    SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
    FROM places JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
), spread AS (
    SELECT DISTINCT reach.a FROM reach JOIN ruled
        ON regexp_extract(reach.b, '^[^/?#]*') = ruled.host
        AND regexp_extract(reach.b, '^[^/?#]*([^?#]*)', 1) = ruled.path
    WHERE ruled.rule_verdict = 'block'
)
SELECT page_id, host, path, rule,
    coalesce(rule_verdict, CASE WHEN whole AND host || path || query IN (SELECT a FROM spread) THEN 'block' ELSE 'allow' END)
        AS verdict
FROM (SELECT page_id, host, path, query, coalesce(whole, false) AS whole FROM placed) AS p LEFT JOIN ruled USING (host, path)
"""

# The remainders of the sixteen half bytes, fixed values of the checksum.
_CRC_STEPS = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes as a SQL expression."""
    half = f"xor({{0}} >> 4, ({_CRC_STEPS})[({{0}} & 15) + 1])"
    taken = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    step = half.format(half.format("xor(c, b)"))
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {taken}), lambda c, b: {step}), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _edits(state: str, keeps: dict[str, str], to: str) -> str:
    """The cheapest edit of a turn in SQL: cost in nine digits, then the initials of this and all later edits."""
    put = lambda edit, cost, after: (
        f"printf('%09d', substr(v.{after}, 1, 9)::BIGINT + {cost}) || '{edit}' || substr(v.{after}, 10)"
    )
    cases = "".join(f" WHEN r.initial = '{role}' THEN {put('K', 'r.truncated', after)}" for role, after in keeps.items())
    free = f"CASE WHEN r.gone THEN NULL ELSE {put('R', '2 + r.truncated', to)} END"
    kept = f"CASE WHEN r.gone THEN NULL{cases} END"
    return f"least({put('D', 3, state)}, {free}, {kept}) AS {state}"


_INSERT = "least({0}, printf('%09d', substr({1}, 1, 9)::BIGINT + 2) || 'I' || substr({1}, 10)) AS {0}"
_INSERTS = ", ".join(_INSERT.format(s, to) for s, to in (("z", "u"), ("s", "u"), ("u", "a"), ("a", "u")))

_OP11_SQL = rf"""
WITH RECURSIVE shown AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), kinds AS (
    SELECT *, {_crc32("name")} % 20 AS kind FROM shown
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending
    FROM damaged
), faults AS (
    SELECT *, ending = '' AS blank,
        ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
        left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), r AS (
    SELECT *, blank OR duplicate AS gone, (NOT blank AND NOT duplicate AND right(ending, 1) NOT IN ('.', '!', '?'))::BIGINT AS truncated
    FROM faults
), sizes AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(truncated)::BIGINT AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id
), v AS (
    SELECT conv_id, n AS i, '000000000' AS z, '000000004II' AS s, '000000002I' AS u, '000000000' AS a FROM sizes
    UNION ALL
    SELECT conv_id, i, {_INSERTS} FROM (
        SELECT conv_id, i, {_INSERTS} FROM (
            SELECT v.conv_id, v.i - 1 AS i,
                {_edits("z", {"s": "s", "u": "u"}, "u")}, {_edits("s", {"u": "u"}, "u")},
                {_edits("u", {"a": "a"}, "a")}, {_edits("a", {"u": "u"}, "u")}
            FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.i = r.i
        )
    )
), best AS (
    SELECT conv_id, substr(z, 1, 9)::BIGINT AS cost, substr(z, 10) AS audit FROM v WHERE i = 0
), letters AS (
    SELECT conv_id, j, substr(audit, j, 1) AS edit
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)
), steps AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS k
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), joined AS (
    SELECT s.conv_id, s.edit, s.k, r.role, r.text, coalesce(max((s.edit = 'K' AND s.k = 1 AND r.initial = 's')::INT)
        OVER (PARTITION BY s.conv_id), 0) AS ahead
    FROM steps s LEFT JOIN r ON s.edit <> 'I' AND s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i
), lines AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - ahead) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines
    FROM joined WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN sizes ON c.conv_id IS NOT DISTINCT FROM sizes.conv_id
LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN lines ON c.conv_id IS NOT DISTINCT FROM lines.conv_id
"""

_OP12_SQL = """
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT id, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400
), strings AS (
    SELECT id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM starts
), repeated AS (
    SELECT id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)
), begun AS (
    SELECT id, i, coalesce(i > 200 + lag(i) OVER (PARTITION BY id ORDER BY i), true)::INT AS new FROM repeated
), numbered AS (
    SELECT id, i, sum(new) OVER (PARTITION BY id ORDER BY i) AS span FROM begun
), spans AS (
    SELECT id, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY id, span
), totals AS (
    SELECT id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY id
), between_spans AS (
    SELECT spans.id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY spans.id ORDER BY a), 0) + 1,
        2 * (a - coalesce(lag(b) OVER (PARTITION BY spans.id ORDER BY a), 0))) AS piece
    FROM spans JOIN d ON spans.id = d.id
), kept AS (
    SELECT id, string_agg(piece, '' ORDER BY a) AS pieces FROM between_spans GROUP BY id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN totals ON d.id = totals.id LEFT JOIN kept ON d.id = kept.id
"""

_OP13_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents
), counted AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS name, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, {_crc32("name")} AS h FROM counted
), damaged AS (
    SELECT n, CASE WHEN h % 97 = 0
        THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
    SELECT word, n, unnest(range(length(word))) AS i FROM words
), cuts AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM places
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts AS a JOIN cuts AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON cuts.rest = words.word
    UNION SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON cuts.rest = words.word
), ranked AS (
    SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place
    FROM near
), formed AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.other END AS form,
        CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
    FROM words AS w LEFT JOIN ranked AS r ON w.word = r.word AND r.place = 1
), ways AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON ways.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, ways.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN ways ON formed.word = ways.word JOIN formed AS ends ON ends.word = ways.root AND ends.form IS NULL
"""

ORACLES = {
    "op2_topk": _OP2_SQL,
    "op9_exact_dedup": _OP9_SQL,
    "op10_url_filter": _OP10_SQL,
    "op11_conversations": _OP11_SQL,
    "op12_repeats": _OP12_SQL,
    "op13_spelling": _OP13_SQL,
}
