"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import round_trip
from panelcast.llm.conversation_repair import structure_repair
from panelcast.llm.exact_dedup import exact_groups
from panelcast.llm.html_wrappers import extracted
from panelcast.llm.langid import fitted, predicted, remainder
from panelcast.llm.lattice import near_copies
from panelcast.llm.lm import scored
from panelcast.llm.mixing import mixed
from panelcast.llm.ngram_join import similar_groups
from panelcast.llm.packing import packed
from panelcast.llm.secret_scan import BASE, scanned
from panelcast.llm.url_filters import Rule, host_rule, judged
from panelcast.llm.whitening import whitened
from panelcast.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


URL_RULES = [
    host_rule("net", "/", allow=False),
    host_rule("example.net", "/en/", allow=True),
    host_rule("example.com", "/de/", allow=False),
    host_rule("org", "/fr/", allow=True),
    *(Rule(None, f"*{word}*/**", allow=False, weight=0) for word in ("casino", "pills", "adult", "bets")),
    *(Rule(None, f"*{word}*", allow=False, weight=0) for word in ("casino", "pills", "adult", "bets")),
]


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op1_url_filters"] = r"""
WITH u AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), r AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, 'casino|pills|adult|bets') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def kind(name: str):
        return F.size(F.filter(base, lambda s: s.kind == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *map(kind, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), r AS (
    SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predicted(docs, fitted(docs, remainder("doc_id", 5) != 0))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")



@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"), F.array("source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair(table(spark, sf_dir, "conversations"))


def _cheaper(*options: str) -> str:
    """The least of (cost, audit) pairs written as texts of a cost of fixed width and the audit; nulls do not count."""
    return f"least({', '.join(options)})"


def _dearer(state: str, cost: str, edits: str) -> str:
    return f"lpad(({state}[:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {state}[10:] || '{edits}'"


# Forward over the rows of all conversations at once: for each state the least (cost, audit). States: 0 nothing yet, 1 after s,
# 2 after u, 3 after a. First rows are inserted (y), then the row is deleted, kept or given another role (z).
_INSERTED = f"""x0 AS y0, x1 AS y1, {_cheaper("x2", *(_dearer(x, "5", "I") for x in ("x0", "x1", "x3")))} AS y2,
    {_cheaper("x3", _dearer("x2", "5", "I"), _dearer("x0", "10", "II"), _dearer("x1", "10", "II"))} AS y3"""

ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE k AS (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[unicode(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split(key, '')])),
            lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) % 20 AS kind
    FROM k
), d AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM c, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS nr FROM d
), f AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        role[1] AS initial, coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY nr) || role[1], 'su') AS pair, count(*) OVER (PARTITION BY conv_id) AS n
    FROM o
), e AS (
    SELECT DISTINCT coalesce(conv_id::VARCHAR, 'null') AS conv, conv_id FROM conversations
), r AS (
    SELECT conv, 0::BIGINT AS nr, '000000000' AS x0, NULL::VARCHAR AS x1, NULL::VARCHAR AS x2, NULL::VARCHAR AS x3 FROM e
    UNION ALL
    SELECT conv, nr, {_dearer("y0", "2", "D")}, {_cheaper(_dearer("y1", "2", "D"), "CASE WHEN keep AND initial = 's' THEN " + _dearer("y0", "more", "K") + " END")},
        {_cheaper(_dearer("y2", "2", "D"), *("CASE WHEN keep THEN CASE WHEN initial = 'u' THEN " + _dearer(y, "more", "K") + " ELSE " + _dearer(y, "1 + more", "R") + " END END" for y in ("y0", "y1", "y3")))},
        {_cheaper(_dearer("y3", "2", "D"), "CASE WHEN keep THEN CASE WHEN initial = 'a' THEN " + _dearer("y2", "more", "K") + " ELSE " + _dearer("y2", "1 + more", "R") + " END END")}
    FROM (
        SELECT r.conv, f.nr, f.initial, f.fault NOT IN ('blank', 'duplicate') AS keep, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS more, {_INSERTED}
        FROM r JOIN f ON coalesce(f.conv_id::VARCHAR, 'null') = r.conv AND f.nr = r.nr + 1
    )
), s AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM f GROUP BY conv_id
), z AS (
    SELECT e.conv_id, e.conv, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, {_cheaper("x0", "y3")} AS won
    FROM (SELECT *, {_INSERTED} FROM r) r JOIN e ON e.conv = r.conv LEFT JOIN s ON coalesce(s.conv_id::VARCHAR, 'null') = e.conv WHERE r.nr = coalesce(s.n, 0)
), a AS (
    SELECT conv, unnest(string_split(won[10:], '')) AS edit, generate_subscripts(string_split(won[10:], ''), 1) AS i FROM z WHERE length(won) > 9
), b AS (
    SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv ORDER BY i) AS nr FROM a
), g AS (
    SELECT b.*, f.role, f.text, row_number() OVER (PARTITION BY b.conv ORDER BY i) - 1 AS place
    FROM b LEFT JOIN f ON edit <> 'I' AND coalesce(f.conv_id::VARCHAR, 'null') = b.conv AND f.nr = b.nr WHERE edit <> 'D'
), h AS (
    SELECT *, max(CASE WHEN place = 0 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS opened FROM g
), t AS (
    SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS body
    FROM h GROUP BY conv
)
SELECT z.conv_id, z.gaps, z.blank, z.duplicate, z.truncated, z.illegal, z.won[:9]::BIGINT AS cost, z.won[10:] AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM z LEFT JOIN t ON t.conv = z.conv
"""
