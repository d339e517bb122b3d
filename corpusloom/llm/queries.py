"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, decontam, kdshard, langid, mainext, pii, quality, secrets, simhash
from corpusloom.llm.base import cut, scratch, table

#: The pseudonym key of the registered query; a deployment passes its own.
DEMO_KEY = "corpusloom-demonstration-key"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, DEMO_KEY)


def op2_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations. Of those whose number's crc32 modulo 4 is 2 the stored roles are hidden; they tell how many the model recovers."""
    hidden = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("role").alias("told"), F.when(~hidden, F.col("role")).alias("role"), "text")
    told = F.when((F.col("seg") == 0) & F.col("told").isin(*chat.ROLES), F.col("told"))
    out = chat.transcripts(chat.parse(turns, keep="told"), n_told=told.isNotNull().cast("int"), n_right=(told == F.col("role_pred")).cast("int"))
    return out.withColumn("held_out", hidden)


def op3_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = cut(quality.measured(docs, "text", keep=["doc_id", "lang"]))
    cutoffs = quality.calibrate(rows, table(spark, sf_dir, "labels"), "doc_id", "lang")
    failed = quality.base_failed()
    return rows.select("doc_id", *quality.BASE, failed.alias("base_failed"), (~failed & quality.verdict(cutoffs, "lang")).alias("kept"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=4, radius=4)
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op5_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crf = langid.fit(langid.training_rows(docs.where(~langid.held_out("doc_id")), "text", "lang", "doc_id"))
    out = langid.identify(docs, crf, "text", keep=["doc_id"])
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # Copies of a text differ in their source, so that isn't a dimension: they would be dealt apart.
    dims = {"lang": kdshard.of_string(F.col("lang"))}
    out = kdshard.kd_shards(docs, "doc_id", "text", dims, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainext.extract(table(spark, sf_dir, "pages"), "html", keep=["page_id", "url"])


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call keeps a ledger of its own, so that all its work is done in it: a first run over a sixteenth of the rows, then the run over all, which scans what the first did not."""
    docs, home = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "secret-ledger")
    secrets.scan_versions(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16 == 0), "doc_id", "text", home)
    found, _ = secrets.scan_versions(docs, "doc_id", "text", home)

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f.startswith(kind + ":"))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: F.split_part(f, F.lit(":"), F.lit(1)).isin(*secrets.BASE))
    digest = F.sha2(F.array_join(base, ",").cast("binary"), 256)
    return found.select("doc_id", *[count(k) for k in secrets.BASE], digest.alias("base_sha256"), F.array_join("findings", ",").alias("spans"))


def op9_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.bpe_encode(docs, TOKENIZER, "text", decoded=True, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_decontam_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), "text", window=8, keep=["doc_id"])
    items = F.size("item_ids").cast("bigint")
    return out.select(
        "doc_id", "n_words", "n_hit", items.alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (items >= 2).alias("contaminated")
    )


#: Windows as strings of words. Items of fewer words than eight, but not none, are one window.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.n, spot.i, win.item FROM spot JOIN win ON spot.n = win.n AND spot.s = win.s),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM hit GROUP BY doc_id),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items.ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items.ids, ','), '')) AS items_sha256,
       coalesce(len(items.ids), 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The numbers of a text, and the rules' cutoffs by the exact binomial tail: P(X <= k) summed term by term in logarithms.
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, row_number() OVER () AS k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
(len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(replace(t, '!', '')) AS n_marks FROM w LEFT JOIN r USING (k)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, '') AS stratum, unnest([
struct_pack(rule := 'symbols', v := n_symbols::DOUBLE / nullif(word_chars, 0)), struct_pack(rule := 'capitals', v := n_upper::DOUBLE / nullif(n_letters, 0)),
struct_pack(rule := 'marks', v := n_marks::DOUBLE / nullif(n_words, 0)), struct_pack(rule := 'dup_lines', v := n_dup_lines::DOUBLE / nullif(n_lines, 0))]) AS x FROM m),
b AS (SELECT *, x.rule AS rule, floor(least(coalesce(x.v, 0), 1) * {quality.GRID})::INT AS bin FROM s),
q AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT stratum, rule, bin, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM b JOIN q USING (doc_id) GROUP BY ALL),
f AS (SELECT stratum, rule, sum(g) AS goods, sum(b) AS bads, {quality.LEVEL} / count(*) OVER () AS alpha FROM c GROUP BY stratum, rule),
u AS (SELECT f.*, cut, coalesce(sum(c.g), 0)::BIGINT AS kg, coalesce(sum(c.b), 0)::BIGINT AS kb FROM f, range(1, {quality.GRID + 1}) t(cut) LEFT JOIN c ON c.stratum = f.stratum AND c.rule = f.rule AND c.bin >= t.cut GROUP BY ALL),
p AS (SELECT *, goods = 0 OR kg > {quality.RATE / 4} * goods OR list_sum(list_transform(range(0, kg + 1), lambda i: exp(lgamma(goods + 1) - lgamma(i + 1) - CASE WHEN goods - i = 0 THEN 0 ELSE lgamma(goods - i + 1) END
+ i * ln({quality.RATE / 4}) + (goods - i) * ln(1 - {quality.RATE / 4})))) > alpha AS fails, kb / greatest(bads, 1) - kg / nullif(goods, 0) AS gain FROM u),
o AS (SELECT *, bool_or(fails) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS stopped FROM p),
cutoff AS (SELECT stratum, rule, arg_max(cut, struct_pack(gain := gain, cut := cut)) AS cut FROM o WHERE NOT stopped AND gain > 0 GROUP BY stratum, rule),
gone AS (SELECT DISTINCT b.k FROM b JOIN cutoff USING (stratum, rule) WHERE b.bin >= cutoff.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.k IS NULL AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) LEFT JOIN gone USING (k)
"""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Each rule's pattern, the group whose length counts (0: all), and the length it needs.
OP8_RULES = {
    "assign": (_any_case("(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    **{kind: (rule.pattern, 0, 1) for kind, (_, rule) in secrets.EXTRA.items()},
}
#: Matches are marked by two noncharacters; the text is cut there and lengths are summed.
OP8_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),\nmarked AS ("
    + " UNION ALL ".join(f"SELECT k, {n} AS ord, '{kind}' AS kind, string_split(regexp_replace(t, '{p}', '﷐\\0﷑', 'g'), '﷐') AS parts FROM d" for n, (kind, (p, _, _)) in enumerate(OP8_RULES.items()))
    + """),
cut AS (SELECT k, ord, kind, parts[i] AS part, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM marked WHERE len(parts) > 1)),
found AS (SELECT k, ord, kind, i, split_part(part, '﷑', 1) AS hit, sum(length(replace(part, '﷑', ''))) OVER (PARTITION BY k, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS a FROM cut),
spans AS (SELECT k, ord, kind, a, kind || ':' || a || ':' || (a + length(hit)) AS span FROM found WHERE i > 1 AND CASE """
    + " ".join(f"WHEN kind = '{kind}' THEN length(regexp_extract(hit, '{p}', {g})) >= {n}" for kind, (p, g, n) in OP8_RULES.items())
    + """ END),
every AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
string_agg(span, ',' ORDER BY a, ord) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN every USING (k)"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_feistel": op1_pii_feistel,
    "op2_chat_hmm": op2_chat_hmm,
    "op3_quality_risk": op3_quality_risk,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_langid_crf": op5_langid_crf,
    "op6_kd_shards": op6_kd_shards,
    "op7_html_blocks": op7_html_blocks,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_bpe_backtracking": op9_bpe_backtracking,
    "op10_decontam_automaton": op10_decontam_automaton,
}
ORACLES: dict[str, str] = {"op3_quality_risk": OP3_SQL, "op8_secret_ledger": OP8_SQL, "op10_decontam_automaton": OP10_SQL}
