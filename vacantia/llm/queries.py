"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.exact_dedup import DigestIndex, bucket_count
from vacantia.llm.html_wrapper import extract_main_text
from vacantia.llm.lexical_search import rank_documents
from vacantia.llm.license_scan import LEAST_DICE, TEMPLATES, scan_licenses, size_bounds, template_bigrams
from vacantia.llm.line_crf import fit_line_field, score_quality
from vacantia.llm.ngram_join import near_duplicates
from vacantia.llm.packing import pack_documents
from vacantia.llm.sentencepiece_viterbi import decode_ids, encode_texts
from vacantia.llm.session import corpus_session
from vacantia.llm.substring_dedup import remove_repeats
from vacantia.llm.token_alignment import align_tokens
from vacantia.llm.topk_search import top_k
from vacantia.llm.toxicity import fit_toxicity, score_toxicity
from vacantia.llm.url_filter import SUFFIXES, Rule, filter_urls, host_of, path_of
from vacantia.sources.workspace import new_path

URL_RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    corpus_session(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes are the labels of the documents that the pages' paths name."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    labels = (
        _table(spark, folder, "labels")
        .groupBy("doc_id")
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    )
    named = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    outcomes = (
        pages.withColumn("named", named)
        .select(host_of(F.col("url")).alias("host"), F.expr("try_cast(named AS BIGINT)").alias("doc_id"))
        .join(labels, "doc_id", "left")
        .select("host", "bad")
    )
    return filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The documents come in two batches, the greater ids first, since those are to stay."""
    docs = _table(spark, folder, "documents")
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("doc_id", 0.5).alias("middle")).first()
    index = DigestIndex(spark, new_path(spark, "digests"), bucket_count(size.rows))
    later = F.coalesce(F.col("doc_id") <= F.lit(size.middle), F.lit(True))
    index.add(docs.where(~later))
    index.add(docs.where(later))
    found = index.resolve(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
    index.close()
    return found


def topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, every_row=True)


def packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(_table(spark, folder, "documents"), "byte_bpe_50k", keep_ids=False)
    return pieces.drop("ids")


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents"), keep_text=False).drop("kept")


def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every text and decode it again."""
    model = "piece_bpe_32k.model"
    decoded = decode_ids(encode_texts(_table(spark, folder, "documents"), model), model)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return score_quality(docs, fit_line_field(docs, _table(spark, folder, "labels")))


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = fit_toxicity(docs, _table(spark, folder, "labels"))
    return score_toxicity(docs, model).drop("passages")


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(_table(spark, folder, "documents").select("doc_id", "text"))
    licences = F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",")
    best = F.coalesce(F.floor(F.array_max(F.col("matches.dice")) * 1000), F.lit(0))
    return found.select("doc_id", licences.alias("licences"), F.size("matches").alias("n_matches"), best.alias("best_permille"))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(_table(spark, folder, "documents"), keep_groups=False).drop("groups")


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_table(spark, folder, "pages"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk_search,
    "op2_packing": packing,
    "op3_substring_dedup": substring_dedup,
    "op4_sentencepiece": sentencepiece,
    "op5_quality_classifier": quality,
    "op6_url_filter": url_filter,
    "op7_toxicity": toxicity,
    "op8_license_scan": license_scan,
    "op9_exact_dedup": exact_dedup,
    "op10_ngram_join": ngram_join,
    "op11_token_alignment": token_alignment,
    "op12_html_extraction": html_extraction,
    "op13_lexical_search": lexical_search,
}

def _license_sql() -> str:
    rows = []
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            bigrams = template_bigrams(text)
            fewest, most = size_bounds(len(bigrams), LEAST_DICE)
            rows.append(f"('{name}', {i}, {bigrams}, {fewest}, {most})")
    return f"""
WITH templates(licence, i, wanted, fewest, most) AS (VALUES {", ".join(rows)}),
units AS (
  SELECT row_no, unnest(string_split(coalesce(text, ''), chr(10))
           || list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n'),
                          lambda p: contains(trim(p, ' '), chr(10)))) AS unit
  FROM (SELECT text, row_number() OVER () AS row_no FROM documents)),
words AS (
  SELECT row_no, row_number() OVER () AS unit_no, string_split(trim(regexp_replace(translate(unit,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM units),
bigrams AS (
  SELECT row_no, unit_no,
         list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS b FROM words),
dice AS (
  SELECT row_no, unit_no, licence, 2.0 * len(list_intersect(b, wanted)) / (len(b) + len(wanted)) AS dice,
         max(2.0 * len(list_intersect(b, wanted)) / (len(b) + len(wanted))) OVER (PARTITION BY unit_no) AS best
  FROM bigrams JOIN templates ON len(b) BETWEEN fewest AND most
  WHERE 2 * len(list_intersect(b, wanted)) * {LEAST_DICE.denominator} >= {LEAST_DICE.numerator} * (len(b) + len(wanted))),
found AS (
  SELECT row_no, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_matches,
         CAST(floor(max(dice) * 1000) AS BIGINT) AS best_permille
  FROM dice WHERE dice = best GROUP BY row_no)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_matches, 0)::INTEGER AS n_matches, coalesce(best_permille, 0) AS best_permille
FROM (SELECT doc_id, row_number() OVER () AS row_no FROM documents) LEFT JOIN found USING (row_no)"""


ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10""",
    "op3_substring_dedup": r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT row_no, i, array_to_string(words[i:i + 34], ' ') AS w
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 33)) AS i FROM texts)),
starts AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT row_no, unnest(range(i, i + 35)) AS j FROM starts),
kept AS (
  SELECT row_no, string_agg(words[j], ' ' ORDER BY j) AS kept, count(*) AS n
  FROM (SELECT row_no, words, unnest(range(1, len(words) + 1)) AS j FROM texts) ANTI JOIN gone USING (row_no, j)
  GROUP BY row_no)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_no)""",
    "op8_license_scan": _license_sql(),
    "op6_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS seen, coalesce(sum(bad), 0) AS bad,
         CASE WHEN is_address THEN name WHEN two IN SUFFIXES_ THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
         CASE WHEN is_address THEN '' WHEN two IN SUFFIXES_ THEN two ELSE string_split(name, '.')[-1] END AS suffix
  FROM (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two,
               regexp_matches(name, '^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$') AS is_address
        FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM parts)) LEFT JOIN marks ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) AS BIGINT)
  GROUP BY host, name, two, is_address),
domains AS (SELECT domain, suffix, sum(seen) AS seen, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(seen) AS seen, sum(bad) AS bad FROM domains GROUP BY suffix),
base AS (SELECT (sum(bad) + 1) / (sum(seen) + 2) AS rate FROM suffixes),
levels AS (SELECT 'suffix' AS level, seen, bad FROM suffixes UNION ALL SELECT 'domain', seen, bad FROM domains
           UNION ALL SELECT 'host', seen, bad FROM hosts),
moments AS (SELECT level, count(*) AS g, sum(bad) / sum(seen) AS r, sum(seen) AS n, sum(seen * seen) AS n2,
                   sum(bad * bad / seen) AS k2 FROM levels WHERE seen > 0 GROUP BY level),
between_ AS (SELECT level, g, r, CASE WHEN g > 1 THEN (k2 - n * r * r - (g - 1) * r * (1 - r)) / (n - n2 / n) END AS b
             FROM moments),
weights AS (SELECT max(w) FILTER (level = 'suffix') AS ws, max(w) FILTER (level = 'domain') AS wd,
                   max(w) FILTER (level = 'host') AS wh
            FROM (SELECT level, CASE WHEN b IS NULL THEN 1.0::DOUBLE WHEN b <= 0 THEN 10000.0
                                     ELSE least(10000.0, greatest(1.0, r * (1 - r) / b - 1)) END AS w FROM between_)),
rated AS (
  SELECT h.host, (h.bad + wh * d.rate) / (h.seen + wh) AS rate, h.seen + wh + 1 AS n
  FROM hosts h JOIN (
    SELECT domain, (d.bad + wd * (s.bad + ws * base.rate) / (s.seen + ws)) / (d.seen + wd) AS rate
    FROM domains d JOIN suffixes s USING (suffix), weights, base) d USING (domain), weights)
SELECT page_id, host, path, rule, CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow'
    WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
    ELSE CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / n) >= 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parts)
LEFT JOIN rated USING (host)""".replace("SUFFIXES_", "(" + ", ".join(f"'{x}'" for x in SUFFIXES) + ")"),
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    # The given pages label their article and use two character references in it.
    "op12_html_extraction": r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'),
           '</?b>', '', 'g'), '<br>', ' ', 'g') AS article FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(article, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
           regexp_replace(replace(b, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS lines
  FROM articles)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10))) AS n_chars FROM blocks""",
    "op13_lexical_search": r"""
WITH words AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)),
asked AS (
  SELECT item_no, term, count(*) AS times FROM (
    SELECT item_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT text, row_number() OVER (ORDER BY item_id, text) AS item_no FROM (SELECT DISTINCT item_id, text FROM benchmark)))
  GROUP BY item_no, term),
lengths AS (SELECT row_no, count(*) AS n FROM words GROUP BY row_no),
corpus AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM lengths),
uses AS (SELECT row_no, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words
         WHERE term IN (SELECT term FROM asked) GROUP BY row_no, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM uses, corpus GROUP BY term, N_),
gains AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_))) AS gain
  FROM uses JOIN lengths USING (row_no) JOIN weights USING (term), corpus),
scores AS (SELECT item_no, row_no, any_value(doc_id) AS doc_id, CAST(sum(times * gain) AS BIGINT) AS score
           FROM gains JOIN asked USING (term) GROUP BY item_no, row_no)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS item_no FROM (SELECT DISTINCT item_id, text FROM benchmark))
  USING (item_no) WHERE rank <= 20""",
}
