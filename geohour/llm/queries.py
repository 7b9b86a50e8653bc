"""The registered queries of the operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geohour.llm import (
    decontaminate, extract, grades, licenses, middle, order_minhash, packing, quality_rules, simhash, spelling,
    suffixes, urls, warc,
)
from geohour.llm.common import prepare, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


WORDS_SQL = r"""list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query("op1_pack_mixture")
def op1_pack_mixture(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


LICENCE_SQL = r"""list_filter(regexp_split_to_array(lower(coalesce(text, '')),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
LICENCE_RUNS = """CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1),
  lambda i: array_to_string(w[i : i + 4], ' ')) END"""
LICENCE_ROWS = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.TEMPLATES)


# A window of 2n runs begins every n runs, so a run lies in the last one before it and in the one before that.
@query("op2_license_scan", f"""
WITH t AS (SELECT template, list_distinct({LICENCE_RUNS}) AS own FROM
  (SELECT template, {LICENCE_SQL} AS w FROM (VALUES {LICENCE_ROWS}) v(template, text))),
d AS (SELECT doc_id, {LICENCE_RUNS} AS s FROM (SELECT doc_id, {LICENCE_SQL} AS w FROM documents)),
own AS (SELECT template, len(own) AS n, unnest(own) AS run FROM t),
place AS (SELECT doc_id, unnest(range(0, len(s))) AS p, unnest(s) AS run FROM d),
met AS (SELECT doc_id, template, n, own.run, p // n AS k FROM place JOIN own ON place.run = own.run),
within AS (SELECT * FROM met UNION ALL SELECT doc_id, template, n, run, k - 1 FROM met WHERE k > 0),
shared AS (
  SELECT doc_id, template, k, count(DISTINCT run) / any_value(n) AS containment FROM within GROUP BY doc_id, template, k)
SELECT doc_id, template, max(containment) AS containment, min(k) AS first_window, count(*) AS n_windows
FROM shared WHERE containment >= 0.8 GROUP BY doc_id, template""")
def op2_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op4_extract_main_text")
def op4_extract_main_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit(pages))


@query("op3_decontaminate", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 10) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                lambda k: array_to_string(w[k : k + least(len(w), 10) - 1], ' '))) AS phrase
  FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
hit AS (
  SELECT DISTINCT dw.doc_id, k, dw.n, item_id FROM
    (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM dw) dw
    JOIN iw ON dw.phrase = iw.phrase AND dw.n = iw.n),
words AS (SELECT doc_id, count(*) AS n_hit FROM
  (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_grades")
def op5_grades(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    grader = grades.fit(docs, read(spark, sf_dir, "labels"))
    return grades.grade_texts(docs, grader).select("doc_id", "grading.*")


@query("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, forest).select("doc_id", "rules.*")


@query("op7_simhash_pivots")
def op7_simhash_pivots(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_suffix_repeats")
def op8_suffix_repeats(spark, sf_dir):
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


@query("op9_warc_derivatives")
def op9_warc_derivatives(spark, sf_dir):
    return warc.build_records(read(spark, sf_dir, "pages")).drop("record").withColumn(
        "is_derived", F.col("record_type") != "response")


# Fixed rules of the query: (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


@query("op10_url_filter", """
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, 'allow') AS verdict
FROM s LEFT JOIN best USING (page_id)""")
def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(read(spark, sf_dir, "pages"), rules)


@query("op11_spelling_variants", r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, length(b) // 2),
      lambda i: CAST('0x' || substr(b, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
    lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)]))) AS h
  FROM counted, crc),
voc AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
                     || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM voc)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN voc b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN voc b ON a.rest = b.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r,
         count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form,
         CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM voc v LEFT JOIN ranked ON v.word = ranked.word AND r = 1),
way AS (
  SELECT word, word AS top FROM formed UNION ALL
  SELECT way.word, form FROM way JOIN formed ON formed.word = way.top WHERE form IS NOT NULL)
SELECT formed.word, form, top AS root, n, n_near, form_n FROM formed JOIN way USING (word)
WHERE top IN (SELECT word FROM formed WHERE form IS NULL)""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.group_variants(spelling.vocabulary(spelling.noisy_words(read(spark, sf_dir, "documents"))))


@query("op12_order_minhash")
def op12_order_minhash(spark, sf_dir):
    return order_minhash.edited_fingerprints(read(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, p, len(p) - 1 + CASE WHEN p[-1] = '' THEN 0 ELSE 1 END AS n,
         list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM u),
s AS (
  SELECT *, array_to_string(p[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(p) THEN chr(10) ELSE '' END AS pre,
         array_to_string(p[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(p) THEN chr(10) ELSE '' END AS upto FROM c),
f AS (
  SELECT doc_id, t, n, pre, substr(upto, length(pre) + 1) AS mid, substr(t, length(upto) + 1) AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100
         THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f""")
def op13_fill_in_middle(spark, sf_dir):
    made = middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    return made.select(
        "doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"),
        fim["middle_chars"].alias("middle_chars"), F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(middle.restored(fim["output"], fim["form"]), 256).alias("restored_sha256"))
