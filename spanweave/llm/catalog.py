"""The queries of the operators, with the SQL that checks them where SQL can say it.

Every query applies its operator with production parameters to the whole of
its table; digest columns come from the operator's own results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.hosts import PUBLIC_SUFFIXES
from spanweave.sources.tables import read_table

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        LLM_QUERIES[name] = f
        if sql:
            LLM_ORACLES[name] = sql
        return f
    return put


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.langid import held_out, identify, train
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")), "text", F.col("lang"))
    return (identify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "accepted"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
r AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS dropped FROM l LEFT JOIN r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_query("op7_line_dedup", LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.lines import dedup_lines
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
        ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
fp AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM s GROUP BY doc_id),
rep AS (SELECT f, min(doc_id) AS r FROM fp GROUP BY f),
rs AS (SELECT r, g, hash(g) AS h FROM rep JOIN s ON s.doc_id = rep.r),
df AS (SELECT g, count(*) AS df FROM rs GROUP BY g),
pos AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY df, h, g) AS k FROM rs JOIN df USING (g)),
pre AS (SELECT r, g FROM pos JOIN n ON n.doc_id = pos.r WHERE k <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.r AS x, b.r AS y FROM pre a JOIN pre b ON a.g = b.g AND a.r < b.r),
inter AS (SELECT x, y, count(*) AS c FROM cand JOIN rs a ON a.r = x JOIN rs b ON b.r = y AND b.g = a.g GROUP BY x, y),
e AS (SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT r, r FROM rep UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN fp ON fp.doc_id = d.doc_id
LEFT JOIN rep ON rep.f = fp.f LEFT JOIN comp ON comp.x = rep.r
"""


@_query("op2_ngram_jaccard_join", NEAR_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.jaccard import similar_components
    return similar_components(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


LEAK_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM t),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(a) - 3, 1)),
        lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3] || ' ' || a[i + 4])) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, max(n.n) AS n_item, count(*) AS n_shared, count(*) / max(n.n) AS containment
FROM s b JOIN s d ON d.kind = 'd' AND b.kind = 'b' AND b.g = d.g JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 5 * count(*) >= 4 * max(n.n)
"""


@_query("op8_benchmark_decontamination", LEAK_SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.decontam import contaminated
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def byte_bpe(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@_query("op6_token_binary")
def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.pfor import read_ids, write_ids
    return read_ids(write_ids(read_table(spark, sf_dir, "documents"), byte_bpe()))


@_query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), byte_bpe())


@_query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.quality import judge
    out = judge(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), columns=["doc_id"], max_chars=None)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("natural"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance")))


@_query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a passage: their text after it, the spans, and where the passages still stand."""
    from spanweave.llm.paragraphs import dedup_passages
    out = dedup_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.where(F.size("removed") > 0).select("doc_id", F.col("kept_in").alias("kept_doc_ids"), "removed",
                                                   F.size("removed").alias("n_removed"), "text")


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.langid import held_out
    from spanweave.llm.toxicity import score, train
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return score(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


#: The rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

HOSTS_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id, 1 - quality AS bad FROM labels WHERE quality IN (0, 1)),
c AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x FROM p LEFT JOIN o ON o.doc_id = p.page_id GROUP BY host),
q AS (SELECT c.*, string_split(host, '.') AS parts FROM c),
h AS (SELECT host, n, x, k, array_to_string(parts[greatest(len(parts) - k, 1):], '.') AS domain, array_to_string(parts[greatest(len(parts) - k + 1, 1):], '.') AS suffix
      FROM (SELECT q.*, CASE WHEN array_to_string(parts[greatest(len(parts) - 1, 1):], '.') IN (PUBLIC) THEN 2 ELSE 1 END AS k FROM q)),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(dn) AS sn, sum(dx) AS sx FROM d GROUP BY suffix),
s1 AS (SELECT suffix, sn, sx, (t.x - sx) / nullif(t.n - sn, 0) AS top FROM s, (SELECT sum(n) AS n, sum(x) AS x FROM h) t),
sw AS (SELECT 1 / least(greatest(coalesce(sum(pow(sx / sn - top, 2) * sn - top * (1 - top)) / nullif(sum(top * (1 - top) * (sn - 1)), 0), 0.001), 0.001), 0.5) - 1 AS w
       FROM s1 WHERE sn > 0 AND top > 0 AND top < 1),
d1 AS (SELECT domain, dn, dx, coalesce((sx - dx + w * top) / (sn - dn + w), (sx - dx) / nullif(sn - dn, 0)) AS above FROM d JOIN s1 USING (suffix), sw),
dw AS (SELECT 1 / least(greatest(coalesce(sum(pow(dx / dn - above, 2) * dn - above * (1 - above)) / nullif(sum(above * (1 - above) * (dn - 1)), 0), 0.001), 0.001), 0.5) - 1 AS w
       FROM d1 WHERE dn > 0 AND above > 0 AND above < 1),
k AS (SELECT host, n, x, coalesce((dx - x + w * above) / (dn - n + w), (dx - x) / nullif(dn - n, 0)) AS mu FROM h JOIN d1 USING (domain), dw),
kw AS (SELECT 1 / least(greatest(coalesce(sum(pow(x / n - mu, 2) * n - mu * (1 - mu)) / nullif(sum(mu * (1 - mu) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS w
       FROM k WHERE n > 0 AND mu > 0 AND mu < 1),
b AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + w + 1)) AS bad_bound
      FROM (SELECT host, n, w, (x + w * coalesce(mu, 0)) / (n + w) AS mean FROM k, kw)),
r AS (SELECT p.*, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bad_bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN b ON b.host = r.host
""".replace("PUBLIC", ", ".join(f"'{x}'" for x in PUBLIC_SUFFIXES))


@_query("op3_url_filter", HOSTS_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes are the quality labels of the same number: 0 is a bad page."""
    from spanweave.llm.hosts import judge_urls
    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@_query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.whitening import whiten
    return whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.runs import longest, periodic_runs, with_planted_runs
    docs = with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (periodic_runs(docs)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(c.alias(k) for k, c in longest(F.col("runs")).items()),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


COPIES_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
"""


@_query("op13_exact_dedup", COPIES_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanweave.llm.exact import exact_groups
    return (exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"))
