"""The registered queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrecon.llm import bpe, hnsw, html, langid, mixing, pieces, pii, simhash, topk, toxicity, variants, warc, whitening
from gridrecon.llm.common import crc_mod

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PII_KEY = "surrogates-1"
EPOCHS, FRACTION, SEED = 2, 0.6, 7
WEIGHTS: dict[tuple[str, ...], int] = {("web",): 3, ("books",): 2, ("code",): 1} | {
    (d, k): w for d in ("web", "books", "code") for k, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain() -> Column:
    """Domain of a source: documents has no such column, so the first digit of the name's MD5 decides."""
    first = F.substring(F.md5("source"), 1, 1)
    return F.when(first <= "4", "web").when(first <= "9", "books").otherwise("code")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = toxicity.classify(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), domain(), FRACTION, EPOCHS, SEED, WEIGHTS)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities", "kinds")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.sample(docs, crc_mod("doc_id", 3) != 1)
    out = langid.identify(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_ranks(spark, RANKS)).drop("n_pieces")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.read_model(spark, PIECES))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_topk, op2_warc, op3_toxicity, op4_mixing, op5_html, op6_pii, op7_langid, op8_simhash, op9_hnsw, op10_bpe,
            op11_variants, op12_pieces, op13_whitening,
        )
    }


SQL_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((((instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
            + instr('0123456789abcdef', coalesce(nullif(substr(h, CAST(5 * i // 4 + 2 AS BIGINT), 1), ''), '0')) - 1)
           >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM m
"""


def _sql_share(source: str, parent: str, names: str, weight: str) -> str:
    """Water filling among the children of each parent; source has budget and cap."""
    return f"""
    SELECT * EXCLUDE (w, fore, rest, is_full), CAST(CASE WHEN is_full THEN cap ELSE least(cap,
             (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent})) * w
             // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent})) END AS BIGINT) AS quota
    FROM (SELECT *, fore * w + cap * rest <= budget * w AS is_full
          FROM (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fore,
                       sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {names} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                FROM (SELECT *, CAST({weight} AS BIGINT) AS w FROM {source})))"""


SQL_MIXING = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN substr(md5(source), 1, 1) <= '4' THEN 'web' WHEN substr(md5(source), 1, 1) <= '9' THEN 'books' ELSE 'code' END AS domain,
         lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
one AS (SELECT domain, 0 AS top, CAST(sum(cap) AS BIGINT) AS cap, (SELECT least(sum(cap), CAST(floor(sum(cap) / {EPOCHS} * CAST({FRACTION} AS DOUBLE)) AS BIGINT)) FROM leaves) AS budget FROM leaves GROUP BY domain),
q1 AS ({_sql_share("one", "top", "domain", "CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END")}),
two AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(q1.quota) AS budget FROM leaves l JOIN q1 USING (domain) GROUP BY ALL),
q2 AS ({_sql_share("two", "domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")}),
three AS (SELECT l.*, q2.quota AS budget FROM leaves l JOIN q2 ON l.domain = q2.domain AND l.lang IS NOT DISTINCT FROM q2.lang),
q3 AS ({_sql_share("three", "domain, lang", "source", "1")}),
e AS (
  SELECT d.*, CASE WHEN available > 0 THEN quota // available ELSE 0 END AS whole, CASE WHEN available > 0 THEN quota % available ELSE 0 END AS part
  FROM d JOIN q3 ON d.domain = q3.domain AND d.lang IS NOT DISTINCT FROM q3.lang AND d.source IS NOT DISTINCT FROM q3.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || whole || '|' || doc_id), doc_id) AS run FROM e)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN run <= part THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r WHERE whole + CASE WHEN run <= part THEN 1 ELSE 0 END > 0
"""

SQL_HNSW = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
c AS (SELECT vec_id AS id, vec_id AS low FROM v UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id WHERE c.low < e.b)
SELECT id AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(low) AS component_id, id = min(low) AS kept
FROM c LEFT JOIN n ON n.a = c.id GROUP BY id
"""

SQL_VARIANTS = r"""
WITH RECURSIVE runs AS (
  SELECT d, run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
               translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents) GROUP BY ALL),
bits AS (
  SELECT *, flatten(list_transform(flatten(list_transform(string_split(d || ':' || run, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END)),
           lambda b: list_transform(range(8), lambda k: CAST((b >> CAST(k AS INTEGER)) & 1 AS BIGINT)))) AS bits
  FROM runs),
sums AS (
  SELECT d, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS h
  FROM bits),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS other_n, first(other ORDER BY other_n DESC, encode(other)) AS other FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_variants": SQL_VARIANTS, "op1_topk": SQL_TOPK, "op2_warc": SQL_WARC, "op4_mixing": SQL_MIXING, "op9_hnsw": SQL_HNSW}
