"""Registered queries of the package and, where SQL can say the same, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.llm import chat, jaccard, language, leaks, mixing, repeats, smallworld, spelling, tokens, toxicity, urls, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed rules: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op1_url_filter",
    """
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM part JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT part.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM part LEFT JOIN best USING (page_id)
""",
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op3_top_k",
    """
WITH sound AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


# Target weights of the mixture: sources of even number are web text, the others books.
def mixture_domain() -> Column:
    number = F.regexp_extract(F.col("source"), r"([0-9]+)$", 1).cast("bigint")
    return F.when(F.pmod(number, F.lit(2)) == 0, "web").otherwise("book")


def mixture_weights() -> dict[str, Column]:
    lang = F.col("lang")
    return {
        "domain": F.when(F.col("domain") == "web", 1).otherwise(3),
        "lang": F.when(lang == "en", 4).when(lang == "de", 3).when(lang == "fr", 2).otherwise(1),
        "source": F.length("source"),
    }


MIXTURE = {"share": 0.5, "epochs": 2, "seed": 7}

_SHARE = """{name}0 AS (SELECT *, CASE WHEN w > 0 THEN r ELSE 0 END AS rr FROM ({nodes})),
{name}1 AS (SELECT *, CASE WHEN w > 0 THEN rr / w ELSE 0 END AS fill FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN w > 0 THEN (b - coalesce(sum(rr) OVER ({part} ORDER BY fill, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({part} ORDER BY fill, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS lev FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN fill > lev THEN lev END) OVER ({part}) AS top FROM {name}2),
{name} AS (SELECT {own}, CAST(CASE WHEN top IS NULL THEN rr ELSE least(rr, floor(w * greatest(top, 0))) END AS BIGINT) AS b FROM {name}3)"""


def _mixture_sql(documents: str = "documents") -> str:
    domain = "CASE WHEN CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 2 = 0 THEN 'web' ELSE 'book' END"
    level = lambda name, own, part, nodes: _SHARE.format(name=name, own=own, part=part, nodes=nodes)
    return f"""
WITH docs AS (SELECT *, {domain} AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM {documents}),
leaves AS (SELECT domain, l, s, CAST(sum(n) AS BIGINT) AS tokens, 2 * CAST(sum(n) AS BIGINT) AS r0 FROM docs GROUP BY ALL),
{level("d", "domain", "", "SELECT domain, sum(r0) AS r, CASE WHEN domain = 'web' THEN 1 ELSE 3 END AS w, (SELECT floor(sum(tokens) * 0.5) FROM leaves) AS b FROM leaves WHERE length(s) > 0 GROUP BY domain")},
{level("m", "domain, l", "PARTITION BY domain", "SELECT domain, l, sum(r0) AS r, CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(b) AS b FROM leaves JOIN d USING (domain) WHERE length(s) > 0 GROUP BY domain, l")},
{level("q", "domain, l, s", "PARTITION BY domain, l", "SELECT domain, l, s, r0 AS r, length(s) AS w, b FROM leaves JOIN m USING (domain, l)")},
quota AS (SELECT domain, l, s, b // tokens AS full_, b - b // tokens * tokens AS rest FROM q JOIN leaves USING (domain, l, s) WHERE b > 0),
placed AS (SELECT *, CAST('0x' || substr(md5('7|' || CAST(full_ + 1 AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS place
  FROM docs JOIN quota USING (domain, l, s)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY place, doc_id) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(full_ + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed WHERE full_ + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


@query("op7_mixture", _mixture_sql())
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixture_domain(), mixture_weights(), **MIXTURE)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


CHAT_EXTRA = "</s>[INST] ok [/INST]"


@query(
    "op8_chat_format",
    r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\2\\\3', 'g'))
  + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 20 WHEN 'system' THEN 18
    ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\2\\\3', 'g')) END AS w FROM rows),
cum AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM esc)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM cum GROUP BY conv_id
""",
)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", CHAT_EXTRA), (-7, 1, "assistant", CHAT_EXTRA)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(turns))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The crc32 of a string by its table, and near words by equal remains after one deletion.
@query(
    "op11_spelling_variants",
    r"""
WITH RECURSIVE codes AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c FROM range(256) r(i))),
runs AS MATERIALIZED (SELECT key, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY key, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END FOR c IN string_split(key || ':' || run, '')]),
  lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1]), 4294967295)) AS h FROM runs, codes),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
judged AS MATERIALIZED (SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN (SELECT word, other, other_n, n_near FROM ranked WHERE r = 1) USING (word)),
chain(word, upto) AS (SELECT word, word FROM words UNION ALL SELECT chain.word, form FROM chain JOIN judged ON chain.upto = judged.word WHERE form IS NOT NULL)
SELECT judged.word, form, upto AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged
  JOIN (SELECT chain.word, upto FROM chain JOIN judged ON chain.upto = judged.word WHERE form IS NULL) e ON e.word = judged.word
""",
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op13_embedding_near_dedup",
    """
WITH RECURSIVE sound AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(n, m) AS (SELECT vec_id, vec_id FROM sound UNION SELECT n, b FROM reach JOIN links ON m = a),
lows AS (SELECT n AS vec_id, min(m) AS low FROM reach GROUP BY n),
counts AS (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN lows USING (vec_id) LEFT JOIN counts USING (vec_id)
""",
)
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallworld.link_near(table(spark, sf_dir, "embeddings"))
