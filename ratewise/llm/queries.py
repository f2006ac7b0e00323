"""Registered queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from ratewise.llm.bpe import round_trip
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN).drop("text")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm import toxicity
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), toxicity.ORDER)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.jaccard import jaccard_components
    return jaccard_components(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
                  ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, (place_ % 3)::INT AS place, [5, 2, 1][(place_ % 3) + 1] AS weight
      FROM (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place_ FROM src)),
o AS (SELECT *, row_number() OVER o AS position, sum(cap) OVER o - cap AS caps_before, sum(weight) OVER o - weight AS weight_before,
             sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source COLLATE "C" NULLS LAST)),
lv AS (SELECT (words * 3)::DOUBLE / 2 - caps_before AS num, (weights - weight_before)::DOUBLE AS den FROM o
       WHERE ((words * 3)::DOUBLE / 2 - caps_before) * weight <= cap::DOUBLE * (weights - weight_before) ORDER BY position LIMIT 1),
t AS (SELECT source, source_size, place, least(cap::DOUBLE, weight * num / den) AS target FROM o, lv),
c AS (SELECT d.*, source_size, place, target, floor(target + 0.5)::BIGINT AS whole,
             (sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id NULLS FIRST, size
                              ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(greatest(whole - c, 0), size) + least(greatest(whole - source_size - c, 0), size))::BIGINT AS taken
FROM c
"""


OP1_SQL = """
WITH RECURSIVE
one AS (SELECT vec_id, min({v: embedding, l: label}) FILTER (WHERE label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
          AND len(list_filter(embedding, lambda e: e <> 0)) > 0) AS u FROM embeddings GROUP BY vec_id),
e AS (SELECT vec_id, u.l AS label, u.v::DOUBLE[] AS v FROM one WHERE u IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.v) = len(b.v)
          WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS to_ FROM one UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.to_ = links.a),
c AS (SELECT id, min(to_) AS component_id FROM reach GROUP BY id)
SELECT c.id AS vec_id, (SELECT count(*) FROM links WHERE links.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c
"""


@query("op1_near_vectors", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.near_vectors import near_vectors
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.mixing import plan
    out = plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return (out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")    # untaken rows spread by id
            .select("doc_id", "size", "source_size", "target", "taken"))


OP4_SQL = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) FILTER (WHERE len(embedding) > 0
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0) AS e FROM embeddings
           WHERE vec_id IS NOT NULL GROUP BY vec_id),
c AS (SELECT vec_id, list_transform(e, lambda x: floor(x * 64)) AS e FROM v WHERE e IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM c q JOIN c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""


@query("op4_bit_slices", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.bit_slices import top_k
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# The control strings of the template, escaped as the operator does it.
OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE)', '\1\\\2\3', 'g') AS body,
             regexp_replace(replace(replace(replace(role, '\', '\\'), ']', '\]'), chr(10), '\n'), '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE)', '\1\\\2\3', 'g') AS name FROM c),
f AS (SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN ' ' || body || ' </s>'
                WHEN 'system' THEN '<<SYS>>' || chr(10) || body || chr(10) || '<</SYS>>' || chr(10) || chr(10)
                ELSE '[ROLE ' || name || ']' || chr(10) || body || chr(10) || '[/ROLE]' || chr(10) END AS shown FROM e)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.chat import format_conversations, read_back
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return (read_back(format_conversations(rows.unionByName(probe)))
            .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


@query("op2_training_order")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from ratewise.llm.training_order import training_order
    out = training_order(read(spark, sf_dir, "documents").select("doc_id", "text"), 20_240_817,
                         public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("slot", "sequence", "first_doc", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def _licence_sql() -> str:
    """The operator's tables as SQL values."""
    from ratewise.llm.licences import RULES, SENTENCES, _sequence
    table = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    steps, found = ["seq"], []
    for name, ids in rules:
        found.append(f"CASE WHEN contains({steps[-1]}, '{_sequence(ids)}') THEN '{name}' END")
        steps.append(f"replace({steps[-1]}, '{_sequence(ids)}', '|')")
    return rf"""
WITH known(s, id) AS (VALUES {table}),
cut AS (SELECT doc_id, string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '([.!?;])[ \t]+', '\1' || chr(10), 'g')),
               '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS parts FROM documents),
one AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS n FROM cut),
seqs AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY n) AS seq, count(*) AS n FROM one JOIN known ON trim(p, ' ') = s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(seq, '') AS sequence,
       coalesce(list_aggregate(list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))), 'string_agg', ','), '') AS licences
FROM documents d LEFT JOIN (SELECT *, seq AS s0 FROM seqs) q ON d.doc_id = q.doc_id
"""


@query("op3_licences", _licence_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.licences import scan
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"),
                      F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("sequence"),
                      F.array_join("licences", ",").alias("licences"))


# Fetch dates and the dated list are derived from the pages themselves: a page's
# date from its id; entries from its host, the first segment of its path and
# (every tenth page) its URL, dated and dealt by an md5 of the key.
OP6_SQL = r"""
WITH cap AS (SELECT row_number() OVER () AS r, page_id, url, DATE '2021-01-01' + (page_id * 7919 % 1461)::INT AS fetched_at,
       lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS h,
       regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM pages),
parts AS (SELECT *, string_split(h, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM cap WHERE h <> ''),
keyed AS (SELECT r, fetched_at, unnest(list_distinct(
       list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.'))
       || list_transform(range(1, len(segs) + 1), lambda i: 'p:' || h || '/' || array_to_string(segs[1:i], '/') || '/')
       || ['u:' || h || rest])) AS key FROM parts),
names AS (SELECT DISTINCT 'd:' || h AS key FROM parts UNION SELECT 'p:' || h || '/' || segs[1] || '/' FROM parts WHERE len(segs) > 0
          UNION SELECT 'u:' || h || rest FROM parts WHERE page_id % 10 = 0),
hashed AS (SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS a, ('0x' || substr(md5(key), 5, 4))::INT AS b FROM names),
events AS (SELECT key, CASE WHEN a % 3 = 0 THEN 'allow' ELSE 'block' END AS action, DATE '2021-01-01' + (a % 1200)::INT AS day FROM hashed
  UNION ALL SELECT key, 'remove', DATE '2021-01-01' + (a % 1200 + 30 + b % 400)::INT FROM hashed WHERE b % 4 <> 0
  UNION ALL SELECT key, 'block', DATE '2021-01-01' + (a % 1200 + 500 + b % 300)::INT FROM hashed WHERE b % 5 = 0),
last AS (SELECT key, day, max(action) AS action FROM events GROUP BY key, day),
valid AS (SELECT * FROM (SELECT key, action, day AS f, lead(day) OVER (PARTITION BY key ORDER BY day) AS t FROM last) WHERE action <> 'remove'),
hit AS (SELECT r, k.key, action FROM keyed k JOIN valid v ON k.key = v.key AND fetched_at >= f AND (t IS NULL OR fetched_at < t)),
best AS (SELECT r, count(DISTINCT key) AS active,
       max({k: CASE key[1] WHEN 'u' THEN 3 WHEN 'p' THEN 2 ELSE 1 END, l: length(key), b: action = 'block', key: key}) AS top FROM hit GROUP BY r)
SELECT page_id, coalesce(active, 0) AS active, top.key AS matched, coalesce(top.b, false) AS blocked
FROM cap LEFT JOIN best ON cap.r = best.r
"""


def _dated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with fetch dates and a dated list, both derived from the pages."""
    from ratewise.llm.url_lists import ALLOW, BLOCK, REMOVE, keys
    day = lambda n: F.date_add(F.lit("2021-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.col("page_id") * 7919 % 1461).alias("fetched_at"))
    k = captures.select("page_id", keys(F.col("url")).alias("k")).where(F.size("k") > 0)
    paths = F.filter("k", lambda x: x.startswith("p:"))
    names = (k.select(F.element_at("k", 1).alias("key"))
             .union(k.where(F.size(paths) > 0).select(F.element_at(paths, 1)))
             .union(k.where(F.col("page_id") % 10 == 0).select(F.element_at("k", -1))).distinct())
    number = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 4), 16, 10).cast("int")
    h = names.withColumns({"a": number(1), "b": number(5)})
    start = F.col("a") % 1200
    entries = (h.select("key", F.when(F.col("a") % 3 == 0, ALLOW).otherwise(BLOCK).alias("action"), day(start).alias("at"))
               .union(h.where(F.col("b") % 4 != 0).select("key", F.lit(REMOVE), day(start + 30 + F.col("b") % 400)))
               .union(h.where(F.col("b") % 5 == 0).select("key", F.lit(BLOCK), day(start + 500 + F.col("b") % 300))))
    return captures, entries


@query("op6_url_lists", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.url_lists import filter_captures
    captures, entries = _dated(read(spark, sf_dir, "pages").select("page_id", "url"))
    return filter_captures(captures, entries).select("page_id", "active", "matched", "blocked")


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm import language_id
    from ratewise.llm.toxicity import held_out, remainder
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn(docs.where(remainder() != 0))
    return language_id.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _plant(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The texts with every tenth (by the id's crc32) made periodic from some word on."""
    out = []
    for doc_id, text in zip(ids.to_pylist(), texts):
        text = text.as_py()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and (words := (text or b"").split()):
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join(words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a])
        out.append(text)
    return pa.array(out, pa.binary())


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewise.llm.periodic_runs import periodic_runs
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs(docs, F.arrow_udf(_plant, "binary")(F.col("doc_id").cast("long"), F.col("text").cast("binary")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"),
                       F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from ratewise.llm.token_alignment import align
    docs, _ = align(read(spark, sf_dir, "documents").select("doc_id", "text"),
                    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
