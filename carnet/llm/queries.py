"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnet.llm import centroids, chat, decontam, langid, langmodel, merkle, mixing, neighbours, pii, simhash, tokencount, toxicity, urlfilter
from carnet.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_neighbours")
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


#: A document is rejected from this score on.
TOXIC_FROM = 0.3


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows of the held-out fold give no labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(docs, model, "t")
    return scored.select("doc_id", held.alias("held_out"), "t.score", (F.col("t.score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("t.passages").alias("n_passages"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_mix")
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"), with_text=False).taken()


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(read(spark, sf_dir, "documents"))
    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op6_lm")
def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = langmodel.train(docs.where(~held), part=F.xxhash64("doc_id"))
    scored = langmodel.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_tokens")
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = tokencount.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), "n")
    return counted.select("doc_id", "n.n_bytes", "n.n_tokens", (F.col("n.n_tokens") > tokencount.LIMIT).alias("over_limit"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), '<image:', '<\image:'), '<audio:', '<\audio:'), '<document:', '<\document:') AS body,
    replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), '<image:', '<\image:'), '<audio:', '<\audio:'), '<document:', '<\document:'), ':', '\:') AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 13) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op8_chat", CHAT_SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and digests of what is read back from the formatted text."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    chats = chat.format_chats(rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = chats.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Fixed rules of the URL query, and the words in a host name that put a page's address on the list.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SPAM_HOSTS = r"(^|[.-])(casino|bets|pills)([.-]|$)"

URL_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{urlfilter.TRACKING}'))) AS params,
    coalesce(contains(url, '://'), false) AS whole FROM pages),
judged AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, params, whole FROM parts),
named AS (
  SELECT *, CASE WHEN whole THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM judged),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{SPAM_HOSTS}') AND canonical IS NOT NULL)
SELECT n.page_id, n.host, n.path, n.rule,
  CASE WHEN n.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN n.rule IS NOT NULL OR l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM named n LEFT JOIN listed l ON n.canonical = l.canonical
"""


@query("op9_urls", URL_SQL)
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by the list of addresses that the table shows on spam hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urlfilter.host_of(F.col("url")).rlike(SPAM_HOSTS)).select("url")
    return urlfilter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


LEAK_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM (SELECT *, least(10, len(w)) AS n FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS lo, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM doc, sizes WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT d.doc_id, d.n, d.lo, x.item_id FROM doc_windows d JOIN windows x USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(lo, lo + n)) AS p FROM (SELECT DISTINCT doc_id, n, lo FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


@query("op10_leaks", LEAK_SQL)
def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found = decontam.find_hits(docs, items, "found")
    n_hit = decontam.n_hit(F.col("found"))
    return found.select("doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op11_langid")
def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows of the held-out fold teach nothing."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model, "found")
    return found.select("doc_id", held.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.second", "found.ambiguous")


def merkle_sql(source_levels: int = 6, top_levels: int = 5) -> str:
    """The manifest level by level: ``a`` holds the leaves with what they fold to, ``s`` and ``t`` the nodes of each level. A tree that has come to one node stays as it is."""
    def h(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"

    bits = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    head = " || ".join(h(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [f"""leafs AS (SELECT *, sha256({head} || {h('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {h("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered FROM documents)""",
            "s0 AS MATERIALIZED (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node, doc_id, leaf, tampered FROM leafs)",
            "a0 AS (SELECT doc_id, g, i, leaf, coalesce(tampered, leaf) AS folded, '' AS proof FROM s0)"]

    def climb(name: str, levels: int, key: str) -> None:
        for k in range(levels):
            ctes.append(f"{name}r{k} AS (SELECT g, i // 16 AS run, list(node ORDER BY i) AS nodes, any_value(total) AS total FROM (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS total FROM {name}{k}) GROUP BY g, i // 16)")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, run AS i, CASE WHEN total = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}r{k})")
            left, right = "array_to_string(nodes[1:i % 16], '')", "array_to_string(nodes[i % 16 + 2:], '')"
            ctes.append(f"""{key}{k + 1} AS (SELECT a.* REPLACE (i // 16 AS i, CASE WHEN total = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, CASE WHEN total = 1 THEN proof ELSE proof || {left} || {right} END AS proof)
                FROM {key}{k} a JOIN {name}r{k} r ON a.g IS NOT DISTINCT FROM r.g AND a.i // 16 = r.run)""")

    climb("s", source_levels, "a")
    ctes.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, node, g AS name FROM s{source_levels})")
    ctes.append(f"b0 AS (SELECT a.doc_id, 0 AS g, t0.i, a.leaf, t0.node AS subroot, a.folded, a.proof FROM a{source_levels} a JOIN t0 ON a.g IS NOT DISTINCT FROM t0.name)")
    climb("t", top_levels, "b")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM b{top_levels}, t{top_levels}"


@query("op12_manifest", merkle_sql())
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.manifest(docs).proofs().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, in integers; the nearest centroid is a minimum of (distance, number)."""
    ctes = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            "rows AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM kept)",
            f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM rows QUALIFY j < {k})"]
    for n in range(rounds + 1):
        gap = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': CAST({gap} AS BIGINT), 'j': j}}) AS best FROM rows, c{n} GROUP BY r)")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT j, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT best.j AS j, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
                FROM a{n} JOIN (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM rows) USING (r) GROUP BY best.j, i) GROUP BY j)""")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (j))")
    return f"""WITH {', '.join(ctes)}, found AS (SELECT r, best.j AS j, best.d AS d FROM a{rounds})
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM found JOIN rows USING (r) JOIN c{rounds} USING (j)"""


@query("op13_centroids", centroids_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds, with sums of distances and the centroid's digest."""
    return centroids.described(centroids.cluster(read(spark, sf_dir, "embeddings")))
