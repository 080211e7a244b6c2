"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowaudit.llm import chatrepair, decontam, kdshard, langid, mixing, pii, quality, quotes, search, secretscan, simhash, unitdedup, urlrules
from rowaudit.llm.common import table

QUERIES = {}
ORACLE = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


@register("op2_quality_rules")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality.judge(docs, quality.fit_weights(docs, trusted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "llr")


@register("op5_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
        ([5.0::DOUBLE, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM w)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(lev) FROM l) * w) AS target FROM l),
b AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
        CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS e,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size, d.text
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(e * size + least(greatest(budget - e * source_size - ahead, 0), size) AS BIGINT) AS taken
FROM p
""")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op8_secret_scan")
def op8(spark, sf_dir):
    found = secretscan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


_OP9 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (
  SELECT page_id,
    translate(regexp_extract(u, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    least(%PATTERNS%) AS p
  FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN p IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN p END AS pattern_rule
FROM r
"""
_PATTERNS = ", ".join(
    f"CASE WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}' END" for r in urlrules.PATTERN_RULES)


@register("op9_url_rules", _OP9.replace("%PATTERNS%", _PATTERNS))
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.apply_rules(pages, urlrules.HOST_RULES + urlrules.PATTERN_RULES).drop("url")


@register("op6_simhash")
def op6(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@register("op3_kd_shards")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return kdshard.shard_table(docs, shards=24).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op1_string_tiling")
def op1(spark, sf_dir):
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_tokens", "covered", "share", F.size("tiles").cast("long").alias("n_tiles"))


@register("op7_unit_dedup")
def op7(spark, sf_dir):
    gone = unitdedup.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gone.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("first_id").alias("first_doc_id"), "first_start")


@register("op10_langid")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs.select("doc_id", "text"), langid.train(docs))


@register("op4_quote_links")
def op4(spark, sf_dir):
    msgs = quotes.messages(table(spark, sf_dir, "conversations"))
    msgs = msgs.withColumn("own_md5", F.md5(quotes.own_text(F.col("text"))))
    return quotes.reply_order(msgs, ("own_md5",)).select(
        F.col("conv").alias("conv_id"), "turn", "role", "own_md5", "position", "parent_conv", "parent_turn", "n_quotes", "n_linked",
        "root_conv", "root_position", "depth", "thread_position")


@register("op11_lexical_search", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
           FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
e AS (SELECT r, unnest(t) AS term FROM d),
f AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_all),
c AS (SELECT q.item_id, d.r, d.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * len(d.t) * n_all) // l_all)))) AS BIGINT) AS score
      FROM f JOIN w USING (term) JOIN q USING (term) JOIN d USING (r), s GROUP BY q.item_id, d.r, d.doc_id),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
      FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""")
def op11(spark, sf_dir):
    found = search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def damaged(chats):
    """The faults of the contract, dealt by crc32 of conversation and turn."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(at("text"), "[.!?]", "")).otherwise(at("text"))
    role = F.when(hit == 4, "user").otherwise(at("role"))
    copies = F.array_repeat(F.lit(1), F.when(hit == 3, 2).otherwise(1))
    return chats.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _op12_sql() -> str:
    """Backward steps over the states 1 to 4 (nothing yet, after s, after u, after a); v holds, by
    state, the cost, the audit and the text of the cheapest repair of what is left."""
    due = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}
    keeps = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}

    def edit(cost, letter, line, rest):
        text = f"v[{rest}].o" if line is None else f"{line} || v[{rest}].o"
        return f"{{'c': v[{rest}].c + {cost}, 'a': '{letter}' || v[{rest}].a, 'o': {text}}}"

    def plain(q):
        extra, (to, name) = "(f = 2)::INT", due[q]
        deleted = edit(3, "D", None, q)
        renamed = edit(f"2 + {extra}", "R", f"chr(10) || '{name}:' || m.t", to)
        keep = "".join(f"WHEN m.i = '{i}' THEN [{edit(extra, 'K', "chr(10) || m.r || ':' || m.t", p)}] " for i, p in keeps[q].items())
        return f"list_min([{deleted}] || CASE WHEN f = 0 THEN [] ELSE [{renamed}] || CASE {keep}ELSE [] END END)"

    def inserted(q):
        (to, name), (to2, name2) = due[q], due[due[q][0]]
        one = f"{{'c': v[{to}].c + 2, 'a': 'I' || v[{to}].a, 'o': chr(10) || '{name}:' || v[{to}].o}}"
        two = f"{{'c': v[{to2}].c + 4, 'a': 'II' || v[{to2}].a, 'o': chr(10) || '{name}:' || chr(10) || '{name2}:' || v[{to2}].o}}"
        return f"list_min([v[{q}], {one}, {two}])"

    end = "[{'c': 0, 'a': '', 'o': ''}, {'c': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}, " \
          "{'c': 2, 'a': 'I', 'o': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 'o': ''}]"
    return rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::BIGINT, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END), 4294967295::BIGINT)) % 20 AS hit
  FROM conversations),
r AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS r,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS t,
    unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM x WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, copy) AS pos,
        row_number() OVER (PARTITION BY conv_id, r, t ORDER BY turn NULLS FIRST, copy) AS said FROM r),
f AS (SELECT conv_id, turn, pos, r, t, left(r, 1) AS i, t = '' OR NOT regexp_matches(t, '[^\x20\x09-\x0D]') AS blank, said > 1 AS again,
        right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM n),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        list({{'i': i, 'r': r, 't': t, 'f': CASE WHEN blank OR again THEN 0 WHEN cut THEN 2 ELSE 1 END}} ORDER BY pos) AS m,
        count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated FROM f GROUP BY conv_id),
b AS (
  SELECT conv_id, m AS ms, n AS pos, {end} AS v FROM g
  UNION ALL
  SELECT conv_id, ms, pos - 1, [{", ".join(inserted(q) for q in (1, 2, 3, 4))}] FROM (
    SELECT conv_id, ms, pos, [{", ".join(plain(q) for q in (1, 2, 3, 4))}] AS v
    FROM (SELECT conv_id, ms, pos, v, ms[pos] AS m, ms[pos].f AS f FROM b WHERE pos > 0))),
s AS (SELECT conv_id, v[1] AS best FROM b WHERE pos = 0),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(len(list_filter(range(1, n), lambda k: m[k].i || m[k + 1].i NOT IN ('su', 'ua', 'au'))), 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@register("op12_chat_repair", _op12_sql())
def op12(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = chatrepair.repair(damaged(chats))
    ids = chats.select(F.col("conv_id").alias("conv")).distinct().alias("i")
    got = ids.join(fixed.summary.alias("s"), F.col("i.conv").eqNullSafe(F.col("s.conv")), "left").join(
        chatrepair.digests(fixed).alias("d"), F.col("i.conv").eqNullSafe(F.col("d.conv")), "left")
    longs = [F.coalesce(f"s.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select(F.col("i.conv").alias("conv_id"), *longs, F.coalesce("s.audit", F.lit("")).alias("audit"),
                      F.coalesce("d.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op13_pii")
def op13(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")
