"""The registered query of each operator of this subpackage, with its SQL text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqlytics.llm import decontaminate, fingerprints, importance, mixing, near_dup, quality, repeats, secrets, sharding, token_counts, toxicity, url_filter, whitening

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SHARD_BYTES = 1 << 20
#: Passages of 17 code points are sure to be seen, so a text of 22 or more shows that three quarters of it are unchanged.
GRAM, WINDOW = 8, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.rule_table(pages, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


URL_SQL = r"""
with recursive p as (
  select page_id, url, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), q as (
  select page_id, html, strpos(url, '://') > 0 as is_url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail
  from p
), tags as (
  select case when is_url then host || tail end as src, host, path, unnest(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) as raw
  from q
), refs as (
  select src, host, path, regexp_replace(regexp_replace(raw, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g'), '(?i)&(?:sol|#0*47|#x0*2f);', '/', 'g') as t from tags where raw <> ''
), halves as (
  select *, regexp_extract(t, '^[^?#]*') as part, regexp_extract(t, '^[^?#]*(\?[^#]*)', 1) as query,
    coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') as dir from refs
), whole as (
  select *, case when prefix(part, '/') then part else dir || part end as p from halves
), dotless as (
  select *, list_reduce(list_prepend('', string_split(substr(p, 2), '/')),
    lambda acc, x: case x when '..' then regexp_replace(acc, '/[^/]*$', '') when '.' then acc else acc || '/' || x end)
    || case when regexp_matches(p, '/\.\.?$') then '/' else '' end as clean from whole
), ends as (
  select src, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when prefix(t, '//') then 'http:' || t
    when not regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') then 'http://' || host || case when part = '' then path else clean end || query end as t from dotless
), edges as (
  select src, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(r, '^[^/?#]*([^#]*)', 1) as dst
  from (select src, substr(t, strpos(t, '://') + 3) as r from ends where strpos(t, '://') > 0) where src is not null
), linked as (
  select src as a, dst as b from edges where src <> dst union select dst, src from edges where src <> dst
), reach as (
  select a, b from linked union select r.a, e.b from reach r join linked e on r.b = e.a
), rules(action, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), names as (
  select b as node, regexp_extract(b, '^[^/?#]*') as host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) as path from reach group by b
), said as (
  select node, arg_max(action, length(rhost || rpath)) as action from names, rules
  where (host = rhost or suffix(host, '.' || rhost)) and prefix(path, rpath) group by node
), class as (
  select a as node, bool_or(action = 'allow') as ok from reach join said on b = node group by a
), ruled as (
  select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from (select distinct host, path from q), rules
  where (host = rhost or suffix(host, '.' || rhost)) and prefix(path, rpath) group by host, path
)
select page_id, q.host, q.path, rule, coalesce(action, case when not ok then 'block' end, 'allow') as verdict
from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, case when is_url then host || tail end as node from q) q
left join ruled on ruled.host = q.host and ruled.path = q.path left join class on class.node = q.node
"""


def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES).select("doc_id", "bytes", "shard", "shard_depth", "shard_bytes")


SHARD_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0) as bytes,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '/' || coalesce(text, '')), 1, 15))::bigint as h
  from documents
), b as (
  select depth, h >> (60 - depth) as p, sum(bytes) as total from d, range(0, 61) r(depth) group by 1, 2 having sum(bytes) <= {SHARD_BYTES}
), f as (
  select doc_id, bytes, h, min(depth) as depth, arg_min(total, depth) as total
  from d join b on b.p = d.h >> (60 - depth) group by doc_id, bytes, h
)
select doc_id, cast(bytes as bigint) as bytes, 'b' || case when depth > 0 then lpad(bin(h >> (60 - depth)), cast(depth as integer), '0') else '' end as shard,
  cast(depth as integer) as shard_depth, cast(total as bigint) as shard_bytes
from f
"""


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), s as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) as nth from d group by source
), w as (
  select *, case (nth - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w, 2 * source_size as most, 1.5::double * sum(source_size) over () as whole from s
), r as (
  select *, most <= (whole - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0)) * w
    / sum(w) over (o rows between current row and unbounded following) as is_full
  from w window o as (order by most / w, nth)
), f as (
  select *, coalesce(sum(most) filter (is_full) over (), 0) as taken_up, sum(w) filter (not is_full) over () as open_w from r
), t as (
  select source, cast(source_size as bigint) as source_size, case when is_full then most::double else least(most::double, (whole - taken_up)::double * w / open_w::double) end as target from f
), x as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(target) as bigint) as budget,
    coalesce(sum(size) over (partition by d.source order by md5(coalesce(cast(doc_id as varchar), '') || '/' || size), doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as prior
  from d join t on d.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when source_size = 0 then 0 else budget // source_size * size + least(size, greatest(0, budget % source_size - prior)) end as bigint) as taken
from x
"""


def toxic_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    rejected = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", rejected.alias("predicted"))


def prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def simhash_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


def block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def winnowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_edits(_table(spark, sf_dir, "documents"), GRAM, WINDOW)
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def transducer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return token_counts.over_limit(counted).select("doc_id", size, "n_tokens", "over_limit")


def secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.sha2(joined(F.filter("spans", lambda s: s.kind != "net")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, joined("spans").alias("spans"))


def head_tail_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.scored(docs, _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte: a table built by its rule, folded over the bytes of each distinct word
RESAMPLE_SQL = r"""
with recursive steps as (
  select list(list_reduce(range(0, 9), lambda acc, k: case when k = 0 then acc when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end, b)
    order by b) as t from range(0, 256) r(b)
), every as (
  select 'd' as kind, row_number() over () as id, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark
), w as (
  select kind, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from every
), runs as (
  select kind, id, unnest(w) as f from w
), crc as (
  select f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), cast(2 * i + 1 as bigint), 2))::bigint),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295::bigint), 4294967295) % 10000 as bucket
  from (select distinct f from runs), steps
), hits as (
  select kind, id, bucket from runs join crc using (f)
), totals as (
  select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from hits group by bucket
), gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select count(*) from hits where kind = 'd') + 10000)::double
    / ((s + 1)::double * ((select count(*) from hits where kind = 'b') + 10000)::double))) as gain from totals
), weights as (
  select id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from hits join gain using (bucket) where kind = 'd' group by id
), x as (
  select doc_id, coalesce(n, 0) as n, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from w left join weights using (id) where kind = 'd'
), s as (
  select doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from x
), r as (
  select *, n >= 20 as fit, row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) as nth, count(*) over (partition by n >= 20) as many from s
)
select doc_id, cast(n as bigint) as n_features, weight, cast(score as bigint) as score, case when fit and nth <= 10 * many // 100 then nth end as rank from r
"""


def whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.by_component(whitening.whitened(_table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judged(docs, quality.plan(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUALITY_SQL = r"""
with d as (
  select row_number() over () as id, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), g as (
  select id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') as g from (select id, w, unnest(range(1, len(w) - 3)) as i from d)
), c as (
  select id, count(distinct i + j) as n from (select id, i, count(*) over (partition by id, g) as n from g), range(0, 5) r(j) where n > 1 group by id
), p as (
  select id, max(n) as n from (
    select id, w[i] as a, w[i + 1] as b, count(*) as n from (select id, w, unnest(range(1, len(w))) as i from d) group by 1, 2, 3) group by id
), m as (
  select l.*, len(w) as n_words, list_sum(list_transform(w, lambda x: length(x))) as chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as symbols,
    len(lines) - len(list_distinct(lines)) as dups, coalesce(c.n, 0) as repeated, coalesce(p.n, 0) as pair
  from l left join c using (id) left join p using (id)
), b as (
  select *, n_words < 10 or 100 * repeated > 20 * n_words as failed,
    chars < 3 * n_words or chars > 10 * n_words or 100 * symbols > 10 * n_words or (dups >= 3 and 100 * dups > 30 * len(lines))
    or 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣▪]'))) > 90 * len(lines)
    or 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) > 30 * len(lines)
    or 100 * len(list_filter(w, lambda x: not regexp_matches(x, '\p{L}'))) > 20 * n_words or (n_words >= 100 and 200 * pair > 20 * n_words) as rejected
  from m
)
select doc_id, cast(n_words as bigint) as n_words, cast(coalesce(chars, 0) as bigint) as word_chars, cast(symbols as bigint) as n_symbols, cast(dups as bigint) as n_dup_lines,
  cast(repeated as bigint) as n_repeat_words, failed as base_failed, not failed and not rejected as kept
from b
"""


QUERIES = {
    "op1_redirect_filter": (url_redirects, URL_SQL),
    "op2_block_anchors": (block_anchors, None),
    "op3_winnowing": (winnowed, None),
    "op4_secret_network": (secret_network, None),
    "op5_extendible_shards": (extendible_shards, SHARD_SQL),
    "op6_prob_minhash": (prob_minhash, None),
    "op7_transducer_tokens": (transducer_tokens, None),
    "op8_simhash_windows": (simhash_decontaminate, None),
    "op9_source_mix": (mix_sources, MIX_SQL),
    "op10_toxic_ngrams": (toxic_ngrams, None),
    "op11_head_tail_resample": (head_tail_resample, RESAMPLE_SQL),
    "op12_block_whitening": (whiten_embeddings, None),
    "op13_quality_cascade": (quality_cascade, QUALITY_SQL),
}
