"""The registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsearch.llm import (
    ann, exact, huffman, licenses, lines, negatives, packing, periods, pieces, quality, simhash, tools, warc,
)
from sigsearch.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tools.derived_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(tools.SCHEMAS, "name string, field string, type string, required boolean")
    return tools.format_calls(calls, results, schemas)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.derived_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "page", "refers_to", "status", warc.header_text(F.col("headers")).alias("headers"), "digest")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    sure = F.filter("found", lambda f: f["confirmed"])
    return found.select(
        "doc_id", "paragraphs", F.size("found").alias("licensed"), F.size(sure).alias("confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    back = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    first, last = min(vocabulary.byte_ids), max(vocabulary.byte_ids)
    return back.select(
        "doc_id", F.size("ids").alias("n_ids"), F.size(F.filter("ids", lambda i: i.between(first, last))).alias("n_byte_ids"),
        F.xxhash64("ids").alias("ids_hash"), F.xxhash64("text").alias("text_hash"))


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "lines_removed", F.length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mine(negatives.usable(vectors.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.described(periods.find_runs(periods.with_periods(table(spark, sf_dir, "documents"))))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = huffman.write_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return huffman.read_files(files).select(
        "doc_id", "start", F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_simhash": op2_simhash,
    "op3_revisits": op3_revisits,
    "op4_licenses": op4_licenses,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pieces": op6_pieces,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_repeated_lines": op9_repeated_lines,
    "op10_neighbours": op10_neighbours,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periods": op12_periods,
    "op13_token_files": op13_token_files,
}
ORACLE: dict[str, str] = {
    "op1_tool_calls": """
with recursive
calls as (
  select conv_id, 'c' || turn as call_id, turn, coalesce(text, '') as text,
         (['search', 'lookup', 'note', 'erase'])[((conv_id + turn) % 4 + 1)::int] as name,
         'c' || (turn // 2) as used
  from conversations where role = 'assistant'),
results as (
  select conv_id, 'c' || (turn - 1) as call_id, text as content, true as answered from conversations where role = 'user' and turn > 0),
depth(conv_id, call_id, level) as (
  select c.conv_id, c.call_id, 0 from calls c
  where c.used = c.call_id or not exists (select 1 from calls u where u.conv_id = c.conv_id and u.call_id = c.used)
  union all
  select c.conv_id, c.call_id, d.level + 1 from calls c join depth d on c.conv_id = d.conv_id and c.used = d.call_id and c.used <> c.call_id),
given as (
  select c.*, d.level, r.content, coalesce(r.answered, false) as answered,
         case when c.turn % 5 = 4 then null when c.conv_id % 7 = 3 then '"many"' else (c.conv_id % 50)::varchar end as lim,
         c.conv_id % 11 = 5 as color, c.conv_id % 2 = 0 as done
  from calls c join depth d using (conv_id, call_id) left join results r using (conv_id, call_id)),
judged as (
  select *, case when name = 'erase' then ['no tool erase'] else list_filter([
      case when name = 'note' and not done then 'missing done' end,
      case when name = 'search' and lim is null then 'missing limit' end,
      case when name in ('search', 'lookup') and lim = '"many"' then 'type limit' end,
      case when color then 'unknown color' end,
      case when name in ('search', 'lookup') and done then 'unknown done' end,
      case when name = 'note' and lim is not null then 'unknown limit' end], lambda e: e is not null) end as problems,
    case when answered then 'linked' else 'unanswered' end as status
  from given)
select conv_id, call_id, turn, level, status, len(problems) = 0 as valid, array_to_string(problems, '; ') as errors,
       '{"arguments":{' || case when color then '"color":"red",' else '' end || case when done then '"done":true,' else '' end
       || case when lim is not null then '"limit":' || lim || ',' else '' end || '"query":' || to_json(text)::varchar || '},"call":"' || call_id
       || '","conversation":' || conv_id || ',"errors":' || to_json(problems)::varchar || ',"level":' || level || ',"name":"' || name
       || '","result":' || coalesce(to_json(content)::varchar, 'null') || ',"status":"' || status || '"}' as line
from judged
union all
select conv_id, call_id, null, null, 'stray', true, '',
       '{"arguments":null,"call":"' || call_id || '","conversation":' || conv_id || ',"errors":[],"level":null,"name":null,"result":'
       || coalesce(to_json(content)::varchar, 'null') || ',"status":"stray"}'
from results where (conv_id, call_id) not in (select (conv_id, call_id) from calls)
""",
    "op3_revisits": r"""
with plain as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^https?://', '', 'i') as u from pages),
parts as (
  select page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
      lambda f: f <> '' and not regexp_matches(f, '^(utm_[a-z]+|gclid|fbclid)(=|$)', 'i'))) as fields
  from plain),
paged as (
  select page_id, html, host || path || case when len(fields) > 0 then '?' || array_to_string(fields, '&') else '' end as page,
    '"' || substr(md5(html), 1, 12) || '"' as tag, page_id % 97 as day from parts),
visits as (
  select *, page_id * 4 + n as record_id, case when n in (0, 2) then 'response' else 'revisit' end as kind,
    day * 10 + case n when 0 then 0 when 1 then page_id % 40 - 5 when 2 then 20 else page_id % 60 end as moment
  from paged cross join (values (0), (1), (2), (3)) v(n)
  where n = 0 or (n = 2 and page_id % 5 = 0) or (n in (1, 3) and page_id % 7 <> 6)),
records as (
  select record_id, page, kind, moment, 't' || moment as h_date, case when page_id % 4 <> 0 then 'd' || day end as h_mod,
    case when kind = 'response' then 'text/html' else 'text/plain' end as h_type,
    case when n <> 1 then 'max-age=' || record_id end as h_cache,
    case when kind = 'revisit' and page_id % 13 = 5 then null when n = 2 then '"new-' || substr(tag, 2, 20)
         when kind = 'revisit' and page_id % 11 = 3 then '"gone"' when kind = 'revisit' and page_id % 3 = 1 then 'W/' || tag else tag end as h_tag,
    md5(case when n = 2 then html || '2' else html end) as digest
  from visits),
carried as (
  select *, last_value(case when kind = 'response' then record_id end ignore nulls) over (
    partition by page order by moment, record_id rows between unbounded preceding and 1 preceding) as refers_to from records),
met as (
  select a.*, r.h_date as r_date, r.h_mod as r_mod, r.h_type as r_type, r.h_cache as r_cache, r.h_tag as r_tag, r.digest as payload,
    case when a.refers_to is null then 'orphan'
         when coalesce(case when a.h_tag is not null and r.h_tag is not null then regexp_replace(a.h_tag, '^W/', '') = regexp_replace(r.h_tag, '^W/', '')
              when a.h_mod is not null and r.h_mod is not null then a.h_mod = r.h_mod else a.digest = r.digest end, false) then 'resolved'
         else 'mismatch' end as status
  from carried a left join records r on a.refers_to = r.record_id where a.kind = 'revisit'),
fields as (
  select *, status = 'resolved' as ok from met)
select record_id, page, refers_to, status,
  array_to_string(list_filter([
    'cache-control: ' || case when ok then coalesce(h_cache, r_cache) else h_cache end,
    'content-type: ' || case when ok then r_type else h_type end,
    'date: ' || h_date,
    'etag: ' || case when ok then coalesce(h_tag, r_tag) else h_tag end,
    'last-modified: ' || case when ok then coalesce(h_mod, r_mod) else h_mod end], lambda x: x is not null), chr(10)) as headers,
  case when ok then payload end as digest
from fields
""",
    "op5_exact_dedup": """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(plain) as text_sha256
from t window w as (partition by plain)
""",
    "op11_hard_negatives": """
with fine as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from fine a join fine b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
met as (
  select p.anchor_id, p.positive_id, n.vec_id as negative_id, p.positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same
    and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from met where rank <= 10
""",
}
