"""One thin query per operator of this subpackage over the given tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


_TURN = r"length('<s>[INST][/INST]</s>') + length(regexp_replace(coalesce(role, '') || chr(0) || coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) - 1"


@query("op1_prefix_targets", rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered as (
  select *, {_TURN} as chars, row_number() over w as spot, count(*) over (partition by conv_id) as n,
    sum({_TURN}) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by spot)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by spot) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (role = 'assistant' or spot = n))::bigint as formatted_chars,
  count(*) filter (role = 'assistant' or spot = n) as n_examples
from numbered group by conv_id
""")
def op1_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.chat import expand_prefix_targets, read_conversations

    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text").unionByName(own)
    return read_conversations(expand_prefix_targets(rows))


VOCABULARY = "byte_bpe_50k.json"


@query("op2_keyed_token_shards")
def op2_keyed_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.shards import keys_of, locate, read_payloads, write_shards
    from proofline.session import scratch_path

    docs, path = table(spark, folder, "documents", "doc_id", "text"), scratch_path(spark, "shards")
    write_shards(docs, path, VOCABULARY, end_id=0)
    found = read_payloads(locate(keys_of(docs), path), path, VOCABULARY, digest_only=True)
    return found.selectExpr("key as doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.packing import pack_documents

    docs = table(spark, folder, "documents", "doc_id", "text")
    placed = pack_documents(docs, VOCABULARY, end_id=0)
    return placed.select(placed["key"].alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_digest_cache_counts")
def op5_digest_cache_counts(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from proofline.llm.counts import add_missing, count_tokens
    from proofline.session import scratch_path

    docs, path = table(spark, folder, "documents", "doc_id", "text"), scratch_path(spark, "counts")
    add_missing(docs.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 0), path, VOCABULARY)  # one half of the texts is known
    return count_tokens(docs, path, VOCABULARY)  # which finds it in the cache and encodes the other


@query("op6_weighted_mix", r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix:' || doc_id::varchar) as spot from documents
), sizes as (
  select source, coalesce(sum(size), 0)::bigint as source_size, count(*) as n from docs group by source
), weighed as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sizes
), rates as (
  select 0 as round, 0.0::double as rate, (select 1.5 * sum(source_size)::double / sum(weight) from weighed) as following
  union all
  select round + 1, following,
    (select case when count(*) filter (not 2 * source_size < r.following * weight) = 0 then r.following else
       (1.5 * sum(source_size)::double - coalesce(sum(2 * source_size) filter (2 * source_size < r.following * weight), 0)::double)
       / (sum(weight) filter (not 2 * source_size < r.following * weight)) end from weighed)
  from rates r where following > rate
), plan as (
  select source, source_size, least(2.0 * source_size::double, (select max(rate) from rates) * weight)::double as target from weighed
), placed as (
  select d.*, p.source_size, p.target,
    case when p.source_size > 0 then floor(p.target / p.source_size)::bigint else 0 end as epochs,
    coalesce(sum(size) over (partition by d.source order by spot, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join plan p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 0.5)::bigint - before)))::bigint as taken
from placed
""")
def op6_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from proofline.llm.mixing import mix, word_count

    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    return mix(docs, word_count(F.col("text"))).drop("source")


@query("op8_simhash_components")
def op8_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query("op9_redirect_equivalence", r"""
with recursive parts as (
  select page_id, url, html, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), hosts as (
  select *, regexp_extract(rest, '^[^/?#]*') as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, host, path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged as (
  select p.*, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    (select max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) from rules r
      where (p.host_lower = r.host or ends_with(p.host_lower, '.' || r.host)) and starts_with(p.path, r.path)) as own
  from (select *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host_lower from hosts) p
), edges as (
  select url as a, regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) as b from pages
  where html like '%<link rel="canonical" href="%'
), walk(a, b) as (
  select a, b from edges union select b, a from edges
  union select w.a, e.b from walk w join (select a, b from edges union select b, a from edges) e on w.b = e.a
), near as (
  select w.a, bool_or(j.own.verdict = 'allow') as allowed, bool_or(j.own.verdict = 'block') as blocked from walk w join judged j on j.url = w.b group by w.a
)
select j.page_id, j.host, j.path, j.own.rule as rule,
  coalesce(j.own.verdict, case when n.blocked and not coalesce(n.allowed, false) then 'block' end, 'allow') as verdict
from judged j left join near n on n.a = j.url
""")
def op9_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.urls import judge_urls

    return judge_urls(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op10_exact_top_k", """
with clean as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from (select * from clean where vec_id % 50 = 0) q join clean c on c.vec_id != q.vec_id and len(c.v) = len(q.v)
), ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from proofline.llm.vectors import top_k

    return top_k(table(spark, folder, "embeddings", "vec_id", "embedding"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query("op3_robust_outliers")
def op3_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.quality import judge

    return judge(table(spark, folder, "documents", "doc_id", "text", "lang", "source")).drop("distance")


@query("op7_boosted_pii")
def op7_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from proofline.llm.pii import KINDS, find_personal_data, told

    found = find_personal_data(table(spark, folder, "documents", "doc_id", "text"))
    number = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_phrase_collocations", rf"""
with docs as (select row_number() over () as doc, coalesce(lang, 'und') as lang, {_LOWER} as text from documents),
pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs)
), phrases as materialized (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from (
    select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest(range(1, 5)) as m from pieces) where len(w) >= m
  ) group by all
), totals as (select lang, sum(f)::bigint as n from phrases where m = 1 group by lang
), candidates as materialized (select *, string_split(phrase, ' ') as w from phrases where m > 1 and f >= 30
), places as materialized (
  select c.lang, c.m, c.phrase, c.f, k, array_to_string(c.w[1:k], ' ') as head, array_to_string(c.w[k + 1:c.m], ' ') as tail
  from (select *, unnest(range(1, m)) as k from candidates) c
), frequent as materialized (select lang, phrase, f from phrases where f >= 30
), lefts as materialized (select p.*, f.f as l from places p join frequent f on f.lang = p.lang and f.phrase = p.head
), cuts as (
  select p.lang, p.phrase, p.f as a, k, l, f.f as r, ((2000000::hugeint * p.f) // (l + f.f))::bigint as score
  from lefts p join frequent f on f.lang = p.lang and f.phrase = p.tail
), best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(f) as above
  from (select lang, w, f, k, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from candidates where m > 2)) group by all
), kept as (select b.* from best b left join inner_parts i using (lang, phrase) where above is null or 100::hugeint * above < 80::hugeint * a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.phrases import collocations

    return collocations(table(spark, folder, "documents", "lang", "text"))


_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op12_suffix_automaton_leaks", rf"""
with items as (select distinct coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark
), windows as (
  select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as words
  from (select item, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
), docs as (select row_number() over () as row, doc_id, {_WORDS} as w from documents
), spots as (
  select row, k, i, array_to_string(w[i:i + k - 1], ' ') as words
  from (select row, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct k from windows) where len(w) >= k)
), found as (select s.row, s.k, s.i, v.item from spots s join windows v on s.k = v.k and s.words = v.words
), hits as (select row, count(distinct spot) as n from (select row, unnest(range(i, i + k)) as spot from found) group by row
), held as (select row, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct row, item from found) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(hits.n, 0)::bigint as n_hit, coalesce(held.n, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from docs left join hits using (row) left join held using (row)
""")
def op12_suffix_automaton_leaks(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from proofline.llm.leaks import find_leaks

    found = find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op13_blocked_lexical_search", rf"""
with docs as (select row_number() over () as row, doc_id, {_WORDS} as w from documents
), sized as (select row, doc_id, len(w)::bigint as n from docs where len(w) > 0
), whole as (select count(*) as big_n, coalesce(sum(n), 0)::bigint as big_l from sized
), asked as (select row_number() over () as item, item_id, unnest(list_distinct({_WORDS})) as term from benchmark
), held as (
  select row, term, count(*) as tf from (select row, unnest(w) as term from docs) where term in (select term from asked) group by row, term
), weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from held, whole group by term, big_n
), scored as (
  select item, item_id, s.doc_id, s.row, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint as score
  from asked a join held h using (term) join weights using (term) join sized s using (row), whole group by item, item_id, s.doc_id, s.row
), ranked as (select *, (row_number() over (partition by item order by score desc, doc_id nulls last))::integer as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
""")
def op13_blocked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from proofline.llm.lexical import search

    return search(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)
