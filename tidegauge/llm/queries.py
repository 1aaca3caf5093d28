"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.llm import alignment, bpe, chat, fingerprints, html, neardup, packing, phrases, runtime, sharding, substring, suffixes, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_: str = "id") -> Column:
    return F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out()).withColumnRenamed("id", "doc_id")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (select q.vec_id as query_id, c.vec_id as vec_id, sum(q.x * c.x)::bigint as score
      from c q join c on q.i = c.i where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach as (select doc_id, doc_id as r from d union select reach.doc_id, y from reach join links on r = x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(r) as component_id, doc_id = min(r) as kept from reach left join n using (doc_id) group by doc_id, n
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    chats = chat.read_back(chat.formatted(rows.unionByName(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("conversation_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g') as half from rows),
f as (select *, regexp_replace(half, '\[(/?INST\])', '[\\\1', 'g') as escaped from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|turn|>' || role || '<|says|>' || escaped || '<|end|>'))::bigint as formatted_chars
from f group by conv_id
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), 24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from d),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as v from places),
late as (select doc_id, i from windows qualify min(doc_id) over (partition by v) < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p, true as away from late),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
left_over as (select doc_id, count(*) as n_words, count(away) as n_removed, string_agg(word, ' ' order by p) filter (away is null) as kept from words left join gone using (doc_id, p) group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join left_over using (doc_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    edited_sha256 = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    rows = runtime.Scratch(spark, "fingerprints").keep(found.select(F.col("id").alias("doc_id"), "n_chars", edited_sha256, "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    return rows.join(fingerprints.neighbours(rows), "fingerprint").select(*rows.columns, "n_equal", "n_near")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(table(spark, sf_dir, "documents"), source, offsets=False, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bpe.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), source, with_ids=False)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        found = alignment.summary(table(spark, sf_dir, "documents"), bpe.from_json(public_tokenizers.path("byte_bpe_50k.json")), file.read())
    return found.withColumnRenamed("id", "doc_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
          from words cross join (values (1), (2), (3)) t(k)),
f as (select lang, k, phrase, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= 10),
cuts as (select *, unnest(range(1, k)) as cut from c),
rated as (select cuts.*, x.a as l, y.a as r, (1000000::hugeint * cuts.a * cuts.a) // (x.a::hugeint * y.a) as score
          from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.w[1:cuts.cut], ' ')
                    join f y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.w[cuts.cut + 1:cuts.k], ' ')),
best as (select * from rated qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, phrase, max(a) as over from (select lang, a, array_to_string(w[1:2], ' ') as phrase from c where k = 3
           union all select lang, a, array_to_string(w[2:3], ' ') from c where k = 3) group by all),
left_over as (select best.* from best left join longer using (lang, phrase) where longer.over is null or 100 * longer.over < 50 * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, i, sha256(substr(h, 2 * i - 1, 400)) as v from (select doc_id, h, unnest(range(1, greatest(len(h) // 2 - 198, 1))) as i from d)),
again as (select doc_id, i from windows qualify count(*) over (partition by v) > 1),
parted as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as first from again),
numbered as (select doc_id, i, sum(first) over (partition by doc_id order by i) as span from parted),
spans as (select doc_id, span, min(i) as a, max(i) + 199 as b from numbered group by doc_id, span),
between_ as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
pieces as (select doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' order by a) as head, max(b) as last, sum(b - a + 1) as n_removed, count(*) as n_spans from between_ join d using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join pieces using (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_topk_search, op3_near_duplicates, op4_chat_format, op5_html_extraction, op6_sharding, op7_substring_dedup, op8_simhash, op9_byte_bpe, op10_packing, op11_token_alignment, op12_phrases, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op4_chat_format": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op12_phrases": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
