"""Queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, langid, ngram_join, packing, pieces, quality, secrets, vafile, warc, whitening, wrappers
from .shared import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by n-gram Jaccard join (ngram_join.near_duplicates): null, empty and wordless texts link with nothing, repeated
    rows and equal texts link with one another, texts of any length are read whole; no rows give none."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("comp", "key")


#: A-Z alone are lower-cased.
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct rid, hash(array_to_string(w[i:i + 4], ' ')) as h, hash('2' || array_to_string(w[i:i + 4], ' ')) as h2 from (select rid, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
c as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.h = b.h and a.h2 = b.h2 and a.rid < b.rid group by all),
l as (select x, y from c join n a on a.rid = x join n b on b.rid = y where 100 * c.c >= 75 * (a.n + b.n - c.c)),
e as (select x, y from l union all select y, x from l),
r as (select rid as x, rid as y from d union select r.x, e.y from r join e on e.x = r.y)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id, cast(coalesce(k.k, 0) as bigint) as n_links
from d left join n on n.rid = d.rid join (select r.x, min(o.doc_id) as component_id from r join d o on o.rid = r.y group by r.x) m on m.x = d.rid left join (select x, count(*) as k from e group by x) k on k.x = d.rid
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents (secrets.scan): a null text is empty, a repeated row is reported again, texts are read whole; no
    rows give none."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back (warc.round_trip): a null html is empty; of equal payloads the one with the largest
    page_id is the response, and so are rows that repeat it; no rows give none."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP3_SQL = """
with bytes as (select page_id, encode(coalesce(html, '')) as body from pages),
hashed as (select page_id, octet_length(body) as payload_bytes, upper(sha1(body)) as hex from bytes),
spelt as (
    select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, 1 + 5 * cast(i // 4 as int), 5) as bigint) >> (15 - 5 * cast(i % 4 as int))) & 31 as int), 1)), 'string_agg', '') as payload_digest
    from hashed),
kept as (select *, max(page_id) over (partition by payload_digest) as m from spelt)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to
from kept
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (langid.identify): null, empty and letterless texts are `und`; ties go to the first language in
    the alphabet; equal texts are judged alike, whole; no rows give none."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents (decontam.decontaminate): null and empty texts have no words, repeated rows are judged
    each, texts are read whole; no rows give none, and without a benchmark nothing is hit."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = f"""
with i as (select cast(item_id as varchar) as item, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
v as (select distinct item, least(len(w), 10) as n, array_to_string(w[k:k + 9], ' ') as words from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
g as (select rid, k, n, array_to_string(w[k:k + n - 1], ' ') as words from (select rid, w, unnest(range(1, len(w) + 1)) as k from d) cross join (select distinct n from v) where k + n - 1 <= len(w)),
f as (select rid, k, g.n, item from g join v on v.n = g.n and v.words = g.words),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from (select distinct rid, k, n from f)) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from f) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every side (chat.rotate): null turns come first, a null role is `unknown`, a null text empty; messages
    that repeat count once; no rows give none."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = """
with said as (select distinct conv_id, coalesce(turn, -1) as turn, role, coalesce(text, '') as text from conversations),
sides as (select distinct conv_id, role as perspective from said where role is distinct from 'system'),
divided as (select *, cast(floor(turn / 64) as bigint) as part from said),
numbered as (
    select *, case when count(*) over (partition by conv_id, part) > 256 then cast(floor((row_number() over (partition by conv_id, part order by turn, role nulls first, text) - 1) / 256) as int) else 0 end as sub from divided),
placed as (
    select m.conv_id, part, sub, s.perspective, m.turn, m.role, m.text, m.role is not distinct from s.perspective as own,
        case when m.role is not distinct from s.perspective then '<|assistant|>' || chr(10) when m.role = 'system' then '<|system|>' || chr(10) else '<|user name=' || replace(replace(replace(replace(coalesce(m.role, 'unknown'), '<|', '<\\|'), '|>', '|\\>'), chr(10), ' '), chr(13), ' ') || '|>' || chr(10) end as head,
        replace(m.text, '<|', '<\\|') || '<|end|>' || chr(10) as body
    from numbered m join sides s on m.conv_id is not distinct from s.conv_id),
measured as (
    select *, sum(length(head) + length(body)) over (partition by conv_id, perspective order by part, sub, turn, role nulls first, text rows unbounded preceding) as finish from placed)
select conv_id, coalesce(perspective, 'unknown') as perspective, part, sub, cast(max(finish) - sum(length(head) + length(body)) as bigint) as start, count(*) as n_messages, count(*) filter (where own) as n_targets,
    string_agg(head || body, '' order by turn, role nulls first, text) as text,
    coalesce(string_agg(case when own then cast(finish - length(body) as varchar) || ':' || cast(finish as varchar) end, ',' order by turn, role nulls first, text), '') as mask,
    cast(sum(length(head) + length(body)) as bigint) as n_chars, cast(coalesce(sum(length(body)) filter (where own), 0) as bigint) as n_mask_chars
from measured m group by conv_id, m.perspective, part, sub
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 50th vector the five best of all others (vafile.top_k): vectors that are null or hold null or non-finite
    components take no part, ties go to the smaller vec_id, repeated rows are rows of their own; no rows give none."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents (quality.classify): null and empty texts are judged by their votes alone, equal texts alike, texts are
    read whole; no rows give none."""
    return quality.classify(table(spark, sf_dir, "documents"))


OP8_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as f from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.f, v.f) as bigint) as score
    from v as q join v on q.vec_id <> v.vec_id and len(q.f) = len(v.f) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens (packing.pack_documents): a null text is empty and has the end id alone, repeated
    rows are documents of their own, long texts are cut, never dropped; no rows give none."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all pages (wrappers.extract): null and empty html have an empty text, a null url is of the host '', repeated rows
    are read each, pages of any length whole; no rows give none."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ids and back (pieces.round_trip): null and empty texts have no ids, repeated rows are encoded each, texts
    are read whole; no rows give none."""
    import public_tokenizers

    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their four largest components (whitening.whiten): vectors that are null or hold null or non-finite entries
    take no part, equal ones are fitted once, repeated rows are rows of their own; no rows give none. deviation is null where it
    is beyond 64 bits, and deviation_exact has it in any case."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.expr("try_cast(deviation as bigint)")})


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings (codes.compress): vectors that are null or hold null or non-finite components take no part, ties of
    vec_ids go by vector, null labels are one label, repeated rows count each; no rows give none."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = codes.codebooks_digest(books) if books is not None else None
    return codes.with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), F.col("error").cast("long").alias("error"), F.col("label_error").cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _op13_round(books: str, assigned: str, new: str) -> str:
    """SQL: parts to their nearest entries of a table of books, and the books after it."""
    return f"""
{assigned} as materialized (
    select rid, part, min(struct_pack(d := d, entry := entry)) as best
    from (select x.rid, x.part, b.entry, (x.p[1] - b.p[1]) ** 2 + (x.p[2] - b.p[2]) ** 2 + (x.p[3] - b.p[3]) ** 2 + (x.p[4] - b.p[4]) ** 2 as d from parts x join {books} b on b.part = x.part)
    group by rid, part),
{new} as materialized (
    select b.part, b.entry, coalesce(s.p, b.p) as p
    from {books} b left join (
        select a.part, a.best.entry as entry, [floor(sum(x.p[1]) / count(*)), floor(sum(x.p[2]) / count(*)), floor(sum(x.p[3]) / count(*)), floor(sum(x.p[4]) / count(*))] as p
        from {assigned} a join parts x on x.rid = a.rid and x.part = a.part group by a.part, a.best.entry) s on s.part = b.part and s.entry = b.entry)"""


OP13_SQL = f"""
with v as materialized (
    select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select rid, part, x[4 * part + 1:4 * part + 4] as p from v, (select unnest(range(16)) as part)),
b0 as materialized (select part, rid - 1 as entry, p from parts where rid <= 64),
{_op13_round("b0", "a1", "b1")},
{_op13_round("b1", "a2", "b2")},
{_op13_round("b2", "a3", "b3")},
coded as (select rid, string_agg(printf('%02x', cast(best.entry as int)), '' order by part) as code, cast(sum(best.d) as bigint) as error from a3 group by rid),
digest as (select sha256(string_agg(cast(cast(p[1] as bigint) as varchar) || ',' || cast(p[2] as bigint) || ',' || cast(p[3] as bigint) || ',' || cast(p[4] as bigint), ',' order by part, entry)) as sha from b2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256
from v join coded using (rid), digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_secret_scan, op3_warc, op4_language_id, op5_decontamination, op6_chat_rotation, op7_quality, op8_top_k, op9_packing, op10_html_extraction, op11_sentencepiece, op12_whitening, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_warc": OP3_SQL, "op5_decontamination": OP5_SQL, "op6_chat_rotation": OP6_SQL, "op8_top_k": OP8_SQL, "op13_vector_codes": OP13_SQL}
