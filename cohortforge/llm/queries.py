"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, language, lm, minhash, mixing, packing, quality, runs, sharding, topk, warc, whitening
from .common import read


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.document_runs(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_quality_classifier, op3_warc, op4_lm_scoring, op5_topk_search, op6_mixing, op7_packing,
    op8_embedding_dedup, op9_minhash_dedup, op10_language_id, op11_decontamination, op12_whitening, op13_periodic_runs)}

#: The words of the contracts, in DuckDB's regular expressions.
_WORD = r"[^\x20\x09-\x0D]+"


def _tree_level(level: int) -> str:
    """One level of the splitting tree: of the drawn blocks of each node, the half with the smallest hashes goes left."""
    return f"""n{level + 1} as (select k, blk, e, node * 2 + case when 2 * row_number() over (partition by node
      order by ('0x' || substr(md5('mix-{level}|' || k || '|' || blk || '|' || e), 1, 15))::bigint, k, blk, e)
      <= count(*) over (partition by node) + 1 then 0 else 1 end node from n{level})"""


_MIXING = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint u from documents),
s as (select source, sum(size)::bigint source_size, ceil(count(*) / 256.0::double)::bigint n_blocks,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w from d group by source),
r as (select *, 2.0::double * source_size top, 2.0::double * source_size / w ratio,
    1.5::double * sum(source_size) over () budget from s),
l as (select *, (budget - coalesce(sum(top) over (order by ratio, source nulls last
      rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) lv from r),
t as (select *, least(top, coalesce(w * first_value(case when lv <= ratio then lv end ignore nulls) over (order by ratio,
    source nulls last rows between unbounded preceding and unbounded following), top)) target from l),
p as (select d.*, coalesce('=' || d.source, 'null') k, t.source_size, t.target, round(t.target)::bigint wanted,
    least(floor(d.u / 1152921504606846976.0::double * t.n_blocks), t.n_blocks - 1)::bigint blk
    from d join t on d.source is not distinct from t.source),
b as (select k, blk, sum(size)::bigint words, any_value(source_size) source_size, any_value(wanted) wanted from p group by all),
bs as (select *, coalesce(sum(words) over (partition by k order by blk rows between unbounded preceding and 1 preceding), 0)::bigint start from b),
n0 as (select k, blk, e, 0 node from bs, range(0, 2) r(e) where e * source_size + start < wanted and words > 0),
{_tree_level(0)}, {_tree_level(1)}, {_tree_level(2)},
o as (select p.*, bs.start + coalesce(sum(p.size) over (partition by p.k, p.blk order by p.u, p.doc_id, p.size
    rows between unbounded preceding and 1 preceding), 0)::bigint pos, row_number() over () rid from p join bs using (k, blk)),
w as (select o.*, n.e, n.node, greatest(0, least(o.size, o.wanted - n.e * o.source_size - o.pos))::bigint words
    from o left join n3 n on n.k = o.k and n.blk = o.blk)
select any_value(doc_id) doc_id, any_value(size) size, any_value(source_size) source_size, any_value(target) target,
    coalesce(sum(words), 0)::bigint taken,
    coalesce(string_agg(e || ':' || node || ':' || words, ',' order by e) filter (where words > 0), '') draws from w group by rid
"""

_WARC = """
with p as (select page_id, coalesce(html, '') h from pages),
g as (select page_id, h, sha1(h) d, max(page_id) over (partition by h) top from p),
b as (select *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' a, [('0x' || substr(d, (i * 5 + 1)::int, 5))::bigint for i in range(0, 8)] fives from g)
select page_id, octet_length(encode(h))::bigint payload_bytes,
  array_to_string([substr(a, (v >> 15 & 31)::int + 1, 1) || substr(a, (v >> 10 & 31)::int + 1, 1)
    || substr(a, (v >> 5 & 31)::int + 1, 1) || substr(a, (v & 31)::int + 1, 1) for v in fives], '') payload_digest,
  case when page_id = top then 'response' else 'revisit' end record_type,
  case when page_id <> top then top end refers_to
from b
"""

_VALID = """embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0"""

_TOPK = f"""
with v as (select vec_id, row_number() over () r, [floor(256 * x::double) for x in embedding] e from embeddings where {_VALID}),
s as (select q.r q, q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id % 50 = 0 and c.r <> q.r),
r as (select *, row_number() over (partition by q order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""

_VECTORS = f"""
with recursive v as (select vec_id, [x::double for x in embedding] e from embeddings where {_VALID}),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint n_links,
  least(e.vec_id, coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id))::bigint component_id,
  e.vec_id <= coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id) kept
from embeddings e
"""

_SHINGLES = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) s from w),
n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) n from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.n >= 80 * (x.n + y.n - i.n)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) b from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id))::bigint component_id,
  d.doc_id <= coalesce(m.b, d.doc_id) kept
from documents d left join n using (doc_id) left join m on m.a = d.doc_id
"""

_DECONTAMINATION = r"""
with w as (select doc_id, row_number() over () r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select coalesce(item_id::varchar, '') item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark),
g as (select distinct item, least(len(w), 10) l, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
    for i in range(1, greatest(len(w) - 8, 2))]) s from b where len(w) > 0),
p as (select r, w, l, unnest(range(1, len(w) - l + 2)) i from w, (select distinct l from g) x where len(w) >= l),
h as (select p.r, p.i, p.l, g.item from p join g on g.l = p.l and g.s = array_to_string(p.w[p.i:p.i + p.l - 1], ' ')),
n as (select r, count(distinct i)::bigint n_hit from (select r, unnest(range(i, i + l)) i from h) x group by r),
t as (select r, count(distinct item)::bigint n_items, sha256(string_agg(distinct item, ',' order by item)) s from h group by r)
select w.doc_id, len(w.w)::bigint n_words, coalesce(n.n_hit, 0) n_hit, coalesce(t.n_items, 0) n_items,
  coalesce(t.s, sha256('')) items_sha256, coalesce(n.n_hit, 0) > 0 contaminated
from w left join n using (r) left join t using (r)
"""

#: Only what SQL can express; the others are tested against brute force, round trips or held-out accuracy.
ORACLE = {
    "op3_warc": _WARC,
    "op5_topk_search": _TOPK,
    "op6_mixing": _MIXING,
    "op8_embedding_dedup": _VECTORS,
    "op9_minhash_dedup": _SHINGLES,
    "op11_decontamination": _DECONTAMINATION,
}
