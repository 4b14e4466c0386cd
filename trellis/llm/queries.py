"""Registered queries of the data-preparation operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, license_scan, line_dedup, mixing, ngram_join, packing, quality, token_files, top_k, toxicity
from .common import table

#: The vocabulary file of the token operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k.numbered(top_k.quantized(table(spark, sf_dir, "embeddings")))
    return top_k.top_k(rows.where("id % 100 = 0"), rows, k=10)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(spark, token_files.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_top_k, op2_ngram_jaccard_join, op3_best_fit_packing, op4_license_scan, op5_embedding_near_dedup, op6_token_files, op7_quality_classifier, op8_line_dedup, op9_source_mixing, op10_toxicity)}



def _license_sql(k: int = 4, cover: float = 0.75, gap: int = 2) -> str:
    """The scan over words as texts: grams joined with the same templates, votes by diagonal and its neighbours."""
    rows = ", ".join(f"('{g}', {t}, {at}, '{label}', {base}, {size}, {keys}::integer[])" for g, t, at, label, base, size, keys in license_scan.template_rows(license_scan.NOTICES, k))
    sizes = sorted({len(r[0].split()) for r in license_scan.template_rows(license_scan.NOTICES, k)})
    return rf"""
with templates(gram, t, pos, label, base, size, keys) as (values {rows}),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from w),
n as ({" union all ".join(f"select doc_id, i - 1 as place, array_to_string(w[i : i + {s - 1}], ' ') as gram from g where i + {s - 1} <= len(w)" for s in sizes)}),
hits as (select doc_id, place - pos as diagonal, t, pos, label, base, size, keys from n join templates using (gram)),
near as (select doc_id, t, label, size, keys, pos, unnest(range(diagonal - {gap}, diagonal + {gap + 1})) as diagonal from hits where not base),
spans as (select doc_id, t, diagonal, label, size, keys, list_distinct(flatten(list([pos{"".join(f", pos + {j}" for j in range(1, k))}]))) as covered from near group by all),
judged as (select doc_id, label, len(covered) / size as share, len(covered) / size >= {cover} and len([x for x in keys if not list_contains(covered, x)]) = 0 as good from spans),
b as (select doc_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hits where base group by doc_id),
labels as (select doc_id, label from hits where base union select doc_id, label from judged where good),
l as (select doc_id, string_agg(label, ',' order by label) as labels from labels group by doc_id),
s as (select doc_id, max(share) as score from judged group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(score, 0.0::double) end as score
from w left join b using (doc_id) left join l using (doc_id) left join s using (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": _license_sql(),
    "op5_embedding_near_dedup": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from r group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id""",
    "op9_source_mixing": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast([3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as double) as weight, 2.0::double * source_size as cap from s),
f as (select *, 1.5::double * sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double) as before,
    sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as after from w),
g as (select *, (total - before) * weight / after >= cap as full_ from f),
p as (select source, source_size, case when full_ then cap
    else (total - sum(case when full_ then cap else 0.0::double end) over ()) * weight / sum(case when full_ then 0.0::double else weight end) over () end as target from g),
q as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    cast('0x' || substr(md5('1:' || coalesce('s' || source, 'null')), 1, 8) as bigint) / 4294967296.0::double as u from p),
r as (select d.doc_id, d.size, q.source_size, q.target, q.rate, q.u, q.rate - floor(q.rate) as part,
    row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as rank from d join q on d.source is not distinct from q.source),
a as (select *, case when part > 0 and floor(rank * part) % 2 = 1 then ceil(floor(rank * part) / part) + ceil((floor(rank * part) + 1) / part) - 1 - rank else rank end as pos from r),
c as (select *, cast(floor(rate) + floor((pos + 1) * part + u) - floor(pos * part + u) as bigint) as copies from a)
select doc_id, size, source_size, target, size * copies as taken, copies from c""",
    "op1_exact_top_k": """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op2_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select g from s group by g having count(*) > 1),
t as (select s.doc_id, s.g from s join common using (g)),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from t x join t y on x.g = y.g and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from r group by a),
e as (select a, count(*) as n_links from l group by a),
sig as (select doc_id, string_agg(g, chr(10) order by g) as k from s group by doc_id),
k as (select doc_id, min(doc_id) over (partition by k) as class_id, count(*) over (partition by k) as class_size from sig)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(n_links, 0) as n_links, coalesce(component_id, w.doc_id) as component_id,
  coalesce(class_id, w.doc_id) as class_id, coalesce(class_size, 1) as class_size
from w left join n using (doc_id) left join k using (doc_id) left join e on e.a = w.doc_id left join c on c.a = w.doc_id""",
    "op8_line_dedup": """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.first as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
}
