"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from geonear.llm import (
    annpartition,
    bytebpe,
    exactdedup,
    htmltext,
    langid,
    lexical,
    linededup,
    mixing,
    packing,
    pii,
    simhash,
    tokenfile,
    vectorcodes,
)
from geonear.llm.common import table
from geonear.session import scratch_path

KINDS = pii.KINDS


def op1_length_buckets(spark, sf_dir):
    """Places of all documents in token-budget batches of optimal length buckets."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_learned_partitions(spark, sf_dir):
    """The 20 nearest vectors found for every twentieth vector."""
    return annpartition.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _of_kind(kind):
    return lambda s: s.kind == kind


def op3_pii_tagger(spark, sf_dir):
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_tagger(docs)).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_site_lines(spark, sf_dir):
    """Every document without its source's boilerplate lines."""
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "n_chars", F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"))


def op5_exact_dedup(spark, sf_dir):
    """The copy that stays for every document."""
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_template_removal(spark, sf_dir):
    """Main text of every page."""
    pages = htmltext.extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_naive_bayes(spark, sf_dir):
    """Predicted language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.where(~langid.held_out()))
    return langid.with_language(docs.withColumn("held_out", langid.held_out()), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op9_repair_ids(spark, sf_dir):
    """Ids of every document, written to a compressed token file and read back."""
    path = scratch_path(spark, "token-file")
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenfile.token_documents(tokenfile.read_token_file(spark, path))
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


def op10_byte_bpe(spark, sf_dir):
    """Ids of every document, and the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytebpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bytebpe.bpe_decode(encoded, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_posting_blocks(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pareto_mix(spark, sf_dir):
    """Copies of every document in a mix of the sources."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "inclusion", "taken")


def op13_part_trie(spark, sf_dir):
    """Code and error of every vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = vectorcodes.compress_vectors(rows)
    return coded.select("vec_id", "code", "error", "label_error",
                        F.sha2(F.lit(books.text() if books else ""), 256).alias("codebooks_sha256"))


QUERIES = {q.__name__: q for q in (
    op1_length_buckets, op2_learned_partitions, op3_pii_tagger, op4_site_lines, op5_exact_dedup,
    op6_template_removal, op7_simhash, op8_naive_bayes, op9_repair_ids, op10_byte_bpe,
    op11_posting_blocks, op12_pareto_mix, op13_part_trie,
)}

def _part_trie_sql():
    """Two rounds of assignment and floor means, then the codes, as common table expressions."""
    nearest = """assigned{0} as materialized (
        select vec_id, p, any_value(c) as c, min_by(e, [d, e]) as e, min(d) as d
        from (select vec_id, p, c, e, list_sum(list_transform(list_zip(c, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
              from cut join book{0} using (p)) group by vec_id, p)"""
    moved = """book{1} as materialized (
        select p, e, coalesce(m.v, book{0}.v) as v from book{0} left join (
            select p, e, list(floor_mean order by i) as v from (
                select p, e, i, floor(sum(c[i])::double / count(*))::bigint as floor_mean
                from assigned{0}, unnest(range(1, len(c) + 1)) as t(i) group by p, e, i)
            group by p, e) m using (p, e))"""
    rounds = ",\n".join([nearest.format(0), moved.format(0, 1), nearest.format(1), moved.format(1, 2), nearest.format(2)])
    return f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
              where embedding is not null and len(embedding) > 0
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (select vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as c
                     from kept, unnest(range(16)) as t(p)),
book0 as materialized (select p, e, c as v from cut join (
    select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < 64) using (vec_id)),
{rounds},
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error
          from assigned2 group by vec_id),
hashed as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as h
           from (select p, e, unnest(v) as x, unnest(range(len(v))) as i from book2))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256
from coded join kept using (vec_id), hashed"""


ORACLE_SQL = {
    "op4_site_lines": rf"""
with pages as (select doc_id, source, text, coalesce('h' || source, '') as site, string_split(text, chr(10)) as ls
               from documents),
lines as (select doc_id, site, unnest(ls) as raw, unnest(range(len(ls))) as pos from pages),
trimmed as (select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from lines),
counts as (select site, line, count(distinct doc_id) as n from trimmed where line <> '' group by all),
total as (select site, count(*) as n from pages group by all),
boiler as (select site, line from counts c join total t using (site)
           where c.n >= {linededup.MIN_PAGES} and c.n / t.n > {linededup.MAX_RATIO}),
kept as (select t.doc_id, count(b.line) as n_dropped,
                coalesce(string_agg(raw, chr(10) order by pos) filter (where b.line is null), '') as text
         from trimmed t left join boiler b using (site, line) group by all)
select p.doc_id, source, case when p.text is null then null when n_dropped = 0 then p.text else k.text end as text,
       length(case when n_dropped = 0 then p.text else k.text end) as n_chars,
       coalesce(len(ls), 0) as n_lines, coalesce(n_dropped, 0) as n_dropped
from pages p left join kept k using (doc_id)""",
    "op5_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)""",
    "op11_posting_blocks": r"""
with found as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
sizes as (select r, any_value(doc_id) as doc_id, count(*) as n from found group by r),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
asked as (select item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
query as (select item_id, t, count(*) as q from asked group by all),
tfs as (select r, t, count(*) as tf from found where t in (select t from query) group by all),
weights as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
            from tfs, total group by t, n_docs),
impacts as (select doc_id, r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) as impact
            from tfs join sizes using (r), total),
scored as (select item_id, r, any_value(doc_id) as doc_id, sum(q * w * impact)::bigint as score
           from query join weights using (t) join impacts using (t) group by item_id, r),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
           from scored where score > 0)
select * from ranked where rank <= 10""",
    "op12_pareto_mix": rf"""
with docs as (select doc_id, coalesce('h' || source, '') as src,
                     coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
sized as (select doc_id, src, len(ws) as size,
                 case when len(ws) = 0 then 0
                      else ceil(({mixing.STEPS} * len(list_distinct(ws)))::double / len(ws))::int end as step,
                 ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint as drawn from docs),
named as (select src, sum(size)::bigint as source_size, row_number() over (order by src = '', src) - 1 as nth
          from sized group by src),
weighed as (select src, source_size, {mixing.MAX_COPIES} * source_size as cap,
                   ([3, 1, 2])[(nth % 3)::int + 1] as w, sum(source_size) over () as total from named),
risen as (select *, sum(cap) over p as caps, sum(w) over f as free from weighed
          window p as (order by cap::double / w, src rows between unbounded preceding and 1 preceding),
                 f as (order by cap::double / w, src rows between current row and unbounded following)),
lambdas as (select cap, w, ({mixing.SHARE}e0 * total - coalesce(caps, 0)) / free as lam from risen where source_size > 0),
-- The first source that stays below its cap fixes the words per unit of weight.
level as (select max(lam) as lam from lambdas where lam * w < cap),
targets as (select src, source_size, case when cap <= lam * w then cap::double else w * lam end as target
            from weighed, level),
rests as (select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as whole from targets),
steps as (select src, step, sum(size)::bigint as n from sized group by all),
known as (select steps.*, source_size, target, whole, greatest(0, target - whole * source_size) as rest
          from steps join rests using (src)),
rates as (select *, case when sum(step * n) over f > 0
                         then (rest - coalesce(sum(n) over a, 0)) / sum(step * n) over f end as rate from known
          window a as (partition by src order by step desc rows between unbounded preceding and 1 preceding),
                 f as (partition by src order by step desc rows between current row and unbounded following)),
rate as (select src, arg_max(rate, step) as rate from rates where rate * step <= 1 group by src),
plan as (select r.src, r.step, r.source_size, r.target, r.whole, r.rest,
                case when step = 0 then 0.0e0 else least(1.0e0, coalesce(rate.rate, 1.0e0) * step) end as p
         from rates r left join rate using (src)),
placed as (select doc_id, size, drawn, plan.*, (drawn + 0.5e0) / 4503599627370496e0 as u from sized join plan using (src, step)),
ranked as (select *, case when p >= 1 then 0 when p <= 0 then 4503599627370495
                          else floor((u / (1 - u) / (p / (1 - p))) / (1 + u / (1 - u) / (p / (1 - p)))
                                     * 4503599627370496e0)::bigint end as place from placed),
summed as (select *, coalesce(sum(size) over (partition by src order by place, doc_id
                                              rows between unbounded preceding and 1 preceding), 0) as reached from ranked)
select doc_id, size::bigint as size, source_size, target, p as inclusion,
       (size * (whole + (2 * reached + size <= 2 * rest)::bigint))::bigint as taken
from summed""",
    "op13_part_trie": _part_trie_sql(),
}
