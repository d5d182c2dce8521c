"""The corpus operators' queries, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_extract, importance, licenses, minhash, mixing, packing, pii, substring_dedup, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        html_extract.op1_html_extract,
        pii.op2_pii,
        substring_dedup.op3_suffix_dedup,
        minhash.op4_minhash,
        vector_dedup.op5_embedding_dedup,
        mixing.op6_mixing,
        ann.op7_ann,
        licenses.op8_licenses,
        packing.op9_packing,
        importance.op10_quality,
    )
}
SQL: dict[str, str] = {
    "op3_suffix_dedup": substring_dedup.SQL,
    "op4_minhash": minhash.SQL,
    "op6_mixing": mixing.SQL,
    "op5_embedding_dedup": """with recursive v as (select vec_id, embedding::double[] x from embeddings),
 u as (select * from v where x is not null and len(list_filter(x, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
 e as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.95),
 r as (select vec_id a, vec_id b from v union select r.a, e.b from r join e on r.b = e.a),
 c as (select a, min(b) component_id from r group by a),
 n as (select a, count(*) n from e group by a)
select vec_id, coalesce(n.n, 0)::bigint n_links, component_id, vec_id = component_id kept from v join c on v.vec_id = c.a left join n on n.a = v.vec_id""",
}
