"""DuckDB SQL of the centroid clustering: one pair of statements a round."""

from __future__ import annotations


def cluster_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    parts = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
 where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {width})""",
        "e as materialized (select r, generate_subscripts(v, 1) as i, unnest(v) as x from v)",
        f"s as (select r, row_number() over (order by sha256('{seed}:' || vec_id::varchar)) - 1 as c from v qualify c < {k})",
        "c0 as materialized (select c, i, x as y from s join e using (r))",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d
 from (select r, c, sum((x - y) * (x - y)) as d from e join c{n} using (i) group by r, c) group by r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} as materialized (select c, i, coalesce(m, y) as y from c{n} left join
 (select c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*)) as m from e join a{n} using (r) group by c, i) using (c, i))"""
            )
    last, old = f"a{rounds}", f"c{rounds}"
    return f"""with {", ".join(parts)}
 select vec_id, c::integer as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256
 from v join {last} using (r) join (select c, sha256(string_agg(y::varchar, ',' order by i)) as h from {old} group by c) using (c)"""
