"""The same results in SQL, written against the tables alone; the independent side of the correctness check."""

from __future__ import annotations

_LINES = "orders join lineitem on l_orderkey = o_orderkey"
_ITEM = {"part": "l_partkey", "supplier": "l_suppkey", "brand": "cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint)"}


def _x(item: str, name: str = "x") -> str:
    joined = _LINES + (" join part on l_partkey = p_partkey" if item == "brand" else "")
    return f'{name} as (select o_custkey as "user", {_ITEM[item]} as item, count(*)::double as value from {joined} group by 1, 2)'


def _g(x: str = "x", name: str = "g") -> str:
    return f'{name} as (select a.item, b.item as neighbor, sum(a.value * b.value) as p from {x} a join {x} b using ("user") group by 1, 2)'


_TENTH = '("user" * 31 + item * 17 + 42) % 10'
_SPLIT = f"train as (select * from x where {_TENTH} < 8), test as (select * from x where {_TENTH} >= 8)"


def _scores(history: str, lambd: str, g: str = "g") -> str:
    w = f"w as (select neighbor as source, item as target, p as weight from {g} where item <> neighbor and p >= {lambd})"
    return f'{w}, s as (select h."user", target as item, sum(value * weight) as score from {history} h join w on h.item = source group by 1, 2)'


def _ranking(history: str, k: int, exclude: bool) -> str:
    """Dense ranking: every user by every item."""
    seen = f'exists (select 1 from {history} h where h."user" = u."user" and h.item = i.item)' if exclude else "false"
    return f"""dense as (
      select u."user", i.item, {seen} as seen, coalesce(s.score, 0) as score
      from (select distinct "user" from {history}) u cross join (select distinct item from {history}) i
      left join s on s."user" = u."user" and s.item = i.item),
    ranked as (select "user", row_number() over (partition by "user" order by seen, case when seen then 0 else score end desc, item) - 1 as rank,
      item, case when seen then -1.0 else score end as score, seen from dense qualify rank < {k})"""


_COUNTING = "user_id is not null and item_id is not null and isfinite(val) and val > 0"
_GRAM_COUNTS = "item_id is not null and neighbor_id is not null and neighbor_id <> item_id and isfinite(p) and p > 0"
_SWEEPS = 1500


def _fit(sweeps: int = _SWEEPS, lam: str = "2.0") -> str:
    """Weights of the brands after so many sweeps of coordinate descent from zero, beta 2; ``lam`` is an expression over g."""
    return f"""with recursive {_x("brand", "raw")},
 items as (select item, row_number() over (order by item) r from (select distinct item from raw)),
 xi as (select "user" u, r i, value v from raw join items using (item)),
 g as (select a.i i, b.i k, sum(a.v * b.v) p from xi a join xi b using (u) group by 1, 2),
 grid as (select a.r i, b.r k, coalesce(p, 0) p from items a cross join items b left join g on g.i = a.r and g.k = b.r),
 rws as (select i, list(p order by k) prow from grid group by i),
 allp as (select list(prow order by i) m, count(*) n, (select {lam} {"from g" if "(" in lam else ""}) lam from rws),
 it as (
  select i t, 0 step, list_transform(range(1, n + 1), lambda z: 0.0::double) w from rws, allp
  union all
  select t, step + 1, list_transform(w, lambda wk, idx:
    case when idx <> (step % n) + 1 then wk when idx = t then 0.0
    else greatest(0.0, (m[t][idx] - list_sum(list_transform(w, lambda wj, j:
      case when j = idx then 0.0 else wj * m[j][idx] end)) - lam) / (m[idx][idx] + 2.0)) end)
  from it, allp where step < n * {sweeps}),
 final as (select t, w from it where step = (select n * {sweeps} from allp)),
 slopes as (select t, k, m[k][k] + 2.0 as curvature, m[t][k] as p, w[k] as w, lam, m[t][k] - list_sum(list_transform(w, lambda wj, j: wj * m[j][k])) - lam - 2.0 * w[k] as slope
   from final, allp, (select unnest(range(1, 1 + (select n from allp))) as k) where k <> t),
 weights as (select s.item as source, d.item as target, w[s.r] as weight from final join items d on d.r = t cross join items s where w[s.r] > 0)
"""


_FIT = _fit()
_NDCG = """
 hits as (select r."user", count(*) h, sum(1 / log2(rank + 2)) dcg from ranked r join test t on t."user" = r."user" and t.item = r.item where rank < 5 group by 1),
 held as (select "user", count(*) n from test group by 1),
 m as (select coalesce(h, 0) / 5.0 p, coalesce(h, 0)::double / n r, coalesce(dcg, 0) / list_sum(list_transform(range(0, least(n, 5)), lambda j: 1 / log2(j + 2))) g from held left join hits using ("user"))
select round(coalesce(avg(p), 0), 6) as precision_at_k, round(coalesce(avg(r), 0), 6) as recall_at_k, round(coalesce(avg(g), 0), 6) as ndcg_at_k, count(*) as n_users from m"""

ORACLE = {
    "p1_found": f"""with x as (select distinct user_id, item_id from interactions where {_COUNTING}),
 g as (select distinct neighbor_id, item_id from gram where {_GRAM_COUNTS})
select 'col_ptr' as field_name, item_id from x group by item_id having count(*) * 50 >= (select count(*) from x)
union all select 'indptr', item_id from g group by item_id having count(*) * 50 >= (select count(*) from g)""",
    "p1_item_activity": f"""select item_id, count(*) as n_rows, count(*) filter (channel = 'web') as n_web,
 cast(sum(cast(round(val * 1000) as bigint)) as bigint) as sum_milli, max(cast(round(val * 1000) as bigint)) as max_milli, min(user_id) as first_user
from interactions where {_COUNTING} group by item_id""",
    "interactions_count": f"with {_x('brand')} select * from x",
    "interactions_binary": f'with {_x("brand")} select "user", item, 1.0::double as value from x',
    "interactions_weighted": f'select o_custkey as "user", l_partkey as item, sum(l_quantity) as value from {_LINES} group by 1, 2 having sum(l_quantity) <> 0',
    "interactions_by_item": f"with {_x('supplier')} select item, count(*) as n_users, sum(value) as total from x group by 1",
    "interactions_check": f"with {_x('part')} select count(*) as n_cells, bool_and(value = floor(value)) as whole_numbers from x",
    "gram": f"with {_x('supplier')}, {_g()} select * from g",
    "gram_diag": f"with {_x('brand')}, {_g()} select item, p from g where item = neighbor",
    "gram_offdiag": f"with {_x('brand')}, {_g()} select * from g where item <> neighbor",
    "gram_row": f"with {_x('supplier')}, {_g()} select neighbor, p from g where item <> neighbor and item = 7",
    "gram_tiled": f"with {_x('brand')}, {_g()} select * from g",
    "candidates": f"with {_x('supplier')}, {_g()} select * from g where item <> neighbor and p >= 40",
    "holdout_split": f"with {_x('part')}, {_SPLIT} select 'train' as side, count(*) as n, sum(value) as total from train union all select 'test', count(*), sum(value) from test",
    "unseen_antijoin": f'with {_x("brand")}, {_SPLIT} select "user", item from test where not exists (select 1 from train where train."user" = test."user" and train.item = test.item)',
    "hits_semijoin": f'with {_x("part")}, {_SPLIT} select "user", count(*) as hits from test where item in (select item from train group by 1 having count(*) >= 20) group by 1',
    "predict_scores": f"with {_x('brand')}, {_g()}, {_scores('x', '100')} select * from s",
    "predict_unseen": f'with {_x("brand")}, {_SPLIT}, {_g("train")}, {_scores("train", "50")} select * from s where not exists (select 1 from train where train."user" = s."user" and train.item = s.item)',
    "predict_dense": f'with {_x("brand")}, {_SPLIT}, {_g("train")}, {_scores("train", "50")}, {_ranking("train", 1000000, True)} select "user", item, case when seen then 0.0 else score end as score, seen from ranked',
    "top_k_scores": f"with {_x('brand')}, {_SPLIT}, {_g('train')}, {_scores('train', '50')} select \"user\", row_number() over (partition by \"user\" order by score desc, item) - 1 as rank, item, score from s where not exists (select 1 from train where train.\"user\" = s.\"user\" and train.item = s.item) qualify rank < 3",
    "explain": f'with {_x("brand")}, {_SPLIT}, {_g("train")}, {_scores("train", "50")} select h."user", target as item, source, value * weight as part from train h join w on h.item = source where not exists (select 1 from train where train."user" = h."user" and train.item = target)',
    "source_ratings": "select user_id as \"user\", event_id as item, 1.0::double as value from events where value > 0",
    "source_synthetic": """select id // 20 as "user", ((id + 42) % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647) % 2000 as item, count(*)::double as value
from range((select count(*) * 20 from customer)) t(id) group by 1, 2""",
    "recommend_topk": f'with {_x("supplier")}, {_g()}, {_scores("x", "40")}, {_ranking("x", 5, False)} select "user", rank, item, score from ranked',
    "recommend_fill": f'with {_x("brand")}, {_SPLIT}, {_g("train")}, {_scores("train", "50")}, {_ranking("train", 10, True)} select "user", rank, item, score from ranked',
    "recommend_with_seen": f'with x as (select user_id as "user", event_type as item, count(*)::double as value from events group by 1, 2), {_g()}, {_scores("x", "1")}, {_ranking("x", 3, True)} select "user", rank, item, score from ranked',
    "evaluate_ranked": f"with {_x('brand')}, {_SPLIT}, {_g('train')}, {_scores('train', '50')}, {_ranking('train', 5, True)}, {_NDCG}",
    "evaluate_scores": f"with {_x('brand')}, {_SPLIT}, {_g('train')}, {_scores('train', '50')}, dense as (select * from s where not exists (select 1 from train where train.\"user\" = s.\"user\" and train.item = s.item)), ranked as (select *, row_number() over (partition by \"user\" order by score desc, item) - 1 as rank from dense), {_NDCG}",
    "fit_weights_brand": f"{_FIT} select source, target, round(weight, 4) as weight from weights",
    "fit_weights_blocked": f"{_FIT} select source, target, round(weight, 4) as weight from weights",
    "fit_diagnostics": f"""{_fit(1, "floor(avg(p) filter (i <> k))")} select item, case when count(*) filter (p >= lam) > 0 then 1 else 0 end as n_passes,
 coalesce(bool_and(w < 0.002 and case when w > 0 then abs(slope) else greatest(slope, 0) end / curvature < 0.002) filter (p >= lam), true) as converged
from slopes join items on r = t group by 1""",
    "fit_max_iter_zero": f"with {_x('brand')}, {_g()} select item, 0::bigint as n_passes, max(p) filter (item <> neighbor and p >= 2) is null as converged from g group by 1",
    "fit_huge_lambda": f"with {_x('brand')} select distinct item, 0::bigint as n_passes, true as converged from x",
    "kkt_truncated": f"{_fit(1)} select item as target, round(max(case when w > 0 then abs(slope) else greatest(slope, 0) end), 3) as violation from slopes join items on r = t group by 1",
    "gram_large_groups": f"""with r as (select c_nationkey as g, l_partkey as e, count(*)::double as v from {_LINES} join customer on c_custkey = o_custkey group by 1, 2),
 p as (select a.e as a, b.e as b, count(*) as n, sum(a.v * b.v) as s from r a join r b using (g) where a.e < b.e group by 1, 2)
select n, count(*) as pairs, sum(s) as total, sum(s * ((a * 31 + b) % 101)) as mixed from p group by 1""",
    "objective": f"""{_FIT}, gg as (select a.item i, b.item k, p from g join items a on a.r = g.i join items b on b.r = g.k),
 parts as (select i as target, p / 2 as part from gg where i = k
  union all select target, -weight * p from weights join gg on i = source and k = target
  union all select a.target, a.weight * b.weight * p / 2 from weights a join weights b using (target) join gg on i = a.source and k = b.source
  union all select target, 2.0 * weight + weight * weight from weights)
select target, round(sum(part), 3) as objective from parts group by 1""",
}
