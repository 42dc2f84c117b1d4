"""Queries of the llm operators and, where SQL can say it, the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import core
from ..sources.tables import table
from .encode import count_tokens, decode, encode
from .overlap import contained, nearest_sets, overlaps
from .packing import Packing, pack, pack_documents
from .reading import hard_documents, learn_scale, levels
from .similar import SimilarSets, linked_sets, similar_sets
from .surprise import cooccurrence
from .topn import top_n


def counting_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, item_id) of rows that count. Rows repeat."""
    return core.counting_interactions(spark, folder).select("user_id", "item_id")


def counting_gram(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, neighbor_id) of entries that count. Rows repeat."""
    return core.counting_gram(spark, folder).select("item_id", "neighbor_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cooccurrence(counting_interactions(spark, folder), "user_id", "item_id", min_count=8, min_lift=4.0)
    frequent = F.col("n_ab") * found.n_groups >= 4 * F.col("n_a") * F.col("n_b")  # the same limit in whole numbers
    return found.pairs.where(frequent).select("item_a", "item_b")


def p2_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with a common user, popular and rare items included: counts, expectation, p-value and q-value over all pairs."""
    return cooccurrence(counting_interactions(spark, folder), "user_id", "item_id").pairs


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of `p2_surprise`."""
    return cooccurrence(counting_interactions(spark, folder), "user_id", "item_id").pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlaps(table(spark, folder, "audiences"), "col_id", "row_idx")
    return contained(pairs, 5).select(F.col("set_a").alias("col_a"), F.col("set_b").alias("col_b"))


def p3_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Shared identifiers of all pairs of audiences that share any."""
    return overlaps(table(spark, folder, "audiences"), "col_id", "row_idx")


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """For every audience the three others most like it."""
    near = nearest_sets(overlaps(table(spark, folder, "audiences"), "col_id", "row_idx"), 3)
    return near.select(F.col("set").alias("col_id"), "other", "rank", "shared")


def _similar_items(spark: SparkSession, folder: str) -> dict[str, SimilarSets]:
    """By field: items as sets of users, and as sets of neighbors, of at least 5 values and Jaccard similarity 3/5."""
    x, g = counting_interactions(spark, folder), counting_gram(spark, folder)
    return {"row_idx": similar_sets(x, "item_id", "user_id", 0.6, min_size=5), "indices": similar_sets(g, "item_id", "neighbor_id", 0.6, min_size=5)}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _similar_items(spark, folder)
    one, two = (s.pairs().select(F.lit(k).alias("field_name"), F.col("a").alias("item_a"), F.col("b").alias("item_b")) for k, s in found.items())
    return one.unionByName(two)


def p4_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item and field: its class of exact copies, their number, and the links of the class."""
    found = _similar_items(spark, folder)
    one, two = (linked_sets(s).select(F.lit(k).alias("field_name"), F.col("e").alias("item_id"), "class", "copies", "links") for k, s in found.items())
    return one.unionByName(two)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "weights").where(F.col("target_item") != F.col("source_item"))
    return top_n(w, "target_item", "source_item", "weight", 10, positive=True).select("target_item", "source_item")


def p5_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The same with weights and positions, three to a target."""
    w = table(spark, folder, "weights").where(F.col("target_item") != F.col("source_item"))
    return top_n(w, "target_item", "source_item", "weight", 3, positive=True)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by source."""
    docs = table(spark, folder, "documents")
    return count_tokens(docs, keys=("doc_id", "source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document after encoding and decoding; null texts come back empty."""
    return decode(encode(table(spark, folder, "documents")))


def _packed(spark: SparkSession, folder: str) -> Packing:
    return pack_documents(table(spark, folder, "documents"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces: container and stretch of tokens."""
    return _packed(spark, folder).pieces


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers used, the proven least number, tokens, share of room filled, rounds of packing."""
    p = _packed(spark, folder)
    fill = p.tokens / (p.containers * 2048) if p.containers else 1.0
    return spark.createDataFrame([(p.containers, p.bound, p.tokens, fill, p.rounds)], "containers bigint, least bigint, tokens bigint, fill double, rounds int")


def p7_byte_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the bytes of their text in containers of 4,096: bytes, the proven least number of containers, and whether no fewer are used."""
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length(F.col("text")).cast("bigint").alias("size"))
    p = pack(docs, "doc_id", "size", 4096)
    return spark.createDataFrame([(p.tokens, p.bound, p.containers >= p.bound)], "bytes bigint, least bigint, kept boolean")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return hard_documents(docs, learn_scale(docs, table(spark, folder, "level_labels")))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Language, words, grade estimates and level of every document."""
    docs = table(spark, folder, "documents")
    return levels(docs, learn_scale(docs, table(spark, folder, "level_labels")))


QUERIES = {
    "p2_found": p2_found,
    "p2_surprise": p2_surprise,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_overlaps": p3_overlaps,
    "p3_nearest": p3_nearest,
    "p4_found": p4_found,
    "p4_items": p4_items,
    "p5_found": p5_found,
    "p5_positions": p5_positions,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p6_round_trip": p6_round_trip,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p7_byte_bound": p7_byte_bound,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

_X = "x as (select distinct user_id, item_id from interactions where user_id is not null and item_id is not null and isfinite(val) and val > 0)"
_PAIRS = f"""{_X}, c as (select item_id, count(*) as n from x group by 1), u as (select count(distinct user_id) as n from x),
 ab as (select a.item_id as item_a, b.item_id as item_b, count(*) as n_ab from x a join x b using (user_id) where a.item_id < b.item_id group by 1, 2),
 s as (select item_a, item_b, n_ab, ca.n as n_a, cb.n as n_b, u.n as n from ab join c ca on ca.item_id = item_a join c cb on cb.item_id = item_b cross join u)"""
_M = """m as (select distinct col_id, row_idx from audiences where col_id is not null and row_idx is not null),
 c as (select col_id, count(*) as n from m group by 1),
 ab as (select a.col_id as set_a, b.col_id as set_b, count(*) as shared from m a join m b using (row_idx) where a.col_id < b.col_id group by 1, 2),
 s as (select set_a, set_b, shared, ca.n as size_a, cb.n as size_b from ab join c ca on ca.col_id = set_a join c cb on cb.col_id = set_b)"""



def _similar(rows: str, element: str, value: str, field: str) -> str:
    """Exact, through the values of each set that are rarest overall: similar sets share one of those."""
    return f"""with r as ({rows}), t as (select {element} as e, {value} as v, count(*) over (partition by {element}) as n, count(*) over (partition by {value}) as d from r),
 o as (select *, row_number() over (partition by e order by d, v) as k from t where n >= 5),
 p as (select e, v, n from o where k <= n - ceil(0.6 * n - 1e-9) + 1),
 c as (select distinct x.e as a, y.e as b, x.n as na, y.n as nb from p x join p y using (v) where x.e < y.e),
 s as (select a, b, na, nb, count(*) as m from c join r x on x.{element} = a join r y on y.{element} = b and y.{value} = x.{value} group by all)
select '{field}' as field_name, a as item_a, b as item_b from s where m * 5 >= 3 * (na + nb - m)"""


def _items(rows: str, element: str, value: str, field: str) -> str:
    """Classes of equal sets, and how many other classes are similar to each."""
    return f"""select '{field}' as field_name, e.item_id, e.class, e.copies, coalesce(n.links, 0) as links from
 (select item_id, min(item_id) over (partition by l) as class, count(*) over (partition by l) as copies from
  (select {element} as item_id, list({value} order by {value}) as l from ({rows}) group by 1 having count(*) >= 5)) e
 left join (select ca, count(distinct cb) as links from
  (select x.class as ca, y.class as cb from both_ways p join classes x on x.field_name = p.field_name and x.item_id = p.a join classes y on y.field_name = p.field_name and y.item_id = p.b
   where p.field_name = '{field}' and x.class <> y.class) group by 1) n on n.ca = e.class"""


def _classes(rows: str, element: str, value: str, field: str) -> str:
    return f"""select '{field}' as field_name, item_id, min(item_id) over (partition by l) as class from
 (select {element} as item_id, list({value} order by {value}) as l from ({rows}) group by 1 having count(*) >= 5)"""


_ROWS = (
    ("select distinct user_id, item_id from interactions where user_id is not null and item_id is not null and isfinite(val) and val > 0", "item_id", "user_id", "row_idx"),
    ("select distinct item_id, neighbor_id from gram where item_id is not null and neighbor_id is not null and neighbor_id <> item_id and isfinite(p) and p > 0", "item_id", "neighbor_id", "indices"),
)
_P4 = tuple(_similar(*r) for r in _ROWS)
_W = """w as (select target_item, source_item, max(weight) as weight from weights
  where target_item <> source_item and isfinite(weight) and weight > 0 group by 1, 2),
 r as (select *, row_number() over (partition by target_item order by weight desc, source_item) as position from w)"""

ORACLE = {
    "p2_found": f"with {_PAIRS} select item_a, item_b from s where n_ab >= 8 and n_ab * n >= 4 * n_a * n_b",
    "p2_pairs": f"with {_PAIRS} select item_a, item_b, n_ab, n_a, n_b, round(n_ab * n::double / (n_a * n_b), 6) as lift from s",
    "p3_found": f"with {_M} select set_a as col_a, set_b as col_b from s where shared * 5 >= least(size_a, size_b)",
    "p3_overlaps": f"with {_M} select * from s",
    "p3_nearest": f"""with {_M}, d as (select set_a as col_id, set_b as other, shared, shared::double / (size_a + size_b - shared) as j from s
 union all select set_b, set_a, shared, shared::double / (size_a + size_b - shared) from s)
select col_id, other, row_number() over (partition by col_id order by j desc, other) as rank, shared from d qualify rank <= 3""",
    "p4_found": f"({_P4[0]}) union all ({_P4[1]})",
    "p4_items": f"""with pairs as (select * from ({_P4[0]}) union all select * from ({_P4[1]})),
 both_ways as (select field_name, item_a as a, item_b as b from pairs union all select field_name, item_b, item_a from pairs),
 classes as (({_classes(*_ROWS[0])}) union all ({_classes(*_ROWS[1])}))
({_items(*_ROWS[0])}) union all ({_items(*_ROWS[1])})""",
    "p5_found": f"with {_W} select target_item, source_item from r where position <= 10",
    "p5_positions": f"with {_W} select * from r where position <= 3",
    "p7_byte_bound": """with d as (select coalesce(strlen(text), 0) as n from documents), r as (select n % 4096 as s, count(*) as m from d where n % 4096 > 0 group by 1),
 t as (select t, coalesce(sum(m) filter (s > 4096 - t), 0) + ceil(coalesce(sum(s * m) filter (s between t and 4096 - t), 0) / 4096.0) as least from range(1, 2049) x(t), r group by 1),
 k as (select k, ceil(sum(m * case when (k + 1) * s % 4096 = 0 then s * k else ((k + 1) * s // 4096) * 4096 end) / (k * 4096.0)) as least from range(1, 31) x(k), r group by 1)
select (select cast(sum(n) as bigint) from d) as bytes,
 cast((select sum(n // 4096) from d) + greatest((select max(least) from t), (select max(least) from k), (select ceil(sum(s * m) / 4096.0) from r)) as bigint) as least, true as kept""",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
