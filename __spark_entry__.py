"""Registered queries and the SQL that each of them must agree with.

Two transaction databases are derived from the tables, both whole:
``BR`` (order, brand of the part, quantity) and ``SK`` (order, a skewed code
of the part, quantity).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import basketyield as by  # noqa: E402
from basketyield.functions import itemset_text, utilities_of  # noqa: E402
from basketyield.sources.sinks import itemset_lines  # noqa: E402

try:  # the subpackage may be left out
    from basketyield.llm import queries as llm_queries  # noqa: E402
except ImportError:  # or a library that only it needs may be missing
    llm_queries = None

BR_MIN = 5000
SK_MIN = 200000
SK_LOW = 20000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    parts = _table(spark, sf_dir, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    brand = F.expr("cast(substr(p_brand, 7) as bigint)")
    return by.from_table(joined, "l_orderkey", brand, "l_quantity", rows=lines.count())


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return by.from_table(lines, "l_orderkey", F.expr("(l_partkey * l_partkey) div 200000 + 1"), "l_quantity")


def _ranked(cells: DataFrame, min_util: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the revised cells of a database."""
    dictionary = by.item_rank(by.item_twu(cells), min_util)
    return dictionary, by.revise_transactions(cells, dictionary)


def _revised(cells: DataFrame, min_util: int) -> tuple[DataFrame, int]:
    """The revised cells of a database and its number of ranks."""
    dictionary = by.item_rank(by.item_twu(cells), min_util)
    n = dictionary.count()
    return by.revise_transactions(cells, dictionary, n), n


def _text_itemsets(itemsets: DataFrame) -> DataFrame:
    return itemsets.selectExpr(f"{itemset_text('itemset')} as items", "bigint(size) as size", "utility")


def _miner(domain: Callable, min_util: int, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _text_itemsets(by.mine_high_utility_itemsets(domain(spark, sf_dir), min_util, **options))

    return run


def _brand_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by.mine_high_utility_itemsets(brands(spark, sf_dir), BR_MIN)


def entry(spark: SparkSession) -> DataFrame:
    """High-utility brand itemsets of the smallest data set."""
    return _text_itemsets(by.mine_high_utility_itemsets(brands(spark, "/root/testdata/sf0.001"), 500))


# --- databases and files ---------------------------------------------------


def q_db_profile(spark, sf_dir):
    return by.db_profile(brands(spark, sf_dir)).select("n_transactions", "n_items", "max_item", "total_utility")


def q_max_item(spark, sf_dir):
    return by.max_item(codes(spark, sf_dir))


def q_first_transactions(spark, sf_dir):
    return by.first_transactions(brands(spark, sf_dir), 100).select("tid", "item", F.col("utility").alias("u"))


def _utility_lines(cells: DataFrame, value: str = "line") -> DataFrame:
    """The database as utility text, one ``value`` for each transaction; ``line`` is its text."""
    line = f"concat({itemset_text('items')}, ':', tu, ':', {itemset_text('utils')})"
    rows = by.to_transactions(cells)
    return rows.selectExpr("tid", "tu", "items", "utils", f"{line} as line").selectExpr("tid", f"{value} as value")


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def q_utility_text(spark, sf_dir):
    """Write the database as utility text, read it back, print the transactions."""
    path = by.Stage(spark).path("text")
    _utility_lines(brands(spark, sf_dir)).select("value").write.text(path)
    return _counted(by.format_transactions(by.read_utility_transactions(spark, path, validate_tu=True)), "value")


def q_utility_text_wide(spark, sf_dir):
    """The same with utilities of 10^9 a piece, whose totals need 64 bits."""
    path = by.Stage(spark).path("text")
    wide = brands(spark, sf_dir).withColumn("utility", F.col("utility") * 1_000_000_000)
    _utility_lines(wide).select("value").write.text(path)
    return _counted(by.format_transactions(by.read_utility_transactions(spark, path, validate_tu=True)), "value")


def q_utility_text_first_n(spark, sf_dir):
    """The first 100 lines of files that hold the transactions in order."""
    path = by.Stage(spark).path("text")
    lines = _utility_lines(brands(spark, sf_dir)).repartitionByRange(4, "tid").sortWithinPartitions("tid")
    lines.select("value").write.text(path)
    return _counted(by.format_transactions(by.read_utility_transactions(spark, path, max_count=100)), "value")


def q_utility_text_dirty(spark, sf_dir):
    """Comments, blank and malformed lines among the others: what is kept and what is returned as malformed."""
    path = by.Stage(spark).path("text")
    mixed = "case tid % 5 when 0 then concat('# ', line) when 1 then concat('x ', line) when 2 then '' else line end"
    _utility_lines(brands(spark, sf_dir), mixed).select("value").write.text(path)
    kept = by.format_transactions(by.read_utility_transactions(spark, path, mode="PERMISSIVE"))
    kept = kept.selectExpr("'kept' as kind", "value")
    return _counted(kept.unionByName(by.malformed_lines(spark, path).selectExpr("'malformed' as kind", "value")), "kind", "value")


def q_header_mismatches(spark, sf_dir):
    path = by.Stage(spark).path("text")
    value = f"if(tid % 3 = 0, concat({itemset_text('items')}, ':', tu + 1, ':', {itemset_text('utils')}), line)"
    _utility_lines(brands(spark, sf_dir), value).select("value").write.text(path)
    return _counted(by.header_mismatches(spark, path), "value", "header_tu", "tu")


def q_count_lines_containing(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return by.count_lines_containing(lines, "line", {"n_a": "a", "n_b": "b"})


# --- before the search -----------------------------------------------------


def q_item_twu(spark, sf_dir):
    return by.item_twu(brands(spark, sf_dir))


def q_promising_items(spark, sf_dir):
    return by.promising_items(codes(spark, sf_dir), SK_MIN)


def q_item_rank(spark, sf_dir):
    return by.item_rank(by.item_twu(codes(spark, sf_dir)), SK_MIN).select("item", "twu", F.col("rk"))


def q_revised_transactions(spark, sf_dir):
    _, revised = _ranked(codes(spark, sf_dir), SK_MIN)
    rows = by.to_array_form(revised)
    return rows.selectExpr("tid", f"{itemset_text('items')} as items", f"{itemset_text('utils')} as utils", "tu")


def q_emptied_transactions(spark, sf_dir):
    cells = codes(spark, sf_dir)
    _, revised = _ranked(cells, SK_MIN)
    return by.emptied_transactions(cells, revised)


def q_suffix_utilities(spark, sf_dir):
    revised, n = _revised(codes(spark, sf_dir), SK_MIN)
    return by.suffix_utilities(revised, max_rank=n).select("tid", "item", "rk", F.col("utility").alias("u"), "sfx")


def q_root_subtree_utility(spark, sf_dir):
    revised, n = _revised(codes(spark, sf_dir), SK_MIN)
    return by.root_subtree_utility(revised, max_rank=n)


def q_primary_items(spark, sf_dir):
    return by.primary_items(q_root_subtree_utility(spark, sf_dir), SK_MIN)


def q_reverse_lex_order(spark, sf_dir):
    _, revised = _ranked(brands(spark, sf_dir))
    return by.reverse_lex_order(by.to_array_form(revised)).select("tid", "pos")


# --- one level of the search -----------------------------------------------


def _children(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the projections on every single brand."""
    dictionary, revised = _ranked(brands(spark, sf_dir))
    return dictionary, by.project_on_items(by.root_projection(by.to_array_form(revised)))


def _item_of(rank: str, dictionary: DataFrame, name: str) -> DataFrame:
    return dictionary.select(F.col("rk").cast("int").alias(rank), F.col("item").alias(name))


def q_projected_transactions(spark, sf_dir):
    dictionary, children = _children(spark, sf_dir)
    lines = by.format_transactions(children).selectExpr("get(prefix, 0) as r", "value")
    return _counted(lines, "r", "value").join(_item_of("r", dictionary, "e"), "r").select("e", "value", "n")


def q_merged_projections(spark, sf_dir):
    dictionary, children = _children(spark, sf_dir)
    merged = by.merge_transactions(children.where("size(items) > 0"))
    return (
        merged.selectExpr(
            "get(prefix, 0) as r", f"{itemset_text('items')} as suffix", "n", "prefix_util as pu", "get(sfx, 0) as rem",
            f"{itemset_text(utilities_of('sfx'))} as utils",
        )
        .join(_item_of("r", dictionary, "e"), "r")
        .select("e", "suffix", "n", "pu", "rem", "utils")
    )


def q_extension_bounds(spark, sf_dir):
    dictionary, children = _children(spark, sf_dir)
    return (
        by.extension_bounds(children)
        .selectExpr("get(prefix, 0) as re", "z as rz", "lu", "su")
        .join(_item_of("re", dictionary, "e"), "re")
        .join(_item_of("rz", dictionary, "z"), "rz")
        .select("e", "z", "lu", "su")
    )


def q_itemset_utilities(spark, sf_dir):
    dictionary, children = _children(spark, sf_dir)
    pairs = by.itemset_utilities(by.project_on_items(children))
    named = by.decode_itemsets(pairs, dictionary)
    support = by.decode_itemsets(pairs.select("prefix", F.col("support").alias("utility")), dictionary)
    return named.join(support.selectExpr("itemset", "utility as support"), "itemset").selectExpr(
        "get(itemset, 0) as i", "get(itemset, 1) as j", "utility", "support"
    )


# --- the search and its results ----------------------------------------------


def q_itemset_level_counts(spark, sf_dir):
    return by.itemset_level_counts(_brand_itemsets(spark, sf_dir)).selectExpr("bigint(size) as size", "n")


def q_itemset_report(spark, sf_dir):
    return by.itemset_report(_brand_itemsets(spark, sf_dir)).selectExpr(
        "pattern", "bigint(size) as size", f"{itemset_text('itemset')} as items", "utility"
    )


def q_itemset_text(spark, sf_dir):
    """The written text lines, read back."""
    path = by.Stage(spark).path("itemsets")
    by.write_itemsets_text(_brand_itemsets(spark, sf_dir), path)
    return by.read_lines(spark, path)


def q_itemset_lines(spark, sf_dir):
    return itemset_lines(by.mine_high_utility_itemsets(codes(spark, sf_dir), SK_LOW))


def q_without_item(spark, sf_dir):
    rest = by.without_item(_brand_itemsets(spark, sf_dir), F.lit(1).cast("bigint"))
    return rest.selectExpr(f"{itemset_text('itemset')} as items", f"{itemset_text('rest')} as rest")


def _stats(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    """Work per itemset size at a threshold of 1, where every itemset that occurs is a candidate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = by.mine(codes(spark, sf_dir), 1, strategy=strategy, counters=True)
        return by.mining_stats(result).selectExpr(
            "bigint(size) as size", "candidates", "itemsets", "transactions", "rows", "merges"
        )

    return run


def q_hui_raw_lines(spark, sf_dir):
    """Order lines as they are, with repeated brands, straight to the miner."""
    lines, parts = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    raw = lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        "l_orderkey as tid", "cast(substr(p_brand, 7) as bigint) as item", "l_quantity as utility"
    )
    return _text_itemsets(by.mine_high_utility_itemsets(raw, BR_MIN))


def q_search_nodes(spark, sf_dir):
    """Exact utility of every candidate, with nothing pruned at a threshold of 1."""
    result = by.mine(codes(spark, sf_dir), 1)
    return _text_itemsets(result.decoded(result.nodes.select("prefix", "utility")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "db_profile": q_db_profile,
        "max_item": q_max_item,
        "first_transactions": q_first_transactions,
        "utility_text": q_utility_text,
        "utility_text_wide": q_utility_text_wide,
        "utility_text_first_n": q_utility_text_first_n,
        "utility_text_dirty": q_utility_text_dirty,
        "header_mismatches": q_header_mismatches,
        "count_lines_containing": q_count_lines_containing,
        "item_twu": q_item_twu,
        "promising_items": q_promising_items,
        "item_rank": q_item_rank,
        "revised_transactions": q_revised_transactions,
        "emptied_transactions": q_emptied_transactions,
        "suffix_utilities": q_suffix_utilities,
        "root_subtree_utility": q_root_subtree_utility,
        "primary_items": q_primary_items,
        "reverse_lex_order": q_reverse_lex_order,
        "projected_transactions": q_projected_transactions,
        "merged_projections": q_merged_projections,
        "extension_bounds": q_extension_bounds,
        "itemset_utilities": q_itemset_utilities,
        "hui_level": _miner(brands, BR_MIN),
        "hui_raw_lines": q_hui_raw_lines,
        "hui_subtree": _miner(brands, BR_MIN, strategy="subtree"),
        "hui_no_merging": _miner(brands, BR_MIN, merging=False),
        "hui_no_subtree_pruning": _miner(brands, BR_MIN, subtree_pruning=False),
        "hui_untrimmed": _miner(brands, BR_MIN, trim_secondary=False),
        "hui_skewed": _miner(codes, SK_LOW),
        "hui_skewed_high": _miner(codes, SK_MIN),
        "itemset_level_counts": q_itemset_level_counts,
        "itemset_report": q_itemset_report,
        "itemset_text": q_itemset_text,
        "itemset_lines": q_itemset_lines,
        "without_item": q_without_item,
        "mining_stats": _stats("level"),
        "search_nodes": q_search_nodes,
        "search_stats": _stats("subtree"),
        **(llm_queries.queries() if llm_queries else {}),
    }


_BR = (
    "select l_orderkey tid, cast(substr(p_brand,7) as bigint) item, cast(sum(l_quantity) as bigint) u "
    "from lineitem join part on l_partkey=p_partkey group by 1,2"
)
_SK = (
    "select l_orderkey tid, (l_partkey*l_partkey)//200000+1 item, cast(sum(l_quantity) as bigint) u "
    "from lineitem group by 1,2"
)


def _before(domain: str, min_util: int) -> str:
    """Everything up to the revised, ranked cells ``r``."""
    return f"""with t as ({domain}), tu as (select tid, cast(sum(u) as bigint) tu from t group by 1),
    w as (select item, cast(sum(tu) as bigint) twu, count(*) support from t join tu using(tid) group by 1),
    rk as (select item, twu, row_number() over (order by twu,item) rk from w where twu>={min_util}),
    r as (select tid, item, rk, u,
          cast(sum(u) over (partition by tid order by rk desc rows unbounded preceding) as bigint) sfx
          from t join rk using(item))"""


def _mined(domain: str, min_util: int) -> str:
    """``h``: all high-utility itemsets, from every subset of every transaction."""
    return f"""with recursive t as ({domain}), s(tid,last,items,arr,k,u) as (
    select tid,item,item::varchar,[item],1,u from t union all
    select s.tid,t.item,s.items||' '||t.item,list_append(s.arr,t.item),s.k+1,s.u+t.u
    from s join t on t.tid=s.tid and t.item>s.last),
    h as (select items, arr, cast(k as bigint) size, cast(sum(u) as bigint) utility
          from s group by items,arr,k having sum(u)>={min_util})"""


def oracle_sql() -> dict[str, str]:
    sk, br = _before(_SK, SK_MIN), _before(_BR, 0)
    mined = f"{_mined(_BR, BR_MIN)} select items, size, utility from h"
    # every itemset in rank order, with what follows its last item in each transaction
    stats = f"""{_before(_SK, 1).replace("with t", "with recursive t", 1)},
        f as (select tid, rk, string_agg(rk::varchar, ' ' order by rk) over
              (partition by tid order by rk rows between 1 following and unbounded following) rest from r),
        s(tid, last, items, k) as (select tid, rk, rk::varchar, 1 from r union all
              select s.tid, r.rk, s.items||' '||r.rk, s.k+1 from s join r on r.tid=s.tid and r.rk>s.last),
        c as (select s.items, k, count(*) n, count(rest) kept, count(distinct rest) d
              from s join f on f.tid=s.tid and f.rk=s.last group by 1, 2)
        select cast(k as bigint) size, count(*) candidates, count(*) itemsets, cast(sum(n) as bigint) transactions,
        cast(sum(d) as bigint) "rows", cast(sum(kept)-sum(d) as bigint) merges from c group by k"""
    text = """string_agg(item::varchar||'['||u::varchar||'] ','' order by item)||' Remaining Utility:'
        ||cast(sum(u) as bigint)::varchar||' Prefix Utility:0'"""
    line = "string_agg(item::varchar,' ' order by item)||':'||cast(sum(u) as bigint)::varchar||':'||string_agg(u::varchar,' ' order by item)"
    root = "select item, rk, cast(sum(sfx) as bigint) su from r group by 1,2"
    projected = """, p as (select a.tid, a.item e, a.rk ark, a.u pu, b.rk, b.u from r a
        left join r b on a.tid=b.tid and b.rk>a.rk)"""
    return {
        "db_profile": f"""with t as ({_BR}) select count(distinct tid) n_transactions,
            count(distinct item) n_items, cast(max(item) as bigint) max_item,
            cast(sum(u) as bigint) total_utility from t""",
        "max_item": f"select max(item) max_item from ({_SK})",
        "first_transactions": f"""with t as ({_BR}), f as (select distinct tid from t order by tid limit 100)
            select t.* from t join f using(tid)""",
        "utility_text": f"""with t as ({_BR}), l as (select tid,
            string_agg(item::varchar||'['||u::varchar||'] ','' order by item)||' Remaining Utility:'
            ||cast(sum(u) as bigint)::varchar||' Prefix Utility:0' as value from t group by 1)
            select value, count(*) n from l group by 1""",
        "count_lines_containing": """with l as (select unnest(string_split(text, chr(10))) line from documents)
            select count(*) filter (contains(line,'a')) n_a, count(*) filter (contains(line,'b')) n_b, count(*) n
            from l""",
        "item_twu": f"{br} select * from w",
        "promising_items": f"{sk} select * from w where twu>={SK_MIN}",
        "item_rank": f"{sk} select * from rk",
        "revised_transactions": f"""{sk} select tid, string_agg(rk::varchar,' ' order by rk) items,
            string_agg(u::varchar,' ' order by rk) utils, cast(sum(u) as bigint) tu from r group by tid""",
        "emptied_transactions": f"{sk} select tid from tu where tid not in (select tid from r)",
        "suffix_utilities": f"{sk} select tid, item, rk, u, sfx from r",
        "root_subtree_utility": f"{sk} {root}",
        "primary_items": f"{sk} {root} having sum(sfx)>={SK_MIN}",
        "reverse_lex_order": f"""{br}, a as (select tid, list(-rk order by rk desc) k from r group by 1)
            select tid, cast(dense_rank() over (order by k) as bigint) pos from a""",
        "projected_transactions": f"""{br}{projected}, g as (select tid, e, pu,
            coalesce(string_agg(rk::varchar||'['||u::varchar||'] ','' order by rk),'')||' Remaining Utility:'
            ||cast(coalesce(sum(u), 0) as bigint)::varchar||' Prefix Utility:'||pu::varchar as value from p group by 1,2,3)
            select e, value, count(*) n from g group by 1,2""",
        "merged_projections": f"""{br}{projected}, g as (select tid, e, pu,
            string_agg(rk::varchar,' ' order by rk) suffix, cast(sum(u) as bigint) rem, list(u order by rk) us
            from p where rk is not null group by 1,2,3),
            m as (select e, suffix, count(*) n, cast(sum(pu) as bigint) pu, cast(sum(rem) as bigint) rem
                  from g group by 1,2),
            c as (select e, suffix, i, cast(sum(us[i]) as bigint) u from
                  (select e, suffix, us, unnest(range(1, len(us)+1)) i from g) group by 1,2,3),
            v as (select e, suffix, string_agg(u::varchar,' ' order by i) utils from c group by 1,2)
            select e, suffix, n, pu, rem, utils from m join v using(e, suffix)""",
        "extension_bounds": f"""{br} select a.item e, b.item z, cast(sum(a.sfx) as bigint) lu,
            cast(sum(a.u+b.sfx) as bigint) su from r a join r b on a.tid=b.tid and b.rk>a.rk group by 1,2""",
        "itemset_utilities": f"""with t as ({_BR}) select a.item i, b.item j, cast(sum(a.u+b.u) as bigint) utility,
            count(*) support from t a join t b on a.tid=b.tid and a.item<b.item group by 1,2""",
        "hui_level": mined,
        "hui_subtree": mined,
        "hui_no_merging": mined,
        "hui_no_subtree_pruning": mined,
        "hui_untrimmed": mined,
        "hui_skewed": f"{_mined(_SK, SK_LOW)} select items, size, utility from h",
        "hui_skewed_high": f"{_mined(_SK, SK_MIN)} select items, size, utility from h",
        "itemset_level_counts": f"{_mined(_BR, BR_MIN)} select size, count(*) n from h group by rollup(size)",
        "itemset_report": f"""{_mined(_BR, BR_MIN)} select cast(row_number() over (order by size, arr)-1 as bigint)
            pattern, size, items, utility from h""",
        "itemset_text": f"{_mined(_BR, BR_MIN)} select items||' #UTIL: '||utility as value from h",
        "itemset_lines": f"{_mined(_SK, SK_LOW)} select items||' #UTIL: '||utility as value from h",
        "without_item": f"""{_mined(_BR, BR_MIN)} select items,
            array_to_string(list_filter(arr, lambda x: x<>1),' ') rest from h where list_contains(arr,1)""",
        "search_nodes": f"{_mined(_SK, 1)} select items, size, utility from h",
        "mining_stats": stats,
        "search_stats": stats,
        "hui_raw_lines": mined,
        "utility_text_wide": f"""with t as (select tid, item, u*1000000000 u from ({_BR})),
            l as (select tid, {text} as value from t group by 1) select value, count(*) n from l group by 1""",
        "utility_text_first_n": f"""with t as ({_BR}), l as (select tid, {text} as value from t group by 1
            order by tid limit 100) select value, count(*) n from l group by 1""",
        "utility_text_dirty": f"""with t as ({_BR}), l as (select if(tid%5=1,'malformed','kept') kind,
            if(tid%5=1, 'x '||{line}, {text}) as value from t where tid%5 not in (0, 2) group by tid)
            select kind, value, count(*) n from l group by 1, 2""",
        "header_mismatches": f"""with t as ({_BR}), l as (select tid, cast(sum(u) as bigint) tu,
            string_agg(item::varchar,' ' order by item) i, string_agg(u::varchar,' ' order by item) us
            from t where tid%3=0 group by 1) select i||':'||(tu+1)::varchar||':'||us as value, tu+1 header_tu, tu,
            count(*) n from l group by 1, 2, 3""",
        **(llm_queries.oracle_sql() if llm_queries else {}),
    }
