"""Metrics over tables of syntax nodes (see `faktum.sources.scripts`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One name for an operator's spellings; an assignment with an operation counts as the operation.
OPERATORS = {
    "xor": "^ ^=", "band": "& &=", "bor": "| |=", "bnot": "~", "shl": "<< <<=", "shr": ">> >>=", "ushr": ">>> >>>=", "add": "+ +=", "sub": "- -=", "mul": "* *=", "div": "/ /=", "mod": "% %=", "pow": "** **=",
    "eq": "== ===", "ne": "!= !==", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "land": "&&", "lor": "||", "lnot": "!", "coalesce": "?? ??=",
}


def operator(op: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(y) for name, own in OPERATORS.items() for x in own.split() for y in (x, name))), op)


def tree_metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a script: counts of nodes, calls, bindings, chains of members, identifiers, arrays, sequences, functions and loops; zero values are null as far as they are left out."""
    kind, name = F.col("kind"), F.col("name")
    is_ = lambda x: kind == x
    some = lambda x: F.when(x > 0, x)
    chain = kind.isin("member", "subscript") & name.isNotNull()
    flagged = lambda x: some(F.count_if(F.array_contains(F.split(F.coalesce("flag", F.lit("")), ","), x)))
    functions = F.count_if(is_("function"))
    all_numbers = lambda x: F.max(F.when(is_(x) & (F.col("arity") >= 2) & (F.col("numbers") == F.col("arity")), F.col("arity")))
    return nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("node_count"),
        F.max("depth").alias("max_depth"),
        F.max(F.when(is_("capped"), 1)).alias("depth_capped"),
        F.count_if(is_("call")).alias("call_count"),
        F.max(F.when(chain, F.regexp_count(name, F.lit(r"\.")) + 1)).alias("member_depth_max"),
        F.max("terms").alias("string_concat_chain_max_length"),
        some(F.max(F.when(is_("array"), F.col("arity")))).alias("array_literal_max_length"),
        all_numbers("array").alias("numeric_array_max_length"),
        some(F.count_if(kind.isin("assign", "declare") & name.isNotNull())).alias("bind_count"),
        some(F.count_if(chain & F.col("fresh"))).alias("member_count"),
        some(F.count_if(is_("identifier") & F.col("fresh"))).alias("identifier_count"),
        some(F.count_if(is_("sequence"))).alias("sequence_count"),
        all_numbers("sequence").alias("numeric_sequence_max_length"),
        flagged("identity").alias("identity_function_count"),
        flagged("string").alias("string_return_function_count"),
        F.round(flagged("string") / functions, 6).alias("string_return_function_ratio"),
        flagged("constant").alias("const_return_function_count"),
        F.round(flagged("constant") / functions, 6).alias("const_return_function_ratio"),
        flagged("same").alias("self_compare_count"),
        flagged("endless").alias("infinite_loop_count"),
    )


def operator_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, n, density): how often each operator stands in a script, also by node."""
    own = nodes.select(*keys, operator(F.col("op")).alias("op"))
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), *(F.count_if(F.col("op") == x).alias(x) for x in OPERATORS))
    rows = counts.select(*keys, "nodes", F.inline(F.array(*(F.struct(F.lit(x).alias("op"), F.col(x).alias("n")) for x in OPERATORS)))).filter("n > 0")
    return rows.select(*keys, "op", "n", F.round(F.col("n") / F.col("nodes"), 6).alias("density"))
