"""Character-budgeted prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROMPT_CHARS = 12000
#: Our template; {question}, {docs}, {history} and {triples} are filled in.
TEMPLATE = "Answer the question from the material.\n\nQuestion: {question}\n\nMaterial:\n{docs}\n\nConversation:\n{history}\n\nRelations:\n{triples}\n"
EMPTY = {"docs": "(no material)", "history": "(no conversation)", "triples": "(no relations)"}


def budget_prefix(entries: DataFrame, separator: int, charge_first: bool = False, budget: str = "budget") -> DataFrame:
    """The longest prefix of entries (query_id, pos, entry, budget) whose running length fits, with ``left``, the budget after it.

    An entry is checked as used + length and then costs length + ``separator``; with ``charge_first`` the cost is added before the check, so the
    entry that overflows is charged too. Entries after the first overflow never fit."""
    by = Window.partitionBy("query_id").orderBy("pos")
    length = F.length("entry")
    before = F.coalesce(F.sum(length + separator).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = entries.withColumn("_need", before + length + (separator if charge_first else 0)).withColumn("_cost", before + length + separator)
    over = F.min(F.when(F.col("_need") > F.col(budget), F.col("pos"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_over", over)
    used = F.max(F.when(F.col("_over").isNull() | (F.col("pos") < F.col("_over")) | (F.lit(charge_first) & (F.col("pos") == F.col("_over"))), F.col("_cost"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("left", F.col(budget) - F.coalesce(used, F.lit(0)))
    return rows.withColumn("fits", F.col("_over").isNull() | (F.col("pos") < F.col("_over"))).drop("_need", "_cost", "_over")


def section(entries: DataFrame, budgets: DataFrame, separator: str, charge_first: bool = False) -> DataFrame:
    """(query_id, text, left) for every question of budgets (query_id, budget); entries: (query_id, pos, entry)."""
    rows = budget_prefix(entries.join(budgets, "query_id"), len(separator), charge_first)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("pos", "entry")))), lambda x: x["entry"])
    done = rows.groupBy("query_id").agg(F.array_join(parts, separator).alias("text"), F.min("left").alias("left"))
    return budgets.join(done, "query_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("left", "budget").alias("left"))


def build_prompt(questions: DataFrame, docs: DataFrame, history: DataFrame, triples: DataFrame, chars: int = PROMPT_CHARS, template: str = TEMPLATE) -> DataFrame:
    """(query_id, prompt): the budget goes to documents, what is left to history, then to triples; empty parts get a placeholder.

    docs, history and triples: (query_id, pos, entry); questions: (query_id, question)."""
    budgets = questions.select("query_id", F.lit(chars).alias("budget"))
    d = section(docs, budgets, "\n\n")
    h = section(history, d.select("query_id", F.col("left").alias("budget")), "\n", charge_first=True)
    t = section(triples, h.select("query_id", F.col("left").alias("budget")), "\n")
    rows = questions.join(d.select("query_id", F.col("text").alias("docs")), "query_id").join(h.select("query_id", F.col("text").alias("history")), "query_id").join(t.select("query_id", F.col("text").alias("triples")), "query_id")
    prompt = F.lit(template)
    for part, empty in EMPTY.items():
        prompt = F.replace(prompt, F.lit("{" + part + "}"), F.when(F.col(part) == "", empty).otherwise(F.col(part)))
    return rows.select("query_id", F.replace(prompt, F.lit("{question}"), F.col("question")).alias("prompt"))
