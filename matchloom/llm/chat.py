r"""Chat formatting with a round trip through a grammar, on DataFrame functions alone.

    conversation := turn*
    turn         := "### " role ": " text " </turn>" newline

A backslash escapes a control string ("###", "</turn>") or another backslash in a text; in a role, a colon
is written "\;" as well. A text is first rendered as it is. Where the parser would not give it back
(control strings, or backslashes that read as escapes), it is escaped. The whole output is then parsed and compared
with the source, role by role and text by text, in full. Where they differ, all of the conversation's texts are escaped,
and it is parsed and compared once more; exact says whether they are the same in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_END = " </turn>\n"
_CONTROL = r"(\\|###|</turn>)"
_ESCAPED = r"\\(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\;"))


def _unrole(role: Column) -> Column:
    # "\;" only ever stands for a colon: before a semicolon of the role itself, backslashes come in pairs
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\;", "$1:"), _ESCAPED, "$1")


def _reads_back(text: Column) -> Column:
    """Whether the parser gives a text back as it is."""
    return ~text.rlike(r"###|</turn>") & (unescape(text) == text)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>. What is not a turn gives a null one."""
    chunks = F.split(formatted, r"\Q" + _END + r"\E", -1)

    def turn(chunk: Column) -> Column:
        colon = F.locate(": ", chunk, 5)
        role, text = F.substr(chunk, F.lit(5), colon - 5), F.substr(chunk, colon + 2)
        good = chunk.startswith("### ") & (colon > 0) & ~F.regexp_replace(text, _ESCAPED, ".").rlike("###|</turn>")
        return F.when(good, F.struct(_unrole(role).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), turn)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points) of the assistant's texts in it, and exact.

    exact: the parser gives all turns back as they were. A conversation that it does not give back as it was
    rendered first has every text escaped. No text is known for which exact is false then; such a conversation is
    returned all the same, marked.

    Turns go by turn_col (null first); ties go by role and text, and repeated rows are repeated turns. A
    null text or role is empty; rows with a null conversation id form one conversation. An empty table
    gives no row. Other columns are left out, whatever their names.

    Rows are rendered before the shuffle. A conversation becomes one string, so it is together in one task;
    its size is what a string can hold.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit("### "), _role(F.col("role")), F.lit(": "))
    safe = escape(F.col("text"))
    body = F.when(_reads_back(F.col("text")), F.col("text")).otherwise(safe)
    turns = turns.select("*", head.alias("head"), body.alias("body")).withColumn("safe", F.when(safe != F.col("body"), safe))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def span(body: Column) -> Column:
        size = F.length("head") + F.length(body) + len(_END)
        before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return F.when(F.col("role") == ASSISTANT, F.struct((before + F.length("head")).cast("long").alias("start"), F.length(body).cast("long").alias("length")))

    line = lambda body: F.concat("head", body, F.lit(_END))
    lines = turns.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("k"), line("body").alias("line"), F.struct("role", "text").alias("turn"), span(F.col("body")).alias("span"),
            line("safe").alias("safe"), span(F.coalesce("safe", "body")).alias("safe_span"),
        ).alias("t"),
    )
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    same = lambda formatted: F.coalesce(parse(formatted) == F.col("t.turn"), F.lit(False))
    first = whole.withColumn("formatted", F.array_join("t.line", "")).withColumn("first", same(F.col("formatted")))
    again = F.array_join(F.transform("t", lambda x: F.coalesce(x["safe"], x["line"])), "")
    out = first.withColumn("formatted", F.when(F.col("first"), F.col("formatted")).otherwise(again))
    spans = F.filter(F.when(F.col("first"), F.col("t.span")).otherwise(F.col("t.safe_span")), lambda s: s.isNotNull())
    return out.select("conv_id", "formatted", spans.alias("loss_spans"), (F.col("first") | same(F.col("formatted"))).alias("exact"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
