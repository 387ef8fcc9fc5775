"""The two-layer funnel: category, then part, then its attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import Catalogue
from .categories import resolved
from .matching import USED, Asked, matched

EVENTS = ("cat", "cat-other", "part", "part-other", "side", "pos", "restart")


def next_question(category: Column, part: Column) -> Column:
    """What is to be asked next: category, part, side, position, or none."""
    needs = part["needs_clarification"]
    return (
        F.when(category["status"] == "category_ambiguous", "category")
        .when(part["status"] == "ambiguous", "part")
        .when(F.array_contains(needs, "side"), "side")
        .when(F.array_contains(needs, "position"), "position")
        .otherwise("none")
    )


def funnel(phrases: DataFrame, catalogue: Catalogue, index: DataFrame) -> DataFrame:
    """Add category_result, result and next_question to a table of phrases.

    An unresolved word is matched without a restriction, a resolved one within its category, and where the
    category is ambiguous the question comes first (the match within no category is still there). All other columns stay,
    whatever their names; restrict_category is the category that was resolved, and tier that of match().
    """
    asked = Asked(phrases, "phrase")
    pairs = asked.pairs()
    rows = resolved(asked, index, pairs).withColumn("restrict_category", F.col("category_result.category"))
    out = matched(asked, rows, catalogue, pairs).withColumn("next_question", next_question(F.col("category_result"), F.col("result")))
    return asked.put_back(out, dict.fromkeys((*USED, "category_result", "result", "tier", "next_question")))


def fold_answers(answers: DataFrame) -> DataFrame:
    """The state of each session after its answers.

    session, category, part_id, side, position, category_said (a category was chosen, or none of them),
    part_refused (none of the parts was it), n_answers.

    answers has session, step, event and value. "cat-other" and "part-other" clear what they answer, a new
    category clears the part, a new part its attributes, and "restart" everything. Steps of a session are
    folded by when each field was last set or cleared, which are maxima, so long sessions need no order in
    one task.
    """
    if_event = lambda *names: F.col("event").isin(*names)
    fields = {
        "category": (("cat",), ("cat-other", "restart")),
        "part_id": (("part",), ("part-other", "cat", "cat-other", "restart")),
        "side": (("side",), ("part", "part-other", "cat", "cat-other", "restart")),
        "position": (("pos",), ("part", "part-other", "cat", "cat-other", "restart")),
        "category_said": (("cat", "cat-other"), ("restart",)),
        "part_refused": (("part-other",), ("part", "cat", "cat-other", "restart")),
    }
    found = {}
    for name, (sets, clears) in fields.items():
        last = F.max(F.when(if_event(*sets, *clears), F.struct("step", if_event(*sets).alias("set"), "value")))
        flag = name in ("category_said", "part_refused")
        found[name] = (F.coalesce(last["set"], F.lit(False)) if flag else F.when(last["set"], last["value"])).alias(name)
    return answers.groupBy("session").agg(*found.values(), F.count(F.lit(1)).alias("n_answers"))


def answered(phrases: DataFrame, catalogue: Catalogue, state: DataFrame, index: DataFrame) -> DataFrame:
    """Phrases (with session) matched under what their sessions have answered, with what is still to be asked.

    Adds category_result, result, chosen (a part_id) and next_question: "category" while the category is
    ambiguous and nothing was said of it, "phrase" once all parts were refused (another phrase is needed),
    then "part", "side", "position", "none". A category that was chosen restricts the match, as does one
    that is resolved; after "cat-other" nothing does. All other columns stay, whatever their names.
    """
    asked = Asked(phrases, "phrase")
    pairs, session = asked.pairs(), asked.column("session")
    said = state.select(F.col("session").alias("of"), F.col("category").alias("said_category"), F.col("part_id").alias("said_part"), F.col("side").alias("said_side"), F.col("position").alias("said_position"), "category_said", "part_refused")
    rows = resolved(asked, index, pairs).withColumn("session", session).join(said, F.col("session") == F.col("of"), "left")
    category = F.when(F.col("category_said"), F.col("said_category")).otherwise(F.col("category_result.category"))
    out = matched(asked, rows.withColumn("restrict_category", category), catalogue, pairs)
    pick = F.filter(F.col("result.candidates"), lambda c: c["part_id"] == F.col("said_part"))
    single = (F.col("result.status") == "single_match") | (F.size(pick) == 1)
    chosen = F.when(F.col("result.status") == "single_match", F.col("result.part_id")).otherwise(F.get(pick, F.lit(0))["part_id"])
    flags = catalogue.parts.select(F.col("part_id").alias("chosen"), "side_flag", "position_flag")
    out = out.withColumn("chosen", F.when(single, chosen)).join(flags, "chosen", "left")
    ask = lambda flag, said, got: F.col(flag) & F.col(said).isNull() & F.col(got).isNull()
    open_category = (F.col("category_result.status") == "category_ambiguous") & ~F.coalesce("category_said", F.lit(False))
    question = F.when(open_category, "category").when(F.coalesce("part_refused", F.lit(False)), "phrase")
    question = question.when(F.col("chosen").isNull() & (F.col("result.status") == "ambiguous"), "part")
    question = question.when(ask("side_flag", "said_side", "result.attributes.side"), "side").when(ask("position_flag", "said_position", "result.attributes.position"), "position")
    out = out.withColumn("next_question", question.otherwise("none"))
    return asked.put_back(out, dict.fromkeys((*USED, "category_result", "result", "tier", "chosen", "next_question")))
