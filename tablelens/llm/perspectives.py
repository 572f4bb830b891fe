"""Multi-party chat: one rendering of a dialogue for each of its speakers.

From a speaker's perspective its turns are the assistant's, all others come
from named users, and turns of context roles (system) stay what they are. Only
built-in functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.plans.arranged import Arranged


@dataclass(frozen=True)
class Template:
    """What stands around a turn."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    assistant: str = "assistant"
    user: str = "user"
    name: str = " name="


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context: tuple[str, ...] = ("system",),
    template: Template = Template(),
    unnamed: str = "unknown",
) -> DataFrame:
    """One row per conversation, participant and turn: ``(conv_id, participant,
    position, turn, speaker, role, rendered, loss_start, loss_end, start)``.

    The dialogue of a perspective is its ``rendered`` parts put together by
    ``position``; ``start`` is the place of the part in it, in characters, so a
    dialogue of any length is never one value. The mask bears loss on
    ``[loss_start, loss_end)``, counted in the whole dialogue: the assistant's text
    and its end mark; it is empty for all other turns.

    A NULL speaker is called ``unnamed``, a NULL text is empty, turns with NULL order
    come first, NULL conversations are one conversation. Ties of the order are
    broken by speaker and text; repeated rows are repeated turns. Conversations in
    which only context roles speak have no participant and so no perspective; an
    empty table gives no rows. Other columns are not read.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{order}`").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit(unnamed)).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    t, is_context = template, F.col("speaker").isin(*context) if context else F.lit(False)
    people = (
        rows.where(~is_context)
        .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant"))
        .distinct()
    )
    is_self = F.col("speaker") == F.col("participant")
    role = F.when(is_self, F.lit(t.assistant)).when(is_context, F.col("speaker")).otherwise(F.lit(t.user))
    named = F.when(is_context, F.lit("")).otherwise(F.concat(F.lit(t.name), F.col("speaker")))
    head = F.concat(F.lit(t.start), role, F.when(is_self, F.lit("")).otherwise(named), F.lit("\n"))
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "participant",
        "turn",
        "speaker",
        "text",
        role.alias("role"),
        F.concat(head, F.col("text"), F.lit(t.end)).alias("rendered"),
        F.length(head).cast("long").alias("_head"),
        is_self.alias("_self"),
    )
    arranged = Arranged(seen, ["conv_id", "participant"], ["turn", "speaker", "text"])
    placed = arranged.before(
        {"position": F.lit(1).cast("long"), "start": F.length("rendered").cast("long")}
    )
    end = F.col("start") + F.length("rendered")
    return placed.select(
        "conv_id",
        "participant",
        "position",
        "turn",
        "speaker",
        "role",
        "rendered",
        F.when(F.col("_self"), F.col("start") + F.col("_head")).otherwise(end).alias("loss_start"),
        end.alias("loss_end"),
        "start",
    )
