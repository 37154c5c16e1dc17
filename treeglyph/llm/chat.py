"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

A dialogue is rendered once for each participant: that speaker's turns as assistant, the others' as users with their names, and passive roles (system)
as they are. The mask has a character for each one of the rendering: 1 on what the assistant says and its end mark, else 0.

Turns are ordered by number, speaker and text, so ties and repeated rows have a fixed place; null numbers come first; a null text is
empty; a null speaker is the participant "unknown"; rows without a conversation belong to one of their own, with a null id. A dialogue without
participants gives no rows, and an empty table none. What opens a marker in a text or a name (``<|``) is rendered as ``< |``, and a name's line breaks as blanks, so no text
can pass for a turn. A rendering is one value, so a dialogue has to fit into a row; turns are gathered by dialogue, the
participants come from the gathered turns, and no other shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARK, SHOWN = "<|", "< |"
UNKNOWN = "unknown"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(SHOWN))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", passive: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_col, speaker, n_turns, n_own, rendered and mask: a row for each dialogue and participant."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("speaker"),
        _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    talks = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    active = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["speaker"].isin(*passive)), lambda t: t["speaker"]))
    sides = talks.select(conv_col, "turns", F.explode(active).alias("speaker"))
    me = F.col("speaker")

    def head(t: Column) -> Column:
        role = F.when(t["speaker"] == me, F.lit("assistant")).when(t["speaker"].isin(*passive), t["speaker"]).otherwise(F.concat(F.lit("user name="), _plain(F.translate(t["speaker"], "\r\n", "  "))))
        return F.concat(F.lit(START), role, F.lit("\n"))

    def mask(t: Column) -> Column:
        own = F.when(t["speaker"] == me, F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.repeat(F.lit("0"), F.length(head(t))), F.repeat(own, F.length(t["text"]) + len(END)), F.lit("0"))

    return sides.select(
        conv_col,
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["speaker"] == me)).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))), "").alias("rendered"),
        F.array_join(F.transform("turns", mask), "").alias("mask"),
    )


def rotation_digests(turns: DataFrame) -> DataFrame:
    r = rotate(turns)
    sha = lambda c: F.sha2(F.col(c), 256)
    return r.select(
        "conv_id", "speaker", "n_turns", "n_own", F.length("rendered").cast("long").alias("n_chars"), F.length(F.replace("mask", F.lit("0"), F.lit(""))).cast("long").alias("n_masked"), sha("rendered").alias("rendered_sha256"), sha("mask").alias("mask_sha256")
    )


ROTATION_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as who, replace(coalesce(text, ''), '<|', '< |') as said from conversations
), sides as (
  select distinct conv_id, who as speaker from t where who <> 'system'
), lines as (
  select s.conv_id, s.speaker, t.turn, t.who, t.said,
    '<|im_start|>' || case when t.who = s.speaker then 'assistant' when t.who = 'system' then t.who else 'user name=' || replace(translate(t.who, chr(13) || chr(10), '  '), '<|', '< |') end || chr(10) as head
  from sides s join t on t.conv_id is not distinct from s.conv_id
), whole as (
  select conv_id, speaker, count(*) as n_turns, count(*) filter (who = speaker) as n_own,
    string_agg(head || said || '<|im_end|>' || chr(10), '' order by turn nulls first, who, said) as rendered,
    string_agg(repeat('0', length(head)) || repeat(case when who = speaker then '1' else '0' end, length(said) + 10) || '0', '' order by turn nulls first, who, said) as mask
  from lines group by conv_id, speaker
)
select conv_id, speaker, n_turns::bigint as n_turns, n_own::bigint as n_own, length(rendered)::bigint as n_chars,
  length(replace(mask, '0', ''))::bigint as n_masked, sha256(rendered) as rendered_sha256, sha256(mask) as mask_sha256
from whole
"""
