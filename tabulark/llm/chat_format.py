"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative
template says which text segments a turn gives and which of them count towards the loss.

A template has `transitions` {state: {role: state}} from the state "start", `accept` (states a
conversation may end in) and `roles` {role: [(part, loss), ...]}, where a part of None is the turn's text.

Defined results: turns are ordered by `turn`. A valid conversation gives its segments in order; one that
is not gives a single row of segment -1 with the reason in `error`: a null turn, a null text, two
different rows of one turn, a role the state has no way for (null roles count as "null"), or an end
in a state that isn't accepted. Repeated rows count once, rows with a null conv_id are left out, an
empty text keeps its empty segment. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "transitions": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    "accept": ["assistant"],
    "roles": {
        "system": [("<|system|>\n", False), (None, False), ("<|end|>\n", False)],
        "user": [("<|user|>\n", False), (None, False), ("<|end|>\n", False)],
        "assistant": [("<|assistant|>\n", False), (None, True), ("<|end|>\n", True)],
    },
}


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, segment, role, text, loss, error); see the module for each edge case."""
    steps = [x for s, to in template["transitions"].items() for r, t in to.items() for x in (F.lit(f"{s}>{r}"), F.lit(t))]
    ways = F.create_map(*steps)

    def step(state, turn):
        role = F.coalesce(turn["role"], F.lit("null"))
        to = F.try_element_at(ways, F.concat(state, F.lit(">"), role))
        return F.when(state.startswith("!"), state).otherwise(F.coalesce(to, F.concat(F.lit("!"), role, F.lit(" after "), state)))

    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_distinct(F.array_sort(F.collect_list("t"))).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), step)
    order = F.transform("turns", lambda t: t["turn"])
    error = (
        F.when(F.exists("turns", lambda t: t["turn"].isNull()), "null turn")
        .when(F.exists("turns", lambda t: t["text"].isNull()), "null text")
        .when(F.size(F.array_distinct(order)) < F.size("turns"), "repeated turn")
        .when(state.startswith("!"), F.substring(state, 2, 1_000_000))
        .when(~state.isin(template["accept"]), F.concat(F.lit("ends in "), state))
    )
    checked = chats.select("conv_id", "turns", error.alias("error"))

    def segments(turn):
        made = F.array().cast("array<struct<role:string,text:string,loss:boolean>>")
        for role, parts in template["roles"].items():
            listed = F.array(*[F.struct(F.lit(role).alias("role"), (turn["text"] if part is None else F.lit(part)).alias("text"), F.lit(loss).alias("loss")) for part, loss in parts])
            made = F.when(turn["role"] == role, listed).otherwise(made)
        return made

    nothing = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("loss")))
    listed = checked.select("conv_id", "error", F.when(F.col("error").isNull(), F.flatten(F.transform("turns", segments))).otherwise(nothing).alias("s"))
    out = listed.select("conv_id", "error", F.posexplode("s").alias("k", "s"))
    return out.select("conv_id", F.when(F.col("error").isNull(), F.col("k")).otherwise(-1).alias("segment"), "s.role", "s.text", "s.loss", "error")


SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
o as (select *, coalesce(role, 'null') as r, row_number() over w as k, coalesce(lag(coalesce(role, 'null')) over w, 'start') as before,
             count(*) over (partition by conv_id) as n from t window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
b as (select *, concat(before, '>', r) in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') as ok from o),
e as (select conv_id, case when bool_or(turn is null) then 'null turn' when bool_or(text is null) then 'null text'
        when count(distinct turn) < count(*) then 'repeated turn'
        when bool_or(not ok) then min_by(concat(r, ' after ', before), k) filter (not ok)
        when max_by(r, k) <> 'assistant' then concat('ends in ', max_by(r, k)) end as error from b group by conv_id),
s as (select b.conv_id, (3 * (k - 1) + p.p)::int as segment, role, case p.p when 0 then concat('<|', role, '|>', chr(10)) when 1 then text else concat('<|end|>', chr(10)) end as text,
        role = 'assistant' and p.p > 0 as loss, null::varchar as error
      from b join e using (conv_id), (values (0), (1), (2)) p(p) where e.error is null)
select * from s union all select conv_id, -1, null, null, false, error from e where error is not null
"""
