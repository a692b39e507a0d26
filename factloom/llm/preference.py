"""Preference formatting: one prompt for the common turns, paired masked completions.

Only DataFrame functions: the turns of a pair are gathered in one aggregate
(one shuffle), the longest common turn prefix is the place of the first
unequal pair of turns, and prompt and completions are rendered from slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(f"{CLOSE}\n"))


def _segments(turns: Column) -> Column:
    """Each turn as its header, never trained on, and its body, trained on if the assistant speaks."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(_header(t).alias("text"), F.lit(False).alias("train")),
                F.struct(_body(t).alias("text"), (t["role"] == "assistant").alias("train")),
            ),
        )
    )


def format_preferences(turns: DataFrame, *, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair_id, n_prefix, prompt, chosen, rejected`` from rows of turns.

    ``side`` is 'chosen' or 'rejected'; other rows are an error of the caller
    and are left out.  Turns are ordered by number, then role, then text, so
    ties and repeated rows have one order; a null number comes first, a null
    role or text is empty.  ``n_prefix`` counts the leading turns equal in role
    and text.  ``prompt`` renders them once; ``chosen`` and ``rejected`` are
    arrays of (text, train) segments of what follows: all turns if nothing is
    shared, none if one conversation is the start of the other or is missing.
    A null pair is a pair of its own.  An empty table gives an empty table;
    other columns are not read.
    """
    one = F.struct(F.col(side).alias("side"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = turns.filter(F.col(side).isin("chosen", "rejected")).groupBy(F.col(pair).alias("pair_id")).agg(F.collect_list(one).alias("turns"))
    of = lambda name: F.array_sort(F.transform(F.filter("turns", lambda t: t["side"] == name), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))))
    split = gathered.select("pair_id", of("chosen").alias("c"), of("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    split = split.withColumn("n_prefix", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))
    rest = lambda name: _segments(F.slice(name, F.col("n_prefix") + 1, F.size(name)))
    return split.select(
        "pair_id",
        "n_prefix",
        F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n_prefix")), lambda t: F.concat(_header(t), _body(t))), "").alias("prompt"),
        rest("c").alias("chosen"),
        rest("r").alias("rejected"),
    )


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs made from a table of single conversations (``conv_id, turn, role, text``).

    Chosen is each conversation as it stands.  Rejected has its turns before
    its last assistant turn (all, if it has none), then the last assistant turn
    of the neighbour ``conv_id xor 1``.  Turns that follow the last assistant
    turn are left to the chosen side.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    marked = rows.join(last, "conv_id", "left")
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = marked.filter("last is null or turn < last or turn is null").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    there = rows.select(F.col("conv_id").alias("pair_id")).distinct()
    swapped = marked.filter("role = 'assistant' and turn = last").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.lit("rejected").alias("side"), F.lit(2**62).alias("turn"), "role", "text")
    return chosen.unionByName(kept).unionByName(swapped.join(there, "pair_id", "left_semi"))


def digest(formatted: DataFrame) -> DataFrame:
    joined = lambda name: F.array_join(F.transform(name, lambda s: s["text"]), "")
    mask = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", F.length(s["text"]), F.when(s["train"], "1").otherwise("0"))), ",")
    return formatted.select(
        "pair_id", "n_prefix", "prompt", joined("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), joined("rejected").alias("rejected"), mask("rejected").alias("rejected_mask")
    )


#: DuckDB SQL for the digest of the pairs of ``conversations``.
ORACLE = f"""
with last as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by conv_id),
marked as (select c.*, l.last from conversations c left join last l using (conv_id)),
turns as (
  select conv_id as pair_id, 'chosen' as side, turn, role, text from conversations
  union all select conv_id, 'rejected', turn, role, text from marked where last is null or turn < last or turn is null
  union all select xor(conv_id, 1), 'rejected', 4611686018427387904, role, text from marked
    where role = 'assistant' and turn = last and xor(conv_id, 1) in (select conv_id from conversations)
),
numbered as (
  select pair_id, side, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by pair_id, side order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from turns
),
prefix as (
  select pair_id, coalesce(min(case when same then null else k end) - 1, max(k)) as n_prefix from (
    select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.k, r.k) as k, coalesce(c.role = r.role and c.text = r.text, false) as same
    from (select * from numbered where side = 'chosen') c
    full outer join (select * from numbered where side = 'rejected') r on c.pair_id = r.pair_id and c.k = r.k
  ) group by pair_id
),
rendered as (
  select n.*, p.n_prefix, '{OPEN}' || role || chr(10) as head, text || '{CLOSE}' || chr(10) as body
  from numbered n join prefix p using (pair_id)
)
select pair_id, cast(max(n_prefix) as integer) as n_prefix,
  coalesce(string_agg(head || body, '' order by k) filter (side = 'chosen' and k <= n_prefix), '') as prompt,
  coalesce(string_agg(head || body, '' order by k) filter (side = 'chosen' and k > n_prefix), '') as chosen,
  coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || (case when role = 'assistant' then '1' else '0' end), ',' order by k)
    filter (side = 'chosen' and k > n_prefix), '') as chosen_mask,
  coalesce(string_agg(head || body, '' order by k) filter (side = 'rejected' and k > n_prefix), '') as rejected,
  coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || (case when role = 'assistant' then '1' else '0' end), ',' order by k)
    filter (side = 'rejected' and k > n_prefix), '') as rejected_mask
from rendered group by pair_id
"""
