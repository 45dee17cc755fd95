"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of tokens choose the windows greedily: a window takes turns as long as the tokens since its first turn fit its
room, which is the budget less the system turn and less the history that it repeats. Each window begins with the
conversation's system turn and with as many of the last turns of the window before as fit the history budget; these are
marked as repeated and carry no loss, so each assistant text is a target once. Where they and the window's first turn
are too long together, nothing is repeated; a turn that alone is too long has a window of its own, which says so. Windows
are chosen within blocks of `BLOCK` turn numbers, from numbers without texts, so no task needs a whole long
conversation; the first window of a block repeats nothing.

A turn is written as `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end; a repeated one
begins with `<|im_again|>`. Control strings inside texts are broken by a backslash behind their first character,
backslashes are doubled; roles are URL-encoded. `read_back` undoes this.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), role and text; repeated
rows are turns of their own; rows of a null conversation form one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import table

BUDGET, HISTORY, BLOCK = 512, 96, 1024
NEW, AGAIN, END = "<|im_start|>", "<|im_again|>", "<|im_end|>\n"
#: The first characters of control strings, before their rest.
_CONTROL = r"([<\[])(?=\|im_(?:start|again|end)\|>|/?s>|/?INST\]|</?SYS>>)"
_TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_tokens(text: Column) -> Column:
    """A token estimate: one for every four bytes, and four for the marks of a turn."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def _windows(turns: Column, room: Column, history: int) -> Column:
    """Turns (place, tokens), in order, to (place, window, carry): the window's number, and whether it repeats what the one before ended with.

    `last` holds the tokens of the window's last turns that are together within the history.
    """
    start = F.struct(
        F.lit(-1).cast("long").alias("window"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("carry"), F.array().cast("array<bigint>").alias("last"),
        F.array().cast("array<struct<place:bigint,window:bigint,carry:boolean>>").alias("out"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def step(s: Column, t: Column) -> Column:
        t_tokens = t["tokens"].cast("long")
        fits = (s["window"] >= 0) & (s["used"] + t_tokens <= room)
        repeated = total(s["last"])
        carry = F.when(fits, s["carry"]).otherwise((s["window"] >= 0) & (repeated + t_tokens <= room))
        window = F.when(fits, s["window"]).otherwise(s["window"] + 1)
        used = t_tokens + F.when(fits, s["used"]).when(carry, repeated).otherwise(F.lit(0).cast("long"))
        recent = F.when(fits, F.array_append(s["last"], t_tokens)).otherwise(F.array(t_tokens))
        last = F.filter(recent, lambda x, i: total(F.slice(recent, i + 1, F.size(recent))) <= history)
        return F.struct(window.alias("window"), used.alias("used"), carry.alias("carry"), last.alias("last"), F.array_append(s["out"], F.struct(t["place"].cast("long").alias("place"), window.alias("window"), carry.alias("carry"))).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=turn_tokens, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_tokens, over_budget): one row for each window, windows in order of `window`.

    loss_spans are (start, length) in characters of `formatted`. `tokens` gives a turn's tokens from its text: an
    estimate by default, or any expression, such as a column of counts. A window over the budget, which holds a turn
    that alone does not fit beside the system turn, says so in over_budget; texts are never cut.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    above = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.min_by(F.struct("role", "tokens"), F.struct("turn", "role", "text")).alias("first"))
    lead = F.first("first").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("conv", "block", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows0"), lead.alias("lead"))
    sums = sums.select(F.col("conv").alias("s_conv"), F.col("block").alias("s_block"), "rows0", F.when(F.col("lead.role") == "system", F.col("lead.tokens")).alias("cost"))
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("end", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block")))
    rows = rows.withColumn("place", F.col("place") + F.col("rows0"))
    is_system = F.col("cost").isNotNull() & (F.col("place") == 1)
    rows = rows.withColumn("is_system", is_system).select("conv", "block", "place", "role", "text", "tokens", "end", "rows0", "cost", "is_system")
    # A block's turns, as numbers alone, to their windows; a window's number is above all of the blocks before.
    turns_of = rows.where("not is_system").groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("place", "tokens"))).alias("turns"), F.first("rows0").alias("rows0"), F.greatest(F.lit(budget) - F.coalesce(F.first("cost"), F.lit(0)), F.lit(budget // 4)).alias("room"))
    chosen = turns_of.select("conv", "rows0", F.explode(_windows(F.col("turns"), F.col("room"), history)).alias("w")).select(F.col("conv").alias("w_conv"), F.col("w.place").alias("w_place"), (F.col("rows0") + F.col("w.window")).alias("window"), F.col("w.carry").alias("carry"))
    placed = rows.where("not is_system").join(chosen, F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("place") == F.col("w_place"))).select("conv", "place", "role", "text", "tokens", "end", "window", "carry")
    # One row a window: where it ends, and which window comes next.
    own = Window.partitionBy("conv").orderBy("window")
    ends = placed.groupBy("conv", "window").agg(F.max("end").alias("last"), F.first("carry").alias("carry"))
    ends = ends.select(F.col("conv").alias("e_conv"), F.col("window").alias("e_window"), "last", F.lead("window").over(own).alias("next"), F.lead("carry").over(own).alias("next_carry"), F.row_number().over(own).alias("nth"))
    same = F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("window") == F.col("e_window"))
    placed = placed.join(ends.drop("nth"), same)
    again = F.coalesce("next_carry", F.lit(False)) & (F.col("last") - F.col("end") + F.col("tokens") <= history)
    uses = F.array_compact(F.array(F.struct(F.col("window").alias("window"), F.lit(True).alias("new")), F.when(again, F.struct(F.col("next").alias("window"), F.lit(False).alias("new")))))
    placed = placed.select("conv", "place", "role", "text", "tokens", F.explode(uses).alias("use")).select("conv", "use.window", "place", "role", "text", "tokens", "use.new")
    # The system turn goes to every window; a conversation of a system turn alone still is one window.
    systems = rows.where("is_system").withColumn("window", F.lit(-1).cast("long")).join(ends.select("e_conv", "e_window", "nth"), F.col("conv").eqNullSafe(F.col("e_conv")), "left")
    systems = systems.select("conv", F.coalesce("e_window", "window").alias("window"), F.lit(0).cast("long").alias("place"), "role", "text", "tokens", (F.coalesce("nth", F.lit(1)) == 1).alias("new"))
    every = placed.unionByName(systems)
    head = F.concat(F.when(F.col("new"), NEW).otherwise(AGAIN), F.url_encode("role"), F.lit("\n"))
    every = every.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("written", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv", "window").orderBy("place")
    start = F.sum(F.length("written")).over(order) - F.length("written") + F.length("head")
    loss = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    parts = every.withColumn("loss", loss).groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("place", "written", "loss"))).alias("parts"), F.sum("tokens").alias("n_tokens"))
    return parts.select(
        F.col("conv").alias(conv), "window", F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"),
        F.array_compact(F.transform("parts", lambda p: p["loss"])).alias("loss_spans"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """`windows` plus what its `formatted` says: turns (role, text) that are not repeated, and loss_texts."""
    roles, texts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1)), F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(F.url_decode(r).alias("role"), unescape(t).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.withColumn("turns", turns).withColumn("loss_texts", loss)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    back = read_back(format_chats(chats))
    part = back.select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("loss_texts", "").alias("loss"),
    )
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"))
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


OP6_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM c),
s AS (SELECT conv_id, tokens AS cost FROM t WHERE place = 1 AND role = 'system'),
p AS (
  SELECT t.*, cost, coalesce(floor(turn / {BLOCK}), -1) AS block, sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY place) AS last, greatest({BUDGET} - coalesce(cost, 0), {BUDGET // 4}) AS room,
         12 + length(role) + 1 + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\|im_(?:start|again|end)\|>|<</?SYS>>|</?s>|\[/?INST\]')) + 11 AS chars
  FROM t LEFT JOIN s ON t.conv_id = s.conv_id),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY place) AS k FROM p WHERE cost IS NULL OR place > 1),
y(conv_id, block, k, win, used, carry, tail) AS (
  SELECT conv_id, block, k, 0, tokens, false, CASE WHEN tokens <= {HISTORY} THEN [tokens] ELSE CAST([] AS BIGINT[]) END FROM q WHERE k = 1
  UNION ALL
  SELECT conv_id, block, k, win, used, carry, [base[i] FOR i IN range(1, len(base) + 1) IF list_sum(base[i:]) <= {HISTORY}] FROM (
    SELECT q.conv_id, q.block, q.k, CASE WHEN y.used + tokens <= room THEN y.win ELSE y.win + 1 END AS win,
      tokens + CASE WHEN y.used + tokens <= room THEN y.used WHEN coalesce(list_sum(tail), 0) + tokens <= room THEN coalesce(list_sum(tail), 0) ELSE 0 END AS used,
      CASE WHEN y.used + tokens <= room THEN y.carry ELSE coalesce(list_sum(tail), 0) + tokens <= room END AS carry,
      CASE WHEN y.used + tokens <= room THEN list_append(tail, tokens) ELSE [tokens] END AS base
    FROM y JOIN q ON q.conv_id = y.conv_id AND q.block = y.block AND q.k = y.k + 1)),
x AS (SELECT q.*, (q.block, win) AS win, carry FROM q JOIN y ON q.conv_id = y.conv_id AND q.block = y.block AND q.k = y.k),
w AS (SELECT conv_id, win, max(last) AS upto, lead(bool_or(carry)) OVER (PARTITION BY conv_id ORDER BY win) AS next FROM x GROUP BY conv_id, win),
n AS (SELECT conv_id, count(*) AS n FROM w GROUP BY 1),
f AS (
  SELECT x.conv_id, chars * CASE WHEN next AND upto - last + tokens <= {HISTORY} THEN 2 ELSE 1 END AS chars FROM x JOIN w ON x.conv_id = w.conv_id AND x.win = w.win
  UNION ALL SELECT p.conv_id, chars * coalesce(n, 1) FROM p LEFT JOIN n ON p.conv_id = n.conv_id WHERE cost IS NOT NULL AND place = 1),
g AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY 1),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY 1)
SELECT said.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, coalesce(n, 1) AS n_windows
FROM said JOIN g ON said.conv_id = g.conv_id LEFT JOIN n ON said.conv_id = n.conv_id
"""
