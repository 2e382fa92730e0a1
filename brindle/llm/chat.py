"""Chat formatting in budgeted windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Conversations of more turns are long: their turns are dealt by blocks of turn numbers.
LONG, PER_BLOCK = 50_000, 10_000
#: Long conversations of which a table is small enough to be broadcast.
MOST_BROADCAST = 100_000
#: What counts as one token: up to six letters, up to three digits, or one other sign.
TOKEN = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\p{L}\p{M}\p{N}\x00-\x20]"
#: Tokens of a turn's own marks and line ends.
MARKS = 4


def count_tokens(text: Column) -> Column:
    """Tokens of a text, by TOKEN."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escape(text: Column) -> Column:
    """Text in which no control string is left: \\ becomes \\\\, and <| becomes <\\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As text; a line end, which ends the role, becomes \\n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(lines)


def long_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Ids of the conversations that have more than LONG turns."""
    return turns.groupBy(F.col(id_col).alias("id")).count().filter(F.col("count") > LONG).select("id")


def format_conversations(
    turns: DataFrame, budget: int = 1024, history_turns: int = 2, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant",
    tokens: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """Format conversations as windows of whole turns, with the spans whose loss counts.

    Turns are written <|im_start|>role, a line end, text, <|im_end|>, a line end, with control strings
    inside roles and texts escaped. A turn has the tokens of its role and text, which the expression tokens counts, and MARKS.
    Prefix sums of tokens choose the windows: a turn whose sum before it falls in the k-th half budget
    belongs to window k. A turn of over half the budget makes a window of its own, so a window's own turns
    never pass the budget, unless one turn alone does: turns are never cut or dropped. Each window starts
    with the conversation's system turn, if its first turn is one, and each but the first then repeats up to
    history_turns turns from the window before, as long as they are a quarter of the budget at most; both
    come on top of the budget. Only a window's own target turns are under the loss; targets that are repeated
    as history are masked.

    Returns id, part and window (both from 0; windows of a conversation in order), formatted, n_repeated (turns at its start that repeat
    others), loss (array of structs of start and length, in characters of formatted) and place: rows of one place
    are in one partition.

    Null roles and texts are empty. Rows are ordered by turn, nulls first, then role, then a hash of the text; repeated
    rows are turns of their own. Null ids are a conversation. An empty table gives no rows. A turn's text may be of any length that
    a row can hold; a window holds the budget and its longest turn.

    Texts are moved once, each conversation to one place. Only those of more than LONG turns are divided, by blocks of PER_BLOCK turn
    numbers; each block is a part, windows end where it ends, and the system turn and the history are handed on to the next.
    """
    rows = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    big = long_conversations(turns, id_col)
    n_big = big.limit(MOST_BROADCAST + 1).count()
    if n_big:
        marked = big.select(F.col("id").alias("of"), F.lit(True).alias("is_long"))
        rows = rows.join(F.broadcast(marked) if n_big <= MOST_BROADCAST else marked, rows["id"].eqNullSafe(marked["of"]), "left").drop("of")
        rows = rows.withColumn("block", F.when(F.col("is_long"), F.coalesce(F.floor(F.col("turn") / PER_BLOCK), F.lit(-(2**62)))).otherwise(F.lit(0).cast("long"))).drop("is_long")
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    size = MARKS + tokens(F.col("role")) + tokens(F.col("text"))
    dealt = rows.select("id", "block", F.xxhash64("id", "block").alias("place"), "turn", "role", F.xxhash64("text").alias("hash"), piece.alias("piece"), size.alias("tokens")).repartition("place")
    half = max(1, budget // 2)
    whole = ["place", "id", "block"]
    inside = Window.partitionBy(*whole).orderBy(F.col("turn").asc_nulls_first(), "role", "hash")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("tokens") > half
    placed = dealt.withColumn("position", F.row_number().over(inside))
    placed = placed.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).withColumn("big", F.coalesce(F.sum(alone.cast("long")).over(earlier), F.lit(0)))
    # a big turn has an odd number, so it is alone; a window is a run of turns of one key
    placed = placed.withColumn("key", F.struct((F.col("big") * 2 + alone.cast("long")).alias("alone"), F.when(alone, F.lit(0)).otherwise(F.floor(F.col("before") / half)).alias("part")))
    begins = (F.col("key") != F.lag("key").over(inside)).cast("int")
    placed = placed.withColumn("begins", F.coalesce(begins, F.lit(0)))
    placed = placed.withColumn("window", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    own = placed.groupBy(*whole, "window").agg(F.sort_array(F.collect_list(F.struct("position", "role", "tokens", "piece"))).alias("own"))
    first = F.get("own", 0)
    is_system = lambda t: (t["position"] == 1) & (t["role"] == "system")
    last = F.slice("own", F.greatest(F.size("own") - history_turns + 1, F.lit(1)), history_turns) if history_turns > 0 else F.slice("own", 1, 0)
    # the tokens from a turn on to the window's end
    rest = lambda i: F.aggregate(F.slice("last", i + 1, max(1, history_turns)), F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    # only a conversation's first turn can be its system turn
    own = own.withColumn("last", last).withColumn("tail", F.filter("last", lambda t, i: (rest(i) <= budget // 4) & ~is_system(t)))
    in_order = Window.partitionBy(*whole).orderBy("window")
    own = own.withColumn("system", F.first(F.when(is_system(first), first)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("history", F.lag("tail").over(in_order))
    if n_big:
        # from each block of a long conversation to the next
        ends = own.groupBy(*whole).agg(F.max_by("tail", "window").alias("tail"), F.first("system").alias("system"))
        ends = ends.join(big.select(F.col("id").alias("of")), ends["id"].eqNullSafe(F.col("of")), "left_semi")
        blocks = Window.partitionBy("id").orderBy("block")
        handed = ends.select(F.col("place").alias("at"), F.first("system").over(blocks).alias("whose"), F.lag("tail").over(blocks).alias("given"), (F.row_number().over(blocks) - 1).alias("nth"))
        own = own.join(handed, own["place"] == handed["at"], "left").withColumn("part", F.coalesce("nth", F.lit(0)))
        # a system turn is one only in the first block
        own = own.withColumn("system", F.when(F.col("part") > 0, F.col("whose")).otherwise(F.col("system"))).withColumn("history", F.coalesce("history", "given"))
    else:
        own = own.withColumn("part", F.lit(0))
    no_turns = F.slice("own", 1, 0)
    headed = F.when((F.col("window") > 0) | (F.col("part") > 0), F.when(F.col("system").isNotNull(), F.array("system"))).alias("head")
    parts = own.select(*whole, "part", "window", "own", headed, "history", no_turns.alias("none"))
    parts = parts.withColumn("repeated", F.concat(F.coalesce("head", "none"), F.coalesce("history", "none"))).withColumn("turns", F.concat("repeated", "own"))
    parts = parts.withColumn("n_repeated", F.size("repeated"))
    # character offsets: where each turn starts, from the lengths of those before
    lengths = F.transform("turns", lambda t: F.length(t["piece"]))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    opening = lambda t: len(START) + F.length(escape_role(t["role"])) + 1
    spans = F.transform("turns", lambda t, k: F.struct(
        (F.get(F.col("starts"), k) + opening(t)).alias("start"), (F.length(t["piece"]) - opening(t) - len(END) - 1).alias("length"),
        ((k >= F.col("n_repeated")) & (t["role"] == target_role)).alias("target"),
    ))
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"], s["length"]))
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return parts.withColumn("starts", starts).select(F.col("id").alias(id_col), "part", F.col("window").cast("int").alias("window"), formatted.alias("formatted"), "n_repeated", loss.alias("loss"), "place")


def read_windows(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Read formatted windows back: a row for each window with its own turns and the texts under its loss.

    Returns id, part, window, turns (array of structs of role and text, repeated ones left out), targets (array of
    unescaped texts), formatted and place.
    """
    marked = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    own = F.slice(F.col("_marked"), F.col("n_repeated") + 1, F.greatest(F.size("_marked") - F.col("n_repeated"), F.lit(0)))
    parsed = F.transform(own, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"),
    ))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumn("_marked", marked).select(id_col, "part", "window", parsed.alias("turns"), targets.alias("targets"), "formatted", "place")
