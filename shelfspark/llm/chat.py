"""Chat formatting in budgeted windows, in DataFrame functions only.

The turns of a conversation, in order of turn, role and text, are laid out in windows of at most ``budget`` tokens (words
plus OVERHEAD per turn). Prefix sums of the turns' tokens choose the windows without a loop: with a stride of half the
room left by the system turn and the history, a turn belongs to the window of the stride in which it starts, so a
window's own turns take at most two strides; a turn longer than a stride has a window of its own (only such a turn can
exceed the budget, as turns are never cut). Every window after the first repeats the leading system turn and as many
whole preceding turns as fit in ``history`` tokens. Only assistant texts in a window's own turns are targets: repeated
ones are masked, so each is learnt once.

A turn is ``<turn ROLE>TEXT</turn>`` and a newline; ``\\``, ``<`` and ``>`` in roles and texts are escaped, so no text can
forge a mark, and ``read_back`` restores them. Prefix sums are taken in blocks of turn numbers and joined, so a very long
conversation is spread over tasks, and a window is all that is ever gathered.

Null texts and roles count as empty; a null turn comes first; a null conversation id is a conversation of its own;
repeated rows are turns of their own. An empty table gives no windows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACE, written

BUDGET, HISTORY, OVERHEAD, LEAST_STRIDE, BLOCK = 1024, 256, 2, 32, 256
OPEN, CLOSE_ROLE, CLOSE = "<turn ", ">", "</turn>\n"
WORD = SPACE.replace("[", "[^") + "+"
TURN = "<turn ([^<>]*)>([^<>]*)</turn>\n"


def escape(c: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    """Pairs of backslashes are cut out first, left to right, so that what is left of them is unambiguous."""
    parts = F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(parts, "\\")


def _positions(df: DataFrame, id_col: str) -> DataFrame:
    """Turns with position, token interval [s, e) and the tokens of a leading system turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = df.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("key"),
                      F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
                      (F.regexp_count(text, F.lit(WORD)) + OVERHEAD).cast("long").alias("tokens"),
                      F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"))
    w = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.select("*", F.row_number().over(w).alias("k"),
                         F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    blocks = turns.groupBy("key", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"),
        F.max(F.when((F.col("k") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("first_system"))
    b = Window.partitionBy("key").orderBy("block")
    before = blocks.select("key", "block", (F.sum("n").over(b) - F.col("n")).alias("before_n"),
                           (F.sum("size").over(b) - F.col("size")).alias("before_size"),
                           F.coalesce(F.first("first_system").over(b), F.lit(0)).alias("system"))
    return (turns.join(before, ["key", "block"])
            .select("id", "key", "role", "text", "tokens", "system", (F.col("before_n") + F.col("k") - 1).alias("pos"),
                    (F.col("before_size") + F.col("run") - F.col("tokens")).alias("s"), (F.col("before_size") + F.col("run")).alias("e")))


def format_windows(df: DataFrame, id_col: str = "conv_id", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(id, window, n_repeated, tokens, formatted, loss): ``loss`` lists the code point spans [start, end) to learn from;
    the first ``n_repeated`` turns of a window repeat earlier ones."""
    stride = F.greatest(F.lit(LEAST_STRIDE), F.floor((F.lit(budget - history) - F.col("system")) / 2))
    turns = (_positions(df, id_col).withColumn("stride", stride).withColumn("bucket", F.floor(F.col("s") / F.col("stride")))
             .withColumn("window", 2 * F.col("bucket") + (F.col("tokens") > F.col("stride")).cast("long")))
    turns = written(turns, "turns")
    windows = turns.groupBy("key", "bucket", "window").agg(F.min("s").alias("ws"), F.min("pos").alias("wp"))
    own = turns.select("id", "key", "window", "pos", "role", "text", "tokens", F.lit(False).alias("repeated"))
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    reach = (turns.where((F.col("tokens") <= history) & ~is_system)
             .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("e") / F.col("stride")),
                                                        F.greatest(F.floor(F.col("e") / F.col("stride")), F.floor((F.col("s") + history) / F.col("stride"))))))
             .drop("window"))
    past = (reach.join(windows, ["key", "bucket"]).where((F.col("ws") >= F.col("e")) & (F.col("ws") - F.col("s") <= history) & (F.col("wp") > F.col("pos")))
            .select("id", "key", "window", "pos", "role", "text", "tokens", F.lit(True).alias("repeated")))
    system = (turns.where(is_system).select("id", "key", "pos", "role", "text", "tokens")
              .join(windows.where("wp > 0").select("key", "window"), "key")
              .select("id", "key", "window", "pos", "role", "text", "tokens", F.lit(True).alias("repeated")))
    pieces = own.unionByName(past).unionByName(system).withColumns({
        "head": F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE_ROLE)), "body": escape(F.col("text"))})
    pieces = pieces.withColumns({"from": F.char_length("head"), "length": F.char_length("body")})
    w = Window.partitionBy("key", "window").orderBy("pos")
    end = F.sum(F.col("from") + F.col("length") + len(CLOSE)).over(w)
    pieces = pieces.withColumn("start", (end - len(CLOSE) - F.col("length")).cast("long"))
    piece = F.struct("pos", "start", (F.col("start") + F.col("length")).alias("end"),
                     (~F.col("repeated") & (F.col("role") == "assistant")).alias("target"), F.concat("head", "body", F.lit(CLOSE)).alias("s"))
    out = pieces.groupBy("key", "id", "window").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("tokens").alias("tokens"),
                                                    F.sum(F.col("repeated").cast("int")).alias("n_repeated"))
    return out.select(F.col("id").alias(id_col), "window", F.col("n_repeated").cast("int").alias("n_repeated"), "tokens",
                      F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
                      F.transform(F.filter("p", lambda x: x["target"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"))


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, window, roles, texts, targets, chars): a window's own turns and its target texts, read from the formatted
    string, and that string's length in code points."""
    def fresh(group: int) -> Column:
        every = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(group))
        return F.transform(F.slice(every, F.col("n_repeated") + 1, F.size(every)), unescape)

    targets = F.transform("loss", lambda x: unescape(F.substring(
        F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    return windows.select(id_col, "window", fresh(1).alias("roles"), fresh(2).alias("texts"), targets.alias("targets"),
                          F.char_length("formatted").alias("chars"))


def digest(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from its windows. A SHA-256 needs its conversation in one piece."""
    turns = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n")))
    back = read_back(windows, id_col).select(id_col, F.struct(
        "window", F.array_join(turns, "").alias("t"), F.array_join("targets", "").alias("l")).alias("w"),
        F.size("roles").cast("long").alias("n"), F.col("chars").cast("long").alias("chars"))
    out = back.groupBy(id_col).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("chars"),
                                   F.sort_array(F.collect_list("w")).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["l"]), "")
    return out.select(id_col, "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["t"]), ""), 256).alias("turns_sha256"),
                      F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.col("chars").alias("formatted_chars"))


def oracle(extra: str) -> str:
    """DuckDB statement for ``digest(format_windows(conversations))``; ``extra`` gives more rows as VALUES."""
    length = lambda c: f"(length({c}) + length({c}) - length(replace(replace(replace({c}, '\\', ''), '<', ''), '>', '')))"
    marks = len(OPEN) + len(CLOSE_ROLE) + len(CLOSE)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {extra})),
t AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + {OVERHEAD} AS tokens,
             {length("role")} + {length("text")} + {marks} AS chars,
             row_number() OVER o - 1 AS pos, coalesce(first_value(role) OVER o = 'system', false) AS sys FROM c
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS e,
             coalesce(max(CASE WHEN sys AND pos = 0 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS st FROM t),
b AS (SELECT *, e - tokens AS s, greatest({LEAST_STRIDE}, ({BUDGET - HISTORY} - st) // 2) AS stride FROM p),
w AS MATERIALIZED (SELECT *, 2 * (s // stride) + CAST(tokens > stride AS INT) AS win FROM b),
v AS (SELECT conv_id, win, min(s) AS ws, min(pos) AS wp FROM w GROUP BY ALL),
h AS (SELECT w.conv_id, sum(chars) AS chars FROM w JOIN v ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND v.wp > w.pos
      AND ((sys AND pos = 0) OR (w.tokens <= {HISTORY} AND v.ws - w.s <= {HISTORY})) GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS t,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS l, sum(chars) AS chars FROM w GROUP BY 1)
SELECT g.conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
       CAST(g.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id
"""
