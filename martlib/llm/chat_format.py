"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered `[INST]role[/INST]` LF `text</s>` LF. The parser cuts at `[INST]`, takes the role up to `[/INST]` LF and the
text up to the closing `</s>` LF; a control string anywhere else is an error. A conversation is rendered plainly first and
parsed again; where the parse differs from the source, its turns are rendered with escapes, with `[INST]!` as their opening
mark (level 2: `[INST]!!`), and parsed again:

  level 0  plain
  level 1  backslash becomes \\b, and the control strings \\i, \\j and \\e
  level 2  backslash becomes \\b, and every `[`, `<` and `!` becomes \\o, \\l or \\x

The first level whose parse is identical to the source is kept; if none is, the job fails and names the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlib.llm.common import read

START, MIDDLE, END, ESCAPED = "[INST]", "[/INST]", "</s>", "!"
#: What each level replaces, in this order; undone in reverse.
LEVELS = (
    (),
    (("\\", "\\b"), (START, "\\i"), (MIDDLE, "\\j"), (END, "\\e")),
    (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"), ("!", "\\x")),
)


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, level: int) -> Column:
    return _replaced(c, LEVELS[level])


def unescape(c: Column, level: int) -> Column:
    return _replaced(c, [(b, a) for a, b in reversed(LEVELS[level])])


def render_turn(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(START + ESCAPED * level), escape(role, level), F.lit(MIDDLE + "\n"), escape(text, level), F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation, by the grammar alone: the level is read from the opening marks.
    A turn that breaks the grammar has a null text."""
    pieces = F.filter(F.split(formatted, "\\[INST\\]", -1), lambda s, i: (i > 0) | (s != ""))

    def turn(piece: Column, level: int) -> Column:
        body = F.substring(piece, F.lit(1 + level), F.char_length(piece))
        cut = F.locate(MIDDLE + "\n", body)
        rest = F.substring(body, cut + len(MIDDLE) + 1, F.char_length(body))
        text = F.substring(rest, F.lit(1), F.char_length(rest) - len(END) - 1)
        sound = (cut > 0) & F.endswith(rest, F.lit(END + "\n")) & ~F.contains(text, F.lit(MIDDLE)) & ~F.contains(text, F.lit(END))
        role = F.substring(body, F.lit(1), cut - 1)
        return F.struct(unescape(role, level).alias("role"), F.when(sound & ~F.contains(role, F.lit(END)), unescape(text, level)).alias("text"))

    level = lambda p: F.when(F.startswith(p, F.lit("!!")), turn(p, 2)).when(F.startswith(p, F.lit("!")), turn(p, 1)).otherwise(turn(p, 0))
    return F.transform(pieces, level)


def _rendered(level: int) -> Column:
    return F.array_join(F.transform("turns", lambda x: render_turn(x["role"], x["text"], level)), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, level, n_turns, loss_spans (array<struct<start,end>>, code points of formatted, end exclusive).

    turns: conv_id, turn, role, text. Turns are in order of turn (nulls first), ties by role and then text; repeated rows
    are turns of their own. Null texts and roles count as empty. A null conv_id is one conversation of its own. Further
    columns are ignored. An empty table gives an empty table. The loss mask covers the (escaped) texts of assistant turns.
    A conversation becomes one string, so it must fit into a task; its rows are rendered before they meet.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = t.withColumns({f"l{k}": F.char_length(render_turn(F.col("role"), F.col("text"), k)) for k in range(3)})
    placed = sized.withColumns({f"e{k}": F.sum(f"l{k}").over(order) for k in range(3)} | {"i": F.count(F.lit(1)).over(order)})
    spans = [F.struct((F.col(f"e{k}") - len(END) - 1 - F.char_length(escape(F.col("text"), k))).alias("start"), (F.col(f"e{k}") - len(END) - 1).alias("end")) for k in range(3)]
    one = F.struct("i", "role", "text", *[s.alias(f"s{k}") for k, s in enumerate(spans)])
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = whole.withColumn("source", source).withColumn("formatted", F.lit(None).cast("string")).withColumn("level", F.lit(None).cast("int"))
    for k in range(3):
        whole = whole.withColumn("tried", F.when(F.col("level").isNull(), _rendered(k)))
        same = F.col("level").isNull() & (parse(F.col("tried")) == F.col("source"))
        whole = whole.withColumn("same", F.coalesce(same, F.lit(False)))
        whole = whole.withColumns({"formatted": F.when(F.col("same"), F.col("tried")).otherwise(F.col("formatted")), "level": F.when(F.col("same"), F.lit(k)).otherwise(F.col("level"))})
    answers = F.filter("turns", lambda x: x["role"] == "assistant")
    pick = lambda k: F.transform(answers, lambda x: x[f"s{k}"])
    loss = F.when(F.col("level") == 0, pick(0)).when(F.col("level") == 1, pick(1)).otherwise(pick(2))
    safe = F.when(F.col("level").isNotNull(), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no escape level restores conversation "), F.col("conv_id").cast("string"))).cast("string"))
    return whole.select("conv_id", safe.alias("formatted"), "level", F.size("turns").cast("long").alias("n_turns"), loss.alias("loss_spans"))


def masked_text(formatted: Column, level: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped and joined."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    at = lambda k: F.array_join(F.transform(cut, lambda x: unescape(x, k)), "")
    return F.when(level == 0, at(0)).when(level == 1, at(1)).otherwise(at(2))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the turns and of the loss text of every conversation and of conversation -1, read back from the formatted text."""
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = chats.sparkSession.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{trap}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    out = format_chats(chats.unionByName(extra)).withColumn("back", parse(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("level"), F.col("loss_spans"))
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests from the source. formatted_chars follows levels 0 and 1.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, replace(replace(replace(replace(role || '|' || text, '\', '\b'), '[INST]', '\i'), '[/INST]', '\j'), '</s>', '\e') AS esc,
             regexp_matches(role || '|' || text, '\[/?INST\]|</s>') OR starts_with(role, '!') AS bad FROM t),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
             CASE WHEN bool_or(bad) THEN sum(length(esc)) ELSE sum(length(role) + length(text)) END AS body, bool_or(bad) AS bad FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (body + n * (length('[INST][/INST]</s>') + 2))::BIGINT AS formatted_chars FROM g
"""
