r"""Chat formatting with typed content parts, in built-in SQL functions only.

A turn's content is an array of parts (type, text, ref, tokens). A visitor, one
SQL expression for each type, flattens them in order: text is escaped, an image,
audio or document part becomes a numbered placeholder, and its reference and the
tokens that it expands to are recorded.

Template of a turn: <|turn|>ROLE\nBODY<|end|>\n. Texts and roles escape & < [
(roles the line end too) as &amp; &lt; &#91; &#10;, so that no text holds a
control string (all of which begin with < or [), and unescaping gives the text
back exactly. The loss mask covers the bodies of assistant turns, no markers.

Defined results: a null text or role counts as empty; null or empty parts give an
empty body; a part of an unknown or null type is an attachment with the placeholder
`part` and the tokens that it gives, 0 if none; turns are ordered by turn, role, text,
nulls first, so ties and repeated rows keep one order; each row of a null conversation
is a conversation of its own, since nothing says that two belong together; an empty table gives an empty table; other columns are not
read. A conversation is one string in the result, so it must fit in memory; all
work on its turns is done before they are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import table

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
#: Tokens that an attachment expands to where the part itself gives no number.
EXPANDS_TO = {"image": 256, "audio": 128, "document": 512}
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, safe in pairs:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, pairs=ROLE_ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(False))


def _visit(part: Column, place: Column) -> Column:
    """The flattened form of one part; place numbers the attachments of its turn from 1."""
    visited = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
    for kind in EXPANDS_TO:
        visited = visited.when(part["type"] == kind, F.concat(F.lit(f"<|{kind}_"), place.cast("string"), F.lit("|>")))
    return visited.otherwise(F.concat(F.lit("<|part_"), place.cast("string"), F.lit("|>")))


def _expanded(part: Column) -> Column:
    tokens = part["tokens"]
    for kind, most in EXPANDS_TO.items():
        tokens = F.when((part["type"] == kind) & part["tokens"].isNull(), F.lit(most).cast("long")).otherwise(tokens)
    return F.coalesce(tokens, F.lit(0).cast("long"))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments (turn, place, type, ref, tokens), expanded_tokens and n_turns."""
    own = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("own")
    rows = turns.select(F.col(conv_id).alias("conv_id"), own, F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    placed = rows.withColumn("body", F.array_join(F.transform("parts", lambda p, i: _visit(p, F.size(F.filter(F.slice("parts", 1, i + 1), lambda q: ~_is_text(q))))), ""))
    attached = F.filter("parts", lambda p: ~_is_text(p))
    placed = placed.withColumn("attached", F.transform(attached, lambda p, i: F.struct(F.col("turn").alias("turn"), (i + 1).alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))))
    head = F.concat(F.lit(TURN), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    pieces = placed.select("conv_id", "own", "turn", "role", "body", "attached", head.alias("head"), F.length(head).cast("long").alias("h"), F.length("body").cast("long").alias("b"))
    so_far = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.col("h") + F.col("b") + len(END)).over(so_far), F.lit(0)) + F.col("h"))
    pile = F.sort_array(F.collect_list(F.struct("start", "turn", "role", F.concat("head", "body", F.lit(END)).alias("piece"), "b", "attached"))).alias("t")
    return (
        pieces.groupBy("conv_id", "own").agg(pile)
        .select(
            "conv_id",
            F.array_join(F.col("t.piece"), "").alias("formatted"),
            F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["b"]).alias("end"))).alias("loss_spans"),
            F.flatten(F.col("t.attached")).alias("attachments"),
            F.size("t").cast("long").alias("n_turns"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds; placeholders stay in the text."""
    chunks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda c: c != "")

    def read(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        text = F.substring(chunk, F.length(role) + 2, F.length(chunk) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text, ESCAPES).alias("text"))

    return F.transform(chunks, read)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(loss_spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return unescape(F.array_join(cut, ""), ESCAPES)


CONTROL = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    turns = own.unionByName(added).withColumn("parts", text_part(F.coalesce("text", F.lit(""))))
    chats = format_chats(turns)
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "expanded_tokens")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str, pairs) -> str:
    return f"length({x})" + "".join(f" + {len(safe) - 1} * (length({x}) - length(replace({x}, {_lit(plain)}, '')))" for plain, safe in pairs)


def _lit(x: str) -> str:
    return "chr(10)" if x == "\n" else f"'{x}'"


OP6_SQL = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
  o AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + {_sql_escaped('role', ROLE_ESCAPES)} + {_sql_escaped('text', ESCAPES)}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id, own"""
