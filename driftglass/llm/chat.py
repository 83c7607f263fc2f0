"""Chat formatting with typed content parts (operator 10). DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.llm.common import table

#: The template: `<turn ROLE>TEXT</turn>`. In roles and texts `&` is written &amp; , `<` &lt; and `>` &gt; , so that `<` and `>`
#: stand only where the template puts them, and reading back is exact.
OPEN, CLOSE, END = "<turn ", ">", "</turn>"
#: Tokens that a placeholder expands to: for an image a tile each, for audio a second each, for a document a page each.
EXPANDS = {"image": 256, "audio": 25, "document": 400}
#: Fixed value: what both turns of conversation -7 say.
PROBE = "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _visit(part: Column) -> Column:
    """A part as the template writes it: text escaped, an attachment as a placeholder that names its type and reference."""
    shown = F.concat(F.lit("<"), part["type"], F.lit(" "), escaped(F.coalesce(part["ref"], F.lit(""))), F.lit("/>"))
    return F.when(part["type"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).when(part["type"].isin(*EXPANDS), shown).otherwise("")


def _tokens(part: Column) -> Column:
    """Text: its words. An attachment: its units (tiles, seconds, pages; 1 where null) times what a unit expands to."""
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    cost = F.lit(0)
    for kind, each in EXPANDS.items():
        cost = F.when(part["type"] == kind, units * each).otherwise(cost)
    words = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return F.when(part["type"] == "text", words).otherwise(cost)


def text_parts(turns: DataFrame) -> DataFrame:
    """Plain turns (text) as turns of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(1).cast("long").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens, from rows (conv_id, turn, role, parts).

    parts: array of structs (type, text, ref, units), visited in order; types are text, image, audio and document, others
    write nothing. loss_spans: start (from 0) and length in `formatted` of each assistant turn's content. attachments: struct
    (turn index, part index, type, ref, tokens) in order.

    Turns stand by turn, null first, then role and content, so ties have one order. Null role: empty. Null parts or no parts:
    an empty turn. Null conv_id: one conversation of its own. Repeated rows stay. Columns beyond the four are left out.
    Very long texts and conversations are formatted whole. Empty table: no rows.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.expr("cast(array() as array<struct<type:string,text:string,ref:string,units:bigint>>)"))
    rows = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("content", F.array_join(F.transform("parts", _visit), ""))
    rows = rows.withColumns({
        "head": F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)),
        "tokens": F.aggregate(F.transform("parts", _tokens), F.lit(0).cast("long"), lambda a, x: a + x),
    })
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    size = F.length("head") + F.length("content") + len(END)
    rows = rows.withColumns({"at": F.row_number().over(order) - 1, "from": F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    shown = F.transform("parts", lambda p, i: F.struct(F.lit(0).alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    refs = F.filter(shown, lambda p: p["type"].isin(*EXPANDS))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("from") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length")))
    rows = rows.select("conv_id", F.struct("at", F.concat("head", "content", F.lit(END)).alias("turn"), span.alias("span"), refs.alias("refs"), "tokens").alias("row"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return by.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"),
        F.size("rows").cast("long").alias("n_turns"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["refs"], lambda p: p.withField("turn", r["at"])))).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """formatted's columns plus turns: array of structs (role, text, loss) read back from the formatted string alone.

    Each turn ends with the template's closing mark, which cannot stand in a text. Placeholders of attachments stay in the
    text as they are written, and are part of their turn's text. Null or empty `formatted`: no turns (null, empty). An empty role or
    text reads back empty, a very long one whole; turns stand in their order, repeats included. A column `turns` of the input gives
    way. Empty table: no rows.
    """
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = unescaped(F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), CLOSE, 1))
        text = unescaped(F.regexp_replace(piece, "^<turn [^>]*>", ""))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def digests(formatted: DataFrame) -> DataFrame:
    """What op10 reports of formatted strings: turns as read_turns() reads them back, and what the loss mask covers, cut out of the
    string itself by loss_spans."""
    back = read_turns(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = back.withColumns({"told": told, "learned": learned})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("loss_spans").cast("long").alias("n_loss_spans"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_turns(text_parts(turns.unionByName(extra))))
