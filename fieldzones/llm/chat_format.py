"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts (``PART``).  A visitor flattens them in order: text is escaped, an
image, audio or document part becomes its placeholder, its reference is recorded, and it counts
as many tokens as it will expand to.  A turn is ``TURN role BODY text END``.

Escaping: a control string inside a role or text gets ``ESC 1`` after its first character, and an
ESC that was there becomes ``ESC 0``; so no control string of a text is one of the output, and
``unescape`` gives the text back.  The loss mask is a list of runs (code points, under the mask or
not), two for each turn (markers with role, then text) and one for the last END; it covers the
escaped texts of assistant turns.

Null text or role counts as empty, a null list of parts as no part, an unknown type as text.
Rows of one conversation and turn keep the order of role, then text; repeated rows are turns of
their own; a null conv_id is a conversation.  A conversation is one row of the result, so its
text has to fit into one task, as in any formatted output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.host_quality import let
from fieldzones.llm.registry import register

TURN, BODY, END, ESC = "<|turn|>", "<|body|>", "<|end|>", "␛"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: None overlaps another: each begins with < or [ and has no further one.
CONTROL = [TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"]
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 256


def escape(text: Column) -> Column:
    safe = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}{ESC}1{c[1:]}")), CONTROL, safe)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def visit(part: Column) -> Column:
    """(text, ref, tokens) of one part: its flattened form, what it refers to, how many tokens
    it expands to (null for text)."""
    up = lambda x, by: F.ceil(F.coalesce(x, F.lit(0)) / by)
    kind = part["type"]
    text = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PLACEHOLDERS.items()], escape(F.coalesce(part["text"], F.lit(""))))
    tokens = (F.when(kind == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
              .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
              .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS))
    return F.struct(text.alias("text"), kind.alias("type"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])


def format_conversations(messages: DataFrame) -> DataFrame:
    """From conv_id, turn, role and ``parts`` (array of PART): conv_id, ``formatted``, the mask
    ``runs``, ``attachments`` in the order of their placeholders, and ``expanded_tokens``."""
    flat = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit).alias("v"))
    turns = flat.select("conv_id", F.struct(
        "turn", "role", F.array_join(F.transform("v", lambda p: p["text"]), "").alias("body"),
        F.filter("v", lambda p: p["tokens"].isNotNull()).alias("refs")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    refs = F.flatten(F.transform("ts", lambda t, i: F.transform(t["refs"], lambda p: F.struct(i.alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    run = lambda n, loss: F.struct(n.cast("long").alias("n"), loss.alias("loss"))
    runs = F.flatten(F.transform("ts", lambda t, i: F.array(
        run(F.length(head(t)) + F.when(i > 0, len(END)).otherwise(0), F.lit(False)),
        run(F.length(t["body"]), t["role"] == "assistant"))))
    return whole.select(
        "conv_id", F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.concat(runs, F.array(run(F.lit(len(END)), F.lit(False)))).alias("runs"), refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role, text) and ``loss`` (the unescaped text under the mask) from the
    formatted text and its mask.  The texts of the odd pieces are those of the odd runs."""
    pieces = F.split("formatted", "<\\|body\\|>|<\\|end\\|>", -1)

    def parse(p):
        places = F.sequence(F.lit(0), (F.size(p) / 2).cast("int") - 1)
        return F.struct(
            F.transform(places, lambda i: F.struct(
                unescape(F.substring(F.get(p, 2 * i), len(TURN) + 1, 1 << 30)).alias("role"), unescape(F.get(p, 2 * i + 1)).alias("text"))).alias("turns"),
            F.array_join(F.transform(places, lambda i: F.when(F.get(F.col("runs"), 2 * i + 1)["loss"], unescape(F.left(F.get(p, 2 * i + 1), F.get(F.col("runs"), 2 * i + 1)["n"].cast("int")))).otherwise("")), "").alias("loss"))

    return formatted.withColumn("read", let(pieces, parse)).select("conv_id", "formatted", "read.turns", "read.loss")


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '{ESC}', '{ESC}0')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}{ESC}1{c[1:]}')"
    return out


PROBE = "</s>[INST] ok [/INST]"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
e AS (SELECT *, {_sql_escape("t")} AS body, {_sql_escape("role")} AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + {len(TURN) + len(BODY) + len(END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op10_content_parts", ORACLE)
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))
    return digests(format_conversations(messages))
