"""Chat formatting with Spark expressions only.

A conversation becomes one string. A block of adjacent turns of one role is written
``<|turn|>role<|text|>text<|part|>text<|end|>``; control strings inside roles and texts get a backslash after their
first character and backslashes are doubled, so no text can open or close a turn and every text can be read back.

Defined results: a null role or text is the empty string; rows of one conversation are sorted by turn, then role, then
text (null turns first); rows with a null conversation id form one conversation; repeated rows are repeated turns; an
empty table gives an empty table; columns other than the four named ones are ignored. A conversation is one string in
the end, so it must fit into a task; what is done before that is linear in it, also where turns are null or equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: Strings that open or close something in this template or in other common ones.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
CHUNK = 32


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _last(blocks: Column) -> Column:
    return F.get(blocks, F.size(blocks) - 1)


def _merge(blocks: Column, x: Column) -> Column:
    """Add a turn to the last block if it has its role, else open a block."""
    last = _last(blocks)
    own = F.struct(x["role"].alias("role"), F.array(x["text"]).alias("texts"))
    longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(x["text"])).alias("texts"))
    return F.when((F.size(blocks) > 0) & (last["role"] == x["role"]), F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(blocks, F.array(own)))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_runs) for every conversation.

    loss_runs covers the formatted text from its first code point to its last as (chars, loss) runs; the runs at odd
    indexes are the texts in turn order. Turns are first gathered in chunks of turn numbers, in which adjacent turns
    of one role are merged, and then the chunks of a conversation, so that a long conversation is never shuffled
    turn by turn into one task.
    """
    turns = rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = turns.groupBy("c", F.floor(F.col("t") / CHUNK).alias("k")).agg(F.sort_array(F.collect_list(F.struct("t", "role", "text"))).alias("turns"))
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    # equal or null turns are in one chunk, however many there are: each run of CHUNK turns is merged for itself
    part = lambda p: F.aggregate(F.slice("turns", p * CHUNK + 1, CHUNK), none, _merge)
    chunks = chunks.select("c", "k", F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size("turns") / CHUNK).cast("int") - 1), part)).alias("blocks"))
    whole = chunks.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "blocks"))).alias("chunks"))
    whole = whole.select("c", F.flatten(F.transform("chunks", lambda x: x["blocks"])).alias("blocks"))

    def head(x: Column, i: Column) -> Column:
        same = (i > 0) & F.coalesce(F.get(F.col("blocks"), i - 1)["role"] == x["role"], F.lit(False))
        return F.when(same, F.lit(PART)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(x["role"]), F.lit(TEXT)))

    whole = whole.select("c", F.transform("blocks", lambda x, i: F.struct(head(x, i).alias("head"), (x["role"] == loss_role).alias("loss"), F.transform(x["texts"], escape).alias("texts"))).alias("blocks"))
    run = lambda chars, loss: F.struct(F.length(chars).cast("long").alias("chars"), loss.alias("loss"))
    runs = F.flatten(F.flatten(F.transform("blocks", lambda x: F.transform(x["texts"], lambda t, k: F.array(run(F.when(k == 0, x["head"]).otherwise(F.lit(PART)), F.lit(False)), run(t, x["loss"]))))))
    return whole.select(
        F.col("c").alias(conv),
        F.concat(F.array_join(F.transform("blocks", lambda x: F.concat(x["head"], F.array_join(x["texts"], PART))), ""), F.lit(END)).alias("formatted"),
        F.concat(runs, F.array(run(F.lit(END), F.lit(False)))).alias("loss_runs"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    quote = lambda mark: f"\\Q{mark}\\E"
    blocks = F.slice(F.split(formatted, quote(TURN)), 2, 1 << 30)
    split = F.transform(blocks, lambda b: F.split(b, quote(TEXT)))
    turns = F.transform(split, lambda p: F.transform(F.split(F.get(F.split(F.get(p, F.lit(1)), quote(END)), F.lit(0)), quote(PART)), lambda t: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(t).alias("text"))))
    return F.flatten(turns)


def masked(chats: DataFrame, out: str = "loss") -> DataFrame:
    """chats with the characters of formatted that loss_runs marks, unescaped and joined in order.

    The formatted text is cut at the runs' counts alone: first into about as many parts as there are runs in each, then
    at the runs of each part, as a substring is found by counting characters from the start.
    """
    names = chats.columns
    d = chats.withColumn("_k", F.ceil(F.sqrt(F.size("loss_runs"))).cast("int"))
    d = d.withColumn("_parts", F.transform(F.sequence(F.lit(0), F.ceil(F.size("loss_runs") / F.col("_k")).cast("int") - 1), lambda p: F.slice("loss_runs", p * F.col("_k") + 1, F.col("_k"))))
    d = d.withColumn("_sizes", F.transform("_parts", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, r: s + r["chars"])))
    none = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("_sizes", none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
    begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("loss"))

    def cut(text: Column, x: Column) -> Column:
        step = lambda s, r: F.struct((s["at"] + r["chars"]).cast("int").alias("at"), F.when(r["loss"], F.concat(s["loss"], F.substring(text, s["at"], r["chars"].cast("int")))).otherwise(s["loss"]).alias("loss"))
        return F.aggregate(x, begin, step, lambda s: s["loss"])

    # arrays meet as arguments: what a function of elements refers to by name may be worked out again for each of them
    texts = F.zip_with(starts, "_sizes", lambda at, n: F.substring("formatted", at.cast("int"), n.cast("int")))
    return d.select(*names, unescape(F.array_join(F.zip_with(texts, "_parts", cut), "")).alias(out))


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts hold, read back from them, and under their loss masks."""
    read = masked(chats).select(F.col(conv), "formatted", read_back(F.col("formatted")).alias("turns"), "loss")
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digest(format_chats(rows.unionByName(own)))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length({_sql_escape('text')}) AS text_chars, length({_sql_escape('role')}) AS role_chars FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN {len(PART)} ELSE {len(TURN + TEXT + END)} + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
