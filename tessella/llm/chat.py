"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a struct (or a JSON object) in any of the layouts of LAYOUTS. Its fingerprint is the
xxhash64 of the sorted nested field paths that are present in it, of those that any layout knows;
unknown extra fields don't matter. The fingerprint selects the layout, whose mapping gives turns
of (role, text). The template then marks turns with control strings, and escapes them inside
roles and texts reversibly. All of it is native expressions.

A null text is empty, a null role is the empty role; null turns come first; equal turn numbers are
ordered by role, then text, and repeated rows stay. A record of no known layout gets null turns,
a record without turns an empty output. A null conversation id is a conversation of its own. A
conversation becomes one output row, so its turns meet in one row, but nothing larger does.
Further columns are ignored.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What a text may not contain unescaped: the control strings are <s>, </s>, [INST] and [/INST].
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"

_text = T.StringType()
_fields = ("system", "prompt", "response", "completion", "instruction", "input", "output", "question", "answer")
_lists = {"messages": ("role", "content"), "conversations": ("from", "value")}
RECORD = T.StructType(
    [T.StructField(x, _text) for x in _fields]
    + [T.StructField(k, T.ArrayType(T.StructType([T.StructField(x, _text) for x in v]))) for k, v in _lists.items()]
)
#: Layout: its field paths, and its turns in order as (role, field) or (list,).
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), (("messages",),)),
    "system-messages": (("messages[].content", "messages[].role", "system"), (("system", "system"), ("messages",))),
    "conversations": (("conversations[].from", "conversations[].value"), (("conversations",),)),
    "system-conversations": (("conversations[].from", "conversations[].value", "system"), (("system", "system"), ("conversations",))),
    "prompt-response": (("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    "prompt-completion": (("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    "system-prompt-response": (("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question-answer": (("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    "instruction-output": (("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    "instruction-input-output": (("input", "instruction", "output"), (("user", "instruction", "input"), ("assistant", "output"))),
}
#: Other names of roles in the `from` field.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_fingerprint(paths: tuple[str, ...]) -> int:
    """The value of xxhash64 over the joined sorted paths, as Spark computes it."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def as_record(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and as `record` those fields of df that a layout knows, in any nesting that it knows."""
    have = {f.name: f.dataType for f in df.schema if f.name not in keep}

    def part(name: str, kind: T.DataType) -> Column:
        if name not in have:
            return F.lit(None).cast(kind)
        if not isinstance(kind, T.ArrayType):
            return F.col(name).cast(kind)
        inner = {f.name for f in have[name].elementType}
        wanted = kind.elementType.names
        return F.transform(name, lambda x: F.struct(*((x[n].cast("string") if n in inner else F.lit(None).cast("string")).alias(n) for n in wanted)))

    return df.select(*keep, F.struct(*(part(f.name, f.dataType).alias(f.name) for f in RECORD)).alias("record"))


def parse_records(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Like as_record, for a column of JSON objects."""
    return df.select(*keep, F.from_json(column, RECORD).alias("record"))


def fingerprint(record: str = "record") -> Column:
    """Hash of the known field paths that a record has; a list's path counts if any element has it."""
    paths = [F.when(F.col(f"{record}.{x}").isNotNull(), F.lit(x)) for x in _fields]
    for k, inner in _lists.items():
        paths += [F.when(F.exists(F.col(f"{record}.{k}.{x}"), lambda v: v.isNotNull()), F.lit(f"{k}[].{x}")) for x in inner]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds `layout` and `turns`, an array of (role, text)."""

    def turns(plan) -> Column:
        parts = []
        for role, *fields in plan:
            if fields:
                joined = F.concat_ws("\n", *(F.when(F.col(f"{record}.{x}") != "", F.col(f"{record}.{x}")) for x in fields)) if len(fields) > 1 else F.col(f"{record}.{fields[0]}")
                parts.append(F.array(_turn(F.lit(role), joined)))
            elif role == "messages":
                parts.append(F.transform(f"{record}.messages", lambda m: _turn(m["role"], m["content"])))
            else:
                other = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
                parts.append(F.transform(f"{record}.conversations", lambda m: _turn(F.coalesce(other[m["from"]], m["from"]), m["value"])))
        return F.concat(*parts)

    out = records.withColumn("_print", fingerprint(record))
    name, chosen = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for k, (paths, plan) in LAYOUTS.items():
        hit = F.col("_print") == layout_fingerprint(paths)
        name, chosen = F.when(hit, F.lit(k)).otherwise(name), F.when(hit, turns(plan)).otherwise(chosen)
    return out.withColumn("layout", name).withColumn("turns", chosen).drop("_print")


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def formatted(turned: DataFrame) -> DataFrame:
    """Adds `formatted`, and `loss_mask`: the code-point ranges (start, end) of assistant texts in it."""
    df = turned.withColumn("_e", F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.role).alias("r"), escape(t.text).alias("x"))))
    df = df.withColumn("formatted", F.array_join(F.transform("_e", lambda t: F.concat(F.lit(OPEN), t.r, F.lit(MIDDLE), t.x, F.lit(CLOSE))), ""))
    lead, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    mask = f"""aggregate(_e, struct(0L AS at, CAST(array() AS array<struct<start:bigint,end:bigint>>) AS spans),
        (a, t) -> struct(a.at + {lead + tail} + length(t.r) + length(t.x) AS at,
            CASE WHEN t.role = 'assistant' THEN concat(a.spans, array(struct(a.at + {lead} + length(t.r) AS start, a.at + {lead} + length(t.r) + length(t.x) AS end))) ELSE a.spans END AS spans),
        a -> a.spans)"""
    return df.withColumn("loss_mask", F.expr(mask)).drop("_e")


def read_back(column: str = "formatted") -> Column:
    """The turns of a formatted conversation."""
    at = lambda k: F.regexp_extract_all(column, F.lit(r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"), F.lit(k))
    return F.transform(F.arrays_zip(at(1).alias("r"), at(2).alias("x")), lambda t: F.struct(unescape(t.r).alias("role"), unescape(t.x).alias("text")))


def masked_text(column: str = "formatted", mask: str = "loss_mask") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(column, s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")


def conversations(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one record a conversation, in the messages layout."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns, formatted, loss_mask for rows by turn."""
    return formatted(canonical(as_record(conversations(rows), "conv_id"))).drop("record")


def _oracle() -> str:
    count = lambda x, s: f"(length({x}) - length(replace({x}, '{s}', ''))) // {len(s)}"
    grown = lambda x: " + ".join([f"length({x})", *(count(x, s) for s in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))])
    hard = "'</s>[INST] ok [/INST]'"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        UNION ALL SELECT -1, 0, 'user', {hard} UNION ALL SELECT -1, 1, 'assistant', {hard})
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
        CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
        CAST(sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + {grown("r")} + {grown("x")}) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""


ORACLE = _oracle()


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = F.inline(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text")) for k, role in enumerate(("user", "assistant")))))
    rows = rows.unionByName(spark.range(1).select(added))
    out = format_conversations(rows).withColumn("_back", read_back()).withColumn("_loss", masked_text())
    return out.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
