"""Chat formatting: typed content parts, a reversible template and a loss mask.

A visitor flattens the text, image, audio and document parts of a turn into
one body, in which each attachment leaves an ordered placeholder; the turn
records each attachment's reference, place and expanded token count. Control
strings inside texts and roles get a backslash, which reading takes away.

A turn is one row in and one row out, so a conversation of any length never
has to fit into one task; a formatted conversation is the concatenation of its
segments in order of turn. Null roles, texts, parts and content count as
empty; repeated rows are formatted again; unknown part types raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append_columns, small_batches, table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What starts a control string of this template or of the bracket-style templates, with any backslashes it already has.
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
SEGMENT = re.compile(r"<\|start\|>(.*?)<\|sep\|>(.*)<\|end\|>", re.DOTALL)

ATTACHMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("tokens", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class PartVisitor:
    """Flattens content parts. Neighbouring texts are joined before escaping, so no control string arises at their seam."""

    def __init__(self, patch: int = 28, audio_tokens_per_second: float = 25.0, tokens_per_page: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_tokens_per_second, tokens_per_page

    def flatten(self, content) -> tuple[str, list[dict], list[dict]]:
        """The body, its attachments and the spans of texts within the body."""
        self.body, self.size, self.text, self.attachments, self.spans = [], 0, [], [], []
        for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
            if part is not None:
                kind = part.get("type") or "text"
                visit = getattr(self, f"visit_{kind}", None)
                if visit is None:
                    raise ValueError(f"unknown content part type: {kind}")
                visit(part)
        self.flush()
        return "".join(self.body), self.attachments, self.spans

    def flush(self) -> None:
        if text := escape("".join(self.text)):
            self.spans.append({"start": self.size, "length": len(text)})
            self.add(text)
        self.text = []

    def add(self, piece: str) -> None:
        self.body.append(piece)
        self.size += len(piece)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": len(self.attachments), "tokens": tokens})
        self.add(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)


def format_turns(df: DataFrame, content: str = "text", keys: tuple[str, ...] = ("conv_id", "turn"), trained: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One segment per turn. `content` is a string column, or an array of structs with `type` and what the type needs.

    Returns the keys, segment, loss_spans (code points of the segment that
    count for the loss: the texts of `trained` roles), attachments and
    expanded_tokens. Other columns of df are not looked at.
    """
    visitor = visitor or PartVisitor()

    def start():
        def compute(roles, contents):
            out = [], [], [], []
            for role, parts in zip(roles, contents, strict=True):
                head = f"{START}{escape(role or '')}{SEP}"
                body, attachments, spans = visitor.flatten(parts)
                out[0].append(f"{head}{body}{END}")
                out[1].append([{"start": s["start"] + len(head), "length": s["length"]} for s in spans] if role in trained else [])
                out[2].append(attachments)
                out[3].append(sum(a["tokens"] for a in attachments))
            return out

        return compute

    fields = [T.StructField("segment", T.StringType()), T.StructField("loss_spans", T.ArrayType(SPAN)), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("expanded_tokens", T.LongType())]
    return append_columns(df, list(keys), ["role", content], start, fields)


def read_segment(segment: str) -> tuple[str, str]:
    """The role and the text of a segment, without placeholders."""
    role, body = SEGMENT.fullmatch(segment).groups()
    for mark in PLACEHOLDERS.values():
        body = body.replace(mark, "")
    return unescape(role), unescape(body)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its segments in order of turn (then of the segment's text).

    SHA-256 has to see a conversation's turns one after the other, so they go
    to one task in order; it keeps running digests, never the conversation.
    """
    small_batches(segments.sparkSession)
    schema = T.StructType([segments.schema["conv_id"], *(T.StructField(c, t) for c, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close():
            if now:
                done.append({"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]})

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                segment = row["segment"]
                role, text = read_segment(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss_spans"]:
                    masked = unescape(segment[span["start"] : span["start"] + span["length"]])
                    now[3] += len(masked)
                    now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa_schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    ordered = segments.select("conv_id", "turn", "segment", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(run, schema)


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return conversation_digests(format_turns(rows.unionByName(planted)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, '<|start|>' || regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|sep|>'
         || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>' AS segment FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
