"""Chat text: whole conversations rendered, encoded once, and a loss mask aligned by offsets.

A turn is rendered as ``[INST] role [/INST] text</s>`` and a line end. Control strings
inside roles and texts get a backslash after their first character, and backslashes are
doubled, so that the parts can be read back exactly. The whole rendering is encoded once
with character offsets; the spans of assistant texts and the spans of tokens are both
sorted, so the tokens of a turn are found by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@dataclass(frozen=True)
class Template:
    """Strings that mark a turn. The line end after a turn makes the next turn a word of its own."""

    before: str = "[INST] "
    between: str = " [/INST] "
    after: str = "</s>\n"
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "</s>")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for one in self.controls:
            text = text.replace(one, f"{one[0]}\\{one[1:]}")
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def turns(self, rendered: str) -> list[tuple[str, str]]:
        """Roles and texts read back from a rendering."""
        marks = f"{re.escape(self.before)}(.*?){re.escape(self.between)}(.*?){re.escape(self.after)}"
        return [(self.unescape(a), self.unescape(b)) for a, b in re.findall(marks, rendered, flags=re.DOTALL)]


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and past-the-last token that overlaps each span, by binary search in sorted token spans."""
    low = np.searchsorted(ends, [a for a, _ in spans], side="right")
    high = np.searchsorted(starts, [b for _, b in spans], side="left")
    return [(int(i), int(j)) if a < b else (int(i), int(i)) for i, j, (a, b) in zip(low, high, spans, strict=True)]


def format_conversations(
    df: DataFrame,
    tokenizer_path: str,
    template: Template = Template(),
    trained_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_chars: int = 1_000_000,
) -> DataFrame:
    """Render, encode and mask every conversation.

    Returns one row per conversation: conv_id, part, text, input_ids, loss_mask (1 for a
    token that overlaps a trained text), loss_spans (character spans of `text` under the
    mask: token spans cut to the turn they belong to). A conversation of over `part_chars`
    characters comes in parts 0, 1, 2 ... that end at turns; the tokens are those of the
    whole, because a turn always starts a word of its own.

    Rows are ordered by turn, then role and text; null turns come first, null roles and
    texts are empty, repeated rows are repeated turns, null ids form one conversation. An
    empty table gives an empty result. A task streams over sorted rows and holds one part.
    """
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = "conv_id long, part int, text string, input_ids array<int>, loss_mask array<byte>, loss_spans array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        done: list[dict] = []

        def finish(conv: int | None, part: int, pieces: list[str], spans: list[tuple[int, int]]) -> None:
            text = "".join(pieces)
            found = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
            mask = np.zeros(len(offsets), np.int8)
            loss = []
            for (low, high), (start, end) in zip(token_ranges(offsets[:, 0], offsets[:, 1], spans), spans, strict=True):
                mask[low:high] = 1
                if low < high:
                    loss.append({"start": max(start, int(offsets[low, 0])), "end": min(end, int(offsets[high - 1, 1]))})
            done.append({"conv_id": conv, "part": part, "text": text, "input_ids": found.ids, "loss_mask": mask, "loss_spans": loss})

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([r["conv_id"] for r in done], pa.int64()), pa.array([r["part"] for r in done], pa.int32()),
                    pa.array([r["text"] for r in done], pa.string()), pa.array([r["input_ids"] for r in done], pa.list_(pa.int32())),
                    pa.array([r["loss_mask"] for r in done], pa.list_(pa.int8())),
                    pa.array([r["loss_spans"] for r in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["conv_id", "part", "text", "input_ids", "loss_mask", "loss_spans"],
            )
            done.clear()
            return out

        conv, part, pieces, spans, at = None, 0, [], [], 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for one, role, text in zip(ids, roles, texts, strict=True):
                if pieces and (one != conv or at >= part_chars):
                    finish(conv, part, pieces, spans)
                    part, pieces, spans, at = (part + 1 if one == conv else 0), [], [], 0
                    if len(done) >= 200 or sum(len(r["text"]) for r in done) > part_chars:
                        yield flush()
                conv = one
                head, body = template.before + template.escape(role) + template.between, template.escape(text)
                if role in trained_roles:
                    spans.append((at + len(head), at + len(head) + len(body)))
                pieces.append(head + body + template.after)
                at += len(pieces[-1])
        if pieces:
            finish(conv, part, pieces, spans)
        if done:
            yield flush()

    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns and loss text of `format_conversations`, read back from its rows, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            if state is not None:
                out.append((conv, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            out.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == 0:
                    close()
                    conv, state = row["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
                text = row["text"]
                for role, said in template.turns(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for span in row["loss_spans"]:
                    said = template.unescape(text[span["start"] : span["end"]])
                    state["loss_n"] += len(said)
                    state["loss"].update(said.encode())
                state["chars"] += len(text)
            yield batch_of()
        close()
        yield batch_of()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "part", "text", "loss_spans").mapInArrow(run, schema)


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of the template's own control strings."""
    from public_tokenizers import path

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more), path("byte_bpe_50k.json")))
