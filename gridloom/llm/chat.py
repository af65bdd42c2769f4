"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template, encoded once with offsets, and the
spans of its turns are intersected with the token spans by binary search; the parts of
tokens that fall into assistant texts are the loss mask.

Template, per turn: `<|im_start|>` role newline text `<|im_end|>` newline.  Both markers
are control tokens of the encoder.  Inside roles and texts every `<`, backslashes, `|` gets
one more backslash, so a marker cannot appear there and unescaping is exact; a role's
newlines and backslashes are escaped too.

Long conversations are not gathered in one task.  Rows are range-partitioned by
(conversation, turn), so a hot conversation is spread over tasks; each task renders,
encodes and masks its run of turns in pieces of bounded size.  Control tokens always
end a piece, so encoding piece by piece gives the ids of the whole.  Only the finished
pieces are then put together per conversation, streaming.

Rules: a null text or role is empty.  Rows of one conversation are ordered by turn (null
first), role and text, so repeated turns have a defined order.  A null conv_id is a
conversation of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

START, END = "<|im_start|>", "<|im_end|>"
#: Characters rendered and encoded at once, about.
PIECE_CHARS = 1 << 18
#: Characters of finished pieces that are handed on at once, about.
BATCH_CHARS = 1 << 21
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and, per turn, the span of its escaped text in UTF-8 bytes."""
    parts, sizes = [], []
    for role, text in turns:
        made = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        parts += made
        sizes += [len(x) if x.isascii() else len(x.encode()) for x in made]
    ends = np.cumsum(np.array(sizes, np.int64)).reshape(-1, 3)
    return "".join(parts), np.stack([ends[:, 0], ends[:, 1]], 1)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return turns


class Encoder:
    """A byte-level tokenizer in which the two markers are control tokens; its tokens tile the text, so their spans are sums of lengths."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.first = max(ranks.values()) + 2  # one id is left free for an end-of-text token
        pieces = [*sorted(ranks, key=ranks.get), b"", START.encode(), END.encode()]
        self.pieces, self.lengths = pieces, np.array([len(x) for x in pieces], np.int64)
        self.fast = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={START: self.first, END: self.first + 1})
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special={START, END}, disallowed_special=()).astype(np.int32)
        except ValueError:  # runs of a million blanks are beyond its regular expressions
            return np.array(self._slow().encode(text, add_special_tokens=False).ids, np.int32)

    def _slow(self):
        if self.slow is None:
            import public_tokenizers
            from tokenizers import AddedToken, Tokenizer

            self.slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            self.slow.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])
        return self.slow

    def decode(self, ids) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])


def tokens_of(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per span the first token that meets it and the one after the last, by binary search on the sorted token spans."""
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    return first, np.where(spans[:, 1] > spans[:, 0], last, first)


def format_turns(turns: list[tuple[str, str]], encoder: Encoder) -> dict:
    """One piece: formatted text, token ids, loss mask by token, and the texts under the mask."""
    formatted, spans = render(turns)
    raw, ids = formatted.encode(), encoder.encode(formatted)
    ends = encoder.ends(ids)
    starts = ends - encoder.lengths[ids]
    wanted = spans[np.array([role == LOSS_ROLE for role, _ in turns], bool)]
    first, last = tokens_of(wanted, starts, ends)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    # the tokens of a span follow one another without a gap: what they cover of it is one stretch
    parts = [raw[max(lo, starts[i]) : min(hi, ends[j - 1])] if j > i else b"" for (lo, hi), i, j in zip(wanted.tolist(), first.tolist(), last.tolist())]
    return {"formatted": formatted, "ids": ids, "mask": np.cumsum(change)[:-1] > 0, "loss_texts": [unescape(x.decode()) for x in parts]}


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> pieces in order: conv_id, piece, formatted, ids, mask, loss_texts."""
    cut = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = cut.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").withColumn("piece", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        held, size, key, first = [], 0, None, 0
        made: list[dict] = []
        waiting = 0

        def finish() -> None:
            made.append({"conv_id": key[0], "piece": first, **format_turns(held, encoder)})

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[name] for row in made], kind) for name, kind in zip(schema.names, schema.types)], schema=schema)

        for batch in batches:
            for conv, role, text, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and ((conv,) != key or size >= PIECE_CHARS):
                    finish()
                    waiting += size
                    held, size = [], 0
                    if waiting >= BATCH_CHARS or len(made) >= 512:
                        yield out()
                        made, waiting = [], 0
                if not held:
                    key, first = (conv,), piece
                held.append((role, text))
                size += len(text)
        if held:
            finish()
        if made:
            yield out()

    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("loss_texts", pa.list_(pa.string()))])
    return dealt.mapInArrow(run, "conv_id bigint, piece bigint, formatted string, ids array<int>, mask array<boolean>, loss_texts array<string>")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output: turns and loss texts, counted and digested."""
    dealt = pieces.select("conv_id", "piece", "formatted", "loss_texts").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out():
            n, turns, chars, loss, size = state
            row = {"conv_id": key[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for conv, formatted, texts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if (conv,) != key:
                    if key:
                        yield out()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in texts:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
        if key:
            yield out()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return dealt.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = f"{END}{START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    return read_back(format_chats(rows))


def _length_sql(column: str) -> str:
    """Characters of a text after escaping: one backslash more per match."""
    return rf"len({column}) + len(regexp_extract_all({column}, '<\\*\|'))"


OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{END}{START}assistant ok'), (-1, 1, 'assistant', '{END}{START}assistant ok')) AS v(conv_id, turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + {_length_sql("role")} + len(role) - len(replace(replace(role, chr(92), ''), chr(10), '')) + {_length_sql("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
