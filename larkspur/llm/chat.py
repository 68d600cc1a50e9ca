"""Chat formatting by token-level assembly.

Each turn is encoded on its own: reserved ids for the role mark and the end mark are spliced around the ids
of its text, so no text can ever produce or merge with a mark.  A conversation's ids are its turns' ids one
after another; where a turn begins is a prefix sum of token counts, and the loss mask is the prefix sum of
+1 where an assistant's text begins and -1 where it ends.  A readable rendering uses the same marks as
strings; control strings that occur in a text (or a role) are escaped there with a backslash, reversibly.

Turns are encoded wherever they are; folding a conversation then reads its turns in order as a stream, so a
conversation of any length is never held whole.

Defined results: a null text is empty; a null role is the empty role; turns of equal number are ordered by
their rendering, a null turn is the first; a null conversation id is one conversation; repeated rows are
repeated turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Where the vocabulary is; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pattern by which this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Marks of the rendering, and the reserved ids (above the vocabulary) that stand for them.
OPEN, CLOSE, STOP = "### ", ": ", " </turn>\n"
CONTROL = ("\\", "###", "</turn>")
#: Offsets above the vocabulary: a known role's mark; any other role is spelt between two ids; a turn's end.
ROLE_IDS = {"system": 1, "user": 2, "assistant": 3}
OTHER_OPEN, OTHER_CLOSE, END = 4, 5, 6
LEARNT = "assistant"


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class Template:
    """Encodes and decodes turns; ranks come from the driver, so executors need no vocabulary file."""

    ranks: dict
    base: int

    @staticmethod
    def of(ranks: dict[bytes, int]) -> Template:
        return Template(ranks, max(ranks.values()) + 1)

    def coder(self):
        import tiktoken

        return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})


_ESCAPE = re.compile("|".join(re.escape(c) for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every control string and every backslash."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """A turn as marked text.  Roles are escaped too, and so are the colons in them."""
    mark = role.capitalize() if role in ROLE_IDS else escape(role).replace(":", "\\:")
    if role not in ROLE_IDS and role.lower() in ROLE_IDS:
        mark = "\\" + mark  # else it would read as the known role
    return f"{OPEN}{mark}{CLOSE}{escape(text)}{STOP}"


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


def parse_rendered(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering, by reading it from the start; anything out of place is an error."""
    got, at = [], 0
    known = {r.capitalize(): r for r in ROLE_IDS}
    while at < len(text):
        m = _HEAD.match(text, at)
        # in an escaped text every end mark has a backslash where the real one has a space
        end = text.find(STOP, m.end()) if m else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        got.append((known.get(m[1]) or unescape(m[1]), unescape(text[m.end() : end])))
        at = end + len(STOP)
    return got


def encode_turn(coder, base: int, role: str, text: str) -> tuple[list[int], int]:
    """Ids of a turn, and how many of them come before its text; the last is the end mark."""
    if role in ROLE_IDS:
        head = [base + ROLE_IDS[role]]
    else:
        head = [base + OTHER_OPEN, *coder.encode_ordinary(role), base + OTHER_CLOSE]
    return [*head, *coder.encode_ordinary(text), base + END], len(head)


def decode_turns(coder, base: int, ids: np.ndarray) -> list[tuple[str, str]]:
    """Roles and texts of a run of ids."""
    got, role = [], None
    names = {v + base: k for k, v in ROLE_IDS.items()}
    start = 0
    for k in np.flatnonzero(np.asarray(ids) >= base):
        i = int(ids[k])
        if i in names:
            role, start = names[i], k + 1
        elif i == base + OTHER_OPEN:
            start = k + 1
        elif i == base + OTHER_CLOSE:
            role, start = coder.decode([int(x) for x in ids[start:k]]), k + 1
        elif i == base + END:
            got.append((role, coder.decode([int(x) for x in ids[start:k]])))
    return got


def loss_mask(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """1 within [start, stop) of any span: a prefix sum over +1 and -1."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, stops, -1)
    return np.cumsum(d[:-1]).astype(np.int8)


def format_turns(conversations: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """One row a turn, in order within each conversation and one conversation after another in a partition:
    conv_id, place (0, 1, ..), token_ids, first_token (its place among the conversation's tokens), mask (of
    its tokens) and formatted (the rendering)."""
    spark = conversations.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(ranks)  # a vocabulary file: of fixed size

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Template.of(held.value)
        coder = t.coder()
        for b in batches:
            ids, heads, shown = [], [], []
            for role, text in zip(b["role"], b["text"], strict=True):
                i, h = encode_turn(coder, t.base, role, text)
                ids.append(i), heads.append(h), shown.append(render(role, text))
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "learnt": b["role"] == LEARNT, "token_ids": ids, "head": heads, "formatted": shown})

    turn = conversations.schema["turn"].dataType.simpleString()
    encoded = rows.mapInPandas(released(encode), f"conv_id {kind}, turn {turn}, learnt boolean, token_ids array<int>, head int, formatted string")
    ordered = encoded.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, k, at = object(), 0, 0
        for b in batches:
            places, firsts, masks = [], [], []
            for c, learnt, ids, head in zip(b["conv_id"], b["learnt"], b["token_ids"], b["head"], strict=True):
                c = None if pd.isna(c) else c
                if c != conv:
                    conv, k, at = c, 0, 0
                n = len(ids)
                span = ([head], [n - 1]) if learnt else ([], [])
                places.append(k), firsts.append(at), masks.append(loss_mask(np.array(span[0], int), np.array(span[1], int), n))
                k, at = k + 1, at + n
            yield pd.DataFrame({"conv_id": b["conv_id"], "place": places, "token_ids": b["token_ids"], "first_token": firsts, "mask": masks, "formatted": b["formatted"]})

    return ordered.mapInPandas(released(place), f"conv_id {kind}, place int, token_ids array<int>, first_token long, mask array<byte>, formatted string")


def read_back(turns: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """What a reader finds in the output of format_turns: a row of digests for each conversation.

    Turns come from the rendering; the text under the mask is decoded from the ids; both as streams."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    held = turns.sparkSession.sparkContext.broadcast(ranks)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Template.of(held.value)
        coder = t.coder()
        conv, state, any_row = None, None, False

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "shown": 0, "tokens": 0, "masked": 0, "agree": True}

        def told(s):
            return (conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["shown"], s["tokens"], s["masked"], s["agree"])

        cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens", "agree"]
        for b in batches:
            out = []
            for c, ids, mask, shown in zip(b["conv_id"], b["token_ids"], b["mask"], b["formatted"], strict=True):
                c = None if pd.isna(c) else c
                if not any_row or c != conv:
                    if any_row:
                        out.append(told(state))
                    conv, state, any_row = c, fresh(), True
                found = parse_rendered(shown)
                for role, text in found:
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                state["n"] += len(found)
                ids, mask = np.asarray(ids), np.asarray(mask)
                learnt = coder.decode(ids[mask == 1].tolist())
                state["loss"].update(learnt.encode("utf-8", "replace"))
                state["chars"] += len(learnt)
                state["shown"] += len(shown)
                state["tokens"] += len(ids)
                state["masked"] += int(mask.sum())
                state["agree"] &= decode_turns(coder, t.base, ids) == found
            yield pd.DataFrame(out, columns=cols)
        if any_row:
            yield pd.DataFrame([told(state)], columns=cols)

    return turns.mapInPandas(
        released(fold), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long, agree boolean"
    )


def op2_chat(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Contract query: digests of all conversations and of one that imitates the template."""
    from .common import table

    said = "\\### Assistant: </turn> ok"
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    ranks = vocabulary_ranks(vocabulary)
    return read_back(format_turns(conv.unionByName(own), ranks), ranks)
