"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Bins are filled
one at a time: of the items that fit, the one whose demand has the largest weighted dot
product with what the bin has left goes in. Where items may be cut, a bin that no whole item
fits takes a piece of the longest one.

Items are packed in groups of bounded size within each partition, so nothing is shuffled and a
task holds one group. A bin that a group leaves short goes into the next group, so a partition
has one short bin at most; the last is split into sequences whose lengths are powers of two,
which need no padding.

Strings of added tokens in a text become those tokens, as the tokenizer's library has it.

Edge cases: null and empty texts are one token, the closing id; repeated rows are packed once
each; a null doc_id is carried along; ties go to the item read first; an empty table gives an
empty result; a text longer than a sequence fills whole sequences and leaves its remainder.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common
from .bpe import byte_letters

#: Items of a group, and the tokens that a group may hold.
GROUP, GROUP_TOKENS = 4096, 8_000_000
#: Characters of a text that is looked through for long gaps, and such a gap.
LONG, _GAP = 4_096, re.compile(r"\s{2048}")
#: Where a byte-level pre-tokenizer cuts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Id that closes each document.
CLOSE = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start within the item, length).

    Without ``cut`` an item that exceeds a limit by itself is an error. With ``cut`` every
    token of an item bears loss, or none does: ``loss`` must be ``tokens`` or zeros.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    tokens, loss = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    if not cut and len(tokens) and (tokens.max() > limits.tokens or loss.max() > limits.loss):
        raise ValueError("an item exceeds a limit; cut it first")
    start = np.zeros(len(tokens), dtype=np.int64)
    demand = np.stack([tokens, np.ones(len(tokens)), loss]) / cap[:, None] if len(tokens) else np.zeros((3, 0))
    weight = demand.sum(axis=1) / max(1e-12, demand.sum())
    left = len(tokens)
    alive = np.ones(len(tokens), dtype=bool)
    bins: list[list[tuple[int, int, int]]] = []
    while left:
        room, content = cap.copy(), []
        # Each placement looks at the items alive; they are compacted once a bin.
        items = np.flatnonzero(alive)
        t, ls = tokens[items], loss[items]
        here = np.ones(len(items), dtype=bool)
        while room[1] >= 1 and room[0] >= 1 and left:
            w = weight * room / cap / cap
            score = np.where(here & (t <= room[0]) & (ls <= room[2]), w[0] * t + w[1] + w[2] * ls, -1.0)
            k = int(score.argmax())
            if score[k] >= 0:
                i, take = items[k], int(t[k])
                content.append((int(i), int(start[i]), take))
                room -= (take, 1, ls[k])
                here[k] = alive[i] = False
                left -= 1
                continue
            take = int(min(room[0], room[2] if ls.any() else room[0]))
            if not cut or take < 1 or not here.any():
                break
            k = int(np.where(here, t, -1).argmax())
            i = items[k]
            bears = ls[k] > 0
            content.append((int(i), int(start[i]), take))
            room -= (take, 1, take if bears else 0)
            start[i] += take
            tokens[i] -= take
            t[k] -= take
            if bears:
                loss[i] -= take
                ls[k] -= take
        bins.append(content)
    return bins


def _powers(content: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Split a bin into bins whose lengths are powers of two."""
    total, out, pieces = sum(x[2] for x in content), [], list(content)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now = []
        while size:
            item, start, length = pieces.pop(0)
            take = min(size, length)
            now.append((item, start, take))
            if take < length:
                pieces.insert(0, (item, start + take, length - take))
            size -= take
        out.append(now)
    return out


class Words:
    """Ids of texts as a ``tokenizers`` file gives them.

    Where the file's merges are numbered in their order, as checked here, merging by rank gives
    the same ids and is several times faster; else the file's own model encodes. Texts that hold
    the string of an added token, and long ones with a run of white space that the faster
    pattern could not match, are always left to the file's own model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content]
        self.ranked = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, pre = file["model"]["vocab"], file["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        own = {t["content"] for t in file["added_tokens"]}
        plain = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        first = len(vocab) - len(own & vocab.keys()) - len(merges)
        in_order = all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges))
        if not (plain and in_order and file["normalizer"] is None and not file["model"]["ignore_merges"]):
            return None
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            return None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in own}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return self.ranked is not None and not any(t in text for t in self.added) and (len(text) < LONG or not _GAP.search(text))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if not t:
                ids: list[int] = []
            elif self._plain(t):
                ids = self.ranked.encode_ordinary(t)
            else:
                ids = self.model.encode(t, add_special_tokens=False).ids
            out.append(np.array(ids, dtype="<u4"))
        return out


def words(path: str) -> Words:
    return common.worker_state("packing", path, lambda: Words(path))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits()) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    A sequence_id holds its partition's number in the upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        ids_of = words(path)
        held: list[tuple] = []  # doc_id, ids that remain, where they start, tokens of the document
        size = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

        def flush(last: bool) -> list[tuple]:
            """Rows of the bins of what is held; but for the last group, a short bin stays held."""
            nonlocal made, held, size
            n = np.array([len(x[1]) for x in held])
            rows, stay = [], []
            for content in pack(n, n, limits, cut=True):
                short = sum(x[2] for x in content) < whole
                if short and not last and len(content) < limits.segments:
                    stay += [(held[i][0], held[i][1][a : a + k].copy(), held[i][2] + a, held[i][3]) for i, a, k in content]
                    continue
                for part in _powers(content) if short else [content]:
                    offset = 0
                    for item, start, length in part:
                        doc, ids, first, total = held[item]
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        rows.append((doc, first + start, length, crc, total, base + made, offset))
                        offset += length
                    made += 1
            held, size = stay, sum(len(x[1]) for x in stay)
            return rows

        whole = min(limits.tokens, limits.loss)
        for batch in batches:
            docs_in, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                part, rows = texts.slice(at, 256).to_pylist(), []
                for doc, ids in zip(docs_in.slice(at, 256).to_pylist(), ids_of.encode(part), strict=True):
                    ids = np.append(ids, np.uint32(CLOSE)).astype("<u4")
                    total, first = len(ids), 0
                    while total - first >= whole:
                        piece = ids[first : first + whole]
                        rows.append((doc, first, whole, zlib.crc32(piece.tobytes()), total, base + made, 0))
                        made += 1
                        first += whole
                    if first < total:
                        held.append((doc, ids[first:].copy(), first, total))
                        size += total - first
                    if len(held) >= GROUP or size >= GROUP_TOKENS:
                        rows += flush(False)
                if rows:
                    yield emit(rows)
            del batch, docs_in, texts
            common.give_back()
        if held:
            yield emit(flush(True))

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Place whole instruction examples (example_id, tokens, loss_tokens) into sequences.

    Returns (example_id, sequence_id, offset, tokens, loss_tokens). A null count is zero; an
    example that exceeds a limit by itself is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ids = part.column(0).to_pylist()
                n, loss = part.column(1).to_numpy(), part.column(2).to_numpy()
                rows = []
                for content in pack(n, loss, limits):
                    offset = 0
                    for item, _, length in content:
                        rows.append((ids[item], base + made, offset, length, int(loss[item])))
                        offset += length
                    made += 1
                names = ["example_id", "sequence_id", "offset", "tokens", "loss_tokens"]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    rows = examples.selectExpr(
        "cast(example_id as long) example_id", "coalesce(cast(tokens as long), 0L) tokens", "coalesce(cast(loss_tokens as long), 0L) loss_tokens"
    )
    return rows.mapInArrow(run, "example_id long, sequence_id long, offset long, tokens long, loss_tokens long")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, placed into sequences.

    Null and empty texts are one token; rows that repeat are packed once each; other columns are
    not read.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
