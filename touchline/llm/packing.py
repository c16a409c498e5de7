"""Packing documents into sequences by first-fit decreasing, in randomised groups.

A hash deals the documents into groups of about ``group_chars`` characters (within each step of a training order, if one is
given, so that the sequences of a step come before those of the next); each group is tokenised, cut and packed in
one task, so token ids never leave it. Documents longer than a sequence give full sequences; the remainders are placed
in order of falling length, each into the first sequence that has room, which a tournament tree of the sequences' free
places finds in logarithmic time. Then the emptiest sequences are taken apart again and their pieces cut to fill the
gaps of the others; what is left at last is cut at powers of two, which need no padding.

Defined results: a null text is empty and has the end id alone; repeated rows stay rows, told apart by ``row_id``, and
are dealt into many groups like others; a null step comes before all; an empty table gives an empty
result. Memory: the ids of one group, four bytes each, and one document's own tokenisation.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

#: Copies of one document that may meet in one group.
TOGETHER = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"
Piece = tuple[int, int, int]  # document, start, length


class FirstFit:
    """Tournament tree over sequences: each inner node has the most free places below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first sequence with at least ``need`` free places, which it then lacks."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        found = at - self.size
        tree[at] -= need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return found


def pack(lengths: list[int], size: int) -> list[list[Piece]]:
    """Sequences of pieces; only sequences whose length is a power of two stay below ``size``."""
    done: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        done += [[(doc, at, size)] for at in range(0, n - size + 1, size)]
        if n % size:
            rest.append((doc, n - n % size, n % size))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = FirstFit(len(rest), size)
    open_: list[list[Piece]] = []
    for piece in rest:
        at = tree.place(piece[2])
        if at == len(open_):
            open_.append([])
        open_[at].append(piece)
    return done + fill(open_, size)


def fill(open_: list[list[Piece]], size: int) -> list[list[Piece]]:
    """Take the emptiest sequences apart to fill the gaps of the fullest; cut what is left at powers of two."""
    order = sorted(range(len(open_)), key=lambda i: (-sum(p[2] for p in open_[i]), i))
    used = [sum(p[2] for p in open_[i]) for i in order]
    total, out = sum(used), []
    full = total // size
    loose = [p for i in order[full:] for p in open_[i]][::-1]
    for i, n in zip(order[:full], used):
        row = list(open_[i])
        while n < size:
            doc, start, length = loose.pop()
            part = min(length, size - n)
            row.append((doc, start, part))
            n += part
            if part < length:
                loose.append((doc, start + part, length - part))
        out.append(row)
    left = total - full * size
    while left:
        want, row = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            doc, start, length = loose.pop()
            part = min(length, want)
            row.append((doc, start, part))
            want -= part
            if part < length:
                loose.append((doc, start + part, length - part))
        out.append(row)
    return out


def public_encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Ids as the tokenizers library gives them for ``<name>.json``; the same vocabulary as ranks is several times faster, and
    the library itself takes over where that fails (very long runs without a break)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = "<|endoftext|>"
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special={end}, disallowed_special=())
        except BaseException as e:  # noqa: BLE001  the library's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def _packed(encoder: Callable[[], Callable[[str], list[int]]], size: int, end_id: int):
    def one_group(group: int, ids: list[int | None], tokens: list[np.ndarray]) -> pd.DataFrame:
        rows = []
        for k, sequence in enumerate(pack([len(x) for x in tokens], size)):
            offset = 0
            for doc, start, length in sequence:
                rows.append((ids[doc], start, length, zlib.crc32(tokens[doc][start : start + length].tobytes()), len(tokens[doc]), (group << 32) | k, offset, (group << 32) | doc))
                offset += length
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id"])
        return out.astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        now, ids, tokens = None, [], []
        for pdf in batches:
            for group, doc_id, text in zip(pdf["group"], pdf["doc_id"].astype("Int64"), pdf["text"]):
                if group != now:
                    if ids:
                        yield one_group(now, ids, tokens)
                    now, ids, tokens = group, [], []
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                tokens.append(np.array([*encode(text or ""), end_id], "<u4"))
        if ids:
            yield one_group(now, ids, tokens)

    return run


def pack_documents(docs: DataFrame, *, size: int = 2048, end_id: int = 1, group_chars: int = 4_000_000, step_col: str | None = None, encoder: Callable[[], Callable[[str], list[int]]] = public_encoder) -> DataFrame:
    """One row per piece of a document (doc_id, text); ``sequence_id`` holds the group in its high half, groups of a smaller
    ``step_col`` (a small integer) first, and ``row_id`` is the row that the piece comes from."""
    bounded_batches(docs.sparkSession)
    step = F.coalesce(F.col(step_col).cast("int"), F.lit(-1)) if step_col else F.lit(0)
    chars = {r["step"]: r["chars"] for r in docs.groupBy(step.alias("step")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).collect()}
    firsts, at = [], 0
    for s in sorted(chars):
        n = max(1, math.ceil(chars[s] / group_chars))
        firsts.append((s, at, n))
        at += n
    place = F.create_map(*[F.lit(x) for s, a, n in firsts for x in (s, F.struct(F.lit(a).alias("first"), F.lit(n).alias("n")))]) if firsts else None
    own = place[step] if firsts else F.struct(F.lit(0).alias("first"), F.lit(1).alias("n"))
    rows = docs.select("doc_id", "text", own.alias("own"), F.xxhash64("doc_id", "text").alias("h"))
    # rows that repeat are counted and dealt as numbered copies, so that they go to many groups, and to the same ones when a task runs again
    often = rows.groupBy("doc_id", "own", "h").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # as a table its size is known: where few rows repeat Spark broadcasts it, and no text moves for it
    path = scratch(docs.sparkSession, "repeated")
    often.write.parquet(path)
    often = docs.sparkSession.read.parquet(path)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "own", "h")]
    once = rows.alias("a").join(often.alias("b"), same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    counted = rows.alias("a").join(often.alias("b"), same, "left_semi").groupBy("doc_id", "text", "own", "h").agg(F.count("*").alias("n"))
    copies = counted.select("doc_id", "text", "own", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    salted = F.when(F.col("copy") < TOGETHER, F.col("h")).otherwise(F.xxhash64("h", F.floor(F.col("copy") / TOGETHER)))
    dealt = once.unionByName(copies).select("doc_id", "text", (F.col("own.first") + F.pmod(salted, F.col("own.n"))).cast("long").alias("group"))
    return dealt.repartition("group").sortWithinPartitions("group", "doc_id", F.xxhash64("text")).select("group", "doc_id", "text").mapInPandas(_packed(encoder, size, end_id), SCHEMA)
