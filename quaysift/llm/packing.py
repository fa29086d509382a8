"""Filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Method: minimum bin slack. Each container is opened with the longest item left; a bitset subset-sum dynamic program
over the remaining lengths (with their counts, in binary parts) finds the sum closest to the room left, and
backtracking gives the counts of each length. The pattern is repeated as long as its lengths last. An item above the
capacity is cut into full parts and a rest; no other item is ever split.

Scale: documents are dealt to blocks by hash, so that a block is packed by one task and has the lengths of the
whole; containers that a block leaves below ``good`` are emptied and their items packed again in fewer blocks, until one
block is left. Only (id, length) pairs are shuffled.

Defined cases: null and empty texts have length 0 and join the first container of their block; items as long as the
capacity fill one; repeated ids are told apart by nothing, so ids should be unique; an empty table gives no rows;
other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

import ast
import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysift.config import DEFAULT
from quaysift.session import cut_lineage, spread

PACKED = "target_name string, capacity_tokens int, doc_id bigint, part int, tokens int, container string, fill int"


@lru_cache(maxsize=4)
def encoder(directory: str, name: str):
    """Byte-pair encoder from a vocabulary file of ranks; the splitting pattern stands beside the files."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(directory, name).read_bytes().splitlines())}
    tree = ast.parse(Path(directory, "__init__.py").read_text())
    pattern = next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and n.targets[0].id == "PATTERN")
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, directory: str = DEFAULT.tokenizer_dir, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, tokens) of every row."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(directory, name).encode_ordinary
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["key"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(count, "doc_id bigint, tokens int")


def fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest possible up to the room: bitset dynamic program with backtracking."""
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach, stages = 1, []
    for length in sorted((n for n, c in lengths.items() if c and n <= room), reverse=True):
        left, part = min(lengths[length], room // length), 1
        while left:
            take = min(part, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


def pack_block(items: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (doc_id, part, tokens) for items of at most the capacity."""
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for item in sorted(items, reverse=True):
        by_length[item[2]].append(item)
    empty = by_length.pop(0, [])
    counts = {n: len(v) for n, v in by_length.items()}
    containers = []
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            pattern = fill(counts, capacity - longest)
            pattern[longest] = pattern.get(longest, 0) + 1
            counts[longest] += 1
            for _ in range(min(counts[n] // c for n, c in pattern.items())):
                containers.append([by_length[n].pop() for n, c in pattern.items() for _ in range(c)])
                for n, c in pattern.items():
                    counts[n] -= c
    if empty:
        if not containers:
            containers.append([])
        containers[0] += empty
    return containers


def _packer(round_no: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        target, capacity, block = pdf["target_name"].iloc[0], int(pdf["capacity_tokens"].iloc[0]), int(pdf["block"].iloc[0])
        rows = []
        for k, content in enumerate(pack_block(list(zip(pdf["doc_id"].tolist(), pdf["part"].tolist(), pdf["tokens"].tolist())), capacity)):
            total = sum(i[2] for i in content)
            rows += [(target, capacity, d, p, t, f"{round_no}-{block}-{k}", total) for d, p, t in content]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return packed


def pack(lengths: DataFrame, targets: DataFrame, per_block: int = 8000, good: float = 0.98) -> DataFrame:
    """Container of each document (and part of one above the capacity) for each target.

    lengths: doc_id, tokens; targets: target_name, capacity_tokens (a handful of rows). Badly filled containers are dealt
    anew into fewer blocks, until one block is left or a round settles less than a tenth of what it was given.
    """
    lengths = cut_lineage(lengths)
    n = lengths.count()
    items = lengths.crossJoin(F.broadcast(targets.filter("capacity_tokens > 0").select("target_name", "capacity_tokens")))
    full = F.floor(F.col("tokens") / F.col("capacity_tokens")).cast("int")
    over = F.col("tokens") > F.col("capacity_tokens")
    whole = items.filter(over).select(
        "target_name", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.col("capacity_tokens").alias("tokens"),
    )
    whole = whole.withColumn("container", F.concat_ws("-", F.lit("full"), "doc_id", "part")).withColumn("fill", F.col("tokens"))
    rest = items.filter(~over | (F.col("tokens") % F.col("capacity_tokens") > 0)).select(
        "target_name", "capacity_tokens", "doc_id", F.when(over, full).otherwise(0).alias("part"),
        F.when(over, F.col("tokens") % F.col("capacity_tokens")).otherwise(F.col("tokens")).cast("int").alias("tokens"),
    )
    done, blocks, left, k = whole, max(1, -(-n // per_block)), None, 0
    while True:
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "part", F.lit(k)), F.lit(blocks)).cast("int"))
        packed = dealt.groupBy("target_name", "block").applyInPandas(_packer(k), PACKED)
        if blocks == 1:
            return done.unionByName(packed)
        packed = cut_lineage(packed)
        enough = F.col("fill") >= F.col("capacity_tokens") * good
        before, left = left, packed.filter(~enough).count()
        if before is not None and left > 0.9 * before:  # what is left cannot be packed well: dealing it anew settles nothing
            return done.unionByName(packed)
        done = done.unionByName(packed.filter(enough))
        rest = packed.filter(~enough).select("target_name", "capacity_tokens", "doc_id", "part", "tokens")
        blocks, k = max(1, -(-left // (3 * per_block))), k + 1
