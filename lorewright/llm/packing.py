"""Hierarchical multi-length packing into windows of 1024 tokens and shorter tiers.

Each task streams its documents through one packer of bounded state. A document's full windows leave at once; its rest is
routed to the shortest tier that holds it. Tiers are packed from the longest: every piece opens a window, whose gap takes
the longest whole pieces of shorter tiers that fit and last a cut of another piece, so windows come out full. At the end of
a task what is left leaves in windows of powers of two. Windows of one tier form step groups of equal token count, STEP_TOKENS; a
task's last group of each tier may hold fewer.

No shuffle: a window's pieces come from one task. Reruns of a task read the same rows and give the same windows; ids carry
the task's number, so they are unique.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lorewright.llm.kernel import slices

TIERS = (128, 256, 512, 1024)
#: Rests held by a packer before it packs, and how many it keeps so that later gaps find fitting pieces.
POOL, KEEP = 4096, 512
STEP_TOKENS = 16384
END_ID = 0
#: Splits text ahead of byte-pair merging, as the vocabulary's byte-level rule has it (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_byte_level(said: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE by PATTERN, without normaliser and options, whose merges rank as the ids of
    what they make do, and whose added tokens are found wherever they stand."""
    model, split = said["model"], said.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or said.get("normalizer") or split.get("type") != "ByteLevel":
        return False
    if split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if any(model.get(o) for o in options):
        return False
    if any(t.get(o) for t in said["added_tokens"] for o in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    added = {t["content"] for t in said["added_tokens"]}
    longer = {i for k, i in model["vocab"].items() if len(k) > 1 and k not in added}
    return all(a < b for a, b in zip(made, made[1:])) and set(made) == longer  # noqa: B905


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Encodes a text by a tokenizer file, no special tokens added, as little-endian unsigned 32-bit ids. Where the file is
    plain byte-level BPE the faster of the two libraries gives the same ids (the tests hold them against each other); any
    other file is read by `tokenizers`."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    if not plain_byte_level(said):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    ranks = {bytes(spelled[c] for c in k): v for k, v in said["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("lorewright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


class Packer:
    """Takes documents, gives full windows as lists of pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL, keep: int = KEEP):
        self.tiers, self.window = sorted(tiers), max(tiers)
        self.keep = max(keep, self.window // 2)  # a window's gap is shorter than half of it, so these always fill it
        self.pool = max(pool, self.keep + 1)
        self.rests: list[tuple[int, int]] = []  # (length, number), ascending
        self.pieces: dict[int, tuple] = {}
        self.count = 0

    def _hold(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.count += 1
        self.pieces[self.count] = (doc, start, ids, total)
        insort(self.rests, (len(ids), self.count))

    def _take(self, at: int) -> tuple:
        return self.pieces.pop(self.rests.pop(at)[1])

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            yield self.window, [(doc, start, ids[start : start + self.window], len(ids))]
        if full < len(ids):
            self._hold(doc, full, ids[full:].copy(), len(ids))
        if len(self.rests) >= self.pool:
            while len(self.rests) > self.keep:
                yield self._window()

    def _window(self) -> tuple[int, list[tuple]]:
        """A full window of the longest rest's tier; the caller sees that enough tokens are left."""
        first = self._take(-1)
        tier = next(t for t in self.tiers if t >= len(first[2]))
        inside, gap = [first], tier - len(first[2])
        while gap:
            fit = bisect_right(self.rests, (gap, self.count)) - 1
            if fit >= 0:
                inside.append(self._take(fit))
            elif self.rests:
                doc, start, ids, total = self._take(0)
                inside.append((doc, start, ids[:gap], total))
                self._hold(doc, start + gap, ids[gap:], total)
            else:
                break
            gap -= len(inside[-1][2])
        return tier, inside

    def end(self) -> Iterator[tuple[int, list[tuple]]]:
        while self.rests:
            tier, inside = self._window()
            left = sum(len(x[2]) for x in inside)
            if left == tier:
                yield tier, inside
                continue
            while left:  # the last tokens: windows of powers of two
                size, taken, room = 1 << (left.bit_length() - 1), [], 1 << (left.bit_length() - 1)
                while room:
                    doc, start, ids, total = inside.pop(0)
                    taken.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        inside.insert(0, (doc, start + room, ids[room:], total))
                    room -= len(taken[-1][2])
                yield size, taken
                left -= size


def _packed(path: str, tiers: tuple[int, ...], keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, code = TaskContext.get().partitionId() << 40, Packer(tiers), encoder(path)
        rows: list[tuple] = []
        texts: list[list[int]] = []
        made, steps = 0, {}

        def put(windows) -> None:
            nonlocal made
            for tier, inside in windows:
                n = steps.get(tier, 0)
                steps[tier] = n + 1
                group = own + (tier << 28) + n // max(1, STEP_TOKENS // tier)
                at = 0
                for doc, start, ids, total in inside:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, own + made, at, tier, group))
                    if keep_ids:
                        texts.append(ids.tolist())
                    at += len(ids)
                made += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            out = [pa.array(c, pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(columns)]
            if keep_ids:
                out.append(pa.array(texts, pa.list_(pa.int32())))
            rows.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * keep_ids)

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(code(text or ""), np.uint32(END_ID)).astype("<u4")
                    put(packer.add(doc, ids))
                if len(rows) > 10_000:
                    yield flushed()
        put(packer.end())
        yield flushed()

    return run


def packed(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and with
    keep_ids the ids.

    docs: doc_id long, text string; other columns are left. A document is its token ids and END_ID; a null or empty text is
    END_ID alone. Rows of one doc_id, and rows of a null doc_id, are documents of their own. tiers are powers of two. A text
    of any length is tokenised whole. No rows give no pieces.
    """
    schema = SCHEMA + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_packed(vocabulary or default_vocabulary(), tuple(tiers), keep_ids), schema)
