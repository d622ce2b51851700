"""Sum-of-squares packing of tokenised documents into sequences.

Documents are tokenised once, cut only where longer than a sequence, and their pieces
dealt by a hash into groups of a bounded number of rows. A group places its pieces one
by one where the sum of squared counts of open sequences per residual gap becomes
smallest, then closes.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
from tokenizers.pre_tokenizers import Sequence as Pieces

from .common import pieces

CAPACITY = 2048
END = 0
GROUP_ROWS = 20_000
MEMO_WORDS = 200_000
#: Signs that the tokenizer parts from letters before them.
SIGNS = b".,;:!?)\"%&*#$"
# Fixed value: how a tokenizer must part texts, by its own description, for its words to be looked up apart.
BY_WORDS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "splits": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_loaded: dict[str, tuple[Tokenizer, Tokenizer | None]] = {}  # kept between the tasks of one Python worker


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed from the longest to the shortest."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; 0 and capacity stay 0
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        gaps = count[size:]
        held = np.flatnonzero(gaps[:-1])
        if len(held):
            change = 2 * (count[held] - gaps[held]) + 2
            if held[0] == 0:  # filled to the brim: the sequence closes
                change[0] = 1 - 2 * gaps[0]
            gap = int(held[np.argmin(change)]) + size
            number = open_[gap].pop()
            count[gap] -= 1
        else:  # a new sequence only where no open one has room
            gap, number, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = number, capacity - gap
        if gap > size:
            open_[gap - size].append(number)
            count[gap - size] += 1
    return bins, offsets


def parts_by_words(whole: Tokenizer) -> bool:
    """Whether white space ends a token and texts are folded as BY_WORDS says; special tokens all begin with "<|"."""
    said = json.loads(whole.to_str())
    normalizer, splits = said["normalizer"] or {}, (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == BY_WORDS["normalizer"]
        and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and splits[0].get("pattern") == {"Regex": BY_WORDS["splits"]}
        and not splits[1]["add_prefix_space"]
        and all(x["content"].startswith("<|") for x in said["added_tokens"])
    )


def letters_alone(word: bytes) -> bool:
    """Whether a word is of letters, also once it is normalised (the lower case of some letters holds a sign)."""
    plain = word.decode()
    return plain.isalpha() and (plain.isascii() or unicodedata.normalize("NFC", plain).lower().isalpha())


class WordIds:
    """Ids of texts.

    Where the tokenizer parts texts as BY_WORDS says, its tokens never cross white space,
    so each distinct word is encoded once. Texts that may hold special tokens, and all
    texts for any other tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        if path not in _loaded:
            whole, bare = Tokenizer.from_file(path), None
            if parts_by_words(whole):
                # the same model for words of letters that normalising leaves as they are
                bare = Tokenizer(whole.model)
                bare.pre_tokenizer = Pieces([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            _loaded[path] = whole, bare
        self.tokenizer, self.bare = _loaded[path]
        self.memo: list[dict[bytes, bytes]] = [{}, {}]  # words met lately, and those before

    def __call__(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.bare is None or b"<|" in text:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        if len(self.memo[0]) > MEMO_WORDS:
            self.memo[:] = {}, self.memo[0]
        lately, before = self.memo
        if missing := set(words).difference(lately):
            lately.update({w: before[w] for w in missing if w in before})
            # a sign ends a word of letters for the tokenizer too, so what is before and after it is looked up apart
            split = {w: (core, w[len(core) :]) for w in missing.difference(before) if len(core := w.rstrip(SIGNS)) < len(w) and letters_alone(core)}
            parts = {p for pair in split.values() for p in pair}
            lately.update({w: before[w] for w in parts if w in before})
            new = [w for w in missing.difference(before, split) | parts if w not in lately]
            lately.update(zip(new, self._ids(new), strict=True))
            lately.update({w: lately[core] + lately[tail] for w, (core, tail) in split.items()})
        return b"".join(map(lately.__getitem__, words))

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Texts of letters alone are one word each to the tokenizer, which takes them in one go."""
        plain, out = [t.decode() for t in texts], [b""] * len(texts)
        letters = [i for i, t in enumerate(plain) if t.isalpha()]
        small = [i for i in letters if plain[i] == plain[i].lower()]
        large = sorted(set(letters).difference(small))
        done = self._each(small, plain, out, self.bare) + self._each(large, plain, out, self.tokenizer)
        rest = sorted(set(range(len(plain))).difference(done))
        for i, e in zip(rest, self.tokenizer.encode_batch([plain[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _each(self, which: list[int], plain: list[str], out: list[bytes], tokenizer: Tokenizer) -> list[int]:
        """Set the ids of some words of letters; returns those for which it could."""
        joined = " ".join([plain[i] for i in which])
        if not which or tokenizer is self.bare and not unicodedata.is_normalized("NFC", joined):
            return []
        encoded = tokenizer.encode(joined, add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        starts = np.flatnonzero(np.diff(np.array(encoded.word_ids, np.int64), prepend=-1))
        if len(starts) != len(which):
            return []
        ends = [*(4 * starts[1:]).tolist(), len(ids)]
        for i, low, high in zip(which, (4 * starts).tolist(), ends):
            out[i] = ids[low:high]
        return which


def _cut(path: str, capacity: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = WordIds(path), np.array([end], "<u4").tobytes()
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids_of(text or b"") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = place(batch["length"].to_numpy(), capacity)
        group = batch["pack"].to_numpy(np.int64)
        return batch.drop(columns="pack").assign(sequence_id=(group << 32) + bins, offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of a document.

    A document is its ids and the end id; a null text is the end id alone. Repeated rows
    are packed each for itself, as is a row without doc_id. Other columns are ignored; an
    empty table gives an empty result. Texts of any length are encoded whole, one at a time;
    pieces of a group that are equally long go in the order of doc_id, piece and ids_crc32.
    Groups are of about group_rows documents, and
    pieces of long ones, each, so at most a few sequences of each group stay part empty.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, (count + (size or 0) // (4 * capacity)) // group_rows)  # of documents and the pieces of long ones
    cut = read.mapInArrow(_cut(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack").applyInPandas(_pack(capacity), out)
