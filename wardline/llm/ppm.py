"""LM scoring by prediction by partial matching over bytes.

The model is pretrained: the counts of all byte strings of one length in the training
texts, which hold the counts of every shorter context. They are summed over the whole
corpus by shuffles. Where the strings of one two-byte context meet, a byte-context trie
of all longer contexts is built from them and gives each string's last byte a
probability, by escapes (method C) with symbol exclusion; the orders below two, at most
65,536 counts, go to every task. No table of words or strings goes whole through a task
or the driver: documents lie in blocks of bounded size, a block asks for the words and
strings it holds, and the answers return to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, pieces, settle

#: Bytes of context.
ORDER = 5
BLOCK_BYTES = 16_000_000
CHUNK = 1 << 19
SPACER = 10  # before a text and after it


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def strings_of(words: list[bytes]) -> np.ndarray:
    """Code of the ORDER + 1 bytes that end at each byte of the text and at its end mark; the last byte is lowest."""
    raw = np.frombuffer(bytes([SPACER]) * ORDER + b" ".join(words) + bytes([SPACER]), np.uint8)
    n = len(raw) - ORDER
    code = raw[:n].astype(np.int64)
    for i in range(1, ORDER + 1):
        code = (code << 8) | raw[i : i + n]
    return code


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at the wanted keys, 0 where there is none; keys are in order."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_probs(strings: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte after the bytes before it.

    strings: distinct, with all that share their last three bytes' first two; counts in
    training, some 0; pairs: counts of two bytes in a row, 256 x 256.
    """
    levels = {}
    for k in range(ORDER, 1, -1):  # the trie's level of contexts of k bytes
        keys, n = sums(strings & ((1 << 8 * (k + 1)) - 1), counts)
        keys, n = keys[n > 0], n[n > 0]
        context, total = sums(keys >> 8, n)
        levels[k] = keys, n, context, total, sums(keys >> 8, np.ones_like(n))[1]
    after, alone = (pairs > 0).astype(np.int64), pairs.sum(axis=0)
    out, left = np.zeros(len(strings)), np.arange(len(strings))
    met = dropped = np.zeros(len(strings), np.int64)  # symbols excluded, and their count at this order
    for k in range(ORDER, -2, -1):
        s = strings[left]
        if k >= 2:
            keys, n, context, total, kinds = levels[k]
            here = s >> 8 & ((1 << 8 * k) - 1)
            hit, all_, distinct = look(keys, n, s & ((1 << 8 * (k + 1)) - 1)), look(context, total, here), look(context, kinds, here)
        elif k == 1:
            hit, all_, distinct = pairs[s >> 8 & 255, s & 255], pairs.sum(axis=1)[s >> 8 & 255], after.sum(axis=1)[s >> 8 & 255]
        elif k == 0:
            hit, all_, distinct = alone[s & 255], alone.sum(), (alone > 0).sum()
        else:  # any byte not met at all
            out[left] -= np.log10(256 - (alone > 0).sum())
            break
        new = distinct - met
        room = all_ - dropped + new
        found = hit > 0
        out[left[found]] += np.log10(hit[found] / room[found])
        escaped = ~found & (room > 0)
        out[left[escaped]] += np.log10(new[escaped] / room[escaped])
        left = left[~found]
        met = np.broadcast_to(distinct, len(s))[~found]
        s = s[~found]
        if k > 2:
            low_keys, low_n = levels[k - 1][:2]
            below = look(low_keys, low_n, keys & ((1 << 8 * k) - 1))
        elif k == 2:
            below = pairs[keys >> 8 & 255, keys & 255]
        if k >= 2:
            context, below = sums(keys >> 8, below)
            dropped = look(context, below, s >> 8 & ((1 << 8 * k) - 1))
        elif k == 1:
            dropped = (after @ alone)[s >> 8 & 255]
    return out


def _texts(part: pa.Table) -> Iterator[tuple[int | None, bool, list[bytes]]]:
    for some in part.select(["doc_id", "held_out", "text"]).to_batches(max_chunksize=500):
        for doc_id, held_out, text in zip(*(c.to_pylist() for c in some.columns)):
            yield doc_id, held_out, words_of(text)


def _count_words(part: pa.Table) -> tuple[Counter, set[bytes]]:
    trained, others = Counter(), set()
    for _, held_out, words in _texts(part):
        if held_out:
            others.update(words)
        else:
            trained.update(words)
            trained[b""] += 1  # the end
    others.add(b"")
    return trained, others.difference(trained)


def _ask_words(part: pa.Table) -> pa.Table:
    trained, others = _count_words(part)
    keys = sorted([*trained, *others])
    del others
    block = part.column("block")[0].as_py()
    pa.default_memory_pool().release_unused()
    return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "word": pa.array(keys, pa.binary()), "n": pa.array(np.fromiter(map(trained.__getitem__, keys), np.int64, len(keys)))})


def tally(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    code = np.sort(np.concatenate([np.zeros(0, np.int64), *codes]))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.diff(first, append=len(code))


def _ask_strings(part: pa.Table) -> pa.Table:
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # distinct strings and counts of some texts each
    codes: tuple[list, list] = [], []  # of training and of held-out texts
    held = waiting = 0

    def tallied() -> int:
        (keys, n), (others, _) = tally(codes[0]), tally(codes[1])
        parts.append((np.concatenate([keys, others]), np.concatenate([n, np.zeros(len(others), np.int64)])))
        return len(parts[-1][0])

    for _, held_out, words in _texts(part):
        codes[held_out].append(strings_of(words))
        held += len(codes[held_out][-1])
        if held > CHUNK:
            waiting, codes, held = waiting + tallied(), ([], []), 0
            if waiting > 2 * CHUNK:
                parts, waiting = [sums(*map(np.concatenate, zip(*parts)))], 0
    tallied()
    known, counts = sums(*map(np.concatenate, zip(*parts)))
    block = part.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(known), block, np.int32)), "string": pa.array(known), "n": pa.array(counts)})


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros(1 << 16, np.int64)
    for batch in pieces(batches):
        codes, held = [], 0
        for words in map(words_of, batch.column(0).to_pylist()):
            codes.append(strings_of(words))
            held += len(codes[-1])
            if held > CHUNK:
                pairs += np.bincount(np.concatenate(codes) & 0xFFFF, minlength=1 << 16)
                codes, held = [], 0
        if codes:
            pairs += np.bincount(np.concatenate(codes) & 0xFFFF, minlength=1 << 16)
    at = np.flatnonzero(pairs)
    yield pa.record_batch([pa.array(at), pa.array(pairs[at])], names=["pair", "n"])


def _model(pairs: Callable[[], np.ndarray]):
    """Probabilities of strings that come in the order of their two-byte contexts, for some whole contexts at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush(parts: list) -> pa.RecordBatch:
            strings, counts = (np.concatenate(x) for x in zip(*parts))
            return pa.record_batch([pa.array(strings), pa.array(log_probs(strings, counts, pairs()))], names=["string", "value"])

        for batch in batches:
            strings, counts = (c.to_numpy() for c in batch.columns[:2])
            parts.append((strings, counts))
            held += len(strings)
            if held > CHUNK:
                # all but the last context, which may go on in the next batch
                strings, counts = (np.concatenate(x) for x in zip(*parts))
                context = strings >> 8 & 0xFFFF
                cut = int(np.searchsorted(context, context[-1]))
                if cut:
                    yield flush([(strings[:cut], counts[:cut])])
                parts, held = [(strings[cut:], counts[cut:])], len(strings) - cut
        if parts:
            yield flush(parts)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, block_tokens long, block_words long"


def _score(part: pa.Table, answers: pa.Table) -> pa.Table:
    trained, others = _count_words(part)
    total, mine = sum(trained.values()), len(trained)
    logs = dict.fromkeys(others, 0.0)  # of a word never trained on; all others are above 0
    logs.update(zip(trained, np.log10(np.fromiter(trained.values(), float, mine) + 1).tolist()))
    del others
    pa.default_memory_pool().release_unused()
    words = answers.select(["word", "value", "first"]).filter(answers.column("word").is_valid())
    for some in words.to_batches(max_chunksize=20_000):  # so that few are Python objects at once
        named, value, first = some.columns
        logs.update(zip(named.to_pylist(), np.log10(value.to_numpy() + 1).tolist()))
        mine -= sum(map(trained.__contains__, named.filter(pc.invert(first.fill_null(False))).to_pylist()))
    del trained, words
    known = answers.select(["string", "value"]).filter(answers.column("string").is_valid())
    place, values = pd.Index(known.column("string").to_numpy()), known.column("value").to_numpy()
    del known
    rows = [(None, None, None, None, None, None, total, mine)]
    waiting: list[tuple] = []
    codes, held = [], 0

    def flush() -> None:
        if codes:
            each = values[place.get_indexer(np.concatenate(codes))]
            starts = np.cumsum([0, *map(len, codes[:-1])])
            rows.extend((*row, score, None, None) for row, score in zip(waiting, np.add.reduceat(each, starts).tolist()))

    for doc_id, held_out, tokens in _texts(part):
        found = [*map(logs.__getitem__, tokens), logs[b""]]
        waiting.append((doc_id, held_out, len(found), len(found) - found.count(0.0), sum(found)))
        codes.append(strings_of(tokens))
        held += len(codes[-1])
        if held > CHUNK:
            flush()
            waiting, codes, held = [], [], 0
    flush()
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _SCORED.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Null texts are empty: the end alone. Training takes the rows whose crc32 of the id as
    text mod 7 is not 2 (a null id counts as the empty string). score is of the text the
    tokens stand for: words in lower case, one blank between, an end. With no training
    rows every byte has probability 1/256. Repeated rows count each, equal texts score
    alike; texts of any length are scored whole, a block holding one at least; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    read = docs.select(F.col("doc_id").cast("long"), (crc_of_id(F.col("doc_id")) % 7 == 2).alias("held_out"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = size // block_bytes + 1
    dealt = read.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    counted = read.filter("NOT held_out").select("text").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((256, 256), np.int64)  # the only counts that all tasks get: 256 x 256
    for pair, n in counted:
        table[pair >> 8, pair & 255] = n
    pairs = spark.sparkContext.broadcast(table)
    by_block = dealt.groupBy("block")

    word_asked = by_block.applyInArrow(_ask_words, "block int, word binary, n long").filter("word IS NOT NULL AND n IS NOT NULL").repartition("word")
    # a common word has a row in each block: they are summed up and answered as a stream, never gathered, and dealt once
    totals = word_asked.groupBy("word").agg(F.sum("n").alias("all"), F.min(F.when(F.col("n") > 0, F.col("block"))).alias("least"))
    words = word_asked.join(totals, "word").filter("all != n")
    words = words.select("block", "word", F.lit(None).cast("long").alias("string"), F.col("all").cast("double").alias("value"), (F.col("least") == F.col("block")).alias("first"))

    asked = by_block.applyInArrow(_ask_strings, "block int, string long, n long").filter("string IS NOT NULL").repartition("string")
    # both uses of asked take the same rows and columns, so that it is dealt once
    whole = asked.groupBy("string").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    context = F.expr("shiftright(string, 8) & 65535")
    by_context = whole.repartition(context).sortWithinPartitions(context)
    known = by_context.mapInArrow(_model(lambda: pairs.value), "string long, value double")
    strings = asked.join(known, "string").select("block", F.lit(None).cast("binary").alias("word"), "string", "value", (F.col("n") < 0).alias("first"))

    answers = words.union(strings)
    scored = settle(by_block.cogroup(answers.groupBy("block")).applyInArrow(_score, _SCORED))
    tokens, kinds = scored.agg(F.sum("block_tokens"), F.sum("block_words")).first()
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float((tokens or 0) + (kinds or 0) + 1)))
    return scored.filter("n_tokens IS NOT NULL").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens or 0).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
