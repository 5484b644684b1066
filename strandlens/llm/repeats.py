"""Suffix-array dedup by prefix-free parsing: which bytes lie in a 50-byte string that an earlier document holds too.

Rolling-hash triggers cut every text into overlapping phrases: of the K-byte strings that a SIZE-byte window holds, the
one with the smallest hash (of equal ones the last) is the window's trigger, and all successive windows with one
trigger, together, are its phrase. Equal windows have equal triggers, so windows are compared under equal triggers only.
1. Dictionary: phrases go, as hashes, to shards by their trigger. A shard tells of each phrase whether a smaller doc_id
   has it (then all its windows are repeats), and whether its trigger has other phrases too.
2. Suffix array: phrases that are new but share their trigger go to the shards as bytes. There all SIZE-byte suffix
   prefixes of the dictionary's phrases are sorted, and equal runs tell which windows a smaller doc_id has.
3. Parse: each document puts its windows together again and cuts the marked bytes.

Texts are packed once, as blocks of about BLOCK_BYTES, into files bucketed by block, so that the later steps find
them where they are; what is shuffled is hashes, a few dictionary bytes and one bit or mask for each phrase. A block
names each phrase once, so copies and common lines add one entry a block, and sends to those shards only that its phrases
fall in. Memory follows a block and a shard, whose number grows with the text. Each step parses its blocks anew, which
costs less than keeping 15 bytes for each phrase of some 13 bytes. Left out is the suffix array of the parse itself: which
windows repeat is told by the dictionary's suffixes and by the smallest doc_id of each phrase alone, and corpus order
isn't asked for.

Trigger hashes have 40 bits and only nominate. A phrase's hash has 48 more; phrases count as equal if both agree (88 bits:
for 10**13 phrases the chance of one false pair is about 10**-1 without an adversary who knows the fixed salt); windows of
phrases that share only a trigger are compared byte by byte.
Null texts count as empty. Documents with a null doc_id keep all bytes and are no source. Rows that repeat a doc_id
each give a row and are no source for each other. Equal strings stay in the document of smallest doc_id. An empty table gives
no rows. Other columns of the input are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import shared_dir, table

SIZE, K = 50, 24
#: Windows from which a trigger is chosen: SIZE - K + 1 places.
SPREAD = SIZE - K + 1
BLOCK_BYTES, STEP = 2 << 20, 1 << 18
#: Text bytes for each shard of the dictionary, and parts in which a shard's suffixes are sorted one after the other.
SHARD_BYTES, PARTS = 16 << 20, 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SALT = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64)
NONE = np.iinfo(np.int64).max


class Parse:
    """Of one text of SIZE bytes or more: `at`, each phrase's trigger; `first` and `last`, its windows' starts; hashes."""

    def __init__(self, data: np.ndarray):
        ats, firsts, lasts, triggers, phrases = [], [], [], [], []
        windows = len(data) - SIZE + 1
        for low in range(0, windows, STEP):
            high = min(low + STEP, windows)
            part = data[low : high + SIZE - 1]
            n = len(part)
            power, back = tx.powers(BASE, n + 1), tx.powers(INVERSE, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(SALT[part] * power[:n], out=sums[1:])
            grams = tx.mix((sums[K:] - sums[:-K]) * back[: n - K + 1])
            # the smallest of SPREAD successive hashes, and of equal ones the last: place is kept below the hash
            key = (grams & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(grams), dtype=np.uint64))
            low_of, width = key, 1
            while width * 2 <= SPREAD:
                low_of = np.minimum(low_of[:-width], low_of[width:])
                width *= 2
            if width < SPREAD:
                low_of = np.minimum(low_of[: len(key) - SPREAD + 1], low_of[SPREAD - width :][: len(key) - SPREAD + 1])
            at = (np.uint64(0xFFFFFF) - (low_of & np.uint64(0xFFFFFF))).astype(np.int64)
            cut = np.flatnonzero(np.diff(at)) + 1
            first = np.concatenate([[0], cut])
            last = np.concatenate([cut, [len(at)]]) - 1
            ats.append(at[first] + low)
            firsts.append(first + low)
            lasts.append(last + low)
            # chosen for being small, so hashed once more: shards are ranges of equal size
            triggers.append(tx.mix(grams[at[first]] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24))
            size = (last - first + SIZE).astype(np.uint64)
            whole = (sums[last + SIZE] - sums[first]) * back[first]
            phrases.append(tx.mix(whole + size * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16))
        self.at, self.first, self.last, self.trigger, self.phrase = map(np.concatenate, (ats, firsts, lasts, triggers, phrases))


def parse_block(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All phrases of a block: document, first and last window start within it, trigger hash, phrase hash."""
    whole = np.frombuffer(data, np.uint8)
    docs, parts = [], []
    for i in range(len(offsets) - 1):
        if offsets[i + 1] - offsets[i] >= SIZE:
            parts.append(Parse(whole[offsets[i] : offsets[i + 1]]))
            docs.append(np.full(len(parts[-1].at), i))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return np.concatenate(docs), *(np.concatenate([getattr(p, k) for p in parts]) for k in ("first", "last", "trigger", "phrase"))


class Entries:
    """A block's phrases, each distinct one once with its smallest doc_id, by trigger and phrase hash."""

    def __init__(self, data: bytes, offsets: np.ndarray, ids: np.ndarray):
        self.doc, self.first, self.last, trigger, phrase = parse_block(data, offsets)
        self.id = ids[self.doc]
        own = self.id < NONE
        self.doc, self.first, self.last, self.id, trigger, phrase = (x[own] for x in (self.doc, self.first, self.last, self.id, trigger, phrase))
        order = np.lexsort((self.id, phrase, trigger))
        t, p = trigger[order], phrase[order]
        new = np.concatenate([np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.trigger, self.phrase = t[new], p[new]
        self.place = order[new]  # an occurrence in the smallest document
        self.least = self.id[self.place]

    def shards(self, n: int, some: np.ndarray | slice = slice(None)) -> list[tuple[int, int, int]]:
        """(shard, begin, end) of those of n shards that `some` of the entries fall in; triggers are in order and shards
        are ranges of them."""
        shard = (self.trigger[some] * np.uint64(n)) >> np.uint64(40)
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
        return list(zip(shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(shard)]))


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of documents: block, ids, nulls, sizes and data, written as a table bucketed by block."""
    spark = docs.sparkSession

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, flags, texts, size = [], [], [], 0

        def block():
            return pa.record_batch([pa.array([number]), pa.array([[x or 0 for x in ids]], pa.list_(pa.int64())), pa.array([[x is None for x in ids]], pa.list_(pa.bool_())),
                                    pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())], names=["block", "ids", "nulls", "sizes", "data"])

        for part in tx.steps(batches, "text"):
            for i, x in zip(part.column("id").to_pylist(), tx.blobs(part.column("text"))):
                if size and size + len(x) > BLOCK_BYTES:
                    yield block()
                    number, ids, flags, texts, size = number + 1, [], [], [], 0
                ids.append(i)
                texts.append(x)
                size += len(x)
        if ids:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    blocks = rows.mapInArrow(pack, "block long, ids array<long>, nulls array<boolean>, sizes array<long>, data binary")
    name, count = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(count, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  found now; its files, which are outside of the catalogue, stay
    spark.sql(f"DROP TABLE {name}")
    return out


def unpack(row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    ids = np.where(np.array(row["nulls"], bool), NONE, np.array(row["ids"], np.int64))
    return row["data"], np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]), ids


def rows_of(batches, columns=None):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in columns or batch.schema.names}


def by_block(replies: DataFrame, name: str) -> DataFrame:
    """One row for each block: its shards' replies as {shard: bytes}."""
    return replies.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("shard", "reply"))).alias(name))


def joined(row: dict, name: str, kind) -> np.ndarray:
    """The replies to a block's entries, in the order in which it sent them: by shard."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(reply, kind) for _, reply in sorted(row[name] or []))])


REPEAT, SHARED = 1, 2


def dictionary_replies(blocks: list[int], triggers: list[np.ndarray], phrases: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry: REPEAT if a smaller id has the phrase, SHARED if its trigger has another phrase of another id."""
    t, p, i = np.concatenate(triggers), np.concatenate(phrases), np.concatenate(ids)
    order = np.lexsort((i, p, t))
    t, p, i = t[order], p[order], i[order]
    new_t = np.concatenate([[True], t[1:] != t[:-1]])
    new_p = new_t | np.concatenate([[True], p[1:] != p[:-1]])
    group, trigger = np.cumsum(new_p) - 1, np.cumsum(new_t) - 1
    least = i[new_p]
    kinds = np.bincount(trigger[new_p])
    low, high = np.minimum.reduceat(least, np.flatnonzero(new_t[new_p])), np.maximum.reduceat(least, np.flatnonzero(new_t[new_p]))
    found = (i > least[group]) * REPEAT + ((kinds > 1) & (low < high))[trigger] * SHARED
    out = np.empty(len(order), np.uint8)
    out[order] = found
    return np.split(out, np.cumsum([len(x) for x in triggers])[:-1])


def suffix_replies(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each phrase a mask of its windows that a phrase of a smaller id holds. Sorts all SIZE-byte suffix prefixes."""
    ends = np.cumsum(sizes)
    windows = sizes - SIZE + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    index = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (ends - sizes)[owner] + index
    suffix = np.lib.stride_tricks.sliding_window_view(data, SIZE)[start].copy().view(f"V{SIZE}")[:, 0]
    rank = np.unique(suffix, return_inverse=True)[1]
    order = np.lexsort((ids[owner], rank))
    r = rank[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    least = ids[owner[order]][new][np.cumsum(new) - 1]
    repeat = np.empty(len(order), bool)
    repeat[order] = ids[owner[order]] > least
    mask = np.zeros(len(sizes), np.uint32)
    np.bitwise_or.at(mask, owner[repeat], np.uint32(1) << index[repeat].astype(np.uint32))
    return mask


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go) and kept (the bytes that stay); one row for each of `docs`."""
    blocks = packed(docs, key, text)
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def name_phrases(batches):
        for row in rows_of(batches):
            found = Entries(*unpack(row))
            for s, a, b in found.shards(shards):
                ids, which = np.unique(found.least[a:b], return_inverse=True)
                gaps = np.diff(found.trigger[a:b], prepend=np.uint64(0))
                yield pa.record_batch([pa.array([s]), pa.array([row["block"]]), pa.array([gaps.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()]),
                                       pa.array([found.phrase[a:b].view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()]),
                                       pa.array([ids.tobytes()]), pa.array([which.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, : 2 + 2 * (len(ids) > 1 << 16)].T.tobytes()])], names=["shard", "block", "triggers", "phrases", "ids", "which"])

    def wide(planes: bytes, width: int) -> np.ndarray:
        out = np.zeros((len(planes) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
        return out.view(np.uint64)[:, 0]

    def look_up(given: pa.Table) -> pa.Table:
        rows = given.to_pylist()
        ids = [np.frombuffer(x["ids"], np.int64) for x in rows]
        least = [i[wide(x["which"], 2 + 2 * (len(i) > 1 << 16)).astype(np.int64)] for i, x in zip(ids, rows)]
        replies = dictionary_replies([x["block"] for x in rows], [np.cumsum(wide(x["triggers"], 5)) for x in rows], [wide(x["phrases"], 6) for x in rows], least)
        return pa.table({"shard": given["shard"], "block": given["block"], "reply": pa.array([x.tobytes() for x in replies], pa.binary())})

    reply = "shard long, block long, reply binary"
    named = blocks.mapInArrow(name_phrases, "shard long, block long, triggers binary, phrases binary, ids binary, which binary")
    known = by_block(named.groupBy("shard").applyInArrow(look_up, reply), "known")
    with_known = blocks.join(known.hint("shuffle_hash"), "block", "left")

    def wanted(found: Entries, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Replies to the block's entries, and which of them go to the suffix array."""
        flags = joined(row, "known", np.uint8)
        return flags, np.flatnonzero(flags == SHARED)

    def send_phrases(batches):
        for row in rows_of(batches):
            data, offsets, ids = unpack(row)
            found = Entries(data, offsets, ids)
            _, ask = wanted(found, row)
            whole = np.frombuffer(data, np.uint8)
            for s, a, b in found.shards(shards, ask):
                own = ask[a:b]
                place = found.place[own]
                begin = offsets[found.doc[place]] + found.first[place]
                sizes = found.last[place] - found.first[place] + SIZE
                at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                part = tx.mix(found.trigger[own]) % np.uint64(PARTS)
                yield pa.record_batch([pa.array([s]), pa.array([row["block"]]), pa.array([whole[at].tobytes()], pa.binary()), pa.array([sizes.astype(np.uint8).tobytes()]), pa.array([part.astype(np.uint8).tobytes()]), pa.array([found.least[own].tobytes()])],
                                      names=["shard", "block", "data", "sizes", "parts", "ids"])

    def sort_suffixes(given: pa.Table) -> pa.Table:
        rows = given.to_pylist()
        data, sizes, parts = (np.frombuffer(b"".join(x[k] for x in rows), np.uint8) for k in ("data", "sizes", "parts"))
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(x["ids"] for x in rows), np.int64)
        masks = np.zeros(len(sizes), np.uint32)
        for k in range(PARTS):  # equal windows have one trigger, and so are in one part
            own = np.flatnonzero(parts == k)
            if len(own):
                n = sizes[own]
                at = np.repeat(ends[own] - np.cumsum(n), n) + np.arange(int(n.sum()))
                masks[own] = suffix_replies(data[at], n, ids[own])
        masks = np.split(masks, np.cumsum([len(x["sizes"]) for x in rows])[:-1])
        return pa.table({"shard": given["shard"], "block": given["block"], "reply": pa.array([x.tobytes() for x in masks], pa.binary())})

    sent = with_known.mapInArrow(send_phrases, "shard long, block long, data binary, sizes binary, parts binary, ids binary")
    sorted_ = by_block(sent.groupBy("shard").applyInArrow(sort_suffixes, reply), "sorted")
    with_both = with_known.join(sorted_.hint("shuffle_hash"), "block", "left")

    def cut(batches):
        for row in rows_of(batches):
            data, offsets, ids = unpack(row)
            found = Entries(data, offsets, ids)
            flags, ask = wanted(found, row)
            masks = np.zeros(len(flags), np.uint32)
            masks[ask] = joined(row, "sorted", np.uint32)
            # windows of an occurrence: all if a smaller document has the phrase, else those in the mask
            all_of = (flags[found.of] & REPEAT > 0) | (found.id > found.least[found.of])
            step = np.zeros(len(data) + 1, np.int32)
            begin = offsets[found.doc]
            np.add.at(step, (begin + found.first)[all_of], 1)
            np.add.at(step, (begin + found.last)[all_of] + SIZE, -1)
            some = np.flatnonzero(~all_of & (masks[found.of] > 0))
            for k in range(SPREAD):
                on = some[masks[found.of[some]] >> np.uint32(k) & np.uint32(1) > 0]
                np.add.at(step, (begin + found.first)[on] + k, 1)
                np.add.at(step, (begin + found.first)[on] + k + SIZE, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            out = []
            for i in range(len(ids)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                mark = np.concatenate([[False], gone[a:b], [False]])
                edges = np.flatnonzero(mark[1:] != mark[:-1])
                rest = data[a:b] if not len(edges) else np.frombuffer(data, np.uint8)[a:b][~gone[a:b]].tobytes()
                out.append({"doc_id": None if ids[i] == NONE else int(ids[i]), "n_bytes": b - a, "n_removed": b - a - len(rest), "n_spans": len(edges) // 2,
                            "kept_sha256": hashlib.sha256(rest).hexdigest(), "spans": edges.reshape(-1, 2).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]))

    return with_both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))
