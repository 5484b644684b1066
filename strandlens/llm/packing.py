"""Packing: order-preserving dynamic programming cuts the stream of documents' tokens into sequences.

Each text is encoded and closed by the id END; the texts of a partition, in its order, are one stream. A sequence is a window
of the stream of at most `length` tokens. Windows are cut at ends of documents (free), at ends of sentences (SENTENCE
tokens of penalty; the last one of each NEAR tokens) and, where neither comes within GAP tokens, after each GAP (ANYWHERE). The cost of a plan is its padding,
its penalties and START for each sequence; a sequence is padded to `length` unless its size is a power of two.
With best(j) for the cheapest plan that cuts at candidate j, and places p:

    best(j) = penalty(j) + START + min( length - p(j) + min over i in window of best(i) + p(i),  best(i) where p(j) - p(i) is a power of two )

The window's minimum comes from a monotone queue, so that each candidate enters and leaves once. A stream is planned
BLOCK tokens at a time; the last sequence of a block goes on into the next one, and the last of a stream is cut into powers
of two where that costs less than its padding. Memory is that of a block, or of one longer text.

Order: that of the rows as they are read. Partitions are streams of their own, so nothing is shuffled; a lost task
is made again from its rows and gives the same sequences, numbered by partition. Null texts count as empty and have END
alone; null keys stay null; repeated rows are packed each; other columns are left out; an empty table has no pieces. Ties
go to the longer sequence.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import table

LENGTH, END = 4096, 2
#: Penalties in tokens: of a sequence, of a cut at a sentence's end, and of one elsewhere. Tokens without a place to cut at most,
#: and tokens for which one sentence's end is enough.
START, SENTENCE, ANYWHERE, GAP, NEAR = 16, 16, 64, 256, 16
#: Tokens that are planned at a time; words, and cuts of words, that the encoder keeps.
BLOCK, MEMO, PARTS = 1 << 20, 1 << 19, 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Table:
    """Id lists by key: the ids of number i are ids[at[i]:at[i + 1]]."""

    def __init__(self, key, ids: list[int]):
        self.number, self.ids, self.at = {key: 0}, np.array(ids, np.int32), np.array([0, len(ids)], np.int64)

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The keys' numbers, -1 of those that aren't there, and the places of these."""
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        return number, np.flatnonzero(number < 0)

    def get(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys of these numbers end to end, and where each key's end."""
        begin = self.at[number]
        sizes = self.at[number + 1] - begin
        stop = np.cumsum(sizes)
        return self.ids[np.repeat(begin - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)], stop


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own. It never joins what ASCII white space parts, so words are encoded
    once; a new word of plain letters and signs is cut as the tokenizer cuts it, and only cuts that are new too go to the library."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.library = Tokenizer.from_file(path)
        #: The same model for cuts of plain words, which need no normal form and no cutting any more.
        self.joiner = Tokenizer(self.library.model)
        self.joiner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(max(self.library.get_vocab().values()) + 1, bool)  # ids that end a cut
        self.ends = np.zeros(len(self.closes), bool)  # those that end a sentence
        for piece, number in self.library.get_vocab().items():
            self.closes[number] = piece.endswith("</w>")
            self.ends[number] = self.closes[number] and piece.removesuffix("</w>").rstrip("\"')]")[-1:] in (".", "!", "?")
        #: Words that lower-casing and normal forms treat letter by letter, and that hold no special token; the cuts of such words.
        self.plain = regex.compile(r"(?!.*<\|)[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
        self.cuts = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        # white space alone is no word: in words it stands for a text's end, in cuts for a word's
        self.words, self.parts = Table(b"\n", [END]), Table("\n", [])

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)

    def _learn(self, new: list[bytes]) -> None:
        given = b"\n".join(new).decode("utf-8", "replace").split("\n")
        odd = [i for i, x in enumerate(given) if not (x.isascii() and x.isprintable() and "<|" not in x or self.plain(x))]
        if odd:
            self.words.add([new[i] for i in odd], *self._by_library([given[i] for i in odd]))
        left = set(odd)
        plain = [i for i in range(len(new)) if i not in left] if odd else range(len(new))
        parts = self.cuts("".join([given[i] + "\n" for i in plain]).lower())
        number, missing = self.parts.find(parts)
        if len(missing):
            fresh = list(dict.fromkeys([parts[i] for i in missing.tolist()]))
            ids = np.array(self.joiner.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, np.int64)
            self.parts.add(fresh, ids, np.diff(np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])))
            number[missing] = self.parts.find([parts[i] for i in missing.tolist()])[0]
        ids, stop = self.parts.get(number)
        self.words.add([new[i] for i in plain], ids, np.diff(np.concatenate([[0], stop[number == 0]])))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END, end to end, and the number of each text's."""
        if len(self.words.number) > MEMO:
            self.words = Table(b"\n", [END])
        if len(self.parts.number) > PARTS:
            self.parts = Table("\n", [])
        words: list[bytes] = []
        for text in texts:
            words += text.split()
            words.append(b"\n")
        number, missing = self.words.find(words)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            number[missing] = self.words.find(new)[0]
        ids, stop = self.words.get(number)
        return ids, np.diff(np.concatenate([[0], stop[number == 0]]))


@cache
def loaded(path: str) -> Encoder:
    return Encoder(path)


def candidates(stops: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream where it may be cut, from 0 to its end, and their penalties. `stops`: where its documents end."""
    sentences = sentences[np.append(np.diff(sentences // NEAR) > 0, True)[: len(sentences)]]
    place = np.union1d(np.union1d(stops, sentences), [0])
    room = np.diff(place)
    more = (room - 1) // GAP
    wide = np.flatnonzero(more > 0)
    if len(wide):
        n = more[wide]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        place = np.union1d(place, np.repeat(place[wide], n) + GAP * within)
    penalty = np.full(len(place), ANYWHERE)
    penalty[np.isin(place, sentences)] = SENTENCE
    penalty[np.isin(place, stops)] = 0
    return place, penalty


def windows(place: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts of the cheapest plan, from place[0] to place[-1], as places."""
    n = len(place)
    size, exact = 1, []
    while size <= length:
        at = np.searchsorted(place, place - size)
        hit = np.flatnonzero((place - size >= place[0]) & (place[np.minimum(at, n - 1)] == place - size))
        exact.append(np.stack([hit, at[hit]]))
        size *= 2
    exact = np.concatenate(exact[::-1], axis=1)
    exact = exact[:, np.argsort(exact[0], kind="stable")]
    first = np.searchsorted(exact[0], np.arange(n + 1)).tolist()
    before, places, fees = exact[1].tolist(), place.tolist(), penalty.tolist()
    best, back, queue = [0] * n, [0] * n, deque()
    for j in range(1, n):
        p = places[j]
        value = best[j - 1] + places[j - 1]
        while queue and queue[-1][0] > value:  # an earlier one of equal value makes the longer sequence
            queue.pop()
        queue.append((value, j - 1))
        while places[queue[0][1]] < p - length:
            queue.popleft()
        least, chosen = queue[0][0] + length - p, queue[0][1]
        for i in before[first[j] : first[j + 1]]:
            if best[i] < least or best[i] == least and i < chosen:
                least, chosen = best[i], i
        best[j], back[j] = least + fees[j] + START, chosen
    cuts, j = [places[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(places[j])
    return cuts[::-1]


def closed(cuts: list[int], length: int = LENGTH) -> list[int]:
    """`cuts` with the last sequence cut into powers of two, if that costs less than its padding."""
    if len(cuts) < 2:
        return cuts
    rest = cuts[-1] - cuts[-2]
    if (rest.bit_count() - 1) * (ANYWHERE + START) >= length - rest:
        return cuts
    out, at = cuts[:-1], cuts[-2]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


class Stream:
    """Documents of one partition that aren't packed yet."""

    def __init__(self, base: int, length: int):
        self.sequence, self.length = base, length
        self.keys: list = []
        self.ids, self.sizes, self.done = np.zeros(0, np.int32), np.zeros(0, np.int64), 0  # done: tokens of the first document that are packed

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.keys += keys
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def pack(self, ends: np.ndarray, last: bool):
        """The pieces of all sequences that are settled, as an Arrow batch."""
        starts = np.cumsum(self.sizes) - self.sizes - self.done
        place, penalty = candidates(starts + self.sizes, np.flatnonzero(ends[self.ids]) + 1)
        cuts = windows(place, penalty, self.length)
        cuts = np.array(closed(cuts, self.length) if last else cuts[:-1])
        stop = int(cuts[-1])
        begin = np.union1d(np.maximum(starts, 0), cuts)
        begin = begin[begin < stop]
        sizes = np.diff(np.append(begin, stop))
        doc = np.searchsorted(starts, begin, "right") - 1
        own = np.searchsorted(cuts, begin, "right") - 1
        out = {
            "doc_id": pa.array([self.keys[i] for i in doc.tolist()], pa.int64()), "start": pa.array(begin - starts[doc]), "length": pa.array(sizes),
            "ids": pa.ListArray.from_arrays(pa.array(np.append(begin, stop).astype(np.int32)), pa.array(self.ids[:stop])),
            "doc_tokens": pa.array(self.sizes[doc]), "sequence_id": pa.array(self.sequence + own), "offset": pa.array(begin - cuts[own]),
        }
        self.sequence += len(cuts) - 1
        left = int(np.searchsorted(starts + self.sizes, stop, "right"))
        self.done = stop - int(starts[left]) if left < len(starts) else 0
        self.keys, self.sizes, self.ids = self.keys[left:], self.sizes[left:], self.ids[stop:]
        return pa.RecordBatch.from_pydict(out)


PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece: ids are tokens start .. start + length of its document, at `offset` of the sequence `sequence_id`."""
    path = model or default_model()

    def run(batches):
        encoder = loaded(path)
        stream = Stream(TaskContext.get().partitionId() << 40, length)
        for part in tx.steps(batches, "__text"):
            stream.add(part.column("__key").to_pylist(), *encoder.encode(tx.blobs(part.column("__text"))))
            if len(stream.ids) >= BLOCK:
                yield stream.pack(encoder.ends, False)
        if stream.keys:
            yield stream.pack(encoder.ends, True)

    return docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(run, PIECES)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """`pieces` with ids_crc32, the CRC of a piece's ids as little-endian words, in place of its ids."""
    names = [c for c in pieces.columns if c != "ids"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy().tolist()
            view = memoryview(values).cast("B") if len(values) else b""
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pieces.select(names).schema)
    return pieces.mapInArrow(run, fields + "ids_crc32 long")


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, and the tokens that padding adds."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return each.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(F.lit(length) - F.col("n"))).alias("padding"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return with_checksum(pack(table(spark, sf_dir, "documents"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
