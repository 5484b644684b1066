"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text's bytes; at each place its output links name the pieces that end there, and each of them
relaxes the best way to that place. For "unigram" models the best way has the largest sum of piece scores (of equal
sums, the one with the longer last piece). A "bpe" model's scores are merge priorities, whose sum says nothing; there a
way is extended by a piece only if the merges leave the two neighbours apart, which holds for one piece at each place
and gives the ids of the merges themselves, equal to the public library's (tests/llm).

Texts are cut where no piece can reach across: before spaces, around characters without a piece, which become byte
pieces (or the unknown id). Pieces of many short units are found side by side, one byte at a time; a unit of more than
SIDE_BY_SIDE bytes, as in texts without spaces, is walked alone, in time and memory that grow with its length. A bounded
memo keeps the pieces of frequent short units. Decoding joins the pieces' bytes; it returns the text but for U+2581, which
the format itself turns into a space.

Every text is read whole; a null text has null ids, an empty one has none. Each row gives one row, also a repeated one, and
equal texts have equal ids; an empty table gives no rows. Columns ids, n_tokens and round_trip of the input give way to
the new ones; others stay as they are.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import table

SPACE = "▁"
#: Text bytes whose words are held at a time.
STEP_BYTES = 1 << 19
#: Units kept in the memo; bytes of a unit that is searched side by side with others; units searched at once.
MEMO, SIDE_BY_SIDE, BLOCK = 100_000, 48, 8192
PAIRS = 1 << 20
#: Characters of the longest unit that stays in a memo.
LONGEST_KEPT = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str, mode: str = "bpe"):
        proc = sentencepiece.SentencePieceProcessor(model_file=path)
        n = proc.vocab_size()
        self.mode, self.unknown = mode, proc.unk_id()
        self.names = [proc.id_to_piece(i) for i in range(n)]
        special = [proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i) for i in range(n)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if proc.is_byte(i)}
        usable = [i for i in range(n) if not special[i] and not proc.is_byte(i)]
        self.id_of = {self.names[i]: i for i in usable}
        self.score = np.array([proc.get_score(i) for i in range(n)])
        self.bytes_of = [b"" if special[i] else bytes([int(x[3:5], 16)]) if proc.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)]
        self.piece_sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.piece_begin = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.prefix = proc.normalize("a") == SPACE + "a"
        if proc.normalize(" a  b\né ").removeprefix(SPACE * self.prefix) != " a  b\né ".replace(" ", SPACE):
            raise ValueError("only models whose normalisation keeps the text are supported")
        if any(SPACE in x.lstrip(SPACE) for x in self.id_of) or mode == "bpe" and any(x.startswith(SPACE * 2) and x.strip(SPACE) for x in self.id_of):
            raise ValueError("a piece reaches across a space")
        known = "".join(re.escape(x) for x in self.id_of if len(x) == 1 and x != SPACE)
        self.unit = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]")
        self.known = re.compile(f"[{known}{SPACE}]")
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.runs: dict[int, list[int]] = {}
        searched = usable
        if mode == "bpe":
            searched = self._rank([i for i in usable if self.names[i].strip(SPACE) or self.names[i] == SPACE])
            self.pair_key, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self._automaton(searched)

    def merge(self, symbols: list[str]) -> list[str]:
        """What the merges make of some symbols: best score first, then leftmost."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        parts: list[str | None] = list(symbols)
        queue: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.id_of.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, j, parts[i], parts[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if parts[i] != a or parts[j] != b or after[i] != j:
                continue
            parts[i], parts[j] = a + b, None
            self.last = (a, b)
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in parts if x is not None]

    def _rank(self, usable: list[int]) -> list[int]:
        """Orders pieces by merge (single characters first), with each one's last two parts; returns those that merges reach."""
        merged = sorted((i for i in usable if len(self.names[i]) > 1), key=lambda i: (-self.score[i], i))
        order = [i for i in usable if len(self.names[i]) == 1] + merged
        rank = {self.names[i]: r for r, i in enumerate(order)}
        self.rank_id, self.id_rank = np.array(order), np.full(len(self.names), -1, np.int64)
        self.id_rank[order] = np.arange(len(order))
        self.left = np.arange(len(order))
        self.right = self.left.copy()
        reached = [i for i in usable if len(self.names[i]) == 1]
        for i in merged:
            if len(self.merge(list(self.names[i]))) == 1:
                reached.append(i)
                self.left[rank[self.names[i]]], self.right[rank[self.names[i]]] = rank[self.last[0]], rank[self.last[1]]
        joins = {}
        for i in merged:
            x = self.names[i]
            for k in range(1, len(x)):
                if x[:k] in rank and x[k:] in rank:
                    joins[rank[x[:k]] * len(order) + rank[x[k:]]] = rank[x]
        self.join_key = np.array(sorted(joins), np.int64)
        self.join_rank = np.array([joins[k] for k in self.join_key.tolist()], np.int64)
        return reached

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave neighbours a, b (ranks) apart: undoes the later of both until no merge across remains."""
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 40)
        while len(at):
            key = a * len(self.rank_id) + b
            place = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            crossed = (self.join_key[place] == key) & (self.join_rank[place] < limit)
            a, b, at = a[~crossed], b[~crossed], at[~crossed]
            left_later = a > b
            new_a, new_b = self.right[a], self.left[b]
            # the one that cannot be undone stays, and the other is undone instead
            undo_left = np.where(left_later, new_a != a, new_b == b)
            stuck = (new_a == a) & (new_b == b)
            out[at[stuck]] = True
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, new_a, a), np.where(undo_left, b, new_b)
            a, b, at, limit = a[~stuck], b[~stuck], at[~stuck], limit[~stuck]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.rank_id) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_fits[slot]
        if len(new):
            out[new] = self._fits(a[new], b[new])
            self.pair_key[slot[new]] = key[new]
            # where two new pairs share a slot, the later one has it
            self.pair_fits[slot[new]] = out[new]
        return out

    def _automaton(self, usable: list[int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        for i in usable:
            word = self.names[i].encode()
            for k in range(1, len(word) + 1):
                nodes.setdefault(word[:k], len(nodes))
        n = len(nodes)
        self.go = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece, self.size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        up, byte, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for word, node in nodes.items():
            if word:
                up[node], byte[node], depth[node] = nodes[word[:-1]], word[-1], len(word)
        for i in usable:
            node = nodes[self.names[i].encode()]
            self.piece[node] = self.id_rank[i] if self.mode == "bpe" else i
            self.size[node] = depth[node]
        fail, self.output = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # a node's row is its fail node's, then its own children; fail nodes are shallower
        for d in range(int(depth.max()) + 1):
            own = np.flatnonzero(depth == d)
            if d:
                fail[own] = self.go[fail[up[own]], byte[own]] if d > 1 else 0
                self.go[own] = self.go[fail[own]]
                self.output[own] = np.where(self.piece[fail[own]] >= 0, fail[own], self.output[fail[own]])
            below = np.flatnonzero(depth == d + 1)
            for_row = up[below]
            self.go[for_row, byte[below]] = below
        self.first = np.where(self.piece >= 0, np.arange(n), self.output)
        # the same as flat sequences, which are read faster one by one
        self.steps = (memoryview(np.ascontiguousarray(self.go).reshape(-1)), *(x.tolist() for x in (self.first, self.output, self.piece, self.size)), self.score.tolist())
        self.pair_memo: dict[int, bool] = {}

    def search(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as int32 bytes. The units' characters all have pieces."""
        order = np.argsort(-np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
        out = np.empty(len(units), object)
        for k in range(0, len(order), BLOCK):
            own = order[k : k + BLOCK]
            out[own] = self._search([units[i] for i in own.tolist()])
        return out.tolist()

    def _search(self, units: list[bytes]) -> list[bytes]:
        """The same for units from the longest to the shortest."""
        n, sizes = len(units), np.array([len(x) for x in units])
        longest = int(sizes[0])
        grid = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in units), np.uint8).reshape(n, longest)
        last = np.full((n, longest + 1), -1, np.int64)
        begin = np.zeros((n, longest + 1), np.int64)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        state = np.zeros(n, np.int64)
        alive = np.searchsorted(-sizes, -np.arange(longest + 1), "right")
        for j in range(1, longest + 1):
            state = self.go[state[: alive[j]], grid[: alive[j], j - 1]].astype(np.int64)
            row, node = np.arange(len(state)), self.first[state]
            while True:
                ends = node > 0
                if self.mode == "bpe":
                    ends &= last[row, j] < 0
                row, node = row[ends], node[ends]
                if not len(row):
                    break
                piece, start = self.piece[node], j - self.size[node]
                if self.mode == "bpe":
                    before = last[row, start]
                    good = start == 0
                    ask = np.flatnonzero(before >= 0)
                    good[ask] = self.fits(before[ask], piece[ask])
                else:
                    total = best[row, start] + self.score[piece]
                    good = total > best[row, j]
                    best[row[good], j] = total[good]
                last[row[good], j], begin[row[good], j] = piece[good], start[good]
                node = self.output[node]
        row, place, found = np.arange(n), sizes.copy(), []
        while len(row):
            found.append((row, last[row, place]))
            place = begin[row, place]
            row, place = row[place > 0], place[place > 0]
        rows = np.concatenate([r for r, _ in found[::-1]])
        ids = np.concatenate([p for _, p in found[::-1]])
        by = np.argsort(rows, kind="stable")
        ids = ids[by]
        ids = (self.rank_id[ids] if self.mode == "bpe" else ids).astype(np.int32).tobytes()
        ends = 4 * np.cumsum(np.bincount(rows, minlength=n))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _walk(self, unit: bytes) -> bytes:
        """The ids of one long unit: the same search, place by place, with the bytes' steps taken from the automaton's rows."""
        go, first, output, piece, size, score = self.steps
        n, bpe = len(unit), self.mode == "bpe"
        last, begin = array("q", [-1]) * (n + 1), array("q", [0]) * (n + 1)
        best = None if bpe else array("d", [0.0]) + array("d", [-np.inf]) * n
        fits = self.pair_memo
        state = 0
        for j, byte in enumerate(unit, 1):
            state = go[state << 8 | byte]
            node = first[state]
            while node > 0:
                start, own = j - size[node], piece[node]
                if bpe:
                    before = last[start]
                    if start == 0:
                        good = True
                    elif before < 0:
                        good = False
                    else:
                        pair = before << 32 | own
                        good = fits.get(pair)
                        if good is None:
                            if len(fits) >= PAIRS:
                                fits.clear()
                            good = fits[pair] = bool(self._fits(np.array([before]), np.array([own]))[0])
                    if good:
                        last[j], begin[j] = own, start
                        break
                elif (total := best[start] + score[own]) > best[j]:
                    best[j], last[j], begin[j] = total, own, start
                node = output[node]
        found, place = [], n
        while place:
            found.append(last[place])
            place = begin[place]
        ids = np.array(found[::-1], np.int64)
        return (self.rank_id[ids] if bpe else ids).astype(np.int32).tobytes()

    def run(self, n: int) -> list[int]:
        """The ids of n spaces that no other piece takes."""
        if n not in self.runs:
            self.runs[n] = [self.id_of[x] for x in self.merge([SPACE] * n)]
        return self.runs[n]

    def learn(self, units: set[str], memo: dict[str, bytes]) -> None:
        """Adds the units to `memo`."""
        # one space and a word, as most units are, or a word at a text's begin
        whole = [x for x in units if x[0] == SPACE and x[1:2] not in ("", SPACE)]
        words = [x.encode() for x in whole]
        memo.update(zip(whole, self.search(words)) if not words or max(map(len, words)) <= SIDE_BY_SIDE else self._apart(whole, words))
        odd: dict[str, str] = {}
        for x in units.difference(whole):
            if self.mode == "bpe" and not x.strip(SPACE):
                memo[x] = np.array(self.run(len(x)), np.int32).tobytes()
            elif not self.known.match(x):
                ids = [self.byte_ids.get(b, self.unknown) for b in x.encode()]
                memo[x] = np.array(ids if self.byte_ids else [self.unknown], np.int32).tobytes()
            else:
                odd[x] = SPACE * (x[0] == SPACE) + x.lstrip(SPACE) if self.mode == "bpe" else x
        for x, ids in self._apart(list(odd), [v.encode() for v in odd.values()]):
            spaces = len(x) - len(x.lstrip(SPACE))
            if self.mode == "bpe" and spaces > 1:
                # spaces before the first word's own; a bare one joins them
                bare = int.from_bytes(ids[:4], "little") == self.id_of[SPACE]
                ids = np.array(self.run(spaces if bare else spaces - 1), np.int32).tobytes() + ids[4 * bare :]
            memo[x] = ids

    def _apart(self, names: list[str], units: list[bytes]) -> list[tuple[str, bytes]]:
        """Walks long units one by one, so that they don't widen the grid of the others."""
        short = [i for i, x in enumerate(units) if len(x) <= SIDE_BY_SIDE]
        long = [i for i, x in enumerate(units) if len(x) > SIDE_BY_SIDE]
        found = list(zip((names[i] for i in short), self.search([units[i] for i in short])))
        return found + [(names[i], self._walk(units[i])) for i in long]

    def _known(self, memo: dict[str, bytes], every: set[str], learn) -> None:
        new = every.difference(memo)
        if new and len(memo) + len(new) > MEMO:
            kept = {x: memo[x] for x in every.difference(new)}
            memo.clear()
            memo.update(kept)
        if new:
            learn(new, memo)

    def _learn_words(self, words: set[str], memo: dict[str, bytes]) -> None:
        """Adds words that follow one space each to `memo`; those with characters without a piece are cut there."""
        parts = {x: self.unit.findall(SPACE + x) for x in words}
        found: dict[str, bytes] = {}  # not kept, so that no word is held with and without its space
        self.learn(set(chain.from_iterable(parts.values())), found)
        memo.update((x, found[own[0]] if len(own) == 1 else b"".join(map(found.__getitem__, own))) for x, own in parts.items())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        simple = [self.prefix and x != "" and x[0] != " " and x[-1] != " " and "  " not in x and SPACE not in x for x in texts]
        words = [x.split(" ") if easy else [] for x, easy in zip(texts, simple)]
        every = set(chain.from_iterable(words))
        self._known(self.words, every, self._learn_words)
        units = [self.unit.findall(SPACE * self.prefix + x.replace(" ", SPACE)) if x and not easy else [] for x, easy in zip(texts, simple)]
        rest = set(chain.from_iterable(units))
        self._known(self.memo, rest, self.learn)
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, w) if easy else map(self.memo.__getitem__, u)), np.int32) for easy, w, u in zip(simple, words, units)]
        # what is too long to be met again would only fill the memos
        for x in every | rest:
            if len(x) > LONGEST_KEPT:
                self.words.pop(x, None)
                self.memo.pop(x, None)
        return out

    def forget(self) -> None:
        """Empties the memos."""
        self.memo.clear()
        self.words.clear()
        self.pair_memo.clear()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces end to end, before the added space goes."""
        sizes = self.piece_sizes[ids]
        begin = self.piece_begin[ids] - (np.cumsum(sizes) - sizes)
        return self.piece_bytes[np.repeat(begin, sizes) + np.arange(int(sizes.sum()))]

    def round_trips(self, texts: list[str], found: list[np.ndarray]) -> list[bool]:
        """Whether each text's ids decode to it."""
        plain = [b" " * (self.prefix and x != "") + x.encode() for x in texts]
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        decoded = self.decode_bytes(ids)
        if decoded.tobytes() == b"".join(plain) and all(len(x) > 0 or not len(y) for x, y in zip(found, plain)):
            sizes = np.concatenate([[0], np.cumsum(self.piece_sizes[ids])])[np.concatenate([[0], np.cumsum([len(x) for x in found])])]
            if (np.diff(sizes) == [len(x) for x in plain]).all():
                return [True] * len(texts)
        return [self.decode(y.tolist()) == x for x, y in zip(texts, found)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def loaded(path: str, mode: str) -> Pieces:
    return Pieces(path, mode)


def encode_texts(docs: DataFrame, text: str = "text", model: str | None = None, mode: str = "bpe", carry: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, `carry` or all) with ids, n_tokens and round_trip: whether decoding gives the text again."""
    path = model or default_model()
    docs = docs.drop("ids", "n_tokens", "round_trip")
    names = docs.columns if carry is None else carry

    def encode(batches):
        pieces = loaded(path, mode)
        for part in tx.steps(batches, text, STEP_BYTES):
            given = part.column(text).to_pylist()
            found = pieces.encode([x or "" for x in given])
            same = [None if x is None else y for x, y in zip(given, pieces.round_trips([x or "" for x in given], found))]
            sizes = np.array([0 if x is None else len(ids) for x, ids in zip(given, found)], np.int64)
            null = np.array([x is None for x in given])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])), mask=pa.array(null))
            yield pa.record_batch([*(part.column(k) for k in names), ids, pa.array(sizes, mask=null), pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])
        pieces.forget()  # the worker may do other work next

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(names).schema)
    return docs.mapInArrow(encode, fields + "ids array<int>, n_tokens long, round_trip boolean")


def decode_ids(docs: DataFrame, ids: str = "ids", into: str = "text", model: str | None = None) -> DataFrame:
    """`docs` with the text of its ids in column `into`; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def decode(values):
        pieces = loaded(path, "bpe")
        return values.map(lambda x: None if x is None else pieces.decode(list(x)))

    return docs.withColumn(into, decode(F.col(ids)))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, carry=["doc_id"])
