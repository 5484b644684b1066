"""Licence scans: counted base phrases, and matching statistics against a generalised suffix automaton.

A text is lower-cased in A-Z and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (letters, digits and all beyond
ASCII). The templates' words form one generalised suffix automaton. Words stream through it and give at each place the
longest match that ends there with each template, found through suffix links also where another template's is longer.
Matches of MIN_MATCH words or more that the next word doesn't extend, at all their places in the template, are chained in
text and template order, with gaps of MAX_GAP words at most. A chain covers a template span. It counts if it covers
COVER of the template or LONG words, holds the template's telling words in one match, and no word that denies stands
among the DENIED words before it. Of chains that overlap by more than half of the shorter one, the one that covers most
words counts (of equal ones that of larger share, then of smaller label). score is the largest covered share of a chain
that counts, 0 to 1.

Only runs of MIN_MATCH words that templates use are streamed; shorter ones hold no match. Null and empty texts have no
word and score 0. Rows with null or repeated ids each give a row; an empty table gives none. Other columns of the input are
left out, so none can clash. The model is a few hundred kilobytes, whatever the input.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import table
from strandlens.llm.templates import DENIALS, PHRASES, TEMPLATES

MIN_MATCH, MAX_GAP, COVER, LONG, DENIED = 3, 8, 0.75, 30, 3
#: Lower-cases A-Z and turns all other ASCII but a-z and 0-9 into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences. `ends` gives for each state and sequence all places where its words end; `reach` for
    each state and sequence the state of the longest suffix of its words that the sequence has too."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        visits: list[tuple[int, int, int]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                visits.append((last, k, at + 1))
        self.ends: list[dict[int, set[int]]] = [{} for _ in self.next]
        for state, k, end in visits:
            while state > 0:
                self.ends[state].setdefault(k, set()).add(end)
                state = self.link[state]
        self.reach: list[dict[int, int]] = [{} for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.reach[state] = self.reach[self.link[state]] | dict.fromkeys(self.ends[state], state)

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for p's longest string and `word`, apart from q if q stands for longer strings."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(sequence, end, length, state) of each sequence's longest matches of `least` words or more that the next word
        doesn't extend."""
        out, state, length = [], 0, 0
        before: dict[int, tuple[int, int]] = {}
        for at in range(len(words) + 1):
            now: dict[int, tuple[int, int]] = {}
            if at < len(words):
                word = words[at]
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                after = self.next[state].get(word)
                state, length = (0, 0) if after is None else (after, length + 1)
                while state > 0 and self.length[self.link[state]] >= length:
                    state = self.link[state]
                if length >= least:
                    for k, s in self.reach[state].items():
                        n = length if s == state else self.length[s]
                        if n >= least:
                            now[k] = (n, s)
            for k, (n, s) in before.items():
                if k not in now or now[k][0] <= n:
                    out.append((k, at, n, s))
            before = now
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [k for k, _, _ in templates]
        texts = [words_of(x.encode()) for _, _, x in templates]
        self.phrases = [(words_of(x.encode()), k) for x, k in phrases.items()]
        self.denials = {x.encode() for x in DENIALS}
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*texts, *(p for p, _ in self.phrases)] for w in t))}
        self.sizes = [len(t) for t in texts]
        self.telling = []
        for (_, must, _), own in zip(templates, texts):
            words = words_of(must.encode())
            places = [(i, i + len(words)) for i in range(len(own)) if own[i : i + len(words)] == words]
            if not places:
                raise ValueError(f"a template has no {must!r}")
            self.telling.append(places)
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in t] for t in texts])

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
        """(template, first word, end, words covered, whether a match holds telling words) of the best chain that ends in
        each template's matches, gaps bounded."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, end, length, state in found:
            by.setdefault(k, []).extend((end, length, at) for at in sorted(self.automaton.ends[state][k]))
        out = []
        for k, own in by.items():
            best: list[tuple[int, int, bool]] = []  # words covered, first word, telling
            used = set()
            for i, (end, length, at) in enumerate(own):
                tells = any(at - length <= a and b <= at for a, b in self.telling[k])
                score, first, told, before = length, end - length, tells, None
                for j in range(i - 1, -1, -1):
                    e, _, a = own[j]
                    if end - length - e > MAX_GAP:
                        break
                    # words that overlap the one before count once
                    new = min(length, end - e, at - a)
                    if new > 0 and best[j][0] + new > score:
                        score, first, told, before = best[j][0] + new, best[j][1], tells or best[j][2], j
                best.append((score, first, told))
                used.add(before)
            out += [(k, best[i][1], own[i][0], best[i][0], best[i][2]) for i in range(len(own)) if i not in used]
        return out

    def spans(self, found: list[tuple[int, int, int, int]], words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """The chains that count, in text order: label, first word, end, words covered, share of the template."""
        good = []
        for k, first, last, covered, told in self.chains(found):
            share = min(1.0, covered / self.sizes[k])
            if told and (share >= COVER or covered >= LONG) and self.denials.isdisjoint(words[max(0, first - DENIED) : first]):
                good.append((self.labels[k], first, last, covered, share))
        good.sort(key=lambda x: (-x[3], -x[4], x))
        out: list[tuple[str, int, int, int, float]] = []
        for x in good:
            if all(2 * (min(x[2], y[2]) - max(x[1], y[1])) <= min(x[2] - x[1], y[2] - y[1]) for y in out):
                out.append(x)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, texts: list[bytes]) -> list[dict]:
        """For each text n_words, places of base phrases, spans and score."""
        flat: list[bytes] = []
        bounds = [0]
        for text in texts:
            flat += words_of(text)
            bounds.append(len(flat))
        ids = np.fromiter(map(self.vocabulary.get, flat, repeat(-1)), np.int32, len(flat))
        limits = np.array(bounds)
        out = [{"n_words": int(n), "places": [], "spans": [], "score": 0.0} for n in np.diff(limits)]
        for words, label in self.phrases:
            hit = np.ones(max(0, len(ids) - len(words) + 1), bool)
            for k, w in enumerate(words):
                hit &= ids[k : len(ids) - len(words) + 1 + k] == self.vocabulary[w]
            for at in np.flatnonzero(hit):
                doc = int(np.searchsorted(limits, at, "right")) - 1
                if at + len(words) <= limits[doc + 1]:
                    out[doc]["places"].append((int(at - limits[doc]), label))
        known = ids >= 0
        cut = np.zeros(len(ids) + 1, bool)
        cut[limits] = True
        start = np.flatnonzero(known & (cut[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (cut[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        found: dict[int, list] = {}
        for i in np.flatnonzero(end - start >= MIN_MATCH):
            a, b = int(start[i]), int(end[i])
            if hits := self.automaton.matches(ids[a:b].tolist(), MIN_MATCH):
                doc = int(np.searchsorted(limits, a, "right")) - 1
                found.setdefault(doc, []).extend((k, e + a - int(limits[doc]), n, s) for k, e, n, s in hits)
        for doc, hits in found.items():
            out[doc]["spans"] = self.spans(hits, flat[bounds[doc] : bounds[doc + 1]])
            out[doc]["score"] = max((x[4] for x in out[doc]["spans"]), default=0.0)
        return out


SPAN = "struct<label: string, first_word: bigint, end_word: bigint, covered: bigint, share: double>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans, one row for each of `docs`."""

    def scan(batches):
        scanner = Scanner()
        for part in tx.steps(batches, "text"):
            rows = scanner.scan(tx.blobs(part.column("text")))
            places = [sorted(x["places"]) for x in rows]
            base = [sorted({k for _, k in p}) for p in places]
            yield pa.record_batch([
                part.column("doc_id"), pa.array([x["n_words"] for x in rows], pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                pa.array([p[0][0] if p else None for p in places], pa.int64()), pa.array([p[-1][0] if p else None for p in places], pa.int64()),
                pa.array([",".join(b) for b in base]), pa.array([",".join(sorted({*b, *(s[0] for s in x["spans"])})) for b, x in zip(base, rows)]),
                pa.array([x["score"] for x in rows], pa.float64()),
                pa.array([[dict(zip(("label", "first_word", "end_word", "covered", "share"), s)) for s in x["spans"]] for x in rows],
                         pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))),
            ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    part = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = part.schema["doc_id"].dataType.simpleString()
    return part.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
