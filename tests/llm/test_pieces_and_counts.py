import numpy as np
import pytest
import sentencepiece

from strandlens.llm import pieces, token_counts
from tests.llm.fixtures import awkward, documents, prose

ODD = ["  a", "   é", " \n\n  x", "漢字 中文 한국어 😀 \t tab", "x" * 5000, " " * 300, "a  ", "   b", "   Ж", "the  of   and", "▁ literal"]


def unigram_copy(path, into):
    """The same pieces and scores in a model that the library searches by score."""
    data = bytearray(open(path, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    def fields(at, end):
        while at < end:
            key, at = varint(at)
            start = at
            if key & 7 == 0:
                at = varint(at)[1]
            elif key & 7 == 2:
                size, start = varint(at)
                at = start + size
            else:
                at += 8 if key & 7 == 1 else 4
            yield key >> 3, start, at

    for field, start, end in fields(0, len(data)):
        if field == 2:
            for inner, at, _ in fields(start, end):
                if inner == 3:
                    data[at] = 1
    into.write_bytes(bytes(data))
    return str(into)


def test_merges_agree_with_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = pieces.Pieces(pieces.default_model())
    texts = ODD + [x or "" for x in awkward()] + [prose(i, 80) for i in range(20)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text)
    small = pieces.Pieces(pieces.default_model())
    small_memo, pieces.MEMO = pieces.MEMO, 50
    try:
        assert [x.tolist() for x in small.encode(texts)] == library.encode(texts)
    finally:
        pieces.MEMO = small_memo


def test_words_are_held_once_and_those_in_use_stay(monkeypatch):
    own = pieces.Pieces(pieces.default_model())
    texts = [prose(i, 80) for i in range(20)]
    words = {w for x in texts for w in x.split(" ")}
    own.encode(texts)
    assert set(own.words) == words and not own.memo and own.go.itemsize == 2
    asked, learn = [], own._learn_words
    monkeypatch.setattr(pieces, "MEMO", len(words) + 1)
    monkeypatch.setattr(own, "_learn_words", lambda *given: (asked.append(set(given[0])), learn(*given)))
    own.encode([texts[0] + " unmet unmet2"])
    assert asked == [{"unmet", "unmet2"}] and set(own.words) == {*texts[0].split(" "), "unmet", "unmet2"}


def test_long_units_take_time_in_proportion():
    import time

    own, library = pieces.Pieces(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for unit in (prose(5, 60).replace(" ", ""), "漢字中文" * 40, "abc" * 300 + "é" + "zz" * 80):
        assert own.encode([unit])[0].tolist() == library.encode(unit)
    for text in ("".join(prose(k, 40).replace(" ", "") for k in range(2500)), "漢字中文的是" * 20_000):
        began = time.process_time()
        ids = own.encode([text])[0]
        assert time.process_time() - began < 25 and own.decode(ids.tolist()) == text


def test_long_units_by_score(tmp_path):
    own = pieces.Pieces(unigram_copy(pieces.default_model(), tmp_path / "unigram.model"), "unigram")
    text = prose(5, 30).replace(" ", "")
    assert sum(own.score[i] for i in own.encode([text])[0]) == pytest.approx(best_total(own, "▁" + text))


def test_scores_agree_with_the_library(tmp_path):
    path = unigram_copy(pieces.default_model(), tmp_path / "unigram.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.Pieces(path, "unigram")
    texts = [prose(i, 60) for i in range(20)] + ["naïve café", "Straße und Wörter"]
    total = lambda ids: sum(library.get_score(int(i)) for i in ids)
    for text, ids in zip(texts, own.encode(texts)):
        assert "".join(own.names[i] for i in ids) == "▁" + text.replace(" ", "▁")
        assert total(ids) == best_total(own, "▁" + text.replace(" ", "▁")) >= total(library.encode(text))


def best_total(own, text):
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if (k := own.id_of.get(text[start:end])) is not None:
                best[end] = max(best[end], best[start] + own.score[k])
    return best[-1]


def test_encode_and_decode_whole_tables(spark):
    texts = awkward() + ODD
    rows = sorted(pieces.encode_texts(documents(spark, texts).withColumnRenamed("lang", "ids")).collect())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for row, text in zip(rows, texts):
        if text is None:
            assert (row.ids, row.n_tokens, row.round_trip) == (None, None, None)
        else:
            assert row.ids == library.encode(text) and row.n_tokens == len(row.ids) and row.round_trip == ("▁" not in text)
    back = {r.doc_id: r.back for r in pieces.decode_ids(pieces.encode_texts(documents(spark, texts[:-1])), into="back").collect()}
    assert [back[i] for i in range(len(texts) - 1)] == texts[:-1]
    assert pieces.encode_texts(documents(spark, [])).count() == 0


def test_histogram_against_brute_force(spark):
    texts = awkward() + [prose(i, i * 7) for i in range(60)] + [prose(1, 7)] * 5
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    lengths = np.array([len(encode(x)) for x in texts if x is not None])
    made = token_counts.length_histogram(token_counts.token_lengths(documents(spark, texts)))
    rows = {r.n_tokens: r for r in made.collect()}
    assert set(rows) == set(lengths.tolist())
    for n, r in rows.items():
        assert r.n_docs == (lengths == n).sum() and r.docs_at_least == (lengths >= n).sum()
        assert r.tokens_at_least == lengths[lengths >= n].sum() and r.docs_at_most == (lengths <= n).sum()
        assert r.truncated_tokens == np.minimum(lengths, n).sum() and r.share_at_most == pytest.approx((lengths <= n).mean())
    for limit in (0, 1, 100, 101, int(lengths.max()), 10**7):
        assert token_counts.truncated_total(made, limit).first()[0] == np.minimum(lengths, limit).sum()
    assert token_counts.quantile(made, 0.5).first()[0] == np.sort(lengths)[-(-len(lengths) // 2) - 1]
    empty = token_counts.length_histogram(token_counts.token_lengths(documents(spark, [])))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5).first()[0] is None
